import random
import time
from itertools import combinations, pairwise

from pyspark.sql import functions as F

from tributary.llm import html_extract as H


def site(n=9, seed=1):
    """Pages whose tags and class names tell nothing: boilerplate, a heading, text, remarks of others, some parts on some pages only."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        text = "".join(f"<p>words of page {i} part {j} {'and more ' * 8}</p>" for j in range(4 + i % 3))
        extra = f'<div class="xa"><i class="xb">extra {i}</i></div>' if i % 3 else ""
        moved = f'<div class="mv">moved {i}</div>'
        before, after = (moved, "") if i % 2 else ("", moved)
        more = "".join(f'<div class="u"><b>Someone</b> says {rng.random()}</div>' for _ in range(1 + i % 3))
        rows.append((i, f"https://s.org/{i}", f'<html><body><div class="a">always the same here</div><div class="b"><h1>Heading of page {i}</h1></div><div class="q">{before}<div class="c">{text}</div>{after}{extra}</div><div class="d">{more}</div><div class="e">Day {i}</div></body></html>'))
    return rows


def counted(spark, rows):
    df = spark.createDataFrame(rows, "key long, url string, html string").select(F.lit("s.org").alias("host"), "key", "html", F.array().cast("array<string>").alias("ids"))
    return df.mapInArrow(H._counts, "host string, key long, tag string, run long, path string, times int, at int, chars long")


def slow_classes(rows, support=0.5):
    """Valid classes from whole occurrence vectors."""
    pages = [{t: v for (t, n), v in H._counted(page).items() if n == 0} for _, _, page in rows]
    tags = {t for p in pages for t, (k, _) in p.items() if k == 1}
    vectors = {}
    for t in tags:
        vectors.setdefault(tuple(t in p and p[t][0] == 1 for p in pages), []).append(t)
    large = {v: ts for v, ts in vectors.items() if sum(v) >= support * len(pages)}
    top = max(large, key=lambda v: (sum(v), len(large[v])))
    moved = set()
    for v, ts in large.items():
        on = [p for p, has in zip(pages, v, strict=True) if has]
        mean = {t: (sum(p[t][1] for p in on) / len(on), t) for t in ts}
        for p in on:
            order = sorted(ts, key=lambda t: (p[t][1], t))
            for k in range(len(order), 0, -1):
                rising = [c for c in combinations(order, k) if all(mean[a] < mean[b] for a, b in pairwise(c))]
                if rising:
                    moved |= set(order) - set(min(rising, key=lambda c: [mean[t] for t in reversed(c)]))
                    break
    good = {}
    for v, ts in large.items():
        on = [p for p, has in zip(pages, v, strict=True) if has]
        for t in set(ts) - moved:
            slots = {max(((p[a][1], a) for a in large[top] if a not in moved and a in p and p[a][0] == 1 and p[a][1] < p[t][1]), default=(0, ""))[1] for p in on}
            if v == top or len(slots) == 1:
                good.setdefault(v, []).append(t)
    return sorted((sum(v), sorted(ts)) for v, ts in good.items())


def test_classes_are_those_of_whole_vectors(spark):
    for seed, n in ((1, 9), (2, 12), (3, 4)):
        rows = site(n, seed)
        sizes = spark.createDataFrame([("s.org", n)], "host string, pages long")
        got = H.classes(counted(spark, rows), sizes).groupBy("class", "n").agg(F.sort_array(F.collect_list("tag")).alias("tags")).collect()
        want = slow_classes(rows)
        assert sorted((r.n, r.tags) for r in got) == want
        assert not any("mv" in t for _, ts in want for t in ts)  # what moves is no template
        assert n == 4 or any(k < n for k, _ in want)


def test_the_template_decides_without_names(spark):
    rows = site()
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, page in rows:
        want = [f"Heading of page {i}"] + [f"words of page {i} part {j} {'and more ' * 8}".strip() for j in range(4 + i % 3)]
        assert got[i].split("\n") == want
        assert H.main_text(page) != got[i]  # no names to go by: without the template it is the whole page


def test_names(spark):
    assert H.main_text('<article class="comment">Reader says</article><article>Main</article>') == "Main"
    assert H.main_text('<body><div class="social-science"><p>Long</p></div><div class="article-header"><h1>T</h1></div></body>') == "Long\nT"
    assert H.main_text('<body><div class="social-links">Long</div><div class="cookie-notice">T</div><p>x</p></body>') == "x"


def test_hostile_pages_take_linear_time():
    for page in ('<a "' * 40_000, '<a "' * 40_000 + ">", "<" * 200_000, "<a b='" * 40_000, "<b>" * 5_000 + "<td>x" * 5_000, "<div>" * 20_000 + "<p>x" * 5_000, "<p>" * 50_000, "</p>" * 50_000):
        began = time.perf_counter()
        H.main_text(page)
        assert time.perf_counter() - began < 4, page[:8]
    deep = "<div>" * 3000 + "<p>in</p>" + "</div>" * 3000 + "<p>after</p>"
    assert H.main_text(deep) == "in\nafter"


def test_pages_that_repeat(spark):
    """Rows twice over, in another file as it were, have the same template as once, and the same texts."""
    rows = site()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    once, twice = (sorted(map(tuple, H.extract(p).select("page_id", "text").distinct().collect())) for p in (pages, pages.unionByName(pages)))
    assert once == twice and len(once) == len(rows)
    keyed = pages.select(F.lit("s.org").alias("host"), F.col("page_id").alias("key"), "html")
    found = [sorted((r.host, r.content, r.heading) for r in H.templates(p).collect()) for p in (keyed, keyed.unionByName(keyed))]
    assert found[0] == found[1] and found[0][0][1]


def test_a_fourth_class_word_tells_elements_apart():
    paths = [x[1].path for x in H._parsed('<p class="a b c d">x</p><p class="a b c e">y</p><p class="b a c d">z</p>', None) if x[0] == "open"]
    assert len(paths) == 3 and paths[0] == paths[2] != paths[1]


NAMES = ("menu-planning", "comment-on-the-law", "advert-history", "subscription-economics", "promo-code-fraud", "sponsor-letters", "nav-history", "share-price", "related-work", "widget-design", "notice-period", "social-science")


def test_article_text_stays_whatever_its_names():
    for name in NAMES:
        assert H.main_text(f'<article><p>First</p><section class="{name}"><p>Real part</p></section></article>') == "First\nReal part", name
        assert H.main_text(f'<main><p>First</p><div id="{name}">Real part</div></main>') == "First\nReal part", name
        assert H.main_text(f'<article class="{name}"><p>First</p></article><div class="sidebar">x</div>') == "First", name
    for name in ("ad", "ads mid", "ad-slot-inline", "comments", "user-comments", "comment-list", "comment-author", "share-buttons", "newsletter-signup", "related-posts", "menu", "cookie-notice", "promo-box", "sidebar", "sponsored-links", "adSlot"):
        assert H.main_text(f'<article><p>First</p><section class="{name}"><p>No part</p></section></article>') == "First", name


def test_a_deduced_slot_is_like_an_article():
    page = '<body><div class="top">x</div><div class="b"><p>First</p><div class="menu-planning">Real part</div><div class="ad">No</div></div></body>'
    slot = ">body>div.b"
    assert H.main_text(page, slot) == "First\nReal part"
    assert H.main_text('<body><div class="menu-planning">Far</div><p>Text</p></body>') == "Text"  # outside of any, words of layout still count
