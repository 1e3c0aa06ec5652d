"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: tags, each with its path from the root, and
runs of text between them. For every host, tags that the same pages have exactly
once form an equivalence class: they share an occurrence vector. Vectors aren't
gathered: of each tag a partial aggregate keeps the number of its pages and the
exclusive or of their hashes, which are equal for equal vectors, so a host with
a third of all pages is no hot group.

Classes that enough pages have are made valid: ordered (tags that change places
against the others of their class leave it) and nested (so do tags that aren't in
the same slot of the host's largest class on all pages). They are the template; ids and
numbered classes that few pages share aren't part of paths. What lies inside a
template tag is its slot. The article's slot is the innermost one with most
of the host's own text, as opposed to text runs that the template itself
repeats; names of tags and classes have no part in that. An article or main
element of the template around it widens the slot, and the page's heading is a
slot of its own. A page's own article in a slot that is the whole page is taken
out of it, and from a whole page without one the template's runs are dropped.

From these slots come the blocks of text; menus, headers, footers, sidebars,
notices, adverts, forms and comments of readers inside or around it are dropped
by their tags and by the words in their class, id and role.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from itertools import chain
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm._text import ddl, kept, row_batch, slices
from tributary.scratch import cut

#: A class of tokens belongs to the template if this part of the host's pages have it, and so many pages at least.
SUPPORT, MIN_PAGES = 0.5, 3
#: The article's slot is the innermost that has this part of the text of the slot with the most.
MOST = 0.5
#: An id, or a class word with digits, tells elements apart if this part of the host's pages have it, and two at least.
SHARED = 0.05

# Element names of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES_P = BLOCK - {"body", "caption", "dd", "dt", "frameset", "head", "html", "legend", "li", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# What isn't the article, by element, by role, and by the words of class and id.
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "select", "input", "label", "fieldset", "dialog", "menu", "head", "svg", "canvas", "object", "audio", "video", "map", "search"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "note"}
NOISE = {"ad", "ads", "adv", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "promotion", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "widgets"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)""", re.S)
_STOP = re.compile(r"""[>"']""")
#: Elements nested deeper are taken as parts of the one at this depth, as browsers do.
DEPTH = 512
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_DIGIT = re.compile("[0-9]")
_BROKEN = re.compile(r"<[a-zA-Z/!][^<>]*\Z")


#: Layout parts that wrappers around an article are named after too (no-sidebar, header-fixed), and what else such names have.
LAYOUT = {"ad", "ads", "banner", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "sidebar", "toolbar", "widget", "widgets"}
WRAPS = {"body", "container", "content", "fixed", "free", "has", "have", "hidden", "layout", "no", "not", "page", "sticky", "with", "without", "wrap", "wrapper"}
#: Noise only by themselves or beside each other, noise or these words of page layout; and whose words an article element may be.
VAGUE = {"banner", "header", "notice", "notices", "promotion", "related", "reply", "share", "social", "widget"}
UI = {"area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "col", "container", "content", "fixed", "float", "global", "has", "icons", "inner", "item", "items", "layout", "left", "legal", "links", "list", "main", "media", "no", "not", "outer", "page", "panel", "posts", "right", "row", "section", "site", "sticky", "text", "top", "wrap", "wrapper"}
#: What else the names of such parts have inside an article, beside UI and WRAPS; a name with any other word (menu-planning) is of the article's own text.
PARTS = {"after", "author", "before", "by", "card", "cards", "code", "count", "desktop", "email", "embed", "end", "entry", "feed", "form", "google", "grid", "group", "heading", "icon", "in", "inline", "js", "label", "latest", "leaderboard", "link", "message", "meta", "mid", "mobile", "more", "mpu", "new", "post", "primary", "rail", "reader", "readers", "recent", "secondary", "single", "slot", "stories", "strip", "thread", "threads", "tile", "title", "tools", "unit", "user", "users"}
READERS = {"comment", "comments", "disqus", "replies", "reply", "respond"}
#: Why an element is kept out: by its tag, state or role; by class and id; by these, but named like a layout; and likely a wrapper.
KEPT, HARD, SOFT, MIXED, WRAPPER = range(5)


class Node:
    """An element: its path, that of the nearest block around it, its parent, why it would be kept out by itself, whether it is, and whether its children are within an article."""

    __slots__ = ("name", "path", "block", "parent", "noise", "out", "within")

    def __init__(self, name: str, path: str, parent: Node | None, noise: int):
        self.name, self.path, self.parent, self.noise = name, path, parent, noise
        self.block = path if parent is None or name in BLOCK or name in RAW else parent.block
        self.out = bool(noise) or (parent is not None and parent.out)
        self.within = (name in ("article", "main") and not noise) or (parent is not None and parent.within)


def _tag_end(page: str, at: int) -> int:
    """Where the tag that has its name before at ends; a quote that nothing closes is none. -1 if nothing ends it."""
    while (m := _STOP.search(page, at)) is not None:
        if m[0] == ">":
            return m.start()
        closed = page.find(m[0], m.end())
        if closed < 0:
            return page.find(">", m.end())
        at = closed + 1
    return -1


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def _of_layout(group: set[str]) -> bool:
    """Whether the words of one class or id all are such as name parts of pages."""
    return not group - NOISE - UI - WRAPS - PARTS


def _noise(name: str, attributes: dict[str, str], within: bool = False) -> int:
    """Why an element would be kept out by itself; within an article (or the deduced slot), names count only if all of their words are of layout."""
    if (name in DROPPED and name != "form") or "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in ROLES:
        return HARD
    if name in ("html", "body"):
        return KEPT
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if not names.strip():
        return WRAPPER if name == "form" else KEPT
    groups = [{w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", n).lower()) if w} for n in names.split()]
    if name in ("article", "main"):
        return SOFT if any(g & READERS and _of_layout(g) for g in groups) else KEPT
    if within:
        groups = [g for g in groups if _of_layout(g)]
    # Words that mean something else beside others (social-science, article-header) count by themselves or with words of layout.
    groups = [g - VAGUE if g - VAGUE - NOISE - UI else g for g in groups]
    words = set().union(*groups)
    noise = words & NOISE
    if not noise:
        return WRAPPER if name == "form" else KEPT
    if not noise <= LAYOUT or noise == words:
        return SOFT
    return WRAPPER if words & WRAPS else MIXED


def _above(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def _lift(found: list[tuple[str, Node, str]]) -> None:
    """Wrappers of the article are no noise, whatever they are called.

    Where all articles of a page are below noisy classes or forms, that with the
    most text is kept (main first), where its wrappers are named like a layout.
    In a page without any, a wrapper is one that holds over half of the text.
    """
    if not any(kind == "open" and node.noise > HARD for kind, node, _ in found):
        return
    kept, articles, groups = 0, {}, {}
    for kind, node, text in found:
        size = len(text.strip()) if kind == "text" else 0
        if not size:
            continue
        if not node.out:
            if any(a.name in ("article", "main") for a in _above(node)):
                return
            kept += size
            continue
        noisy = [a for a in _above(node) if a.noise]
        if any(a.noise == HARD for a in noisy):
            continue
        inner = next(a for a in _above(node) if a.noise or a.name in ("article", "main"))
        if not inner.noise and (inner.name == "main" or all(a.noise >= MIXED for a in noisy)):
            articles[inner] = articles.get(inner, 0) + size
        if all(a.noise == WRAPPER for a in noisy):
            groups[tuple(noisy)] = groups.get(tuple(noisy), 0) + size
    lifted: set = set()
    if articles:
        lifted = set(_above(max(articles, key=lambda a: (a.name == "main", articles[a]))))
    elif groups:
        fewest = min(map(len, groups))
        best = max((g for g in groups if len(g) == fewest), key=groups.get)
        lifted = set(best) if groups[best] > kept else set()
    for kind, node, _ in found if lifted else ():
        if kind == "open":
            node.noise = KEPT if node in lifted else node.noise
            node.out = bool(node.noise) or node.parent.out


def tokens(page: str, ids: list[str] | None = None, slot: str | None = None):
    """(kind, node, text) of each token in page order.

    kind: open, close or text. The node's path names the element from the root,
    with class and id; out says that the place is one that the article never
    has. With ids, paths have only these of the ids and of the class words with digits.
    slot is the path of a deduced slot, which is as an article to what is in it.
    """
    found = list(_parsed(page, None if ids is None else set(ids), slot))
    _lift(found)
    return found


def _parsed(page: str, ids: set | None, slot: str | None = None):
    """(kind, node, text) of each token, before any wrapper is lifted."""
    stack = [Node("", "", None, KEPT)]
    at, raw_until, deep = 0, "", Counter()

    def pop(k):
        out = []
        while len(stack) > k:
            node = stack.pop()
            out.append(("close", node, ""))
        return out

    page = _BROKEN.sub("", page)
    while at < len(page):
        if raw_until:  # only the element's own end tag ends it
            m = re.compile(f"</{re.escape(raw_until)}\\s*>", re.I).search(page, at)
            raw_until, at = "", m.end() if m else len(page)
            yield from pop(len(stack) - 1)
            continue
        m, end = _TOKEN.search(page, at), 0
        if m is not None and m[2] is not None and (end := _tag_end(page, m.end())) < 0:
            m = None
        if m is None or m.start() > at:
            yield "text", stack[-1], page[at : m.start() if m else len(page)]
        if m is None:
            break
        at = m.end() if m[2] is None else end + 1
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if deep[name]:
                deep[name] -= 1
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    yield from pop(k)
                    break
                if name not in BLOCK and stack[k].name in BLOCK:
                    break
            continue
        attributes = _attributes(page[m.end() : end])
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    yield from pop(k)
                    break
                if stack[k].name in BLOCK:
                    break
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in SELF_CLOSING.get(name, ()):
                yield from pop(k)
                break
            if stack[k].name in BLOCK:
                break
        named = [w for w in attributes.get("class", "").split() if ids is None or w in ids or not _DIGIT.search(w)]
        own = attributes.get("id", "").strip()
        named.sort()
        mark = "".join(f".{w}" for w in named[:3]) + (f"~{crc32(' '.join(named).encode('utf-8', 'replace')):08x}" if len(named) > 3 else "") + (f"#{own}" if own and (ids is None or own in ids) else "")
        node = Node(name, f"{stack[-1].path}>{name}{mark}", stack[-1], _noise(name, attributes, stack[-1].within))
        node.within = node.within or (slot is not None and node.path == slot)
        yield "open", node, name
        if name in VOID:
            continue
        if name in RAW:
            raw_until = name
        elif len(stack) > DEPTH:
            deep[name] += 1
            yield "close", node, ""
            continue
        stack.append(node)
    yield from pop(1)


def blocks(page: str, found=None) -> list[tuple[str, str, bool]]:
    """(path of the nearest enclosing block, text, out) in page order; text decoded, white space single, not empty."""
    out: list[tuple[str, str, bool]] = []
    parts: list[str] = []
    where, skip = "", False

    def flush():
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((where, text, skip))

    for kind, node, text in tokens(page) if found is None else found:
        if kind == "text":
            if node.block != where or node.out != skip:
                flush()
                where, skip = node.block, node.out
            parts.append(text)
        elif node.name in BLOCK:
            flush()
        elif node.name in VOID:
            parts.append(" ")
    flush()
    return out


def host_of(url: Column) -> Column:
    """The url's host in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _counted(page: str, ids: list[str] | None = None) -> dict[tuple[str, int], list[int]]:
    """{token: [occurrences, first position]}: paths of blocks that open, with 0, and text runs, each with its length."""
    found: dict[tuple[str, int], list[int]] = {}
    parsed = tokens(page, ids)
    opened = (((node.path, 0), at) for at, (kind, node, _) in enumerate(parsed) if kind == "open" and not node.out)
    runs = (((f"{path}\0{text}", len(text)), 0) for path, text, noise in blocks(page, parsed) if not noise)
    for token, at in chain(opened, runs):
        found.setdefault(token, [0, at])[0] += 1
    return found


def _counts(batches):
    names = (("host", pa.string()), ("key", pa.int64()), ("tag", pa.string()), ("run", pa.int64()), ("path", pa.string()), ("times", pa.int32()), ("at", pa.int32()), ("chars", pa.int64()))
    for whole in batches:
        for b in slices(whole, "html"):
            rows = []
            for host, key, page, ids in zip(b["host"].to_pylist(), b["key"].to_pylist(), b["html"].to_pylist(), b["ids"].to_pylist(), strict=True):
                found = _counted(page or "", ids)
                rows += [(host, key, None if n else t, hash_text(t) if n else None, t.partition("\0")[0], k, at, n) for (t, n), (k, at) in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(names)], names=[n for n, _ in names])


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def shared_ids(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, ids): ids, and class words with digits, that enough pages of the host share; one row for each host with min_pages."""
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    values = F.regexp_extract_all("html", F.lit(r"""(?i)\sid\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), F.lit(1))
    named = F.regexp_extract_all("html", F.lit(r"""(?i)\sclass\s*=\s*("[^"]*[0-9][^"]*"|'[^']*[0-9][^']*'|[^\s>"']*[0-9][^\s>"']*)"""), F.lit(1))
    bare = lambda x: F.btrim(x, F.lit("\"' \t\n\r\f"))
    words = F.filter(F.flatten(F.transform(named, lambda x: F.split(bare(x), r"\s+"))), lambda w: w.rlike("[0-9]"))
    found = pages.select("host", F.explode(F.array_distinct(F.concat(F.transform(values, bare), words))).alias("id"))
    counts = found.groupBy("host", "id").agg(F.count("*").alias("n")).join(sizes, "host").where(F.col("n") >= F.greatest(F.lit(2), F.lit(SHARED) * F.col("pages")))
    ids = counts.groupBy("host").agg(F.collect_list("id").alias("ids"))
    return sizes.select("host").join(ids, "host", "left").select("host", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def classes(counted: DataFrame, sizes: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(host, tag, class, n): tags of the valid equivalence classes of each host, and on how many pages they are.

    counted has host, key, tag, times and at (position in its page) of the
    pages' tags, sizes has host and pages. Pages that have a tag several times
    don't count for it. Tags of a class are on the same n pages.
    """
    once = counted.where("tag is not null and times = 1")
    # Sums and not xors, which rows that repeat would cancel; halves of two hashes, so that sums of 2^31 pages fit.
    part = lambda seed: F.sum(F.xxhash64("key", F.lit(seed)).bitwiseAND(0xFFFFFFFF))
    tags = once.groupBy("host", "tag").agg(F.count("*").alias("n"), part(1).alias("one"), part(2).alias("two"))
    tags = tags.select("host", "tag", "n", F.xxhash64("n", "one", "two").alias("class"))
    large = cut(tags.join(sizes, "host").where(F.col("n") >= support * F.col("pages")).select("host", "tag", "class", "n"), "classes")
    seen = once.select("host", "key", "tag", "at").join(large, ["host", "tag"])
    # Ordered: tags that change places in their class, against its mean order, leave it.
    sequence = seen.groupBy("host", "class", "key").agg(F.xxhash64(F.sort_array(F.collect_set(F.struct("at", "tag")))["tag"]).alias("order"))
    mixed = sequence.groupBy("host", "class").agg((F.min("order") != F.max("order")).alias("mixed")).where("mixed").select("host", "class")
    loose = cut(seen.join(mixed, ["host", "class"]), "loose")
    mean = loose.groupBy("host", "tag").agg(F.avg("at").alias("mean"))
    orders = loose.join(mean, ["host", "tag"]).groupBy("host", "class", "key").agg(F.sort_array(F.collect_set(F.struct("at", "tag", "mean"))).alias("tags"))
    movers = orders.select("host", F.explode(F.pandas_udf(_movers, "array<string>")(F.transform("tags", lambda t: F.struct(t["mean"].alias("mean"), t["tag"].alias("tag"))))).alias("tag")).distinct()
    seen = cut(seen.join(movers, ["host", "tag"], "left_anti"), "ordered")
    # Nested: on all pages the same tag of the host's largest class comes before.
    top = large.groupBy("host", "class", "n").agg(F.count("*").alias("tags")).groupBy("host").agg(F.max_by("class", F.struct("n", "tags", "class")).alias("top"))
    page = Window.partitionBy("host", "key").orderBy("at", "tag").rowsBetween(Window.unboundedPreceding, -1)
    slot = F.coalesce(F.last(F.when(F.col("class") == F.col("top"), F.col("tag")), ignorenulls=True).over(page), F.lit(""))
    placed = seen.join(top, "host").withColumn("slot", slot).where(F.col("class") != F.col("top"))
    bad = placed.groupBy("host", "tag").agg((F.min("slot") != F.max("slot")).alias("bad")).where("bad").select("host", "tag").unionByName(movers)
    return large.join(bad, ["host", "tag"], "left_anti")


def _movers(pages: pd.Series) -> pd.Series:
    """Of tags in a page's order, with their mean positions, those outside the longest stretch that is in the mean order too."""
    out = []
    for tags in pages:
        ranks = [(t["mean"], t["tag"]) for t in tags]
        tails: list[tuple] = []
        ends: list[int] = []
        before = []
        for i, r in enumerate(ranks):
            k = bisect_left(tails, r)
            before.append(ends[k - 1] if k else -1)
            tails[k : k + 1], ends[k : k + 1] = [r], [i]
        kept, i = set(), ends[-1]
        while i >= 0:
            kept.add(i)
            i = before[i]
        out.append([r[1] for i, r in enumerate(ranks) if i not in kept])
    return pd.Series(out)


def templates(pages: DataFrame, support: float = SUPPORT, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, content, heading, runs, ids): paths of the article's slot and of the heading, text runs of the template if the slot is the whole page, and ids of paths.

    pages has host, key (of the page) and html. Hosts with fewer than min_pages
    pages have no template and no row.
    """
    ids = cut(shared_ids(pages, min_pages), "ids")
    counted = cut(pages.join(ids, "host").mapInArrow(_counts, "host string, key long, tag string, run long, path string, times int, at int, chars long"), "tokens")
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    valid = cut(classes(counted, sizes, support).select("host", F.col("tag").alias("slot")), "template")
    # Text of its own in the slot of each valid tag: runs that the template's pages don't share.
    runs = counted.where("run is not null and path != ''").groupBy("host", "path", "run").agg(F.count("*").alias("support"), F.max("chars").alias("chars")).join(sizes, "host")
    frequent = F.col("support") >= F.greatest(F.lit(2), support * F.col("pages"))
    own = runs.where(~frequent).groupBy("host", "path").agg(F.sum(F.col("chars") * F.col("support")).alias("chars"))
    # A slot holds its own text and that of the paths below: each path gives its text to all of its ancestors.
    above = own.select("host", "chars", F.explode(F.transform(F.sequence(F.lit(2), F.size(F.split("path", ">"))), lambda k: F.array_join(F.slice(F.split(F.col("path"), ">"), 1, k), ">"))).alias("slot"))
    held = cut(above.groupBy("host", "slot").agg(F.sum("chars").alias("chars")).join(valid, ["host", "slot"]), "held")
    most = held.groupBy("host").agg(F.max("chars").alias("most"))
    inner = held.join(most, "host").where(F.col("chars") > F.col("most") * MOST).groupBy("host").agg(F.max_by("slot", F.struct(F.length("slot"), "chars", "slot")).alias("inner"))
    # An article or main element of the template that the slot is in, and the heading nearest to the slot.
    around = valid.join(inner, "host").where(F.startswith(F.concat("inner", F.lit(">")), F.concat("slot", F.lit(">"))))
    named = F.regexp_extract("slot", r">(article|main)(?:[.#][^>]*)?$", 1)
    wide = around.where(named != "").groupBy("host").agg(F.max_by("slot", F.struct((named == "article").cast("int"), -F.length("slot"), "slot")).alias("wide"))
    titles = held.where(F.col("slot").rlike(r">h1(?:[.#][^>]*)?$")).groupBy("host").agg(F.max_by("slot", F.struct("chars", "slot")).alias("heading"))
    best = inner.join(wide, "host", "left").join(titles, "host", "left").select("host", F.coalesce("wide", "inner").alias("content"), "heading")
    whole = best.where(F.col("content").rlike(_WHOLE)).select("host")
    repeated = runs.where(frequent).join(whole, "host", "left_semi").groupBy("host").agg(F.collect_list("run").alias("runs"))
    out = ids.join(best, "host", "left").join(repeated, "host", "left").select("host", "content", "heading", "runs", "ids")
    return out


#: Paths of html and body, whose slot is the whole page.
_WHOLE = r"^(>html(?:[.#][^>]*)?)?(>body(?:[.#][^>]*)?)?$"


def main_text(page: str | None, content: str | None = None, heading: str | None = None, runs: list[int] | None = None, ids: list[str] | None = None) -> str:
    """The article of one page: the blocks in the article's slot and in the heading's, joined by line ends.

    content and heading are paths of the host's slots, if a template was deduced,
    with ids in its paths, and runs are text runs of the template. A page's own
    article or main inside the slot is taken if the slot is the whole page, or if
    it has half of the slot's text; a whole page without one loses the runs.
    A page that has no such slot falls back to its own article or main element, and
    then to all of its blocks that aren't kept out.
    """
    narrow = content if content and not re.search(_WHOLE, content) else None
    found = [b for b in blocks(page or "", tokens(page or "", ids, narrow)) if not b[2]]
    slot = []
    if content:
        inside_of = lambda path, slot: path == slot or path.startswith(slot + ">")
        slot = [b for b in found if inside_of(b[0], content)]
        if slot and heading:
            slot = [b for b in found if inside_of(b[0], content) or inside_of(b[0], heading)]
    inside = [name for name in ("article", "main") if re.search(f">{name}(?=[.#>]|$)", content or "")]
    if slot and not inside:
        whole = re.search(_WHOLE, content)
        for name in ("article", "main"):
            own = [b for b in slot if re.search(f">{name}(?=[.#>]|$)", b[0])]
            if own and (whole or 2 * sum(len(b[1]) for b in own) >= sum(len(b[1]) for b in slot)):
                slot = own
                break
        else:
            if whole and runs:
                known = set(runs)
                slot = [b for b in slot if hash_text(f"{b[0]}\0{b[1]}") not in known] or slot
    for name in ("article", "main"):
        if not slot:
            slot = [b for b in found if re.search(f">{name}(?=[.#>]|$)", b[0])]
    return "\n".join(text for _, text, _ in slot or found)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per row of pages: id, url, the columns in keep, text and n_chars (code points).

    Null and empty html give an empty text. Pages without a host (null urls too)
    are a host of their own. Rows that repeat are pages like others. Other
    columns are ignored, and so are columns to keep that are named like a result;
    an empty table gives no rows.
    """
    out = kept(id_col, [url_col, *(keep or [])], ("text", "n_chars"))
    rows = pages.select(*dict.fromkeys([*out, html_col]))
    plain = rows.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(id_col, url_col).alias("key"), F.col(html_col).alias("html"))
    found = cut(templates(plain), "templates")
    joined = rows.withColumn("__host", host_of(F.col(url_col))).join(found.select(*[F.col(c).alias(f"__{c}") for c in found.columns]), "__host", "left")

    def run(batches):
        for whole in batches:
            for b in slices(whole, html_col):
                texts = [main_text(*r) for r in zip(*[b[c].to_pylist() for c in (html_col, "__content", "__heading", "__runs", "__ids")], strict=True)]
                yield row_batch(b, out, {"text": (texts, pa.string()), "n_chars": ([len(t) for t in texts], pa.int64())})

    return joined.mapInArrow(run, f"{ddl(rows, out)}, text string, n_chars long")
