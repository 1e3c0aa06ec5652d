from pyspark.sql import functions as F

from tributary.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no";</script></head><body class="ad-free">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <article>x</article> -->
<div class="ad">Buy</div><article><h1>Title &amp; more</h1><p>One <b>bold</b>
 text.<p>Two &lt;tags&gt;&nbsp;here<br>and on.<ul><li>Item<li>Other</ul><aside>Side</aside><form>Name <input></form>
<div class="Cookie-Notice">Accept</div><div id="comments"><p>First!</p></div><p title="a>b">Last</article>
<footer>&copy; x</footer></body></html>"""
WANT = "Title & more\nOne bold text.\nTwo <tags> here and on.\nItem\nOther\nLast"


def test_main_text():
    assert H.main_text(PAGE) == WANT
    assert H.main_text(None) == H.main_text("") == ""
    assert H.main_text("plain  text") == "plain text"
    assert H.main_text("<article><p>cut off <b>he") == "cut off he"
    assert H.main_text("<article><p>cut<foot") == "cut"
    assert H.main_text("<div><p>a</p><nav>m</nav></div>") == "a"
    assert H.main_text("<main><p>a</p></main><p>b</p>") == "a"


def pages(spark):
    rows, k = [], 0
    for host, box in (("a.org", "<article>{}</article>"), ("b.org", '<div class="story">{}</div>'), ("c.org", "<main>{}</main>")):
        for i in range(6):
            words = "".join(f"<p>{host} words of page {i} part {j} are long enough to tell</p>" for j in range(3 + i % 2))
            page = f'<html><body><nav>menu of {host}</nav><div class="top">always the same here</div>{box.format(words)}<div class="tail">the same line</div><footer>f{i}</footer></body></html>'
            rows.append((k, f"https://{host}/{i}", page, "x", 1, "c"))
            k += 1
    rows += [(k, None, PAGE, "x", 1, "c"), (k + 1, "no url", None, "x", 1, "c"), (k + 1, "no url", None, "x", 1, "c"), (None, "https://a.org/9", "", None, None, None), (k + 2, "https://a.org/long", "<article>" + "<p>long text</p>" * 20_000 + "</article>", "x", 1, "c")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, key int, content string")


def test_template_finds_the_slot(spark):
    got = {r.page_id: r for r in H.extract(pages(spark)).collect()}
    for k in range(18):
        lines = got[k].text.split("\n")
        assert len(lines) == 3 + k % 6 % 2 and all("part" in x for x in lines), got[k].text
        assert got[k].n_chars == len(got[k].text)
    assert got[18].text == WANT and got[19].text == "" and got[None].text == ""
    assert got[20].text.count("\n") == 19_999


def test_rows_stay(spark):
    df = pages(spark)
    assert H.extract(df).count() == df.count()
    assert H.extract(df.limit(0)).count() == 0


def test_hosts(spark):
    urls = ["https://User@A.org:80/x?y#z", "http://b.net", "/rel", None, "ftp://c.d/"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(H.host_of(F.col("u"))).collect()
    assert [r[0] for r in got] == ["a.org", "b.net", "", "", "c.d"]
