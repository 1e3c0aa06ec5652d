from tributary.llm import html_extract as H


def texts(spark, box, n=8):
    """Texts of a host's pages, in order; box(i, paragraphs) is what the i-th has between its boilerplate."""
    rows = []
    for i in range(n):
        words = "".join(f"<p>words of page {i} part {j} are long enough</p>" for j in range(3 + i % 2))
        rows.append((i, f"https://h.org/{i}", f'<html><body><nav>menu</nav><div class="top">always the same here</div>{box(i, words)}<div class="date">Day {i} of the year</div><div class="tail">the same line</div></body></html>'))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r.text.split("\n") for r in sorted(H.extract(df).collect())]


def parts(i):
    return [f"words of page {i} part {j} are long enough" for j in range(3 + i % 2)]


def test_ids_of_pages(spark):
    for box in (lambda i, w: f'<article id="post-{i}">{w}</article>', lambda i, w: f'<article id="{"abcdefgh"[i] * 5}" class="post-{i} post">{w}</article>'):
        assert texts(spark, box) == [parts(i) for i in range(8)]


def test_one_listing(spark):
    got = texts(spark, lambda i, w: f"<article>{w}</article>" * (2 if i == 3 else 1))
    assert got == [parts(i) * (2 if i == 3 else 1) for i in range(8)]


def test_boilerplate_of_whole_pages(spark):
    got = texts(spark, lambda i, w: f"<div>{w}</div><div>{i} more</div>")
    assert all("always the same here" not in g and "the same line" not in g and g[: len(parts(i))] == parts(i) for i, g in enumerate(got))
