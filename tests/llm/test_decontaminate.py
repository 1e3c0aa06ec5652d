import hashlib
import random
import re
import tracemalloc

from data import WORDS, documents, empty, rows

from tributary.llm import decontaminate as d

RESULT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def slow(docs, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {(i, tuple(w[k : k + min(window, len(w))])) for i, t in items if t and i is not None for w in [words(t)] if w for k in range(len(w) - min(window, len(w)) + 1)}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(item)
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def bench(spark, docs):
    some = [r.text for r in docs.where("doc_id in (0, 1, 2)").select("text").collect()]
    long = docs.where("doc_id = 15").first().text.split(" ")
    items = [(1, " ".join(some[0].split(" ")[10:40]).upper() + "!"), (2, "wort"), (3, None), (4, "..."), (10, " ".join(some[1].split(" ")[:13])), (11, " ".join(some[1].split(" ")[5:18])), (12, " ".join(long[300:340])), (12, "zwei"), (None, "wort"), (5, f"{WORDS[1]} {WORDS[2]}"), (6, "日本")]
    return spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, n_words int"), items


def test_against_brute_force(spark):
    docs = documents(spark)
    b, items = bench(spark, docs)
    want = slow([(r.doc_id, r.text) for r in docs.collect()], items)
    assert rows(d.contamination(docs, b), *RESULT) == want


def test_blocks_give_the_same(spark):
    docs = documents(spark)
    b, items = bench(spark, docs)
    assert d.blocks(b, block_bytes=60)[0] > 2
    want = slow([(r.doc_id, r.text) for r in docs.collect()], items)
    got = d.contamination(docs, b, block_bytes=60, keep=["source", "key"])
    assert rows(got, *RESULT) == want and {"source", "key"} <= set(got.columns)


def test_empty(spark):
    docs = documents(spark)
    b, _ = bench(spark, docs)
    assert d.contamination(empty(spark), b).count() == 0
    clean = d.contamination(docs, b.limit(0))
    assert clean.count() == docs.count() and clean.where("contaminated or n_hit > 0").count() == 0


def test_flat_tables_against_brute_force():
    """Few words, so blocks, prefixes and windows repeat within and across items; windows of one, two and more words."""
    rng = random.Random(9)
    for window in (1, 2, 3, 13, 300):
        items = [(i, " ".join(rng.choices("ab", k=rng.choice((1, 2, 5, 40))))) for i in range(40)] + [(7, "a b a"), (50, None), (51, " . ")]
        docs = [(i, " ".join(rng.choices("abc", k=rng.randrange(60)))) for i in range(30)] + [(98, items[3][1]), (99, None)]
        searchers = d.compile_items(items, window)
        got = sorted(((i, *d._summary(*d.hits(t, searchers))) for i, t in docs), key=repr)
        assert got == slow(docs, items, window)
    assert d.compile_items([]) == [] and d.hits("a b", []) == (2, [], set())


def test_compiled_size_is_bounded():
    """4 MB of benchmark text with hardly a repeated window stay under ten times their size."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(1 << 40):x}" for _ in range(50_000)]
    items = [(i, " ".join(rng.choices(words, k=200))) for i in range(2_000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    searchers = d.compile_items(items)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(searchers) == 1 and size > 4 << 20 and kept < 10 * size and peak < 25 * size, (size, kept, peak)
    assert d.hits(items[5][1], searchers)[2] == {5}
