import random
import re

import numpy as np
import pytest
from data import documents, empty
from pyspark.sql import functions as F

from tributary.llm import periodic_runs, queries


def slow(s):
    """Runs by looking at each period: stretches of words that are the same a period further on."""
    found = {}
    for q in range(1, len(s) // 4 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in found.items())


def slow_collapse(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def samples(rng, n):
    for _ in range(n):
        out = []
        while len(out) < 60 and rng.random() < 0.9:
            part = [rng.randrange(rng.choice((2, 3, 30))) for _ in range(rng.randrange(1, 7))]
            out += part * rng.choice((1, 1, 2, 4, 5, 9)) + part[: rng.randrange(len(part) + 1)]
        yield out


def test_runs_against_brute_force():
    some = 0
    for s in samples(random.Random(1), 1_500):
        assert periodic_runs.runs_of(s) == slow(s), s
        some += len(slow(s)) > 1
    assert some > 100


def test_all_small_sequences():
    for bits in range(1 << 13):
        s = [bits >> k & 1 for k in range(13)]
        assert periodic_runs.runs_of(s) == slow(s)


def test_no_run_is_lost_by_stretches():
    rng = random.Random(2)
    many = list(samples(rng, 400))
    ends = np.cumsum([len(s) for s in many])
    starts = ends - [len(s) for s in many]
    a, b, of = periodic_runs.stretches(np.array([x for s in many for x in s], np.int32), starts, ends)
    for k, s in enumerate(many):
        inside = [(int(x - starts[k]), int(y - starts[k])) for x, y, o in zip(a, b, of) if o == k]
        assert all(any(x <= i and i + n <= y for x, y in inside) for i, n, _ in slow(s))


def test_long_sets_are_split():
    s = [7] * 3_000 + [1, 2, 3] * 1_000
    assert periodic_runs.runs_of(s) == [(0, 3_000, 1), (3_000, 3_000, 3)]
    ends, rng = periodic_runs.Ends(5_000), random.Random(3)
    have = [5_000]
    for p in rng.sample(range(5_000), 3_000):
        left, right = ends.add(p)
        assert left == max((x for x in have if x < p), default=-1) and right == min((x for x in have if x > p), default=-1)
        have.append(p)
    assert list(ends) == sorted(have) and max(map(len, ends.blocks)) <= periodic_runs.BLOCK


def test_operator(spark):
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame([(90, "x y " * 9 + "z"), (91, "a\x0bb " * 20 + "\n a b c"), (92, "é  é é é é\té")], "doc_id long, text string"))
    got = periodic_runs.collapse(docs.withColumn("words", periodic_runs.words(F.col("text"))), "words", ["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        words = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        want = slow(words) if len(words) < 2_000 else []
        assert [(x.start, x.length, x.period) for x in r.runs] == want and r.n_words == len(words)
        assert r.collapsed == slow_collapse(words, want)
    assert sum(bool(r.runs) for r in got) >= 3


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, ["a"] * 8, 5), (1, ["a"] * 8, 5), (None, None, 6), (3, [], 7), (4, ["a", None] * 4, 8)], "id long, w array<string>, runs int")
    got = sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.collapse(odd, "w", ["id", "RUNS"]).collect()), key=repr)
    assert got == sorted([(1, 8, [(0, 8, 1)], "a")] * 2 + [(None, 0, [], ""), (3, 0, [], ""), (4, 8, [(0, 8, 2)], "a ")], key=repr)
    assert periodic_runs.collapse(empty(spark).withColumn("w", periodic_runs.words(F.col("text"))), "w", ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.collapse(odd, "w", ["id"], min_periods=2)


def test_query_on_texts_without_words(spark, tmp_path):
    texts = [None, "", " \t\n", "a", "a b " * 20, "x y z"]
    spark.createDataFrame([(k, texts[k % len(texts)]) for k in range(120)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    db = pytest.importorskip("duckdb").connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(periodic_runs.ORACLE).fetchall())
    assert got.where("n_runs = 0 AND start IS NULL").count() >= 60
