import hashlib

from data import documents, empty, rows
from pyspark.sql import functions as F

from tributary.llm import line_dedup


def slow(pairs, min_chars=40, min_docs=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    last = {k: max(s, key=lambda i: -1 if i is None else i) for k, s in held.items() if len(s) >= min_docs}
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    docs = documents(spark)
    want = slow([(r.doc_id, r.text) for r in docs.collect()])
    assert any(r[2] for r in want)
    got = line_dedup.deduplicate(docs).withColumn("sha", F.sha2("kept_text", 256))
    assert rows(got, "doc_id", "n_lines", "n_dropped", "sha") == want
    assert set(docs.columns) < set(got.columns)


def test_keep_runs_and_no_python(spark):
    docs = documents(spark)
    out = line_dedup.deduplicate(docs)
    for r in out.where("n_dropped > 0").collect():
        assert sum(k.length for k in r.keep_runs) == r.n_lines - r.n_dropped
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_many_slices_and_limits(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("x" * 40)).otherwise(F.lit("y" * 39)).alias("text"))
    got = {r.doc_id: r.n_dropped for r in line_dedup.deduplicate(docs).collect()}
    assert got == {i: int(i % 3 == 0 and i != 297) for i in range(300)}


def test_empty(spark):
    assert line_dedup.deduplicate(empty(spark)).count() == 0
