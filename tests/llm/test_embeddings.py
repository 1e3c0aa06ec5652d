import numpy as np
import pytest
from data import rows
from pyspark.sql import functions as F

from tributary.llm import embeddings

COLS = ("vec_id", "n_links", "component_id", "kept")


def slow(data, threshold=0.93):
    def sound(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    good = [r for r in data if sound(r)]
    u = [np.array(r[1], np.float64) / np.linalg.norm(np.array(r[1], np.float64)) for r in good]
    near = [[i != j and a[2] == b[2] and len(a[1]) == len(b[1]) and u[i] @ u[j] >= threshold for j, b in enumerate(good)] for i, a in enumerate(good)]
    low = [r[0] for r in good]
    for _ in good:
        low = [min([low[i], *(low[j] for j in range(len(good)) if near[i][j])]) for i in range(len(good))]
    out = [(r[0], sum(near[i]), low[i], r[0] == low[i]) for i, r in enumerate(good)]
    return sorted(out + [(r[0], 0, r[0], r[0] is not None) for r in data if not sound(r)], key=repr)


def data(n=300, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dim))
    v = centres[rng.integers(0, 20, n)] + rng.standard_normal((n, dim)) * 0.25
    out = [(i, [float(np.float32(x)) for x in v[i]], int(i % 3)) for i in range(n)]
    out += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [None, *[1.0] * (dim - 1)], 1), (n + 4, [], 1), (n + 5, out[0][1], None), (None, out[0][1], 0), (n + 6, [float("inf")] * dim, 0)]
    out += [(n + 7, out[4][1], 1), (n + 8, out[4][1], 1), (n + 8, out[4][1], 1), (n + 9, [2 * x for x in out[4][1]], 1), (n + 10, out[4][1][:3], 1), (n + 11, [0.5], 1), (n + 12, [0.25], 1)]
    return out


def frame(spark, some):
    return spark.createDataFrame(some, "vec_id long, embedding array<float>, label int").withColumns({"caps": F.lit(1), "id": F.lit("x"), "v": F.lit(2)})


def test_against_brute_force(spark):
    some = data()
    assert rows(embeddings.near_duplicates(frame(spark, some)), *COLS) == slow(some)


def test_blocks_of_a_dense_cluster(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(1)
    v = rng.standard_normal(32) + rng.standard_normal((120, 32)) * 0.2
    some = [(i, [float(np.float32(x)) for x in r], 0) for i, r in enumerate(v)]
    assert rows(embeddings.near_duplicates(frame(spark, some)), *COLS) == slow(some)


def test_recall_at_the_threshold():
    """Pairs at just the threshold, the hardest: their caps meet."""
    rng = np.random.default_rng(2)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    p = unit(rng.standard_normal((2000, 64)))
    n = rng.standard_normal((2000, 64))
    q = 0.93 * p + np.sqrt(1 - 0.93**2) * unit(n - (n * p).sum(axis=1, keepdims=True) * p)
    for size in (500, 50_000):
        codes = [embeddings.Code(64, *embeddings.design(size, 64), seed) for seed in range(embeddings.CODES)]
        meet = np.zeros(2000, bool)
        for c in codes:
            meet |= [bool(np.intersect1d(a, b).size) for a, b in zip(c.decode(p, embeddings.LEAST), c.decode(q, embeddings.LEAST), strict=True)]
        assert meet.mean() > 0.995


@pytest.mark.parametrize("label", ["string", "int"])
def test_empty(spark, label):
    assert embeddings.near_duplicates(spark.createDataFrame([], f"vec_id long, embedding array<float>, label {label}")).count() == 0


def test_one_id_with_several_vectors(spark):
    """A link is its vector's, not its id's; rows of one id are joined by links alone."""
    x, y, near = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.05, 0.0]
    some = [(1, x, 0), (1, y, 0), (2, near, 0), (3, y, 0), (3, x, 0)]
    got = rows(embeddings.near_duplicates(frame(spark, some)), *COLS)
    assert got == slow(some) and (1, 1, 1, True) in got and (1, 2, 1, True) in got
