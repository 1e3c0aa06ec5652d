"""Embedding near-duplicates by spherical-cap filters.

Vectors link when their labels are equal and their cosine is at least a
threshold. Filters are unit directions in a structured random product code: the
space is rotated and cut into ``BLOCKS`` parts, each part has its own small code
of random unit vectors, and a filter is one code word from each part. A vector
belongs to every filter whose inner product with it exceeds alpha (a cap);
these are list-decoded part by part, with the best that the remaining parts
can still add as a bound, and never by trying every filter. Pairs that share
a filter are verified with double precision.

alpha and the number of filters follow from the number of vectors under the most
frequent label: a random vector falls in a cap with probability p, set so
that a cap holds about ``CAP`` of them, and there are enough filters for
``LIST`` caps a vector. That is done with ``CODES`` rotations; a vector that few
caps of a code reach gets the best ones, ``LEAST`` at least. Two vectors at the
threshold share over half of their caps; README.md has the recall measured.

Equal vectors under a label are one class with a count. The members of a cap
are compared in blocks by matrix products; a link counts in the smallest cap that
both vectors belong to, so nothing emits pairs: each block gives link counts
of its members and a spanning forest. Caps of over ``BLOCK`` members (a dense
cluster) are dealt to several tasks as pairs of blocks, none is cut off.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm._text import row_batch
from tributary.operators.components import connected_components
from tributary.scratch import cut

THRESHOLD = 0.93
BLOCKS, CODES, CAP, LIST, LEAST = 4, 3, 48, 6, 4
BLOCK = 2048


class Code:
    """The product code for one dimension: rotation, code words of each part, and decoding."""

    def __init__(self, dim: int, words: int, alpha: float, seed: int = 20):
        rng = np.random.default_rng([seed, dim])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.parts = np.array_split(np.arange(dim), min(BLOCKS, dim))
        self.codes = []
        for part in self.parts:
            c = rng.standard_normal((words, len(part)))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        self.words, self.bound = words, alpha * math.sqrt(len(self.parts))

    def decode(self, unit: np.ndarray, least: int = 1) -> list[np.ndarray]:
        """The filters whose cap each row of unit vectors is in. Where these are too few, alpha is lowered for that row."""
        turned = unit @ self.rotation
        scores = [turned[:, part] @ code.T for part, code in zip(self.parts, self.codes, strict=True)]
        after = np.zeros((len(scores) + 1, len(unit)))
        for k in range(len(scores) - 1, -1, -1):
            after[k] = after[k + 1] + scores[k].max(axis=1)
        out: list = [None] * len(unit)
        bound, rows, most = np.minimum(self.bound, after[0]), np.arange(len(unit)), min(least, self.words ** len(scores))
        while len(rows):
            row, word, total = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.zeros(len(rows))
            for k, s in enumerate(scores):
                sums = total[:, None] + s[rows[row]]
                i, j = np.nonzero(sums + after[k + 1][rows[row]][:, None] >= bound[rows[row]][:, None] - 1e-12)
                row, word, total = row[i], word[i] * self.words + j, sums[i, j]
            counts = np.bincount(row, minlength=len(rows))
            order = np.lexsort((word, row))
            for r, found in zip(rows.tolist(), np.split(word[order], np.cumsum(counts)[:-1]), strict=True):
                out[r] = found
            rows = rows[counts < most]
            bound[rows] -= 0.04
        return out


def design(n: int, dim: int, cap: int = CAP, size: int = LIST) -> tuple[int, float]:
    """Code words a part and alpha for n vectors under one label."""
    p = min(0.25, cap / max(n, 1))
    words = max(2, math.ceil((size / p) ** (1 / min(BLOCKS, dim))))
    # Inner products of random unit vectors are nearly normal with variance 1 / dim. The filters there are decide p.
    p = min(0.5, size / words ** min(BLOCKS, dim))
    return words, NormalDist().inv_cdf(1 - p) / math.sqrt(dim)


def _unit(blobs: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors of packed ones, whose components are floats or doubles, as their lengths tell."""
    v = np.frombuffer(b"".join(blobs), "<f4" if len(blobs[0]) == 4 * dim else "<f8").reshape(-1, dim).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _decoder(designs: dict[int, tuple[int, float]], kind: pa.DataType):
    """Adds the caps of each vector, in ascending order."""

    def run(batches):
        codes = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                dims, blobs = b["dim"].to_numpy(), b["vec"].to_pylist()
                caps: list = [None] * b.num_rows
                for dim in np.unique(dims).tolist():
                    if dim not in codes:
                        codes[dim] = [Code(dim, *designs[dim], seed) for seed in range(CODES)]
                    at_dim = np.flatnonzero(dims == dim)
                    unit = _unit([blobs[i] for i in at_dim], dim)
                    lists = [code.decode(unit, LEAST) for code in codes[dim]]
                    for i, found in zip(at_dim.tolist(), zip(*lists, strict=True), strict=True):
                        caps[i] = np.sort(np.concatenate([CODES * c + k for k, c in enumerate(found)]))
                yield row_batch(b, ["label", "dim", "cid", "n", "vec"], {"caps": (caps, pa.list_(kind))})

    return run


def _verifier(threshold: float):
    """Compares the members of each unit (a cap, or two blocks of one), which come sorted by unit."""

    def compare(key, rows):
        dim, _, b1, b2 = key[1:]
        n, cid = np.array([r[1] for r in rows]), np.array([r[0] for r in rows], np.int64)
        side = np.array([r[4] for r in rows])
        u = _unit([r[2] for r in rows], dim)
        left, right = (np.flatnonzero(side == b1), np.flatnonzero(side == b2)) if b1 != b2 else (np.arange(len(rows)),) * 2
        near = u[left] @ u[right].T >= threshold
        if b1 == b2:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        # A link is counted in the first cap that both ends are in.
        lower = [np.asarray(r[3], np.int64) for r in rows]
        kinds, at = np.unique(np.concatenate(lower), return_inverse=True)
        if len(kinds):
            member = np.zeros((len(rows), len(kinds)), np.float32)
            member[np.repeat(np.arange(len(rows)), [len(x) for x in lower]), at] = 1
            fresh = near & (member[left] @ member[right].T < 0.5)
        else:
            fresh = near
        links = np.zeros(len(rows), np.int64)
        links[left] += fresh @ n[right]
        if b1 != b2:
            links[right] += fresh.T @ n[left]
        root = np.arange(len(rows))
        while True:  # smallest member that links lead to; few rounds, as clusters are dense
            low = root.copy()
            low[left] = np.minimum(low[left], np.where(near, root[right][None, :], len(rows)).min(axis=1))
            if b1 != b2:
                low[right] = np.minimum(low[right], np.where(near.T, root[left][None, :], len(rows)).min(axis=1))
            low = np.minimum(low, low[low])
            if (low == root).all():
                break
            root = low
        for i in np.flatnonzero((links > 0) | (root != np.arange(len(rows)))).tolist():
            yield int(cid[i]), int(links[i]), int(cid[root[i]])

    def run(batches):
        key, rows = None, []
        for b in batches:
            out = []
            cols = [b[c].to_pylist() for c in ("label", "dim", "cap", "b1", "b2", "cid", "n", "vec", "lower", "block")]
            for *k, cid, n, vec, lower, block in zip(*cols, strict=True):
                if k != key:
                    if len(rows) > 1:
                        out += compare(key, rows)
                    key, rows = k, []
                rows.append((cid, n, vec, lower, block))
            yield _links(out)
        if len(rows) > 1:
            yield _links(list(compare(key, rows)))

    return run


def _links(out):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["cid", "links", "root"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of vectors.

    n_links is the number of other rows linked directly, component_id the
    smallest id that links lead to, the own one included, and kept says that
    these are equal. Rows whose vector is null, empty, zero or has null or
    non-finite components, or whose label or id is null, link with nothing; a
    null id has no component and isn't kept. Vectors of different lengths don't
    link. Repeated rows are rows like others, and so are different vectors of one
    id: each has its own links, and components are joined by links, not by ids.
    Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull() & F.col("id").isNotNull())
    good = rows.where("sound").select("id", "label", "v")
    # A class of equal vectors has a number of its own: two of them may have the same smallest id.
    classes = good.groupBy("label", "v").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy("label", F.size("v").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("most")).collect()  # one row a dimension
    designs = {r.dim: design(r.most, r.dim) for r in sizes}
    filters = max((CODES * words ** min(BLOCKS, dim) for dim, (words, _) in designs.items()), default=0)
    cap_type, arrow_type = ("int", pa.int32()) if filters < 1 << 31 else ("long", pa.int64())
    component = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"

    def pack(batches):
        for b in batches:
            yield row_batch(b, ["label", "dim", "cid", "n"], {"vec": ([np.array(v, component).tobytes() for v in b["v"].to_pylist()], pa.binary())})

    label = classes.schema["label"].dataType.simpleString()
    head = f"label {label}, dim int, cid long, n long, vec binary"
    packed = classes.select("label", F.size("v").alias("dim"), "cid", "n", "v").mapInArrow(pack, head)
    decoded = cut(packed.mapInArrow(_decoder(designs, arrow_type), f"{head}, caps array<{cap_type}>"), "caps")
    keys = ["label", "dim", "cap"]
    # Which caps have two members and how many blocks they make is found with ids alone; vectors move once a cap after that.
    slim = decoded.select("label", "dim", "cid", F.explode("caps").alias("cap"))
    counts = slim.groupBy(*keys).count().where("count > 1").select(*keys, F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    shared = slim.join(counts, keys).groupBy("label", "dim", "cid").agg(F.sort_array(F.collect_list(F.struct("cap", "parts"))).alias("shared"))
    member = decoded.drop("caps").join(shared, ["label", "dim", "cid"])
    member = member.select("*", F.posexplode("shared").alias("at", "unit"))
    member = member.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("unit.parts")).cast("int"))
    member = member.select("*", F.explode(F.sequence(F.lit(0), F.col("unit.parts") - 1)).alias("other"))
    member = member.withColumns({"cap": F.col("unit.cap"), "b1": F.least("block", "other"), "b2": F.greatest("block", "other"), "lower": F.slice(F.col("shared.cap"), F.lit(1), F.col("at"))})
    unit = [*keys, "b1", "b2"]
    dealt = member.select(*unit, "cid", "n", "vec", "lower", "block").repartition(*unit).sortWithinPartitions(*unit)
    found = cut(dealt.mapInArrow(_verifier(threshold), "cid long, links long, root long"), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = connected_components(found, "cid", "root").withColumnsRenamed({"id": "cid"})
    lows = groups.join(classes.select("cid", "low"), "cid").groupBy("component").agg(F.min("low").alias("least"))
    groups = groups.join(lows, "component").select("cid", "least")
    named = classes.join(links, "cid", "left").join(groups, "cid", "left")
    named = cut(named.select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "low").alias("component_id")), "named")
    linked = rows.where("sound").join(named, ["label", "v"]).select("id", "n_links", "component_id")
    out = linked.unionByName(rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (
  SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(low.b, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
