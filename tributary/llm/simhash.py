"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has one bit for each bit of the hashes of its word
shingles: 1 where over half the hashes have a 1. Documents link where their
fingerprints differ in at most ``radius`` bits, and components of links are
groups of near copies.

Candidates come from structured bit masks. Position i gets a non-zero vector
m(i) of radius + 1 bits; the mask of v keeps the positions where the inner
product of m(i) and v is odd. ``radius`` differing positions span at most
``radius`` dimensions, so some v is orthogonal to all of them, and the pair is
equal under the mask of that v: no pair within the radius is missed, whatever
the data. 2 ** (radius + 1) - 1 masks suffice (7 for radius 2, each of which
keeps 36 or 37 of 64 bits).

Large buckets need no cap. The members of a bucket agree on the kept bits and
differ only in the rest, so the same construction is applied to the remaining
bits: 28 free bits, then at most 12, then at most 6, when a bucket can't hold
over 64 distinct fingerprints. Buckets of at most 64 are compared directly,
and each gives a spanning forest of its links instead of its pairs.

Only distinct fingerprints are shuffled, 16 bytes each, so a group of exact
copies is one row after a partial aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.components import connected_components
from tributary.scratch import cut, drop

BITS = 64
#: Buckets up to this many fingerprints are compared directly; 2 ** 6 is what the last masks leave at most.
DIRECT = 64
_STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 without words.

    A-Z are lower-cased, words are runs of anything but [\\x20\\x09-\\x0D],
    shingles are ``shingle`` consecutive words joined by a space, with repeats;
    fewer words make one shingle of all of them.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest, total, counts = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1), np.zeros((8, 256), np.int64)
    for at in range(0, total, _STEP):
        some = words[at : min(at + _STEP, total) + shingle - 1]
        joined = b" ".join(some)
        ends = np.cumsum([len(w) + 1 for w in some])
        starts = [0, *ends[: max(0, len(some) - shingle)].tolist()]
        stops = (ends[min(shingle, len(some)) - 1 :] - 1).tolist()
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
        for k, column in enumerate(h.view(np.uint8).reshape(-1, 8).T):
            counts[k] += np.bincount(column, minlength=256)
    ones = (counts @ _BYTE_BITS).reshape(-1)  # bit 0 of byte 0 first
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): one row per row of docs, fp a signed long. Null and empty texts have fp 0."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"))


def covering_masks(free: list[int], radius: int) -> list[int]:
    """Masks over the positions in free; any ``radius`` of these are all outside at least one mask."""
    size = 2 ** (radius + 1) - 1
    return [sum(1 << p for i, p in enumerate(free) if bin((i % size + 1) & v).count("1") % 2) for v in range(1, size + 1)]


def _levels(radius: int) -> list[list[int]]:
    """Masks of each level: those of level k + 1 refine those of level k, in its order."""
    levels = [covering_masks(list(range(BITS)), radius)]
    while max(BITS - bin(m).count("1") for m in levels[-1]) > DIRECT.bit_length() - 1:
        levels.append([m | s for m in levels[-1] for s in covering_masks([p for p in range(BITS) if not m >> p & 1], radius)])
    return levels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forests(radius: int):
    def run(batches):
        for b in batches:
            us, vs = [], []
            for fps in b["fps"]:
                a = np.asarray(fps, np.int64).view(np.uint64)
                near = np.argwhere(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= radius, 1))
                root = list(range(len(a)))
                for i, j in near.tolist():
                    while root[i] != i:
                        i = root[i]
                    while root[j] != j:
                        j = root[j]
                    if i != j:
                        root[j] = i
                        us.append(int(fps[i]))
                        vs.append(int(fps[j]))
            yield pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})

    return run


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): links of distinct fingerprints that connect just what all pairs within the radius connect.

    fps has one distinct signed long a row, in column fp.
    """
    levels, width = _levels(radius), 2 ** (radius + 1) - 1
    out, rows, old = None, fps.select("fp", F.lit(0).alias("t")), None
    for k, masks in enumerate(levels):
        table = F.array(*[F.lit(_signed(m)) for m in masks])
        dealt = rows.select("fp", F.explode(F.sequence(F.col("t") * width, F.col("t") * width + width - 1)).alias("t"))
        dealt = dealt.select("fp", "t", F.col("fp").bitwiseAND(F.get(table, F.col("t"))).alias("key"))
        sizes = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = cut(dealt.join(sizes, ["t", "key"]), f"buckets{k}")
        last = k + 1 == len(levels)
        small = shared if last else shared.where(F.col("n") <= DIRECT)
        found = cut(small.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInPandas(_forests(radius), "u long, v long"), f"links{k}")
        out = found if out is None else out.unionByName(found)
        drop(old)
        old = shared
        if last or not (rows := shared.where(F.col("n") > DIRECT).select("fp", "t")).head(1):
            break
    drop(old)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fingerprint, component_id): one row per row of docs.

    fingerprint is 16 lower-case hex digits; component_id is the smallest id
    that can be reached by links, the own one included. Null, empty and blank
    texts have fingerprint zero and link like any other. Rows that repeat are
    all returned. A null id is never a component_id; a component of null ids
    only has null. Other columns are ignored; an empty table gives no rows.
    """
    rows = cut(with_fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    parts = connected_components(links(fps, radius)).select(F.col("id").alias("fp"), "component")
    named = cut(fps.join(parts, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component")), "named")
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    groups = cut(named.join(lows, "component").select("fp", "component_id"), "groups")
    return rows.join(groups, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
