"""Near copies by SimHash, and beyond its radius by the similarity of word shingles: MinHash bands, exact verification, components.

Two texts are near copies where the Jaccard similarity of their sets of word
shingles is at least ``LEAST``. The first candidates are the links of operator 1:
fingerprints that differ in at most two bits (``simhash.links``, on the
fingerprints of whole texts). Many near copies differ in more bits, so others
share one of BANDS keys, each of ROWS minima of hashed shingles. A pair of
similarity s shares none with probability
(1 - s ** ROWS) ** BANDS, 5e-6 at 0.8; every candidate is verified by its sets.

Buckets have no cap. In rounds, each bucket that isn't in one component yet
compares its members with one of them, another one every round, so a round is
linear and a large group of near copies soon is one component. Rounds end when
they no longer bring down the number of pairs apart. What is left then, pairs in
different components of one bucket, is compared in blocks: pairs with MINIMA equal
minima (a pair of similarity 0.8 has fewer with probability 1e-6) are verified
there, and only links leave the block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm import simhash
from tributary.operators.components import connected_components
from tributary.scratch import cut, drop

SHINGLE, BANDS, ROWS = 5, 40, 6
#: Rounds of pivots at most; fewer where only a few pairs are left.
ROUNDS = 8
#: Equal minima, of BANDS * ROWS, that two sets need to be worth verifying, and bytes of shingles of one block.
MINIMA, BLOCK_BYTES = 161, 8 << 20
#: The least similarity of near copies, as a fraction.
LEAST = (4, 5)
_STEP = 1 << 11
_RNG = np.random.default_rng(42)
_XOR = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; words are as in simhash.fingerprint, fewer make one shingle of all."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))], np.uint64))


def lowest(hashes: np.ndarray) -> np.ndarray:
    """The minima of a set under BANDS * ROWS hash functions."""
    low = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), _STEP):
        some = (hashes[None, at : at + _STEP] ^ _XOR[:, None]) * _ODD[:, None]
        np.minimum(low, some.min(axis=1), out=low)
    return low >> np.uint64(16)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed long for each band; none for a text without words."""
    if not len(hashes):
        return []
    return [_signed(xxhash.xxh64_intdigest(r.tobytes(), k)) for k, r in enumerate(lowest(hashes).reshape(BANDS, ROWS))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have at least the least similarity."""
    if LEAST[0] * max(len(a), len(b)) > LEAST[1] * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, texts: DataFrame, label: str) -> DataFrame:
    """Those of the pairs (u, v) whose texts are near copies."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        last, known, out = None, None, []
        for x, y in zip(a, b, strict=True):
            if x != last:
                last, known = x, shingles(x)
            out.append(similar(known, shingles(y)))
        return pd.Series(out, dtype=bool)

    both = pairs.join(texts.select(F.col("fp").alias("v"), F.col("text").alias("b")), "v")
    both = both.join(texts.select(F.col("fp").alias("u"), F.col("text").alias("a")), "u")
    return cut(both.where(near("a", "b")).select("u", "v"), label)


def _grouped(docs: DataFrame, id_col: str, text_col: str, key_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as a table (rid, row, id, fp, n, sh, other), and (fp, component) of each distinct set of shingles.

    rid numbers the rows of that table; row is the whole row, so that no column
    of docs can clash; sh is the text's SimHash fingerprint, other a hash of it. Sets are told apart by 128
    bits: fp is key_bits of them, and where these meet in different sets, a hash of all.
    """

    @F.pandas_udf("fp long, rest long, n long, sh long, keys array<long>")
    def signed(some: pd.Series) -> pd.DataFrame:
        fps, rests, sizes, bits, keys = [], [], [], [], []
        for t in some:
            h = shingles(t)
            bits.append(_signed(simhash.fingerprint(t)))
            sizes.append(len(h))
            digest = xxhash.xxh3_128_intdigest(h.tobytes())
            fps.append(_signed(digest & ((1 << key_bits) - 1)))
            rests.append(_signed(digest >> 64))
            keys.append(band_keys(h))
        return pd.DataFrame({"fp": np.array(fps, np.int64), "rest": np.array(rests, np.int64), "n": np.array(sizes, np.int64), "sh": np.array(bits, np.int64), "keys": keys})

    plain = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = plain.select("row", "id", "text", F.xxhash64("text").alias("other"), signed("text").alias("s"))
    rows = cut(found.select(F.monotonically_increasing_id().alias("rid"), "row", "id", "text", "other", "s.fp", "s.rest", "s.n", "s.sh", "s.keys"), "shingled")
    met = cut(rows.groupBy("fp").agg(F.min("rest").alias("low"), F.max("rest").alias("high")).where("low != high").select("fp"), "met")
    if met.head(1):
        marked = rows.join(met.withColumn("met", F.lit(True)), "fp", "left")
        rows = cut(marked.withColumn("fp", F.when(F.col("met"), F.xxhash64("fp", "rest")).otherwise(F.col("fp"))).drop("met"), "shingled")
    dealt = cut(rows.select("fp", F.explode("keys").alias("key")).distinct(), "dealt")
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = cut(dealt.join(sizes, "key"), "buckets")
    drop(dealt)
    close = cut(_close(rows), "close")
    wanted = shared.select("fp").unionByName(close.select(F.explode(F.array("u", "v")).alias("fp"))).distinct()
    texts = cut(rows.select("fp", "text", "n").join(wanted, "fp", "left_semi").dropDuplicates(["fp"]), "texts")
    links = _verified(close, texts, "links")
    parts, much = cut(connected_components(links), "parts"), float("inf")
    name = parts.select(F.col("id").alias("fp"), F.col("component").alias("now"))
    open_ = cut(shared.join(name, "fp", "left").select("key", "fp", F.coalesce("now", "fp").alias("of")), "open")
    for k in range(ROUNDS + 1):
        if k:
            name = parts.select(F.col("id").alias("fp"), F.col("component").alias("now"))
            placed = open_.join(name, "fp", "left").select("key", "fp", F.coalesce("now", "fp").alias("of"))
            apart = placed.groupBy("key").agg((F.min("of") != F.max("of")).alias("apart")).where("apart").select("key")
            after = cut(placed.join(apart, "key"), "open")
            drop(open_)
            open_ = after
            before, much = much, _apart(open_)
            if k == ROUNDS or 10 * much >= 9 * before:
                break
        pairs = cut(_pivots(open_, k), "pairs")
        found = _verified(pairs, texts, "links")
        links = links.unionByName(found)
        parts = cut(connected_components(links), "parts")
    links = links.unionByName(cut(_in_blocks(open_, texts), "links"))
    for t in (shared, open_, texts, close):
        drop(t)
    return rows, cut(connected_components(links).select(F.col("id").alias("fp"), "component"), "named")


def _close(rows: DataFrame) -> DataFrame:
    """(u, v), u < v: sets of shingles whose texts have SimHash fingerprints within operator 1's radius, as many pairs as connect these."""
    pairs = cut(rows.select("sh", "fp").distinct(), "fingerprints")
    one = cut(pairs.groupBy("sh").agg(F.min("fp").alias("one")), "distinct")
    same = pairs.join(one, "sh").select(F.col("one").alias("u"), F.col("fp").alias("v"))
    name = lambda c, to: one.select(F.col("sh").alias(c), F.col("one").alias(to))
    near = simhash.links(one.select(F.col("sh").alias("fp"))).select(F.col("u").alias("su"), F.col("v").alias("sv"))
    near = near.join(name("su", "u"), "su").join(name("sv", "v"), "sv").select("u", "v")
    return same.unionByName(near).where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _pivots(members: DataFrame, k: int) -> DataFrame:
    """(u, v), u < v: of each bucket one member, another one each round, with those in other components."""
    mix = F.xxhash64("key", F.lit(k)) if k else F.lit(0).cast("long")
    pivot = members.groupBy("key").agg(F.min(F.col("fp").bitwiseXOR(mix)).alias("low")).select("key", F.col("low").bitwiseXOR(mix).alias("pivot"))
    own = members.select("key", F.col("fp").alias("pivot"), F.col("of").alias("of_pivot"))
    both = members.join(pivot.join(own, ["key", "pivot"]), "key").where("of != of_pivot")
    return both.select(F.least("fp", "pivot").alias("u"), F.greatest("fp", "pivot").alias("v")).distinct()


def _apart(members: DataFrame) -> int:
    """The number of pairs of a bucket's members that are in different components, beyond a few a member."""
    each = members.groupBy("key", "of").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    total = each.agg(F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2).alias("pairs"), F.sum("n").alias("n")).first()
    return max(0, int((total.pairs or 0) - 4 * (total.n or 0)))


def _in_blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): links between a bucket's members in different components, as many as it takes to bring these together.

    A bucket's members are dealt to blocks of about BLOCK_BYTES of shingles, and
    each pair of blocks is compared in one task; only links leave it.
    """

    @F.pandas_udf("sig binary, grams binary")
    def signed(some: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in some]
        return pd.DataFrame({"sig": [lowest(h).astype("<u2").tobytes() for h in sets], "grams": [h.astype("<u8").tobytes() for h in sets]})

    sets = members.select("fp").distinct().join(texts, "fp").select("fp", "n", signed("text").alias("s"))
    sets = cut(sets.select("fp", "n", "s.sig", "s.grams"), "sets")
    sized = members.join(sets.select("fp", "n"), "fp")
    parts = sized.groupBy("key").agg(F.ceil(F.sum(F.col("n") * 8 + 1024) / BLOCK_BYTES).cast("int").alias("parts"))
    dealt = members.join(parts, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "fp", "of").join(sets.drop("n"), "fp")

    def compare(batches):
        unit, rows = None, []
        for b in batches:
            out = []
            for row in zip(*[b[c].to_pylist() for c in ("key", "b1", "b2", "block", "fp", "of", "sig", "grams")], strict=True):
                if row[:3] != unit:
                    out += _links_of(unit, rows)
                    unit, rows = row[:3], []
                rows.append(row[3:])
            yield _pairs(out)
        yield _pairs(list(_links_of(unit, rows)))

    by = ["key", "b1", "b2"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "u long, v long").distinct()


def _pairs(out):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(2)], names=["u", "v"])


def _links_of(unit, rows):
    if len(rows) < 2:
        return
    block, fp, of = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    sig = np.frombuffer(b"".join(r[3] for r in rows), "<u2").reshape(len(rows), -1)
    kinds, counts = np.unique(of, return_counts=True)
    most = kinds[counts.argmax()]
    for i in np.flatnonzero(of != most).tolist():  # of each pair, one at least isn't in the largest component
        own = np.frombuffer(rows[i][4], "<u8")
        other = np.flatnonzero((of != of[i]) & ((block != block[i]) if unit[1] != unit[2] else True))
        for j in other[(sig[other] == sig[i]).sum(axis=1) >= MINIMA].tolist():
            if of[j] != of[i] and similar(own, np.frombuffer(rows[j][4], "<u8")):
                yield int(fp[i]), int(fp[j])
                of[of == of[i]] = of[j]


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id): one row per row of docs; component_id is the smallest id of its group of near copies.

    Texts without words are copies of each other. A null id is never a
    component_id; a group of null ids only has null. Repeated rows are all
    returned. Other columns are ignored; an empty table gives no rows.
    """
    rows, parts = _grouped(docs, id_col, text_col)
    placed = rows.select("id", "fp").join(parts, "fp", "left").select("id", F.coalesce("component", "fp").alias("component"))
    lows = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    return placed.join(lows, "component").select(F.col("id").alias(id_col), "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, with all its columns: one row of each group of near copies.

    That is the row of smallest id, null ids last; of rows of one id the one
    whose text, then whose other columns, hash lowest. Rows are told apart by
    themselves and not by their id: a text without near copies stays whatever
    its id, also where that is null or another row's. Texts without words (null,
    empty, blank) are copies of each other. An empty table gives no rows.
    """
    rows, parts = _grouped(docs, id_col, text_col)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "other", F.xxhash64("row").alias("whole"), "rid")
    placed = rows.select("fp", order.alias("order")).join(parts, "fp", "left")
    best = placed.groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("order").alias("best"))
    kept = best.select(F.col("best.rid").alias("rid"))
    return rows.select("rid", "row").join(kept, "rid", "left_semi").select("row.*")
