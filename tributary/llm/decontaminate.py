"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words. A window is ``window`` consecutive words of a benchmark
item, or all words of a shorter item. Windows of one length m form a set with
three tables: the shift table says for the block of two words that ends at a
position how far the search may skip (up to m - 1 words when the block occurs
in no window), blocks that end a window select a suffix bucket, its prefix
block narrows the bucket, and direct comparison of all words confirms. On a
clean text one position in twelve is looked at.

The benchmark's size is measured first. While its texts stay under
``block_bytes`` they are one block, sent to every executor; beyond that, the
items are dealt to as many blocks as it takes, each within the bound, and the
documents are searched block by block; hits from different blocks are merged
by document. Documents are never shuffled in the first case.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm._text import ddl, kept, resident, row_batch, utf8
from tributary.scratch import cut

WINDOW = 13
#: Bytes of benchmark text that one block holds.
BLOCK_BYTES = 16 << 20

#: ASCII letters and digits and every byte of longer characters stay; all else separates words.
_KEEP = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | str | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z lower-cased, in UTF-8; none for null."""
    if isinstance(text, str):
        text = text.encode("utf-8", "surrogatepass")
    return text.lower().translate(_KEEP).split() if text else []


#: Multiplier of a block's first word, and entries of a shift table at most.
_MIX, _TABLE = 0x9E3779B97F4A7C15, 1 << 25
_LONG = (1 << 64) - 1


class WuManber:
    """Searches word lists for windows of m words, from flat tables.

    The words of all items are numbered once and stand in one list; a window is a position in it. The
    shift table is bytes indexed by a block's hash, where blocks that share an entry take
    the least shift, which never skips an occurrence. Windows are sorted by the hashes of
    suffix and prefix block, equal ones are one group with its items.
    """

    def __init__(self, m: int, ids: list, sizes: list[int], codes: np.ndarray, names: list[bytes], hashes: np.ndarray):
        """ids and sizes (at least m) of items, the codes of their words one after the other, names and hash() of the codes."""
        self.m, self.block, self.ids = m, min(2, m), ids
        self.words = [names[c] for c in codes.tolist()]
        inside = np.ones(len(codes), bool)
        ends = np.cumsum(sizes)
        for k in range(1, m):
            inside[ends - k] = False
        at = np.flatnonzero(inside)
        owner = np.repeat(np.arange(len(ids)), sizes)[at]
        h = hashes[codes]
        blocks_ = h[:-1] * np.uint64(_MIX) + h[1:] if self.block == 2 else h
        self.most = min(255, m - self.block + 1)
        self.mask = min(_TABLE, 1 << max(10, (4 * len(codes)).bit_length())) - 1
        shift = np.full(self.mask + 1, self.most, np.uint8)
        for end in range(self.block, m + 1):  # shorter shifts last
            shift[(blocks_[at + end - self.block] & np.uint64(self.mask)).astype(np.int64)] = min(255, m - end)
        self.shift = shift.tobytes()
        half = np.uint64(32)
        key = blocks_[at + m - self.block] >> half << half | blocks_[at] >> half
        whole = h[at].copy()
        for k in range(1, m):
            whole = whole * np.uint64(_MIX) + h[at + k]
        order = np.lexsort((owner, whole, key))
        key, whole, at, owner = key[order], whole[order], at[order], owner[order]
        same = (key[1:] == key[:-1]) & (whole[1:] == whole[:-1])
        for k in range(m):
            same &= codes[at[1:] + k] == codes[at[:-1] + k]
        heads = np.concatenate(([0], np.flatnonzero(~same) + 1))
        self.keys, self.at = array("Q", key[heads].tobytes()), array("q", at[heads].tobytes())
        self.bounds, self.owner = array("q", np.append(heads, len(at)).tobytes()), array("q", owner.tobytes())

    def items(self, group: int) -> set:
        """The items that hold a group's window."""
        return {self.ids[i] for i in self.owner[self.bounds[group] : self.bounds[group + 1]]}

    def find(self, w: list[bytes]):
        """(start, group) of every occurrence, in order."""
        m, k, shift, mask, n, keys, words = self.m, self.block - 1, self.shift, self.mask, len(w), self.keys, self.words
        at = m - 1
        while at < n:
            suffix = hash(w[at - 1]) * _MIX + hash(w[at]) if k else hash(w[at])
            skip = shift[suffix & mask]
            if skip:
                at += skip
                continue
            start = at - m + 1
            prefix = hash(w[start]) * _MIX + hash(w[start + 1]) if k else suffix
            key = (suffix & _LONG) >> 32 << 32 | (prefix & _LONG) >> 32
            group = bisect_left(keys, key)
            while group < len(keys) and keys[group] == key:
                p = self.at[group]
                if words[p : p + m] == w[start : at + 1]:
                    yield start, group
                    break
                group += 1
            at += 1


def compile_items(items, window: int = WINDOW) -> list[WuManber]:
    """One searcher for each window length that occurs. items: (id, text) pairs.

    Hashes are those of the process, so searchers are used where they are made.
    """
    number: dict[bytes, int] = {}
    parts: dict[int, tuple[list, list, array]] = defaultdict(lambda: ([], [], array("i")))
    for item, text in items:
        w = words_of(text)
        if w:
            ids, sizes, codes = parts[min(window, len(w))]
            ids.append(item)
            sizes.append(len(w))
            codes.extend([number.setdefault(x, len(number)) for x in w])
    names = list(number)
    hashes = np.fromiter(map(hash, names), np.int64, len(names)).view(np.uint64)
    return [WuManber(m, ids, sizes, np.frombuffer(codes, np.int32), names, hashes) for m, (ids, sizes, codes) in sorted(parts.items())]


def compiled(token: str, shared, window: int) -> list[WuManber]:
    """The searchers of a broadcast block, compiled once a worker process, which keeps those of one block."""
    return resident(("searchers", token), lambda: compile_items(shared.value, window))


def hits(text: bytes | str | None, searchers: list[WuManber]) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, merged [start, end) spans that are hit, and the items found."""
    w, spans, items = words_of(text), [], set()
    for s in searchers:
        groups = set()
        for start, group in s.find(w):
            groups.add(group)
            spans.append((start, start + s.m))
        for group in groups:
            items |= s.items(group)
    return len(w), merge(spans), items


def merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _summary(n: int, spans, items) -> tuple:
    n_hit = sum(b - a for a, b in spans)
    ids = ",".join(sorted(map(str, items)))
    return n, n_hit, len(items), hashlib.sha256(ids.encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n


_RESULT = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_()}
_RESULT_DDL = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _results(rows) -> dict:
    return {c: ([r[i] for r in rows], kind) for i, (c, kind) in enumerate(_RESULT.items())}


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[int, Iterator[list]]:
    """The number of blocks that the benchmark's measured size asks for, and these, one at a time, as (id, text) lists."""
    b = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null").distinct()
    n = -(-(b.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) or 1
    n = 1 if n == 1 else 2 * n  # so that an uneven deal stays near the bound
    dealt = b.withColumn("k", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    return n, ([tuple(r) for r in dealt.where(F.col("k") == k).select("item", "text").collect()] for k in range(n))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id, the columns in keep, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts words inside any occurrence of a window; contaminated says
    that these are at least a twentieth of the words. Null and empty texts have
    no words and are clean. Null and blank benchmark texts, and null item ids,
    match nothing. Repeated items count once by id; repeated documents each
    have a row, null ids too. Other columns are ignored, and so are columns to keep
    that are named like a result; empty tables are fine on either side.
    """
    spark = docs.sparkSession
    out = kept(id_col, keep, _RESULT)
    docs = docs.select(*dict.fromkeys([*out, text_col]))
    schema = f"{ddl(docs, out)}, {_RESULT_DDL}"
    n, each = blocks(benchmark, block_bytes=block_bytes)
    if n == 1:
        shared, token = spark.sparkContext.broadcast(next(each)), uuid.uuid4().hex

        def search(batches):
            searchers = compiled(token, shared, window)
            for b in batches:
                yield row_batch(b, out, _results([_summary(*hits(t, searchers)) for t in utf8(b[text_col])]))

        return docs.mapInArrow(search, schema)
    # Hits of each block under a digest of the text, then merged by that.
    keyed, partial = docs.withColumn("__text_sha", F.sha2(F.coalesce(text_col, F.lit("")), 256)), None
    for items in each:
        shared = spark.sparkContext.broadcast(items)

        def scan(batches, shared=shared, token=uuid.uuid4().hex):
            searchers = compiled(token, shared, window)
            for b in batches:
                found = [(s, spans, sorted(map(str, ids))) for s, t in zip(b["sha"].to_pylist(), utf8(b["text"]), strict=True) for _, spans, ids in [hits(t, searchers)] if spans]
                yield row_batch(b, [], {"sha": ([x[0] for x in found], pa.string()), "spans": ([[list(p) for p in x[1]] for x in found], pa.list_(pa.list_(pa.int32()))), "items": ([x[2] for x in found], pa.list_(pa.string()))})

        found = cut(keyed.select(F.col("__text_sha").alias("sha"), F.col(text_col).alias("text")).mapInArrow(scan, "sha string, spans array<array<int>>, items array<string>").distinct(), "hits")
        partial = found if partial is None else partial.unionByName(found)
        shared.destroy()
    merged = partial.groupBy(F.col("sha").alias("__text_sha")).agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("__items"))

    def finish(batches):
        for b in batches:
            rows = [_summary(len(words_of(t)), merge(map(tuple, spans or [])), ids or []) for t, spans, ids in zip(utf8(b[text_col]), b["__spans"].to_pylist(), b["__items"].to_pylist(), strict=True)]
            yield row_batch(b, out, _results(rows))

    return keyed.join(merged, "__text_sha", "left").mapInArrow(finish, schema)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, list_slice(w, i, i + least(len(w), 13) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, list_slice(w, i, i + m - 1) AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)),
found AS (
  SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
