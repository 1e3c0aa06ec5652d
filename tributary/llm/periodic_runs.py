"""Periodic runs of words: maximal stretches that repeat with a smallest period.

Of each stretch a suffix automaton is built. Its states, from the longest to
the shortest, hold the positions at which their strings end, in order; a state's
set is merged into its suffix link's, the smaller into the larger. Where a
position gets a new neighbour at a distance that isn't more than the state's
length, the string at both is a square: the two occurrences touch or overlap.
Such a seed is extended to both sides to a whole run.

A run of length n >= 3 and four periods has all its three-word windows at least
three times within itself. So words are first cut, in whole batches, to the
stretches whose windows occur that often in the stretch, again and again until
little more goes. Nothing that lies in a run can go that way.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm._text import ddl, kept

MIN_WORDS, MIN_PERIODS = 6, 4
#: Words that are handled at once; positions in a block of an ordered set.
BATCH_WORDS, BLOCK = 1 << 20, 512
RUNS = "array<struct<start:long,length:long,period:long>>"


class Ends:
    """An ordered set of end positions, in blocks of bounded length so that adding one is cheap in sets of any size."""

    def __init__(self, first: int):
        self.blocks, self.lows, self.size = [[first]], [first], 1

    def add(self, p: int) -> tuple[int, int]:
        """Adds a position that isn't in the set; its neighbours, -1 where there is none."""
        blocks, k = self.blocks, max(0, bisect_right(self.lows, p) - 1)
        block = blocks[k]
        i = bisect_left(block, p)
        left = block[i - 1] if i else blocks[k - 1][-1] if k else -1
        right = block[i] if i < len(block) else blocks[k + 1][0] if k + 1 < len(blocks) else -1
        block.insert(i, p)
        if not i:
            self.lows[k] = p
        if len(block) > BLOCK:
            half = BLOCK // 2
            blocks[k : k + 1] = [block[:half], block[half:]]
            self.lows.insert(k + 1, block[half])
        self.size += 1
        return left, right

    def __iter__(self):
        for block in self.blocks:
            yield from block


class Automaton:
    """The suffix automaton of a sequence: transitions, suffix links, lengths, and the position that a state was made at (-1 for clones)."""

    def __init__(self, sequence: list[int]):
        following, link, length, end, last = [{}], [-1], [0], [-1], 0
        for i, c in enumerate(sequence):
            new, p = len(following), last
            following.append({})
            length.append(length[last] + 1)
            end.append(i)
            link.append(0)
            while p >= 0 and c not in following[p]:
                following[p][c] = new
                p = link[p]
            if p >= 0:
                q = following[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(following)
                    following.append(following[q].copy())
                    length.append(length[p] + 1)
                    end.append(-1)
                    link.append(link[q])
                    link[q] = link[new] = copy
                    while p >= 0 and following[p].get(c) == q:
                        following[p][c] = copy
                        p = link[p]
            last = new
        self.link, self.length, self.end = link, length, end

    def squares(self):
        """(period, last position) of squares: every run of two periods and more has one with its period."""
        link, length, end = self.link, self.length, self.end
        sets: list[Ends | None] = [None] * len(link)
        for v in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
            # The states that link here are longer, so they are merged already. A state's own position comes last.
            own, here = end[v], sets[v]
            if own >= 0:
                if here is None:
                    here = Ends(own)
                else:
                    yield from self._near(here.add(own), own, length[v])
            sets[v], u = None, link[v]
            if u == 0:
                continue
            there = sets[u]
            if there is None:
                sets[u] = here
                continue
            if there.size < here.size:
                there, here = here, there
            for p in here:
                yield from self._near(there.add(p), p, length[u])
            sets[u] = there

    @staticmethod
    def _near(neighbours: tuple[int, int], p: int, most: int):
        left, right = neighbours
        if left >= 0 and p - left <= most:
            yield p - left, p
        if right >= 0 and right - p <= most:
            yield right - p, right


def runs_of(sequence: list[int], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start and period."""
    n = len(sequence)
    found: dict[int, tuple[list[int], list[int]]] = {}
    for d, e in Automaton(sequence).squares():
        if d * min_periods > n:
            continue
        starts, ends = found.setdefault(d, ([], []))
        k = bisect_right(starts, e - 2 * d + 1) - 1
        if k >= 0 and e < ends[k]:
            continue
        a, b = e - d, e + 1
        while a > 0 and sequence[a - 1] == sequence[a - 1 + d]:
            a -= 1
        while b < n and sequence[b] == sequence[b - d]:
            b += 1
        k = bisect_left(starts, a)
        starts.insert(k, a)
        ends.insert(k, b)
    least: dict[tuple[int, int], int] = {}
    for d in sorted(found):  # a run's multiples of its period span the same words
        for a, b in zip(*found[d]):
            least.setdefault((a, b), d)
    return sorted((a, b - a, d) for (a, b), d in least.items() if b - a >= max(min_words, min_periods * d))


def stretches(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What of sequences (stretches of ids) may be in a run: its starts and ends, and which sequence each is of."""
    at = np.flatnonzero(ends - starts >= MIN_WORDS)
    starts, ends, salt = starts[at].astype(np.int64), ends[at].astype(np.int64), 0
    wide = ids.astype(np.uint64)
    while len(starts):
        sizes = ends - starts - 2
        label = np.repeat(np.arange(len(starts)), sizes)
        first = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        bits = max(10, int(len(first)).bit_length() + 2)
        key = np.full(len(first), salt, np.uint64)
        for part in (wide[first], wide[first + 1], wide[first + 2], label.astype(np.uint64)):
            key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        key = ((key * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)
        # Keys that collide count together, so a window is never taken for rarer than it is.
        good = np.bincount(key, minlength=1 << bits)[key] >= 3
        edge = np.concatenate([[True], (label[1:] != label[:-1]) | (good[1:] != good[:-1])])
        heads = np.flatnonzero(edge)
        tails = np.append(heads[1:], len(first))
        stay = good[heads] & (tails - heads >= MIN_WORDS - 2)
        heads, tails = heads[stay], tails[stay] - 1
        before = int(sizes.sum()) + 2 * len(sizes)
        at, starts, ends = at[label[heads]], first[heads], first[tails] + 3
        salt += 1
        if before - int((ends - starts).sum()) <= before // 100:
            break
    return starts, ends, at


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none of a null one."""
    return F.coalesce(F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"), 1), F.array().cast("array<string>"))


def collapse(docs: DataFrame, words_col: str, keep: list[str], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """One row per row of docs: the columns in keep, n_words, runs and collapsed.

    words_col is an array of words (null: none; a null word is the word "").
    runs are (start, length, period), by start and period, of all maximal
    stretches with smallest period q that are at least min_words and min_periods * q
    long. collapsed are the words joined by spaces, without those that lie in a
    run after its first q words. Rows stay where they are and may repeat; other
    columns are ignored, and so are columns to keep that are named like a result.
    A task's memory grows with the longest stretch that may be in a run, about a
    kilobyte for each of its words.
    """
    if min_words < 6 or min_periods < 4:
        raise ValueError("the windows that are looked for are in runs of six words and four periods and more only")
    out = kept(keep[0], keep[1:], ("n_words", "runs", "collapsed"))
    docs = docs.select(*dict.fromkeys([*out, words_col]))

    def run(batches):
        for whole in batches:
            for b in _pieces(whole, words_col):
                found, texts, sizes = _collapsed(b.column(words_col), min_words, min_periods)
                arrays = [b.column(c) for c in out] + [pa.array(sizes, pa.int64()), found, texts]
                yield pa.RecordBatch.from_arrays(arrays, names=[*out, "n_words", "runs", "collapsed"])

    return docs.mapInArrow(run, f"{ddl(docs, out)}, n_words long, runs {RUNS}, collapsed string")


def _pieces(batch: pa.RecordBatch, column: str):
    """The batch in stretches of rows with about BATCH_WORDS words, one row at least."""
    ends = np.cumsum(pc.coalesce(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_WORDS, "right")))
        yield batch.slice(at, end - at)
        at = end


def _collapsed(lists: pa.Array, min_words: int, min_periods: int):
    sizes = pc.coalesce(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().fill_null("")
    ends = np.cumsum(sizes)
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    per_row: list[list[dict]] = [[] for _ in sizes]
    stays = np.ones(len(flat), bool)
    for s, e, row in zip(*(x.tolist() for x in stretches(ids, ends - sizes, ends))):
        for start, length, period in runs_of(ids[s:e].tolist(), min_words, min_periods):
            per_row[row].append({"start": s + start - int(ends[row] - sizes[row]), "length": length, "period": period})
            stays[s + start + period : s + start + length] = False
    left = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], ends])]
    kept_words = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(stays)) if not stays.all() else flat)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.array([sorted(r, key=lambda x: (x["start"], x["period"])) for r in per_row], kind), pc.binary_join(kept_words, " "), sizes


ORACLE = r"""
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: unicode(x)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h
  FROM documents, crc),
p AS (
  SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS again, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a,
    CASE WHEN len(w) > 0 THEN 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) END AS p FROM d),
w AS (
  SELECT r, n, i, CASE WHEN again AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS x FROM (SELECT *, unnest(range(n)) AS i FROM p)),
same AS (
  SELECT l.r, l.i, m.i - l.i AS q FROM w l JOIN w m ON l.r = m.r AND l.x = m.x AND m.i > l.i AND 4 * (m.i - l.i) <= l.n),
islands AS (
  SELECT r, q, min(i) AS s, count(*) + q AS len FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same) GROUP BY r, q, k),
runs AS (
  SELECT r, s, len, min(q) AS q FROM islands WHERE len >= greatest(6, 4 * q) GROUP BY r, s, len),
about AS (
  SELECT r, count(*) AS n_runs, first(struct_pack(s, len, q) ORDER BY len DESC, s, q) AS top, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
dropped AS (
  SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
left_over AS (
  SELECT w.r, string_agg(w.x, ' ' ORDER BY w.i) AS txt FROM w ANTI JOIN dropped ON dropped.r = w.r AND dropped.i = w.i GROUP BY w.r)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top.s AS BIGINT) AS "start", CAST(top.len AS BIGINT) AS length, CAST(top.q AS BIGINT) AS period,
  CAST(1000 * top.len // top.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(txt, '')) AS collapsed_sha256
FROM d LEFT JOIN about ON about.r = d.r LEFT JOIN left_over ON left_over.r = d.r
"""
