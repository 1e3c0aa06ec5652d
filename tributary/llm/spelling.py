"""Groups of spelling variants: words one inserted, deleted or replaced code point apart.

Words are found through a positional q-gram inverted index. One edit destroys
at most q of a word's q-grams and moves the others by at most one place, so two
words within one edit share max(length) - q + 1 - q positional q-grams at least.
A word's postings (words of a length and a q-gram at a position) are merged by a heap,
equal words in a row are counted, those above the bound are compared directly.

The index is spread by blocks: cut the shorter word of a pair into three; the edit
is in one, and the other two are the same in both words, counted from the start
before the edit and from the end behind it. So a word goes to the group of each
length (its own, and one less) and block, named by the other blocks' letters, and
the q-grams of these letters are known to be shared without a look at them. Groups of
over MOST words are dealt again by each single letter of the block; such a group
has no more words than the alphabet allows for one letter, so none is without bound.
"""

from __future__ import annotations

from collections import defaultdict
from heapq import merge
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm._text import ascii_lower
from tributary.scratch import cut

Q, BLOCKS = 2, 3
#: Words of a group that one task indexes.
MOST = 4_096
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
RUN = "([A-Za-z\\u00C0-\\u00FF]{%d,}+)"


def occurrences(docs: DataFrame, text_col: str = "text", id_col: str | None = None, min_length: int = MIN_LENGTH) -> DataFrame:
    """(id, word), one row for each run of letters [A-Za-zÀ-ÿ] of min_length code points and more; A-Z are lower-cased."""
    found = docs.select(*([F.col(id_col).alias("id")] if id_col else []), F.explode(F.regexp_extract_all(text_col, F.lit(RUN % min_length), 1)).alias("word"))
    # Most words have no capital, and looking for one is cheaper than translating.
    return found.withColumn("word", F.when(F.col("word").rlike("[A-Z]"), ascii_lower(F.col("word"))).otherwise(F.col("word")))


def counted(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of min_length code points and more that occur min_count times and more."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _keyed(blocks: DataFrame) -> DataFrame:
    """(key, n, low, high, word): the key names the letters outside the block [low, high) of words of length n: those before it from the start, those behind it from the end.

    A word of one letter more has any two letters where the block has one.
    """
    rest = F.concat(F.expr("substring(word, 1, low)"), F.expr("substring(word, 1 + length(word) - n + high, n - high)"))
    return blocks.select(F.xxhash64("n", "low", "high", rest).alias("key"), "n", "low", "high", "word")


def _blocks(words: DataFrame) -> DataFrame:
    """(n, low, high, word): a word once for each block of its own length and of one less."""
    out = words.select("word", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("n")).where("n > 0")
    out = out.withColumn("k", F.least(F.lit(BLOCKS), "n")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return out.select("n", F.expr("CAST(j * n div k AS INT)").alias("low"), F.expr("CAST((j + 1) * n div k AS INT)").alias("high"), "word")


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): every pair of distinct words (column word, each once) exactly one edit apart, a < b."""
    whole = _keyed(_blocks(words))
    # Sizes are counted on the map side first; only keys with too many words come out of it.
    hot = whole.groupBy("key").agg(F.count("*").alias("words")).where(F.col("words") > most).select("key")
    cold = whole.join(hot, "key", "left_anti")
    again = whole.join(hot, "key", "left_semi").select("n", F.explode(F.sequence("low", F.col("high") - 1)).alias("low"), "word")
    again = _keyed(again.withColumn("high", F.col("low") + 1))
    dealt = cold.unionByName(again).repartition("key").sortWithinPartitions("key", "n", "low", "high", "word")
    return dealt.mapInArrow(_pairs, "a string, b string").distinct()


def _pairs(batches):
    """Pairs of the groups in a partition that is sorted by group; a group is held while it is worked on, no more."""
    group, name, found = [], None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "n", "low", "high", "word")]
        for key, n, low, high, word in zip(*columns):
            if name != (key, n, low, high):
                if len(group) > 1:
                    found.extend(_group_pairs(group, *name[1:]))
                group, name = [], (key, n, low, high)
            group.append(word)
        yield _batch(found)
        found = []
    if len(group) > 1:
        found.extend(_group_pairs(group, *name[1:]))
    yield _batch(found)


def _batch(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["a", "b"])


def _group_pairs(group: list[str], n: int, low: int, high: int):
    """Pairs of a group's words whose edit is in the block [low, high) of the shorter one, of length n.

    Only the q-grams that touch the block are indexed: of the n - q + 1 of the
    shorter word all others lie in the letters that the group shares.
    """
    first, last = max(0, low - Q + 1), min(high, n - Q + 1)
    postings: dict[tuple[str, int], list[int]] = defaultdict(list)
    shorter = [w for w in group if len(w) == n]
    known = n - Q + 1 - max(0, last - first)
    for i, w in enumerate(shorter):
        for k in range(first, last):
            postings[w[k : k + Q], k].append(i)
    for w in group:
        length = len(w)
        # Of all shared q-grams so many have to be among those that touch the block; one that is moved may be counted twice.
        bound = length - Q + 1 - Q - known
        if bound <= 0:
            near = shorter
        else:
            lists = [p for k in range(first, last + length - n) for d in ((0,) if length == n else (0, -1)) if (p := postings.get((w[k : k + Q], k + d)))]
            near = [shorter[i] for i, same in groupby(merge(*lists)) if sum(1 for _ in same) >= bound] if len(lists) >= bound else ()
        for other in near:
            if (length > n or other < w) and one_edit(other, w) and _first_block(other, w, low, high):
                yield (other, w) if other < w else (w, other)


def one_edit(a: str, b: str) -> bool:
    """Whether a, not the longer one, becomes b by one inserted or replaced code point."""
    k, most = 0, len(a)
    while k < most and a[k] == b[k]:
        k += 1
    return k < len(b) and a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else len(b) == most + 1 and a[k:] == b[k + 1 :]


def _first_block(a: str, b: str, low: int, high: int) -> bool:
    """Whether the block holds the last place at which the edit can be: so a pair comes out of one block's group only."""
    k, most = 0, len(a)
    while k < most and a[k] == b[k]:
        k += 1
    return low <= min(k, most - 1) < high


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n) and their near pairs (a, b).

    form is the near word of largest n (ties: the smallest by code points) if
    that is ratio times the word's n or more; root is where forms lead to in the
    end, the word itself if it has none.
    """
    if ratio < 2:
        raise ValueError("forms end for certain only if each is at least twice as frequent as the word before")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    both = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    follows = F.col("form_n") >= ratio * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(follows, F.col("best.near")).alias("form"), F.when(follows, F.col("form_n")).alias("form_n"))
    out = cut(out, "forms")
    steps = out.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    # n grows by the ratio with each step, so the largest one bounds the steps (19 at ratio 10), and each doubling goes twice as far.
    most = out.agg(F.max("form_n")).first()[0] or 0
    for _ in range((_steps(ratio, most) - 1).bit_length()):
        onward = steps.select(F.col("word").alias("via"), F.col("root").alias("onward"))
        steps = cut(steps.join(onward, F.col("root") == F.col("via"), "left").select("word", F.coalesce("onward", "root").alias("root")), "roots")
    return out.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _steps(ratio: int, most: int) -> int:
    """How many forms there can be one after the other if none has more than most occurrences, 1 at least."""
    steps, n = 1, ratio
    while n * ratio <= most:
        steps, n = steps + 1, n * ratio
    return steps


def group_variants(occurring: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """Spelling variants among the words of occurring (column word, a row an occurrence): forms() of the frequent ones.

    Null words are left out, an empty table gives no rows. Other columns are ignored.
    """
    words = cut(counted(occurring.select("word").where("word IS NOT NULL"), min_length, min_count), "words")
    return forms(words, near_pairs(words))


ORACLE = r"""
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
often AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS whole, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(whole, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x)::BIGINT // 64, 128 + unicode(x)::BIGINT % 64] END))),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM often, crc),
v AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n
  FROM (SELECT times, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
gone AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM gone a JOIN gone b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM gone g JOIN v ON g.less = v.word
  UNION SELECT v.word, g.word, g.n FROM gone g JOIN v ON g.less = v.word),
best AS (
  SELECT v.word, v.n, count(near.other) AS n_near, first(near.other ORDER BY near.m DESC, encode(near.other)) AS other, max(near.m) AS m
  FROM v LEFT JOIN near ON near.word = v.word GROUP BY v.word, v.n),
f AS (
  SELECT word, n, n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM best),
chain AS (
  WITH RECURSIVE c AS (
    SELECT word, word AS at FROM f
    UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
  SELECT c.word, c.at FROM c JOIN f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word
"""
