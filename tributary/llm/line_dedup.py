"""Exact line deduplication across documents, by hashes of normalised lines.

DataFrame operations only. Lines become rows of two 64-bit hashes, the
document and the position. These are range-partitioned by hash (and by a slice
of the document ids, so that a line that a third of all documents hold is dealt
to many tasks), sorted by document and position within, and streamed: each
slice gives its first occurrence, which is the one in the largest document id,
and its number of documents. Slices of a hash are merged by a partial
aggregation. Only hashes that recur go on to the join that finds the positions
to drop; the result for each document is a run-length-compressed keep bitmap,
not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm._text import SPACE, ascii_lower
from tributary.scratch import cut

MIN_CHARS = 40
MIN_DOCS = 5
#: Slices that the occurrences of one hash are dealt to.
SLICES = 64


RESULTS = ("kept_text", "n_lines", "n_dropped", "keep_runs")


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated(occurrences: DataFrame, min_docs: int, slices: int = SLICES) -> DataFrame:
    """(h1, h2, last): hashes in at least min_docs documents, and the largest document with each."""
    dealt = occurrences.select("h1", "h2", "doc", "pos", F.pmod(F.xxhash64("doc"), F.lit(slices)).cast("int").alias("slice"))
    dealt = dealt.repartitionByRange("h1", "h2", "slice")
    stream = Window.partitionBy("h1", "h2", "slice").orderBy(F.col("doc").desc_nulls_last(), "pos")
    first = dealt.withColumn("new", (~F.col("doc").eqNullSafe(F.lag("doc").over(stream)) | F.lag("pos").over(stream).isNull()).cast("int"))
    # Of each document only its first line counts; of each slice the first document is the largest.
    runs = first.groupBy("h1", "h2", "slice").agg(F.sum("new").alias("n"), F.max("doc").alias("last"))
    return runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= min_docs).drop("n")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, text_hash, drops): runs of dropped lines for each document that loses any.

    A line's key is line_key(). Keys of at least min_chars code points that
    occur in at least min_docs documents lose their lines everywhere but in the
    document of largest id among those that hold them. drops is an array of
    (start, length), ascending; documents without any have no row. A document
    is its id and its text, so rows that repeat share one bitmap. Null ids are
    one document, smaller than all others.
    """
    text = F.col(text_col)
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(lines_of(text)).alias("pos", "line"))
    keys = lines.select("doc", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    occurrences = cut(keys.select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.reverse("key"), F.length("key")).alias("h2")), "lines")
    again = cut(repeated(occurrences, min_docs), "repeated")
    dropped = occurrences.join(again, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("last"))).select("doc", "text_hash", "pos")
    order = Window.partitionBy("doc", "text_hash").orderBy("pos")
    runs = dropped.withColumn("island", F.col("pos") - F.dense_rank().over(order))
    runs = runs.groupBy("doc", "text_hash", "island").agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + 1).alias("length"))
    return runs.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("drops"))


def kept_runs(drops: Column, n_lines: Column) -> Column:
    """The complement of runs of dropped lines: runs of kept ones, as (start, length)."""
    ends = F.concat(drops, F.array(F.struct(n_lines.alias("start"), F.lit(0).alias("length"))))

    def gap(d, i):
        before = F.get(ends, i - 1)
        start = F.when(i == 0, F.lit(0)).otherwise(before["start"] + before["length"])
        return F.struct(start.alias("start"), (d["start"] - start).alias("length"))

    return F.filter(F.transform(ends, gap), lambda r: r["length"] > 0)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with kept_text, n_lines, n_dropped and keep_runs after its own columns; own columns of these names give way.

    One row per row of docs. Other lines stay, joined by \\n. Null and empty
    texts have one empty line, which stays; a document that loses every line
    has an empty text. An empty table gives no rows.
    """
    own = [c for c in docs.columns if c.lower() not in RESULTS]
    docs = docs.select(*own)
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs).withColumnsRenamed({"doc": "__doc", "text_hash": "__hash", "drops": "__drops"})
    joined = docs.withColumn("__own", F.xxhash64(text_col))
    joined = joined.join(bitmaps, F.col(id_col).eqNullSafe(F.col("__doc")) & (F.col("__own") == F.col("__hash")), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = joined.withColumn("__lines", lines_of(F.col(text_col))).withColumn("n_lines", F.size("__lines"))
    out = out.withColumn("keep_runs", F.when(F.col("__drops").isNull(), F.array(F.struct(F.lit(0).alias("start"), F.col("n_lines").alias("length")))).otherwise(kept_runs(F.col("__drops"), F.col("n_lines"))))
    kept = F.flatten(F.transform("keep_runs", lambda r: F.slice(F.col("__lines"), r["start"] + 1, r["length"])))
    out = out.withColumn("kept_text", F.when(F.col("__drops").isNull(), text).otherwise(F.array_join(kept, "\n")))
    out = out.withColumn("n_dropped", F.coalesce(F.aggregate("__drops", F.lit(0).cast("long"), lambda a, r: a + r["length"]), F.lit(0).cast("long")))
    return out.withColumn("n_lines", F.col("n_lines").cast("long")).select(*own, *RESULTS)


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keys AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
again AS (
  SELECT key, max(doc_id) AS last FROM keys WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, a.key IS NOT NULL AND k.doc_id <> a.last AS dropped FROM keys k LEFT JOIN again a ON k.key = a.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS BIGINT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
