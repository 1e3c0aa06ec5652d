"""Chat formatting by multi-party perspective rotation.

Every dialogue is rendered once for each of its participants: that speaker's
turns are the assistant's, those of others are of users with names, and turns of
``system`` stay system turns in all renderings. The mask has the spans that a
model is trained on: what the assistant says, with the end marker.

A dialogue is rendered as parts of ``part_turns`` consecutive turns, so that one
with a third of all turns is many bounded rows. The parts' texts, joined in order,
are the rendering of the whole dialogue, and ``start`` says where in it a part
begins, so its masks are those of the whole, moved by start. Turns are numbered
without gathering a dialogue: equal rows are counted first, all rows are sorted in
ranges, and each range starts where those before it end. Starts follow from
counts and lengths alone. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.scratch import cut

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, UNNAMED = "system", "unknown"
PART_TURNS = 1024


def _numbered(rows: DataFrame, width: int) -> DataFrame:
    """rows (key, turn, role, said) with their position in the dialogue and its part, by number, role and SHA-256 of the text."""
    counted = rows.groupBy("key", "turn", "role", "said").agg(F.count("*").alias("n"))
    again = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / width))).alias("again")
    some = counted.select("*", F.sha2("said", 256).alias("tie"), again).withColumn("n", F.least(F.lit(width), F.col("n") - width * F.col("again")))
    order = ["key", "turn", "role", "tie", "again"]
    ranges = some.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = cut(ranges.select(F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("row"), "key", "turn", "role", "said", "n"), "turns")
    sizes = ranges.groupBy("key", "range").agg(F.sum("n").alias("size"))  # one row a range and dialogue
    earlier = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("key", "range", earlier(Window.partitionBy("key").orderBy("range")).alias("first"))
    inside = Window.partitionBy("key", "range").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(firsts, ["key", "range"])
    placed = placed.select("key", "turn", "role", "said", "first", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    placed = placed.withColumn("position", F.col("first") + F.col("before") + F.col("copy"))
    return placed.select("key", F.floor(F.col("position") / width).alias("part"), "position", "role", "said")


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, assistant, n_turns, start, text, mask): one row for each part of a dialogue and each participant of the dialogue.

    mask is an array of (start, end) in code points of text, end excluded; it
    is empty where the participant says nothing in the part. start is the number
    of code points of the parts before. Participants are all roles but system; a
    null role is ``unknown``. A dialogue of system turns alone has no rows. Turns
    are ordered by number, role and the text's SHA-256; repeated turns all stay;
    null numbers come first; null texts are empty. A null conv_id is a dialogue
    like others. In texts "<|" becomes "<\\|", so that none of them can forge a
    marker. Other columns are ignored; an empty table gives no rows.
    """
    said = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("<\\|"))
    # A structure is never null, so that joins keep the dialogue without an id.
    rows = turns.select(F.struct(F.col(conv_col).alias("conv")).alias("key"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(UNNAMED)).alias("role"), said.alias("said"))
    speakers = rows.where(F.col("role") != SYSTEM).select("key", F.col("role").alias("assistant")).distinct()
    numbered = _numbered(rows, part_turns)
    parts = numbered.groupBy("key", "part").agg(F.sort_array(F.collect_list(F.struct("position", "role", "said"))).alias("turns"))

    # Lengths: as if all speakers were users, less what naming one of them the assistant saves.
    around = len(START) + len("\n") + len(END) + len("\n")
    named = lambda role: F.when(role == SYSTEM, F.lit(len(SYSTEM))).otherwise(F.length(role) + len("user name="))
    lengths = numbered.groupBy("key", "part", "role").agg(F.count("*").alias("n"), F.sum(F.length("said") + around + named(F.col("role"))).alias("size"))
    lengths = lengths.groupBy("key", "part").agg(F.sum("size").alias("size"), F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("n"))
    saved = named(F.col("assistant")) - len("assistant")
    each = lengths.join(speakers, "key").select("key", "part", "assistant", (F.col("size") - F.coalesce(F.try_element_at("n", F.col("assistant")), F.lit(0)) * saved).alias("size"))
    before = Window.partitionBy("key", "assistant").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    both = parts.join(each.select("key", "part", "assistant", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")), ["key", "part"])

    def head(t):
        own = t["role"] == F.col("assistant")
        name = F.when(own, F.lit("assistant")).when(t["role"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.concat(F.lit(START), name, F.lit("\n"))

    segments = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["said"], F.lit(END)).alias("body"), (t["role"] == F.col("assistant")).alias("own")))
    both = both.select("key", "part", "assistant", F.col("start"), segments.alias("segments"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(acc, s):
        start = acc["at"] + F.length(s["head"])
        end = start + F.length(s["body"])
        span = F.when(s["own"], F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + 1).alias("at"), F.concat(acc["mask"], span).alias("mask"))

    text = F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "")
    return both.select(
        F.col("key.conv").alias(conv_col),
        "part",
        "assistant",
        F.size("segments").cast("long").alias("n_turns"),
        "start",
        text.alias("text"),
        F.aggregate("segments", zero, step)["mask"].alias("mask"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<\|') AS said FROM conversations),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(said)) - 1 AS position FROM t),
s AS (
  SELECT DISTINCT conv_id, role AS assistant FROM t WHERE role <> 'system'),
r AS (
  SELECT p.conv_id, p.position // 1024 AS part, s.assistant, p.position, p.role = s.assistant AS own,
         '<|im_start|>' || CASE WHEN p.role = s.assistant THEN 'assistant' WHEN p.role = 'system' THEN 'system' ELSE 'user name=' || p.role END || chr(10) AS head,
         p.said || '<|im_end|>' AS body
  FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, assistant ORDER BY position ROWS UNBOUNDED PRECEDING) - length(body) - 1 AS start
  FROM r),
g AS (
  SELECT conv_id, part, assistant, count(*) AS n_turns, CAST(sum(length(head) + length(body) + 1) AS BIGINT) AS n_chars,
         sha256(string_agg(head || body || chr(10), '' ORDER BY position)) AS text_sha256,
         coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(body) AS BIGINT), ',' ORDER BY position) FILTER (WHERE own), '') AS mask
  FROM o GROUP BY conv_id, part, assistant)
SELECT conv_id, part, assistant, n_turns, n_chars, text_sha256, mask,
       CAST(coalesce(sum(n_chars) OVER (PARTITION BY conv_id, assistant ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM g
"""
