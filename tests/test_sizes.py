"""Tables of many ids, in small files, are joined without gathering them in the driver."""

from pyspark.sql import functions as F

from tributary.operators import impact
from tributary.operators.build import build
from tributary.plans import demo
from tributary.scratch import cut, honest_sizes, new_path

ROWS = 300_000


def test_many_ids_in_small_files_are_not_broadcast(spark):
    path = new_path(spark, "data")
    spark.range(ROWS).select(F.col("id").alias("o_orderkey"), (F.col("id") % 5).alias("o_custkey")).write.parquet(f"{path}/orders.parquet")
    rows = demo.table(spark, path, "orders")
    id_ = F.concat(F.lit("db:"), demo.fk_id("orders", F.col("o_orderkey")))
    modules = rows.select(id_.alias("id"), F.lit("CLASS").alias("type"), F.lit(None).cast("string").alias("source_path"), F.lit("HIGH").alias("confidence"), F.col("o_orderkey").alias("seq"))
    other = F.concat(F.lit("db:"), demo.fk_id("orders", F.col("o_orderkey") + 1))
    deps = rows.select(id_.alias("source_id"), other.alias("target_id"), F.lit("USES").alias("edge_type"), F.lit("HIGH").alias("confidence"), F.lit(None).cast("string").alias("evidence"), F.lit(False).alias("dynamic"), F.lit(1).cast("long").alias("seq"))
    edges = build(cut(modules, "modules"), cut(deps, "dependencies")).edges
    first = edges._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in first, first
    assert edges.count() == ROWS - 1


def test_sizes_of_the_session(spark):
    keys = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes"]
    for k in keys:
        spark.conf.unset(k)
    honest_sizes(spark)
    assert [spark.conf.get(k) for k in keys] == ["8m", "-1", "16m"]
    spark.conf.set(keys[0], "3m")
    honest_sizes(spark)
    assert spark.conf.get(keys[0]) == "3m"
    spark.conf.set(keys[0], "8m")


def test_aggregates_after_a_shuffle_are_not_broadcast(spark):
    honest_sizes(spark)
    rows = cut(spark.range(ROWS).select(F.col("id").alias("u"), (F.col("id") * 7 % 1000).alias("v")), "rows")
    low = rows.groupBy("u").agg(F.min("v").alias("m")).where("m IS NOT NULL")
    one = rows.join(low, "u").agg(F.count("*").alias("n"))
    assert one.collect()[0].n == ROWS
    last = one._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin" not in last, last


def test_search_reads_a_table_of_edges_as_it_is(spark, monkeypatch):
    pairs = [("b", "a"), ("c", "b"), ("d", "c"), ("c", "a"), ("a", "a"), ("d", "d"), ("e", None)]
    rows = spark.createDataFrame(pairs * 3, "source string, target string")
    starts = spark.createDataFrame([("a",), ("b",), (None,)], "target string")
    plain = sorted(map(tuple, impact.reach(rows, starts, 3).collect()))
    labels = []
    monkeypatch.setattr(impact, "cut", lambda df, label: labels.append(label) or cut(df, label))
    assert sorted(map(tuple, impact.reach(cut(rows, "edges"), starts, 3).collect())) == plain
    assert plain == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("b", "c", 1), ("b", "d", 2)]
    assert "step" not in labels
