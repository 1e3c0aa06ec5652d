"""Domains of nodes, thresholds that follow from the graph's size, and hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.build import degrees
from tributary.schema import Graph


def segments(id_):
    """The dotted parts of an id, empty ones at the end left out."""
    return F.split(F.regexp_replace(id_, r"\.+$", ""), r"\.")


def pivot(nodes: DataFrame) -> DataFrame:
    """One row, pivot: the smallest depth from 2 whose parts, over ids with more parts than that, have 3 to 10 values; null if none."""
    parts = nodes.select(F.posexplode(segments(F.col("id"))).alias("pos", "part")).where("pos >= 2")
    kinds = parts.groupBy("pos").agg(F.countDistinct("part").alias("n")).where("n between 3 and 10")
    return kinds.agg(F.min("pos").alias("pivot"))


def assign(nodes: DataFrame, config: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, domain, confidence) of every node.

    config has (domain, prefix) pairs; the first whose prefix an id starts with
    decides, with HIGH confidence. Otherwise the pivot's part (MEDIUM), the third
    of four and more parts (MEDIUM), the first of two and more (LOW), ``unknown`` (LOW).
    """
    parts = segments(F.col("id"))
    rows = nodes.select("id", parts.alias("parts")).crossJoin(F.broadcast(pivot(nodes)))  # one row
    named = None
    for domain, prefix in config or []:
        hit = F.startswith("id", F.lit(prefix))
        named = F.when(hit, F.lit(domain)) if named is None else named.when(hit, F.lit(domain))
    named = F.lit(None).cast("string") if named is None else named
    deep = F.col("pivot").isNotNull() & (F.size("parts") > F.col("pivot"))
    domain = F.coalesce(named, F.when(deep, F.get("parts", F.col("pivot"))).when(F.size("parts") >= 4, F.get("parts", F.lit(2))).when(F.size("parts") >= 2, F.get("parts", F.lit(0))).otherwise("unknown"))
    trust = F.when(named.isNotNull(), "HIGH").when(deep | (F.size("parts") >= 4), "MEDIUM").otherwise("LOW")
    return rows.select("id", domain.alias("domain"), trust.alias("confidence"))


def thresholds(nodes: DataFrame, domains: DataFrame) -> DataFrame:
    """One row: coupling, cross_domain_max, max_call_depth, hotspot_cap."""
    n = nodes.agg(F.count("*").alias("n"))
    d = domains.agg(F.countDistinct("domain").alias("d"))
    return n.crossJoin(d).select(
        F.greatest(F.lit(3), F.floor(F.col("n") / 100)).cast("long").alias("coupling"),
        F.greatest(F.lit(2), F.ceil(F.col("d") * 3 / 10)).cast("long").alias("cross_domain_max"),
        F.lit(4).cast("long").alias("max_call_depth"),
        F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.col("n") / 10))).cast("long").alias("hotspot_cap"),
    )


def hotspots(graph: Graph, threshold: int | DataFrame) -> DataFrame:
    """(id, in_degree) of nodes with more dependents than the threshold; the most first, ties by id."""
    d = degrees(graph).select("id", "in_degree")
    if isinstance(threshold, DataFrame):
        d = d.crossJoin(F.broadcast(threshold.select("coupling"))).where("in_degree > coupling").drop("coupling")  # one row
    else:
        d = d.where(F.col("in_degree") > threshold)
    return d.orderBy(F.col("in_degree").desc(), "id")
