"""Reachability with a depth limit: blast radius, ancestors, tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.names import crosses, layer
from tributary.schema import HIGH, LOW, MEDIUM, Graph, risk_label
from tributary.scratch import cut, is_cut


def reach(edges: DataFrame, starts: DataFrame, depth: int, forward: bool = False) -> DataFrame:
    """(target, id, depth): what is reached from each start in 1 to depth steps, with the fewest.

    edges has source and target; starts has target. Dependents are followed
    backwards, dependencies forward. A start isn't visited to begin with, so on a
    cycle it reaches itself. Null and repeated starts add nothing.

    All starts are followed at once: they are dealt to groups of 64, and a node has one
    row a level and group, whose bits say which starts reach it first at that level.
    So a hub is joined with its neighbours once a group, not once a start, and
    messages to one node are united before they are shuffled. Only the result has a
    row for each start and node.
    """
    here, there = ("source", "target") if forward else ("target", "source")
    step = edges.select(F.col(here).alias("id"), F.col(there).alias("next")).where("id != next")
    if depth > 1 and not is_cut(edges):
        step = cut(step.distinct(), "step")  # each level reads it; a table can be read as it is, as edges that repeat send the same bits
    number = F.monotonically_increasing_id()
    starts = cut(starts.select("target").where("target is not null").distinct().select("target", number.alias("k")), "starts")
    group, bit = F.shiftright("k", 6), F.expr("shiftleft(1L, cast(k & 63 as int))")
    front, levels, seen = starts.select(F.col("target").alias("id"), group.alias("g"), bit.alias("bits")), [], None
    for d in range(1, depth + 1):
        sent = front.join(step, "id").groupBy(F.col("next").alias("id"), "g").agg(F.bit_or("bits").alias("bits"))
        if seen is not None:
            old = seen.groupBy("id", "g").agg(F.bit_or("bits").alias("old"))
            sent = sent.join(old, ["id", "g"], "left").select("id", "g", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0)))).alias("bits")).where("bits != 0")
        front = cut(sent, "frontier")
        if not front.head(1):
            break
        levels.append(front.withColumn("depth", F.lit(d)))
        seen = front if seen is None else seen.unionByName(front)
    if not levels:
        return starts.select("target", F.col("target").alias("id"), F.lit(0).alias("depth")).limit(0)
    found = reduce(DataFrame.unionByName, levels)
    each = found.select("id", "depth", "g", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b")).where("shiftright(bits, b) & 1 = 1")
    named = each.select("id", "depth", (F.shiftleft("g", 6) + F.col("b")).alias("k"))
    return named.join(starts, "k").select("target", "id", "depth")


def impact(graph: Graph, starts: DataFrame, depth: int = 3, domains: DataFrame | None = None, custom_layers: dict[str, str] | None = None) -> DataFrame:
    """(target, id, domain, depth, risk, layer, crosses) of everything that depends on the targets, directly or not.

    crosses says that the node itself depends on something in another domain.
    """
    found = reach(graph.edges, starts, depth)
    if domains is None:
        domains = graph.nodes.select("id", F.coalesce("domain", F.lit("")).alias("domain"))
    domains = domains.select("id", "domain")
    own = found.join(domains, "id", "left").withColumn("domain", F.coalesce("domain", F.lit("")))
    ends = graph.edges.select(F.col("source").alias("id"), F.col("target").alias("to")).join(domains.select(F.col("id").alias("to"), F.col("domain").alias("there")), "to")
    ends = ends.join(domains.select("id", F.col("domain").alias("here")), "id").where(crosses(F.col("here"), F.col("there"))).select("id", F.lit(True).alias("crosses")).distinct()
    risk = F.when(F.col("depth") >= 3, HIGH).when(F.col("depth") == 2, MEDIUM).otherwise(LOW)
    own = own.join(ends, "id", "left")
    return own.select("target", "id", "domain", "depth", risk_label(risk).alias("risk"), layer(F.col("id"), custom_layers).alias("layer"), F.coalesce("crosses", F.lit(False)).alias("crosses"))


def summary(impacted: DataFrame) -> DataFrame:
    """One row a target: total_affected, max_depth, cross_domain (affected nodes that reach into another domain)."""
    return impacted.groupBy("target").agg(F.count("*").alias("total_affected"), F.max("depth").alias("max_depth"), F.sum(F.col("crosses").cast("long")).alias("cross_domain"))


def by_layer(impacted: DataFrame) -> DataFrame:
    return impacted.groupBy("layer").agg(F.count("*").alias("n"))


def combined(impacted: DataFrame) -> DataFrame:
    """(id, depth): the impact of all targets together, each node at its least depth."""
    return impacted.groupBy("id").agg(F.min("depth").alias("depth"))


def ancestors(graph: Graph, target: str, impacted: DataFrame, depth: int = 3) -> DataFrame:
    """(id, depth): what target depends on, within some steps, as far as that isn't impacted by it."""
    spark = graph.nodes.sparkSession
    start = spark.range(1).select(F.lit(target).alias("target"))
    known = impacted.select("id").unionByName(start.select(F.col("target").alias("id"))).distinct()
    # The search reads these edges at every level.
    free = cut(graph.edges.join(known.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target"), "free")
    return reach(free, start, depth, forward=True).select("id", "depth")


def tiers(nodes: DataFrame, changed: DataFrame, impacted: DataFrame, domains: DataFrame) -> DataFrame:
    """(id, tier): 0 changed, 1 depends on a change, 2 shares a domain with one; other nodes have no row."""
    zero = changed.select("id", F.lit(0).alias("tier"))
    one = impacted.select("id", F.lit(1).alias("tier"))
    near = domains.join(changed, "id").select("domain").distinct()
    two = domains.join(near, "domain", "left_semi").select("id", F.lit(2).alias("tier"))
    found = zero.unionByName(one).unionByName(two).groupBy("id").agg(F.min("tier").alias("tier"))
    return found.join(nodes.select("id"), "id", "left_semi")


def resolve(nodes: DataFrame, name: str) -> DataFrame:
    """The node that a name means: its id, else the first id that ends in .name or /name."""
    rank = F.when(F.col("id") == name, 0).when(F.endswith("id", F.lit(f".{name}")) | F.endswith("id", F.lit(f"/{name}")), 1)
    hits = nodes.select("id", "seq", rank.alias("r")).where("r is not null")
    return hits.agg(F.min_by("id", F.struct("r", "seq", "id")).alias("id")).where("id is not null")
