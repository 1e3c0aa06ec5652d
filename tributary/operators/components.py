"""Weakly connected components by alternating large-star and small-star rounds.

Each round replaces edges by edges to the smallest known neighbour. The number
of rounds is logarithmic in practice; no round gathers a component, and the
driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.scratch import cut, drop


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component) for every vertex with an edge to another one.

    component is the smallest id that can be reached, in either direction.
    Edges with a null end and loops are ignored; repeated edges count once. An
    empty table gives an empty table. Vertices without edges aren't listed.
    """
    e = cut(_directed(edges.select(F.col(u).alias("u"), F.col(v).alias("v"))), "edges")
    seen = _state(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = cut(_directed(small), "edges")
        drop(e)
        e, before, seen = after, seen, _state(after)
        if before == seen:
            break
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())


def _directed(edges: DataFrame) -> DataFrame:
    return edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(e: DataFrame) -> tuple:
    """Edge count and an order-free checksum: equal when a round changed nothing."""
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.xxhash64("v", "u") % 1000003).cast("long"))).first())
