"""Row schemas and the values that their enumerated columns take."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.scratch import cut, is_cut

NODES = "id string, type string, domain string, source_path string, tags array<string>, confidence string, seq long"
EDGES = "source string, target string, type string, confidence string, dynamic boolean, evidence string, seq long"
MODULES = "id string, type string, source_path string, confidence string, seq long"
DEPENDENCIES = "source_id string, target_id string, edge_type string, confidence string, evidence string, dynamic boolean, seq long"
BLIND_SPOTS = "type string, location string, description string"
DOMAINS = "id string, domain string, confidence string"
FILES = "path string, content string, length long"

# What the type, confidence and risk columns may hold; risks in ascending order.
NODE_TYPES = ("CLASS", "INTERFACE", "ENUM", "MODULE", "PACKAGE", "SERVICE", "CONTROLLER")
EDGE_TYPES = ("IMPORTS", "CALLS", "IMPLEMENTS", "EXTENDS", "USES", "SPRING_DI")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")
RISKS = ("LOW", "MEDIUM", "HIGH", "VERY_HIGH", "BLOCKED")
LOW, MEDIUM, HIGH, VERY_HIGH, BLOCKED = range(5)


def risk_label(rank: Column) -> Column:
    """The name of a risk rank."""
    return F.get(F.array(*[F.lit(r) for r in RISKS]), rank)


@dataclass(frozen=True)
class Graph:
    """A directed dependency graph: source depends on target. At most one edge an ordered pair, no loops, no loose ends."""

    nodes: DataFrame
    edges: DataFrame

    def node(self, id_: str) -> DataFrame:
        return self.nodes.where(F.col("id") == id_)

    def edge(self, source: str, target: str) -> DataFrame:
        return self.edges.where((F.col("source") == source) & (F.col("target") == target))

    def dependencies(self, id_: str) -> DataFrame:
        return self.edges.where(F.col("source") == id_).select(F.col("target").alias("id"))

    def dependents(self, id_: str) -> DataFrame:
        return self.edges.where(F.col("target") == id_).select(F.col("source").alias("id"))

    def counts(self) -> DataFrame:
        """One row: node_count, edge_count."""
        return self.nodes.agg(F.count("*").alias("node_count")).crossJoin(self.edges.agg(F.count("*").alias("edge_count")))


class Planned(Graph):
    """A graph whose tables are made when they are first read, each by itself: who reads nodes only doesn't wait for edges."""

    def __init__(self, nodes: DataFrame | Callable[[], DataFrame], edges: DataFrame | Callable[[], DataFrame]):
        object.__setattr__(self, "_plans", (nodes, edges))

    @cached_property
    def nodes(self) -> DataFrame:
        return self._table(0, "nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return self._table(1, "edges")

    def _table(self, k: int, label: str) -> DataFrame:
        plan = self._plans[k]
        return plan if isinstance(plan, DataFrame) else plan()


class Stored(Planned):
    """The same, and the tables are written then, unless they are already."""

    def _table(self, k: int, label: str) -> DataFrame:
        made = super()._table(k, label)
        return made if is_cut(made) else cut(made, label)
