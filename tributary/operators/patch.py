"""Snapshots that are brought up to date: only what changed files touch is built again.

A snapshot keeps its declarations with the file each comes from, loose ends included:
a dependency that leads nowhere now may lead to a module that a later change adds.
A patch replaces the declarations of changed files and builds again the nodes
these declare, the edges they declare or whose ends came or went, and components
and cycles of the weakly connected components in which a node or an edge came or
went. The result is that of a whole build.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.build import build, strip_namespace
from tributary.operators.structure import cycles, weak_components
from tributary.schema import Graph
from tributary.scratch import cut

_PAIR = ["source_id", "target_id"]


@dataclass
class Snapshot:
    """modules and dependencies are declarations with the path of their file; the rest follows from them.

    components (id, component) and cycles are made when they are first asked for.
    """

    modules: DataFrame
    dependencies: DataFrame
    graph: Graph
    _structure: Callable[[], tuple[DataFrame, DataFrame]]

    @cached_property
    def _made(self) -> tuple[DataFrame, DataFrame]:
        return self._structure()

    @property
    def components(self) -> DataFrame:
        return self._made[0]

    @property
    def cycles(self) -> DataFrame:
        return self._made[1]


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path): files (path, content) that came, went, or have another content digest. Null contents are alike."""
    digest = F.sha2(F.coalesce("content", F.lit("")), 256)
    b, a = before.select("path", digest.alias("b")), after.select("path", digest.alias("a"))
    return b.join(a, "path", "full").where("a IS NULL OR b IS NULL OR a != b").select("path")


def with_paths(modules: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declarations with the path of their file: a module's own, and that of the module that depends (null if it isn't declared)."""
    files = modules.groupBy("id").agg(F.min_by("source_path", "seq").alias("path"))
    return modules.withColumn("path", F.col("source_path")), deps.join(files.withColumnRenamed("id", "source_id"), "source_id", "left")


def snapshot(modules: DataFrame, deps: DataFrame) -> Snapshot:
    """The whole build of declarations with a column path."""
    modules, deps = cut(modules, "modules"), cut(deps, "dependencies")
    graph = build(modules, deps)
    graph = Graph(cut(graph.nodes, "nodes"), cut(graph.edges, "edges"))
    return Snapshot(modules, deps, graph, lambda: (cut(weak_components(graph.nodes, graph.edges), "components"), cut(cycles(graph.edges), "cycles")))


def patch(old: Snapshot, changed: DataFrame, modules: DataFrame, deps: DataFrame) -> Snapshot:
    """The snapshot after files changed: changed (path) lists them, modules and deps are what they now declare (nothing, for files that are gone).

    Paths that aren't in the snapshot are new files; declarations of paths that
    aren't listed are refused by being left out. Declarations without a path stay.
    """
    changed = cut(changed.select("path").where("path IS NOT NULL").distinct(), "changed")
    modules, deps = (cut(new.select(was.columns).join(changed, "path", "left_semi"), "new") for new, was in ((modules, old.modules), (deps, old.dependencies)))
    (kept_modules, gone_modules), (kept_deps, gone_deps) = _parted(old.modules, changed), _parted(old.dependencies, changed)
    all_modules, all_deps = kept_modules.unionByName(modules), kept_deps.unionByName(deps)

    ids = cut(gone_modules.select("id").unionByName(modules.select("id")).distinct(), "ids")
    bare = ids.select(strip_namespace(F.col("id")).alias("id")).distinct()
    redone = all_modules.withColumn("_bare", strip_namespace(F.col("id"))).join(bare.withColumnRenamed("id", "_bare"), "_bare", "left_semi").drop("_bare")
    fresh_nodes = build(redone, all_deps.limit(0)).nodes
    nodes = cut(old.graph.nodes.join(bare, "id", "left_anti").unionByName(fresh_nodes), "nodes")

    was, now = ids.join(old.modules.select("id"), "id", "left_semi"), ids.join(all_modules.select("id"), "id", "left_semi")
    flipped = cut(was.join(now, "id", "left_anti").unionByName(now.join(was, "id", "left_anti")), "flipped")
    pairs = gone_deps.select(*_PAIR).unionByName(deps.select(*_PAIR))
    # Distinct ends tell whether a kept dependency has such an end at all; most patches need no look at each of them.
    hit = cut(kept_deps.select(F.explode(F.array(*_PAIR)).alias("id")).distinct().join(flipped, "id", "left_semi"), "hit")
    if hit.head(1):
        end = lambda c: kept_deps.join(hit.withColumnRenamed("id", c), c, "left_semi").select(*_PAIR)
        pairs = pairs.unionByName(end("source_id")).unionByName(end("target_id"))
    pairs = cut(pairs.distinct(), "pairs")
    fresh = cut(build(all_modules, cut(all_deps.join(pairs, _PAIR, "left_semi"), "redone")).edges, "fresh")
    keys = pairs.select(strip_namespace(F.col("source_id")).alias("source"), strip_namespace(F.col("target_id")).alias("target"))
    # An edge whose end is gone has a flipped end, so its pair is among these.
    replaced = old.graph.edges.join(keys, ["source", "target"], "left_semi").select("source", "target")
    edges = cut(old.graph.edges.join(keys, ["source", "target"], "left_anti").unionByName(fresh), "edges")
    ends = flipped.select(strip_namespace(F.col("id")).alias("id"))
    return Snapshot(all_modules, all_deps, Graph(nodes, edges), lambda: _structure(old, nodes, edges, replaced, fresh.select("source", "target"), ends))


def _parted(declared: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declarations of files that aren't among the changed ones, and of those that are; dealt by path once."""
    marked = cut(declared.join(changed.withColumn("_changed", F.lit(True)), "path", "left").select(*declared.columns, "_changed"), "parted")
    return marked.where("_changed IS NULL").drop("_changed"), marked.where("_changed").drop("_changed")


def _structure(old: Snapshot, nodes: DataFrame, edges: DataFrame, replaced: DataFrame, fresh: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components and cycles after edges were replaced by fresh ones and the nodes in ends came or went."""
    moved = replaced.join(fresh, ["source", "target"], "left_anti").unionByName(fresh.join(replaced, ["source", "target"], "left_anti"))
    moved = moved.select(F.explode(F.array("source", "target")).alias("id")).unionByName(ends).distinct()
    touched = cut(old.components.join(moved, "id", "left_semi").select("component").distinct(), "touched")
    kept = old.components.join(touched, "component", "left_anti").select("id", "component")
    again = cut(nodes.select("id").join(kept, "id", "left_anti"), "again")
    # A component's edges have both ends in it, before and after; so the source tells.
    inside = cut(edges.join(again.withColumnRenamed("id", "source"), "source", "left_semi").select("source", "target"), "inside")
    steady = old.cycles.join(kept.select(F.col("id").alias("cycle")), "cycle", "left_semi").select(old.cycles.columns)
    return cut(kept.unionByName(weak_components(again, inside)), "components"), cut(steady.unionByName(cycles(inside)), "cycles")
