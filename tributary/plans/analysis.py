"""Whole analyses: a project, the impact of one target, the change between two snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators import change, domains, impact, structure
from tributary.schema import Graph
from tributary.scratch import cut, honest_sizes
from tributary.sources.config import Config
from tributary.sources.files import in_roots
from tributary.sources.frontends import FRONTENDS, JavaReader, Parsed, graph_of, parse


@dataclass
class Analysis:
    """A graph with its domains, thresholds, cycles, hotspots; blind spots, errors and warnings of reading it."""

    graph: Graph
    domains: DataFrame
    thresholds: DataFrame
    cycles: DataFrame
    hotspots: DataFrame
    blind_spots: DataFrame
    errors: DataFrame
    warnings: DataFrame

    def gate_blocked(self) -> bool:
        return bool(self.cycles.head(1))

    def sparse(self) -> bool:
        """Whether there are fewer edges than half the nodes, a sign of sources that weren't understood."""
        n, e = self.graph.counts().first()
        return n > 0 and e / n < 0.5

    def violations(self, config: Config, adaptive: bool = False) -> DataFrame:
        """What breaks the rules; adaptive takes the limit on domains from the graph's size."""
        most = self.thresholds.first().cross_domain_max if adaptive else config.max_cross_domain
        out = change.rule_max_cross_domain(self.graph, self.domains, most).unionByName(change.rule_max_call_depth(self.graph, config.max_call_depth))
        if config.no_cycle:
            out = out.unionByName(change.rule_no_cycle(self.cycles))
        if config.forbid_core_entity_leakage:
            listed = self.graph.nodes.where(F.col("id").isin(config.forbid_core_entity_leakage))
            out = out.unionByName(change.rule_entity_leakage(self.graph, self.domains, listed))
        return out


def analyse(files: DataFrame, config: Config | None = None, languages: list[str] | None = None, frontends: dict | None = None, all_java: bool = True, hooks: Iterable[Callable[[Parsed], Parsed]] = ()) -> Analysis:
    """Reads source files and analyses their graph; without any files, that of an empty graph.

    frontends replaces those of the library; without all_java, Java is read below source roots only.
    hooks see what all front ends found, and those before them, and declare more; the graph is built once, from all of it.
    """
    config = config or Config()
    honest_sizes(files.sparkSession)
    parsed = parse(config.visible(files if all_java else in_roots(files)), languages, frontends)
    for hook in hooks:
        parsed += hook(parsed)
    graph, warnings = graph_of(parsed)
    graph = Graph(cut(graph.nodes, "nodes"), cut(graph.edges, "edges"))
    found = cut(domains.assign(graph.nodes, config.prefixes()), "domains")
    limits = domains.thresholds(graph.nodes, found)
    return Analysis(graph, found, limits, cut(structure.cycles(graph.edges), "cycles"), domains.hotspots(graph, limits), parsed.blind_spots, parsed.errors, warnings)


@dataclass
class Change:
    """Differences of two snapshots, what they affect and at what risk."""

    base: Analysis
    head: Analysis
    nodes: DataFrame
    edges: DataFrame
    cycles: DataFrame
    changed: DataFrame
    risks: DataFrame
    summary: DataFrame
    impact: DataFrame


def compare(base_files: DataFrame, head_files: DataFrame, changed_files: list[str] | None = None, config: Config | None = None, depth: int = 3, languages: list[str] | None = None, all_java: bool = True) -> Change:
    """Both snapshots are resolved whole, so no difference is missed or made up; Java files that are the same in both are parsed once."""
    config = config or Config()
    shared = FRONTENDS | {"java": (FRONTENDS["java"][0], JavaReader())}
    head, base = (analyse(f, config, languages, shared, all_java) for f in (head_files, base_files))
    nodes, edges = cut(change.diff_nodes(base.graph, head.graph), "diff"), cut(change.diff_edges(base.graph, head.graph), "diff")
    cycles = change.diff_cycles(base.cycles, head.cycles)
    matched = None
    if changed_files is not None:
        paths = head_files.sparkSession.createDataFrame([(p,) for p in changed_files], "path string")
        matched = change.nodes_of_files(head.graph.nodes, paths)
    changed = cut(change.changed_nodes(nodes, edges, matched), "changed")
    members = cycles.where("change = 'new'").select(F.explode("members").alias("id"))
    risks = change.class_risk(head.graph, head.domains, changed, members, config.critical_paths)
    summary = change.risk_summary(risks, edges, cycles, head.domains, changed, config.critical_paths)
    starts = changed.join(head.graph.nodes.select("id"), "id", "left_semi").select(F.col("id").alias("target"))
    return Change(base, head, nodes, edges, cycles, changed, risks, summary, impact.impact(head.graph, starts, depth, head.domains))
