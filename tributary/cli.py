"""Commands: analyze a project or the impact of one target, and diff two snapshots."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import centrality, impact
from tributary.plans import analysis
from tributary.sinks import exports
from tributary.sources import config as settings
from tributary.sources.classes import class_files, class_roots, compiled
from tributary.sources.files import Git, scan
from tributary.sources.frontends import FRONTENDS, JS_EXTENSIONS, dependency_json

VERSION = "0.1.0"


def _options(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tributary", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("path")
    a.add_argument("--target")
    a.add_argument("--json", action="store_true")
    a.add_argument("--with-metadata", action="store_true")
    a.add_argument("--with-full-analysis", action="store_true")
    a.add_argument("--dot", metavar="FILE")
    a.add_argument("--mermaid", metavar="FILE")
    a.add_argument("--js-report", metavar="FILE", help="a dependency scanner's JSON report, read instead of scanning JavaScript")
    d = sub.add_parser("diff")
    d.add_argument("base", nargs="?", default="HEAD")
    d.add_argument("head", nargs="?")
    d.add_argument("path", nargs="?", default=".")
    d.add_argument("--ci", action="store_true")
    for s in (a, d):
        s.add_argument("--depth", type=int, default=3)
        s.add_argument("--languages", type=lambda x: x.split(","))
        s.add_argument("--format", choices=("text", "agent"), default="text")
        s.add_argument("--all-java", action="store_true", help="Java outside the source roots too, such as tests")
        s.add_argument("--config", help="settings, .tributary.yml in the project by default")
    return p.parse_args(argv)


def analyze(spark: SparkSession, o: argparse.Namespace) -> int:
    config = settings.load(o.config or f"{o.path}/.tributary.yml")
    frontends = FRONTENDS
    if o.js_report:
        frontends = FRONTENDS | {"js": (JS_EXTENSIONS, lambda _: dependency_json(spark, o.js_report))}
    hooks = [compiled(spark, class_files(spark, o.path))] if class_roots(spark, o.path) else []
    found = analysis.analyse(scan(spark, o.path), config, o.languages, frontends, o.all_java, hooks)
    if o.target:
        return _target(spark, o, found)
    if o.dot:
        with open(o.dot, "w", encoding="utf-8") as f:
            f.write(exports.text(exports.dot_lines(found.graph, found.domains)))
    if o.mermaid:
        with open(o.mermaid, "w", encoding="utf-8") as f:
            f.write(exports.text(exports.mermaid_lines(found.graph, found.domains, found.cycles)))
    if o.json:
        metadata = {"version": VERSION, "timestamp": datetime.now(UTC).isoformat()} if o.with_metadata else None
        full = centrality.bundle(found.graph) if o.with_full_analysis else None
        errors = [r.message for r in found.errors.orderBy("message").collect()]
        print(exports.analysis_json(found.graph, found.domains, found.cycles, found.hotspots, found.blind_spots, errors, metadata, full))
        return 0
    if o.format == "agent":
        print(exports.agent_json(found.graph, found.domains, found.cycles, found.hotspots, found.blind_spots))
    else:
        print("\n".join(summary_lines(found)))
    return int(found.gate_blocked())


def summary_lines(found: analysis.Analysis) -> list[str]:
    n, e = found.graph.counts().first()
    cap = found.thresholds.first().hotspot_cap
    out = [f"Nodes: {n}", f"Edges: {e}"]
    if found.sparse():
        out.append("Few dependencies were found for so many nodes; are all sources readable?")
    out += _capped(found.domains.groupBy("domain").agg(F.count("*").alias("n")), ["domain"], 100, "domains", lambda r: f"Domain {r.domain}: {r.n}")
    hot = found.hotspots.limit(cap + 1).collect()
    out += [f"Hotspot {r.id}: {r.in_degree} dependents" for r in hot[:cap]]
    if len(hot) > cap:
        out.append(f"... and {found.hotspots.count() - cap} more")
    out += [f"Cycle: {' -> '.join(r.members)}" for r in found.cycles.orderBy("cycle").limit(exports.TOP_CYCLES).collect()]
    out += [f"Blind spots of type {r.type}: {r.n}, first: {r.description}" for r in exports.spots_by_type(found.blind_spots).orderBy("type").collect()]
    return out + _capped(found.warnings, ["source", "target"], 20, "left out", lambda r: f"Left out: {r.source} -> {r.target} ({r.kind})")


def _capped(rows: DataFrame, order: list[str], cap: int, what: str, line) -> list[str]:
    """The first rows as lines, and how many more there are."""
    out = [line(r) for r in rows.orderBy(*order).limit(cap + 1).collect()]
    return out if len(out) <= cap else [*out[:cap], f"... and {rows.count() - cap} more {what}"]


def _target(spark: SparkSession, o: argparse.Namespace, found: analysis.Analysis) -> int:
    hit = impact.resolve(found.graph.nodes, o.target).head(1)
    if not hit:
        some = [r.id for r in found.graph.nodes.select("id").orderBy("id").limit(20).collect()]
        print("\n".join([f"{o.target} isn't in the graph. Some that are:", *some]), file=sys.stderr)
        return 1
    id_ = hit[0].id
    rows = impact.impact(found.graph, spark.createDataFrame([(id_,)], "target string"), o.depth, found.domains)
    if o.format == "agent" or o.json:
        print(exports.target_json(found.graph, found.domains, rows, id_, centrality.overview(found.graph)))
        return 0
    total = impact.summary(rows).head(1)
    print(f"{id_}: {total[0].total_affected if total else 0} affected, {total[0].cross_domain if total else 0} reach other domains")
    for r in rows.orderBy("depth", "id").limit(exports.DOCUMENT_ROWS).collect():
        print(f"{'  ' * r.depth}{r.id} [{r.domain}] {r.risk} {r.layer}")
    if total and total[0].total_affected > exports.DOCUMENT_ROWS:
        print(f"... and {total[0].total_affected - exports.DOCUMENT_ROWS} more")
    for r in impact.by_layer(rows).orderBy("layer").collect():
        print(f"{r.layer}: {r.n}")
    return 0


def diff(spark: SparkSession, o: argparse.Namespace) -> int:
    git = Git(o.path)
    if not git.available():
        print(f"{o.path} is no git repository", file=sys.stderr)
        return 2
    config = settings.load(o.config or f"{o.path}/.tributary.yml")
    head = git.snapshot(spark, o.head) if o.head else scan(spark, o.path)
    found = analysis.compare(git.snapshot(spark, o.base), head, git.changed(o.base, o.head), config, o.depth, o.languages, o.all_java)
    violations = found.head.violations(config)
    print("\n".join(exports.report_lines(found.edges, found.summary, found.impact, violations)))
    s = found.summary.first()
    blocked = s.new_cycles > 0 or s.overall_risk in ("HIGH", "VERY_HIGH", "BLOCKED")
    return int(blocked and (o.ci or o.format == "agent"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = _options(argv)
    spark = spark or SparkSession.builder.appName("tributary").getOrCreate()
    return (analyze if o.command == "analyze" else diff)(spark, o)


if __name__ == "__main__":
    sys.exit(main())
