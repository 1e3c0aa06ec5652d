"""Graphs and analyses as JSON, compact JSON for agents, Graphviz DOT, Mermaid and text.

Every export is a DataFrame of ordered lines or rows first; a document as one
string is put together only for graphs whose size is checked.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.functions.names import label, mermaid_id, pastel, short_name
from tributary.operators.build import degrees
from tributary.operators.centrality import overview
from tributary.operators.impact import ancestors, combined
from tributary.operators.structure import bridge_nodes
from tributary.schema import Graph

VERSION = "1"
#: Nodes below which agents get the whole graph, and those below which they get all hotspots and bridges.
TIER1, TIER2 = 200, 500
TOP_HOTSPOTS, TOP_BRIDGES, TOP_CYCLES = 20, 30, 10
#: Nodes and edges that a document as one string may have.
DOCUMENT_ROWS = 200_000


def node_rows(graph: Graph) -> DataFrame:
    """(id, json) of every node: id, type, domain, sourcePath, confidence, without nulls."""
    one = F.struct("id", "type", "domain", F.col("source_path").alias("sourcePath"), "confidence")
    return graph.nodes.select("id", F.to_json(one).alias("json"))


def edge_rows(graph: Graph) -> DataFrame:
    """(source, target, json) of every edge."""
    return graph.edges.select("source", "target", F.to_json(F.struct("source", "target", "type", "confidence", "dynamic", "evidence")).alias("json"))


def domain_rows(domains: DataFrame) -> DataFrame:
    """(domain, ids): members of each domain, sorted."""
    return domains.groupBy("domain").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def _bounded(df: DataFrame, order: list) -> list:
    rows = df.orderBy(*order).limit(DOCUMENT_ROWS + 1).collect()
    if len(rows) > DOCUMENT_ROWS:
        raise ValueError(f"more than {DOCUMENT_ROWS} rows are too many for one document; write the rows instead")
    return rows


def graph_document(graph: Graph) -> dict:
    nodes = [json.loads(r.json) for r in _bounded(node_rows(graph), ["id"])]
    edges = [json.loads(r.json) for r in _bounded(edge_rows(graph), ["source", "target"])]
    return {"nodes": nodes, "edges": edges, "stats": {"nodeCount": len(nodes), "edgeCount": len(edges)}}


def to_json(graph: Graph) -> str:
    return json.dumps(graph_document(graph), indent=2, ensure_ascii=False)


def analysis_json(graph: Graph, domains: DataFrame, cycles: DataFrame, hotspots: DataFrame, blind_spots: DataFrame, errors: list[str] | None = None, metadata: dict | None = None, full: dict[str, DataFrame] | None = None) -> str:
    """The analysis as one document; with metadata (version, timestamp) and the full analysis if these are given."""
    spots = [{"type": r.type, "location": r.location, "description": r.description} for r in _bounded(blind_spots, ["type", "location", "description"])]
    out = {
        "graph": graph_document(graph),
        "domains": {r.domain: r.ids for r in _bounded(domain_rows(domains), ["domain"])},
        "cycles": [r.members for r in _bounded(cycles, ["cycle"])],
        "hotspots": [r.id for r in _bounded(hotspots, [F.col("in_degree").desc(), "id"])],
        "blindSpots": spots,
        "errors": list(errors or []),
    }
    if metadata:
        out["metadata"] = metadata
    if full:
        rows = _bounded(full["centrality"], ["id"])
        out["fullAnalysis"] = {
            "pageRank": {r.id: r.pagerank for r in rows},
            "betweenness": {r.id: r.betweenness for r in rows if r.betweenness is not None},
            "closeness": {r.id: r.closeness for r in rows},
            "connectedComponents": full["components"].select("component").distinct().count(),
            "bridges": [f"{r.u}->{r.v}" for r in _bounded(full["bridges"], ["u", "v"])],
        }
    return json.dumps(out, indent=2, ensure_ascii=False)


def _index(df: DataFrame, column: str) -> DataFrame:
    """column with a 0-based index in its order; for the small graphs of tier 1."""
    return df.select(column).distinct().withColumn("at", F.row_number().over(Window.orderBy(column)) - 1)


def agent_nodes(graph: Graph, domains: DataFrame, hotspots: DataFrame, ranks: DataFrame, found_bridges: DataFrame) -> DataFrame:
    """(at, id, domain_at, pr, risk, bridge, hotspot), one row a node: index, domain's index, rank times 10,000, and flags."""
    at = _index(graph.nodes, "id")
    names = _index(domains, "domain").withColumnRenamed("at", "domain_at")
    rows = at.join(domains.select("id", "domain"), "id", "left").join(names, "domain", "left").join(ranks.select("id", "pagerank"), "id", "left").join(degrees(graph), "id")
    rows = rows.join(hotspots.select("id", F.lit(1).alias("hot")), "id", "left").join(bridge_nodes(found_bridges).withColumn("b", F.lit(1)), "id", "left")
    return rows.select(
        "at", "id", F.coalesce("domain_at", F.lit(0)).alias("domain_at"), F.floor(F.coalesce("pagerank", F.lit(0.0)) * 10000 + 0.5).cast("long").alias("pr"),
        F.when(F.col("hot") == 1, 2).when(F.col("in_degree") > 2, 1).otherwise(0).alias("risk"), F.coalesce("b", F.lit(0)).alias("bridge"), F.coalesce("hot", F.lit(0)).alias("hotspot"),
    )


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def spots_by_type(blind_spots: DataFrame) -> DataFrame:
    """(type, n, description) of each type of blind spot, with the description of the first by location."""
    return blind_spots.groupBy("type").agg(F.count("*").alias("n"), F.min(F.struct("location", "description")).getField("description").alias("description"))


def _spots(blind_spots: DataFrame) -> dict:
    return {r.type: r.n for r in spots_by_type(blind_spots).orderBy("type").collect()}


def agent_json(graph: Graph, domains: DataFrame, cycles: DataFrame, hotspots: DataFrame, blind_spots: DataFrame, full: dict[str, DataFrame] | None = None) -> str:
    """A compact document whose detail goes down as the graph's size goes up."""
    full = full or overview(graph)
    n, e = graph.nodes.count(), graph.edges.count()
    out = {"v": VERSION, "n": n, "e": e, "cc": full["components"].select("component").distinct().count()}
    pairs = full["bridges"]
    if n < TIER1:
        rows = agent_nodes(graph, domains, hotspots, full["centrality"], pairs).orderBy("at").collect()
        at = {r.id: r["at"] for r in rows}
        out["domains"] = [r.domain for r in domains.select("domain").distinct().orderBy("domain").collect()] or ["unknown"]
        out["nodes"] = [[r.id, r.domain_at, r.pr, r.risk, r.bridge, r.hotspot] for r in rows]
        out["edges"] = [[at[r.source], at[r.target]] for r in graph.edges.orderBy("source", "target").collect()]
        out["bridges"] = [[at[r.u], at[r.v]] for r in pairs.orderBy("u", "v").collect()]
        out["bs"] = _spots(blind_spots)
        out["cycles"] = [r.members for r in cycles.orderBy("cycle").collect()]
        return _dump(out)
    capped = n >= TIER2
    out["domains"] = {r.domain: r["count"] for r in _bounded(domains.groupBy("domain").count(), ["domain"])}
    hot = hotspots.join(full["centrality"].select("id", "pagerank"), "id").orderBy(F.col("in_degree").desc(), "id").limit(TOP_HOTSPOTS if capped else TIER2)
    out["hotspots"] = [{"id": r.id, "pr": r.pagerank, "dependents": r.in_degree} for r in hot.collect()]
    out["bridges"] = [f"{r.u}->{r.v}" for r in pairs.orderBy("u", "v").limit(TOP_BRIDGES if capped else TIER2).collect()]
    out["bs"] = _spots(blind_spots)
    shorts = cycles.withColumn("names", F.array_join(F.transform("members", lambda m: short_name(m)), "->"))
    out["cycles"] = [[r.names, r.size] for r in shorts.select("cycle", "names", F.col("size")).orderBy("cycle").limit(TOP_CYCLES).collect()]
    if capped:
        out["hint"] = "Name a target for its impact alone"
    return _dump(out)


def target_json(graph: Graph, domains: DataFrame, impacted: DataFrame, target: str, full: dict[str, DataFrame]) -> str:
    """What a change of the target affects and what the target depends on (three steps), as a small graph."""
    ids = {r.id for r in _bounded(impacted.select("id"), ["id"])} | {target} | {r.id for r in _bounded(ancestors(graph, target, impacted), ["id"])}
    spark = graph.nodes.sparkSession
    some = spark.createDataFrame([(i,) for i in sorted(ids)], "id string")
    inner = graph.edges.join(some, F.col("source") == F.col("id"), "left_semi").join(some, F.col("target") == F.col("id"), "left_semi")
    inner = _bounded(inner.select("source", "target"), ["source", "target"])
    names = {r.id: r.domain for r in domains.join(some, "id", "left_semi").collect()}
    ranks = {r.id: r.pagerank for r in full["centrality"].join(some, "id", "left_semi").collect()}
    loose = {r.id for r in bridge_nodes(full["bridges"]).join(some, "id", "left_semi").collect()}
    depth = {r.id: r.in_degree for r in degrees(graph).join(some, "id", "left_semi").collect()}
    hot = {r.id for r in impacted.where("risk in ('HIGH', 'VERY_HIGH', 'BLOCKED')").select("id").collect()}
    order = sorted(depth)
    at = {x: i for i, x in enumerate(order)}
    kinds = sorted({names.get(x, "unknown") for x in order})
    steps = impacted.agg(F.count("*").alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first()
    nodes = [[x, kinds.index(names.get(x, "unknown")), int(ranks.get(x, 0.0) * 10000 + 0.5), 2 if x in hot else 1 if depth[x] > 2 else 0, int(x in loose), int(x in hot)] for x in order]
    near = full["bridges"].join(some, F.col("u") == F.col("id"), "left_semi").join(some, F.col("v") == F.col("id"), "left_semi")
    pairs = [[at[r.u], at[r.v]] for r in _bounded(near.select("u", "v"), ["u", "v"])]
    return _dump({"v": VERSION, "target": target, "n": len(order), "depth": steps.d, "e": len(inner), "affected": steps.n, "domains": kinds, "nodes": nodes, "edges": [[at[r.source], at[r.target]] for r in inner], "bridges": pairs})


def _lines(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _line(df: DataFrame, section: int, line, *keys) -> DataFrame:
    """Rows (section, k1, k2, k3, line), to be sorted by all but the last."""
    full = [*keys, F.lit(""), F.lit(""), F.lit("")][:3]
    return df.select(F.lit(section).alias("section"), *[F.coalesce(k, F.lit("")).alias(f"k{i + 1}") for i, k in enumerate(full)], line.alias("line"))


def dot_lines(graph: Graph, domains: DataFrame | None = None, clusters: bool = True) -> DataFrame:
    """(section, k1, k2, k3, line): a DOT drawing, in the order of the first four columns.

    With domains, nodes are in one cluster a domain, or coloured by domain.
    """
    one = graph.nodes.sparkSession.range(1)
    head = _lines(*[_line(one, 0, F.lit(x), F.lit(str(i))) for i, x in enumerate(("digraph dependencies {", "  rankdir=LR;", "  node [shape=box style=filled];"))])
    q = F.lit('"')
    edges = _line(graph.edges, 2, F.concat(F.lit("  "), q, "source", F.lit('" -> "'), "target", F.lit('";')), F.col("source"), F.col("target"))
    tail = _line(one, 3, F.lit("}"))
    rows = graph.nodes.select("id")
    named = rows.withColumn("domain", F.lit(None).cast("string")) if domains is None else rows.join(domains.select("id", "domain"), "id", "left")
    if domains is None or not clusters:
        colour = F.when(F.coalesce("domain", F.lit("")) == "", "white").otherwise(pastel(F.col("domain")))
        body = _line(named, 1, F.concat(F.lit('  "'), "id", F.lit('" [label="'), label(F.col("id")), F.lit('" fillcolor="'), colour, F.lit('"];')), F.col("id"))
        return _lines(head, body, edges, tail)
    named = named.withColumn("domain", F.coalesce("domain", F.lit("ungrouped")))
    groups = named.select("domain").distinct().withColumn("colour", pastel(F.col("domain")))
    d = F.col("domain")
    opening = [F.concat(F.lit('  subgraph "cluster_'), d, F.lit('" {')), F.concat(F.lit('    label="'), d, F.lit('";')), F.lit("    style=filled;"), F.concat(F.lit('    color="'), F.col("colour"), F.lit('";')), F.concat(F.lit('    fillcolor="'), F.col("colour"), F.lit('";')), F.lit("    penwidth=2;")]
    parts = [_line(groups, 1, x, d, F.lit(f"0{i}")) for i, x in enumerate(opening)]
    parts.append(_line(named, 1, F.concat(F.lit('    "'), "id", F.lit('" [label="'), label(F.col("id")), F.lit('"];')), d, F.lit("1"), F.col("id")))
    parts.append(_line(groups, 1, F.lit("  }"), d, F.lit("2")))
    return _lines(head, *parts, edges, tail)


def mermaid_lines(graph: Graph, domains: DataFrame, cycles: DataFrame) -> DataFrame:
    """(section, k1, k2, k3, line): a Mermaid flowchart, in the order of the first four columns."""
    one = graph.nodes.sparkSession.range(1)
    named = graph.nodes.select("id").join(domains.select("id", "domain"), "id", "left").withColumn("domain", F.coalesce("domain", F.lit("ungrouped")))
    d = F.col("domain")
    groups = named.select("domain").distinct()
    parts = [
        _line(one, 0, F.lit("flowchart TD")),
        _line(groups, 1, F.concat(F.lit("  subgraph "), mermaid_id(d), F.lit('["'), d, F.lit('"]')), d, F.lit("0")),
        _line(named, 1, F.concat(F.lit("    "), mermaid_id(F.col("id")), F.lit('["'), label(F.col("id")), F.lit('"]')), d, F.lit("1"), F.col("id")),
        _line(groups, 1, F.lit("  end"), d, F.lit("2")),
        _line(graph.edges, 2, F.concat(F.lit("  "), mermaid_id(F.col("source")), F.lit(" --> "), mermaid_id(F.col("target"))), F.col("source"), F.col("target")),
        _line(cycles.limit(1), 3, F.lit("  %% Cycles detected:")),
        _line(cycles, 4, F.concat(F.lit("  %% Cycle: "), F.array_join("members", " -> "), F.lit(" -> "), F.get("members", F.lit(0))), F.col("cycle")),
    ]
    return _lines(*parts)


def text(lines: DataFrame) -> str:
    """Lines as one string, for graphs within the bound of a document."""
    return "".join(r.line + "\n" for r in _bounded(lines, ["section", "k1", "k2", "k3"]))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines as text files in order, of any size."""
    lines.orderBy("section", "k1", "k2", "k3").select("line").write.text(path)


def report_lines(edges_diff: DataFrame, summary: DataFrame, impacted: DataFrame, violations: DataFrame | None = None, cap: int = 10) -> list[str]:
    """A change report as text: risk, changed edges (so many of each kind), impact by depth, violations.

    A node that several changes affect counts once, at its least depth.
    """
    s = summary.first()
    out = [f"Overall risk: {s.overall_risk}", f"New cycles: {s.new_cycles}", f"Cross-domain edge changes: {s.cross_domain_edges}", f"Critical path hits: {s.critical_hits}"]
    for change, sign in (("added", "+"), ("removed", "-")):
        some = edges_diff.where(F.col("change") == change)
        n = some.count()
        out.append(f"{change.capitalize()} dependencies: {n}")
        shown = some.select(short_name(F.col("source"), False).alias("s"), short_name(F.col("target"), False).alias("t"), "type").orderBy("s", "t", "type").limit(cap)
        out += [f"  {sign} {r.s} -> {r.t} [{r.type}]" for r in shown.collect()]
        if n > cap:
            out.append(f"  ... and {n - cap} more")
    out += [f"Depth {r.depth}: {r.n} affected" for r in combined(impacted).groupBy("depth").agg(F.count("*").alias("n")).orderBy("depth").collect()]
    if violations is not None:
        out += [f"{r.severity} {r.rule}: {r.subject} ({r.details})" for r in violations.orderBy("rule", "subject").limit(cap).collect()]
        more = violations.count() - cap
        out += [f"... and {more} more violations"] if more > 0 else []
    blocked = s.new_cycles > 0 or s.overall_risk in ("HIGH", "VERY_HIGH", "BLOCKED")
    return [*out, "Gate: BLOCKED" if blocked else "Gate: passed"]
