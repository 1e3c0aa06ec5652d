"""What a change did: differences of two snapshots, risk, rules, gate."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.names import crosses, file_matches, on_critical_path
from tributary.operators.structure import cycles, strong_components
from tributary.schema import BLOCKED, HIGH, LOW, MEDIUM, VERY_HIGH, Graph, risk_label
from tributary.scratch import cut


def _both_ways(base: DataFrame, head: DataFrame, keys: list[str], names=("added", "removed")) -> DataFrame:
    """Keys of one side alone, each side shuffled once. A side has a key once, so nothing is gained before the shuffle."""
    sides = head.select(*keys, F.lit(2).alias("side")).unionByName(base.select(*keys, F.lit(1).alias("side")))
    found = sides.repartition(keys[0]).groupBy(*keys).agg(F.bit_or("side").alias("side")).where("side != 3")
    return found.select(F.when(F.col("side") == 2, names[0]).otherwise(names[1]).alias("change"), *keys)


def diff_nodes(base: Graph, head: Graph) -> DataFrame:
    """(change, id): added and removed nodes."""
    return _both_ways(base.nodes.select("id"), head.nodes.select("id"), ["id"]).select("change", "id")


def diff_edges(base: Graph, head: Graph) -> DataFrame:
    """(change, source, target, type): added and removed edges; a new type is one of each."""
    keys = ["source", "target", "type"]
    return _both_ways(base.edges.select(*keys), head.edges.select(*keys), keys).select("change", *keys)


def diff_cycles(base_cycles: DataFrame, head_cycles: DataFrame) -> DataFrame:
    """(change, members): new and fixed cycles, compared as sets of members."""
    return _both_ways(base_cycles.select("members"), head_cycles.select("members"), ["members"], ("new", "fixed")).select("change", "members")


def changed_nodes(nodes_diff: DataFrame, edges_diff: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """(id): nodes of changed files, added and removed nodes, and sources of changed edges."""
    out = nodes_diff.select("id").unionByName(edges_diff.select(F.col("source").alias("id")))
    return (out if matched is None else out.unionByName(matched.select("id"))).distinct()


def nodes_of_files(nodes: DataFrame, changed_files: DataFrame) -> DataFrame:
    """(id): nodes whose source path is a changed file, and those without one that a changed path names."""
    by_path = nodes.where("source_path is not null").join(changed_files.select(F.col("path").alias("source_path")).distinct(), "source_path", "left_semi").select("id")
    # An id can only match a path by its last part, so that is the join key.
    ext = F.regexp_extract("path", r"\.([^./]*)$", 1)
    files = changed_files.select("path", ext.alias("ext")).withColumn("last", F.when(F.col("ext") == "java", F.regexp_replace(F.substring_index("path", "/", -1), r"\.java$", "")).otherwise(F.substring_index("path", "/", -1)))
    loose = nodes.where("source_path is null").select("id")
    keyed = loose.select("id", F.explode(F.array_distinct(F.array(F.substring_index("id", ".", -1), F.substring_index("id", "/", -1)))).alias("last"))
    by_name = keyed.join(files, "last").where(file_matches(F.col("path"), F.col("id"), F.col("ext"))).select("id")
    return by_path.unionByName(by_name).distinct()


def risk(in_degree: Column, cross_domain: Column, call_depth: Column, critical: Column, in_cycle: Column, low_confidence: Column) -> Column:
    """The rank of the highest of all risks; low confidence raises any but LOW by one."""
    rank = F.greatest(
        F.when(in_degree > 10, HIGH).when(in_degree >= 5, MEDIUM).otherwise(LOW),
        F.when(cross_domain >= 3, HIGH).otherwise(LOW),
        F.when(call_depth >= 3, HIGH).otherwise(LOW),
        F.when(critical, HIGH).otherwise(LOW),
        F.when(in_cycle, VERY_HIGH).otherwise(LOW),
    )
    return F.when(low_confidence & (rank > LOW), F.least(rank + 1, F.lit(BLOCKED))).otherwise(rank)


def foreign_dependencies(graph: Graph, domains: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(id, n): how many dependencies of a node are in other domains than its own; of all nodes, or those in of (id)."""
    d = domains.select("id", "domain")
    e = graph.edges.select(F.col("source").alias("id"), "target")
    e = e if of is None else e.join(of.select("id"), "id", "left_semi")
    e = e.join(d, "id").join(d.select(F.col("id").alias("target"), F.col("domain").alias("there")), "target")
    return e.where(crosses(F.col("domain"), F.col("there"))).groupBy("id").agg(F.count("*").alias("n"))


def class_risk(head: Graph, domains: DataFrame, changed: DataFrame, new_cycle_members: DataFrame, critical: list[str]) -> DataFrame:
    """(id, risk) of the changed nodes that head has."""
    dependents = head.edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))
    rows = changed.select("id").distinct().join(head.nodes.select("id"), "id").join(dependents, "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    rows = rows.join(foreign_dependencies(head, domains, changed), "id", "left")
    rows = rows.join(new_cycle_members.select("id").distinct().withColumn("cyclic", F.lit(True)), "id", "left")
    rank = risk(F.col("in_degree"), F.coalesce("n", F.lit(0)), F.lit(0), on_critical_path(F.col("id"), _texts(critical)), F.coalesce("cyclic", F.lit(False)), F.lit(False))
    return rows.select("id", risk_label(rank).alias("risk"), rank.alias("rank"))


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def risk_summary(risks: DataFrame, edges_diff: DataFrame, cycles_diff: DataFrame, domains: DataFrame, changed: DataFrame, critical: list[str]) -> DataFrame:
    """One row: overall_risk (VERY_HIGH at least with a new cycle), new_cycles, cross_domain_edges, critical_hits."""
    d = domains.select("id", "domain")
    e = edges_diff.join(d.select(F.col("id").alias("source"), F.col("domain").alias("a")), "source").join(d.select(F.col("id").alias("target"), F.col("domain").alias("b")), "target")
    crossing = e.where(crosses(F.col("a"), F.col("b"))).agg(F.count("*").alias("cross_domain_edges"))
    fresh = cycles_diff.where("change = 'new'").agg(F.count("*").alias("new_cycles"))
    hits = changed.where(on_critical_path(F.col("id"), _texts(critical))).agg(F.count("*").alias("critical_hits"))
    top = risks.agg(F.coalesce(F.max("rank"), F.lit(LOW)).alias("top"))
    rows = top.crossJoin(fresh).crossJoin(crossing).crossJoin(hits)  # one row each
    rank = F.when(F.col("new_cycles") > 0, F.greatest("top", F.lit(VERY_HIGH))).otherwise(F.col("top"))
    return rows.select(risk_label(rank).alias("overall_risk"), "new_cycles", "cross_domain_edges", "critical_hits")


def gate(summary: DataFrame) -> DataFrame:
    """One row, gate_blocked: a new cycle, or an overall risk of HIGH and more."""
    return summary.select(((F.col("new_cycles") > 0) | F.col("overall_risk").isin("HIGH", "VERY_HIGH", "BLOCKED")).alias("gate_blocked"))


def rule_no_cycle(found_cycles: DataFrame) -> DataFrame:
    return _violation(found_cycles, "no_cycle", "ERROR", F.col("cycle"), F.array_join("members", ","))


def _violation(rows: DataFrame, rule: str, severity: str, subject: Column, details: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.alias("subject"), details.alias("details"))


def dependent_domains(graph: Graph, domains: DataFrame) -> DataFrame:
    """(id, n, domains): the other domains that a node's dependents are in."""
    d = domains.select("id", "domain")
    e = graph.edges.select(F.col("target").alias("id"), "source").join(d, "id").join(d.select(F.col("id").alias("source"), F.col("domain").alias("there")), "source")
    e = e.where(crosses(F.col("domain"), F.col("there")))
    return e.groupBy("id").agg(F.countDistinct("there").alias("n"), F.array_join(F.sort_array(F.collect_set("there")), ",").alias("domains"))


def rule_max_cross_domain(graph: Graph, domains: DataFrame, most: int = 2) -> DataFrame:
    found = dependent_domains(graph, domains).where(F.col("n") > most)
    return _violation(found, "max_cross_domain", "WARNING", F.col("id"), F.col("domains"))


def rule_entity_leakage(graph: Graph, domains: DataFrame, entities: DataFrame) -> DataFrame:
    """Listed entities (id) that nodes of other domains depend on."""
    found = dependent_domains(graph, domains).join(entities.select("id").distinct(), "id", "left_semi")
    return _violation(found, "forbid_core_entity_leakage", "ERROR", F.col("id"), F.col("domains"))


def call_depths(graph: Graph, bound: int) -> DataFrame:
    """(id, depth, exact): nodes on the longest simple path of dependents that starts at each node, itself included.

    Without cycles depths are settled by levels, without a bound. Nodes whose
    dependents meet a cycle are settled up to ``bound`` + 1 nodes, which is all that
    a rule with that limit asks; depths beyond are told as bound + 1, and exact is false.

    A path that leaves a strongly connected component never returns to it, so a
    simple path is known well enough by its length and its nodes in the component
    it starts in. Of these sets of nodes few are kept for each start and length:
    whatever can precede a path can also precede a kept one (see _Family). So
    there are no more rows than nodes times a number that depends on bound alone.
    """
    found, entered = _entered_depths(graph, bound)
    rest = graph.nodes.select("id").join(entered, "id", "left_anti")
    return found.unionByName(rest.select("id", F.lit(1).alias("depth"), F.lit(True).alias("exact")))


#: Levels that are put together in one table.
_LEVELS = 16


def _entered_depths(graph: Graph, bound: int) -> tuple[DataFrame, DataFrame]:
    """(id, depth, exact) of the nodes that have dependents, and these nodes (id)."""
    step = graph.edges.select(F.col("target").alias("id"), F.col("source").alias("next")).where("id != next")
    # Nodes without dependents have depth 1 and the others 2 at least; so only edges between the others are followed, and no cycle has another.
    entered = cut(step.select("id").distinct(), "entered")
    inner = cut(step.join(entered.withColumnRenamed("id", "next"), "next", "left_semi").select("id", "next").distinct(), "inner")
    labels = cut(strong_components(inner.select(F.col("next").alias("source"), F.col("id").alias("target"))), "labels")
    tainted = cut(_closure(inner.select(F.col("next").alias("id"), F.col("id").alias("next")), labels.select("id")), "tainted")
    cyclic = bool(tainted.head(1))
    clean, free = entered, inner
    if cyclic:
        clean = cut(entered.join(tainted, "id", "left_anti"), "clean")
        free = cut(inner.join(clean, "id", "left_semi"), "free")
    depth, last = clean.withColumn("depth", F.lit(2)), 2
    # Those that a path of last nodes starts at, level by level; without cycles there is a last one.
    front = clean
    while front.head(1):
        last += 1
        front = cut(free.join(front.withColumnRenamed("id", "next"), "next", "left_semi").select("id").distinct(), "front")
        depth = depth.unionByName(front.withColumn("depth", F.lit(last)))
        if last % _LEVELS == 0:
            depth = cut(depth.groupBy("id").agg(F.max("depth").alias("depth")), "depth")
    depth = cut(depth.groupBy("id").agg(F.max("depth").alias("depth")), "depth")
    found = depth.withColumn("exact", F.lit(True))
    if not cyclic:
        return found, entered
    alone = cut(graph.nodes.select("id").join(entered, "id", "left_anti").withColumn("depth", F.lit(1)), "alone")
    bent = _bent_depths(step.join(tainted, "id", "left_semi").distinct(), labels, tainted, depth.unionByName(alone), bound + 1)
    return found.unionByName(bent.select("id", "depth", (F.col("depth") <= bound).alias("exact"))), entered


def _bent_depths(step: DataFrame, labels: DataFrame, tainted: DataFrame, clean: DataFrame, most: int) -> DataFrame:
    """(id, depth): for the tainted nodes, up to most."""
    own = labels.select("id", F.col("cycle").alias("here"))
    to = labels.select(F.col("id").alias("next"), F.col("cycle").alias("there"))
    named = step.join(own, "id", "left").join(to, "next", "left")
    inside, across = named.where("here = there"), named.where("here IS NULL OR there IS NULL OR here != there")
    inside, across = cut(inside.select("id", "next"), "inside"), cut(across.select("id", "next"), "across")
    depth = tainted.withColumn("depth", F.lit(1))
    family = tainted.select("id", F.array("id").alias("path"))
    for k in range(2, most + 1):
        # On from paths within the component, and from nodes elsewhere that k - 1 nodes start at, whatever these are.
        grown = inside.join(family.withColumnRenamed("id", "next"), "next").where(~F.array_contains("path", F.col("id")))
        grown = grown.select("id", F.array_append("path", F.col("id")).alias("path"))
        ready = depth.where(F.col("depth") == k - 1).unionByName(clean.where(F.col("depth") >= k - 1)).select(F.col("id").alias("next")).distinct()
        fresh = across.join(ready, "next", "left_semi").select("id", F.array("id").alias("path")).distinct()
        family = cut(_few(grown.unionByName(fresh), most - k), "family")
        reached = family.select("id").distinct().withColumn("depth", F.lit(k))
        depth = cut(depth.unionByName(reached).groupBy("id").agg(F.max("depth").alias("depth")), "depth")
        if not family.head(1):
            break
    return depth


def _few(paths: DataFrame, ahead: int) -> DataFrame:
    """Of the paths of each id as many as matter if ahead more nodes are to precede them: first in each task, then for each id."""
    kind = paths.schema.simpleString().removeprefix("struct<").removesuffix(">").replace("id:", "id ", 1).replace(",path:", ", path ")

    def reduce(batches):
        kept, held = {}, 0
        for b in batches:
            for id_, path in zip(b.column("id").to_pylist(), b.column("path").to_pylist(), strict=True):
                held += kept.setdefault(id_, _Family(ahead)).add(path)
            if held > HELD_PATHS:
                yield _rows(kept, b.schema)
                kept, held = {}, 0
        if kept:
            yield _rows(kept, b.schema)

    return paths.mapInArrow(reduce, kind).repartition("id").sortWithinPartitions("id").mapInArrow(_by_id(ahead), kind)


#: Paths that a task holds before it passes on what it has.
HELD_PATHS = 200_000


def _by_id(ahead: int):
    """The same for partitions that are sorted by id and have all of its paths; ids are held until a batch ends, the last one until it does."""

    def reduce(batches):
        kept, last = {}, None
        for b in batches:
            for id_, path in zip(b.column("id").to_pylist(), b.column("path").to_pylist(), strict=True):
                last = id_
                kept.setdefault(id_, _Family(ahead)).add(path)
            yield _rows({k: v for k, v in kept.items() if k != last}, b.schema)
            kept = {last: kept[last]} if last in kept else {}
        if kept:
            yield _rows(kept, b.schema)

    return reduce


def _rows(kept: dict, schema: pa.Schema) -> pa.RecordBatch:
    pairs = [(id_, path) for id_, family in kept.items() for path in family.paths]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], schema.field("id").type), pa.array([p[1] for p in pairs], schema.field("path").type)], schema=schema)


class _Family:
    """Representatives of paths: for any set of ahead nodes, if some added path has none of them, a kept one has none of them.

    A tree: each place has a path, and a branch for each of its nodes, for sets with
    that node, down to ahead branches. A set is followed from the top along a node
    that it shares with the path there; where it shares none, or is used up, the
    path does. So a path goes to every empty place whose branches avoid its nodes.
    """

    def __init__(self, ahead: int):
        self.ahead, self.top, self.paths = ahead, None, []

    def add(self, path: list) -> bool:
        """Whether the path is kept."""
        nodes = set(path)
        if self.top is None:
            self.top = (path, {})
            self.paths.append(path)
            return True
        kept, todo = False, [(self.top, 0)]
        while todo:
            (there, branches), depth = todo.pop()
            if depth == self.ahead:
                continue
            for x in there:
                if x in nodes:
                    continue
                if x in branches:
                    todo.append((branches[x], depth + 1))
                else:
                    branches[x], kept = (path, {}), True
        if kept:
            self.paths.append(path)
        return kept


def _closure(step: DataFrame, start: DataFrame) -> DataFrame:
    """start and all that (id, next) steps lead to."""
    seen = front = cut(start.select("id").distinct(), "closure")
    while front.head(1):
        front = cut(front.join(step, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti"), "front")
        seen = seen.unionByName(front)
    return seen


def rule_max_call_depth(graph: Graph, most: int = 3) -> DataFrame:
    depths = call_depths(graph, most) if most < 1 else _entered_depths(graph, most)[0]  # nodes without dependents have depth 1
    found = depths.where(F.col("depth") > most)
    return _violation(found, "max_call_depth", "WARNING", F.col("id"), F.lit(f"more than {most}"))


def compare(base: Graph, head: Graph) -> dict[str, DataFrame]:
    """All differences: nodes, edges, cycles."""
    return {"nodes": diff_nodes(base, head), "edges": diff_edges(base, head), "cycles": diff_cycles(cycles(base.edges), cycles(head.edges))}
