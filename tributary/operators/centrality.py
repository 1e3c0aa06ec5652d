"""PageRank, betweenness, closeness.

Betweenness and closeness go through all shortest paths, but never hold them:
sources are dealt in blocks, each block's paths are followed forth and back, and
what stays of them is a sum for each node. A weakly connected component of at most
``local_edges`` edges (counted beforehand) is sent to a task with each block of its
sources; larger ones are followed level by level with joins, as many
sources at a time as keep the table of reached nodes within ``state_rows``.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.structure import LOCAL_EDGES, bridges, split, weak_components
from tributary.schema import Graph
from tributary.scratch import cut, drop

DAMPING, ITERATIONS, TOLERANCE = 0.85, 30, 1e-6
#: Sources of a component that one task follows, and rows of (source, reached node) that a block of sources may have at once.
SOURCES, STATE_ROWS = 256, 100_000_000


class DensityError(ValueError):
    """The graph has too many edges for betweenness."""


def pagerank(graph: Graph, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, pagerank): ranks that add up to one.

    A node without dependencies passes nothing on; instead every iteration is
    scaled to a sum of one. It ends where no new rank, before scaling, is
    ``tolerance`` off the one before, and after so many iterations at most.
    """
    n = graph.nodes.count()
    if not n:
        return graph.nodes.select("id", F.lit(0.0).alias("pagerank"))
    links = graph.edges.select("source", "target").join(graph.edges.groupBy("source").agg(F.count("*").alias("out")), "source")
    links = cut(links, "links")
    ranks = cut(graph.nodes.select("id", F.lit(1.0 / n).alias("rank")), "ranks")
    total = 1.0
    for _ in range(iterations):
        now = ranks.select("id", (F.col("rank") / F.lit(total)).alias("rank"))
        sent = links.join(now, F.col("source") == F.col("id")).groupBy(F.col("target").alias("id")).agg(F.sum(F.lit(damping) * F.col("rank") / F.col("out")).alias("sent"))
        new = now.join(sent, "id", "left").select("id", (F.lit((1 - damping) / n) + F.coalesce("sent", F.lit(0.0))).alias("rank"), F.col("rank").alias("was"))
        new = cut(new, "ranks")
        total, change = new.agg(F.sum("rank"), F.max(F.abs(F.col("rank") - F.col("was")))).first()
        drop(ranks)
        ranks = new.drop("was")
        ranks._tributary_path = new._tributary_path
        if change < tolerance:
            break
    return ranks.select("id", (F.col("rank") / F.lit(total)).alias("pagerank"))


def check_density(graph: Graph) -> None:
    """Fails if there are more than V (ln V + 1) edges."""
    v, e = graph.nodes.count(), graph.edges.count()
    if v and e > v * (math.log(v) + 1):
        raise DensityError(f"{e} edges between {v} nodes are too many for betweenness; the limit is {v * (math.log(v) + 1):.0f}")


def path_sums(graph: Graph, local_edges: int = LOCAL_EDGES, state_rows: int = STATE_ROWS, sources: int = SOURCES) -> DataFrame:
    """(id, r, t, through) of every node with an edge: how many other nodes it leads to, their total distance, and the parts of others' shortest paths through it."""
    small, large = split(graph.edges, local_edges)
    kind = graph.edges.schema["source"].dataType.simpleString()
    ends = small.select("component", F.explode(F.array("source", "target")).alias("id")).distinct()
    blocks = ends.groupBy("component").agg(F.ceil(F.count("*") / sources).cast("int").alias("blocks"))
    dealt = small.join(blocks, "component").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    turn = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")) == F.col("block")
    dealt = dealt.select("component", "block", "source", "target", turn("source").alias("from_source"), turn("target").alias("from_target"))
    dealt = dealt.repartition("component", "block").sortWithinPartitions("component", "block")
    found = dealt.mapInArrow(_followed, f"id {kind}, r long, t long, through double")
    if large.head(1):
        found = found.unionByName(_levels(large, state_rows))
    return found.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("r", "t", "through")])


def _followed(batches):
    """path_sums() for a partition of whole components with a block of sources each, one after the other."""
    name, links, turns = None, [], {}
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("component", "block", "source", "target", "from_source", "from_target")]
        for component, block, s, t, a, b in zip(*columns, strict=True):
            if name != (component, block):
                if links:
                    yield _sums(links, turns, batch.schema.field("source").type)
                name, links, turns = (component, block), [], {}
            links.append((s, t))
            turns[s], turns[t] = a, b
    if links:
        yield _sums(links, turns, batch.schema.field("source").type)


def _sums(links: list[tuple], turns: dict, kind: pa.DataType) -> pa.RecordBatch:
    """Of the graph of some links, from the nodes whose turn it is: each node once, with its sums so far."""
    at = {x: k for k, x in enumerate(turns)}
    out: list[list[int]] = [[] for _ in at]
    for s, t in links:
        out[at[s]].append(at[t])
    n = len(at)
    reached, total, through = [0] * n, [0] * n, [0.0] * n
    for start in (k for x, k in at.items() if turns[x]):
        dist, paths, order, before = {start: 0}, {start: 1.0}, [start], {start: ()}
        for v in order:  # grows while it is read: first come, first served
            d, p = dist[v] + 1, paths[v]
            for w in out[v]:
                if w not in dist:
                    dist[w], paths[w], before[w] = d, p, [v]
                    order.append(w)
                elif dist[w] == d:
                    paths[w] += p
                    before[w].append(v)
        reached[start], total[start] = len(order) - 1, sum(dist.values())
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            part = (1.0 + share[w]) / paths[w]
            for v in before[w]:
                share[v] += paths[v] * part
            if w != start:
                through[w] += share[w]
    return pa.RecordBatch.from_arrays([pa.array(at, kind), pa.array(reached, pa.int64()), pa.array(total, pa.int64()), pa.array(through, pa.float64())], names=["id", "r", "t", "through"])


def _levels(edges: DataFrame, state_rows: int) -> DataFrame:
    """path_sums() by joins, for blocks of sources one after the other; only sums outlive a block."""
    step = cut(edges.select(F.col("source").alias("id"), F.col("target").alias("next")).repartition("id"), "steps")
    nodes = cut(edges.select(F.explode(F.array("source", "target")).alias("id")).distinct(), "nodes")
    blocks = -(-(n := nodes.count()) // max(1, state_rows // n))
    sums = None
    for b in range(blocks):
        one = _block_sums(step, nodes.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b))
        after = one if sums is None else cut(sums.unionByName(one).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("r", "t", "through")]), "sums")
        if sums is not None:
            drop(sums)
            drop(one)
        sums = after
    drop(step)
    drop(nodes)
    return sums


def _block_sums(step: DataFrame, starts: DataFrame) -> DataFrame:
    levels = [cut(starts.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths")), "paths")]
    while levels[-1].head(1):
        ahead = levels[-1].join(step, "id").groupBy("s", F.col("next").alias("id")).agg(F.sum("paths").alias("paths"))
        for seen in levels:
            ahead = ahead.join(seen.select("s", "id"), ["s", "id"], "left_anti")
        levels.append(cut(ahead.select("s", "id", "paths"), "paths"))
    out, later = None, None
    for d in range(len(levels) - 2, -1, -1):
        there = levels[d + 1].select("s", F.col("id").alias("next"), F.col("paths").alias("more"))
        there = there.withColumn("share", F.lit(0.0)) if later is None else there.join(later.withColumnRenamed("id", "next"), ["s", "next"], "left")
        part = (1 + F.coalesce("share", F.lit(0.0))) / F.col("more")
        passed = levels[d].join(step, "id").join(there.select("s", "next", part.alias("part")), ["s", "next"])
        level = cut(passed.groupBy("s", "id").agg(F.sum(F.col("paths") * F.col("part")).alias("share")), "shares")
        rows = level.where("s != id").select("id", F.lit(0).alias("r"), F.lit(0).alias("t"), F.col("share").alias("through"))
        if d:
            rows = rows.unionByName(levels[d].groupBy(F.col("s").alias("id")).agg(F.count("*").alias("r")).select("id", "r", (F.col("r") * d).alias("t"), F.lit(0.0).alias("through")))
        part = cut(rows.groupBy("id").agg(F.sum("r").alias("r"), F.sum("t").alias("t"), F.sum("through").alias("through")), "sums")
        out = part if out is None else _added(out, part)
        if later is not None:
            drop(later)
        later = level
    drop(later)
    for x in levels:
        drop(x)
    return out if out is not None else cut(starts.select("id", F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("t"), F.lit(0.0).alias("through")), "sums")


def _added(a: DataFrame, b: DataFrame) -> DataFrame:
    both = cut(a.unionByName(b).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("r", "t", "through")]), "sums")
    drop(a)
    drop(b)
    return both


def closeness(graph: Graph, sums: DataFrame | None = None) -> DataFrame:
    """(id, closeness): min(1, (r - 1) / T * (n - 1)) for r nodes reached at a total distance T, 0 for r < 2."""
    sums = path_sums(graph) if sums is None else sums
    n = graph.nodes.agg(F.count("*").alias("n"))
    rows = graph.nodes.select("id").join(sums, "id", "left").crossJoin(F.broadcast(n))  # one row
    score = F.least(F.lit(1.0), (F.col("r") - 1) / F.col("t") * (F.col("n") - 1))
    return rows.select("id", F.when(F.coalesce(F.col("r"), F.lit(0)) > 1, score).otherwise(0.0).alias("closeness"))


def betweenness(graph: Graph, sums: DataFrame | None = None, guard: bool = True) -> DataFrame:
    """(id, betweenness): shortest paths through a node, as a part of the largest value; ends don't count."""
    if guard:
        check_density(graph)
    sums = cut(path_sums(graph), "sums") if sums is None else sums
    top = F.broadcast(sums.agg(F.max("through").alias("top")))  # one row
    out = graph.nodes.select("id").join(sums, "id", "left").crossJoin(top)
    return out.select("id", F.when(F.col("top") > 0, F.coalesce("through", F.lit(0.0)) / F.col("top")).otherwise(0.0).alias("betweenness"))


def overview(graph: Graph) -> dict[str, DataFrame]:
    """centrality (id, pagerank), components (id, component) and bridges (u, v): what needs no paths between all pairs."""
    return {"centrality": pagerank(graph), "components": weak_components(graph.nodes, graph.edges), "bridges": bridges(graph.edges)}


def bundle(graph: Graph) -> dict[str, DataFrame]:
    """All of these: centrality (id, pagerank, betweenness, closeness), components (id, component), bridges (u, v), for graphs of any size.

    Where the graph is too dense for betweenness, that is null.
    """
    out = overview(graph)
    sums = cut(path_sums(graph), "sums")
    try:
        between = betweenness(graph, sums)
    except DensityError:
        between = graph.nodes.select("id", F.lit(None).cast("double").alias("betweenness"))
    return out | {"centrality": out["centrality"].join(between, "id").join(closeness(graph, sums), "id")}
