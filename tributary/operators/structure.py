"""Cycles (strongly connected components) and bridges.

Both split the graph into weakly connected components first. A component whose
number of edges, which is counted, stays under ``local_edges`` is solved in one
task; larger ones are solved by rounds of joins. No component beyond that
bound is ever in one place. The rounds for bridges grow with the logarithm of
the nodes. For cycles, chains and trees are contracted first, in rounds that do so
too; only the depth of what is left, where most nodes lead to several and from several, counts in full.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.operators.components import connected_components
from tributary.scratch import cut, drop

#: Edges of a component that one task may hold.
LOCAL_EDGES = 200_000


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node; a node without edges is its own component."""
    found = connected_components(edges, "source", "target")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def split(edges: DataFrame, local_edges: int) -> tuple[DataFrame, DataFrame]:
    """Edges with their component, of components within the bound and beyond it."""
    plain = edges.select("source", "target").where("source != target").distinct()
    named = plain.join(connected_components(plain, "source", "target"), F.col("source") == F.col("id")).select("component", "source", "target")
    sizes = named.groupBy("component").agg(F.count("*").alias("n"))
    named = cut(named.join(sizes, "component"), "components")
    return named.where(F.col("n") <= local_edges).drop("n"), named.where(F.col("n") > local_edges).drop("n")


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, cycle): members of strongly connected components of two nodes and more; cycle is the smallest member."""
    peeled = _peeled(edges)
    small, large = split(peeled, local_edges)
    drop(peeled)
    found = small.groupBy("component").applyInPandas(_tarjan, f"id {_kind(edges)}, cycle {_kind(edges)}")
    if large.head(1):
        found = found.unionByName(_by_contraction(large))
    return found


#: Peeling goes on while a round takes at least one of so many edges.
_PEEL = 8


def _peeled(edges: DataFrame) -> DataFrame:
    """(source, target) without edges that are on no cycle because nothing leads to their source or their target leads nowhere.

    Layered graphs are gone after a few rounds, before any component is looked for;
    rounds end as soon as they take little, so that long chains don't make many.
    """
    live, n, before = edges.select("source", "target").where("source != target"), None, None
    while n is None or before is None or (n and (before - n) * _PEEL >= before):
        # One end after the other: of layered graphs the first leaves little to look for the second.
        entered = cut(live.join(live.select(F.col("target").alias("x")).distinct(), F.col("source") == F.col("x"), "left_semi"), "entered")
        drop(live)
        less = cut(entered.join(entered.select(F.col("source").alias("x")).distinct(), F.col("target") == F.col("x"), "left_semi"), "peeled")
        drop(entered)
        live, before, n = less, n, less.count()
        if not n:
            break
    return live


def _kind(edges: DataFrame) -> str:
    return edges.schema["source"].dataType.simpleString()


def _tarjan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strongly connected components by two passes over one component, with stacks of their own (no recursion)."""
    out: dict = {}
    back: dict = {}
    for s, t in zip(pdf["source"], pdf["target"], strict=True):
        out.setdefault(s, []).append(t)
        back.setdefault(t, []).append(s)
    order, seen = [], set()
    for root in out:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(out[root]))]
        while stack:
            node, rest = stack[-1]
            for to in rest:
                if to not in seen:
                    seen.add(to)
                    stack.append((to, iter(out.get(to, ()))))
                    break
            else:
                stack.pop()
                order.append(node)
    rows, placed = [], set()
    for root in reversed(order):
        if root in placed:
            continue
        placed.add(root)
        group, todo = [root], [root]
        while todo:
            for to in back.get(todo.pop(), ()):
                if to not in placed:
                    placed.add(to)
                    group.append(to)
                    todo.append(to)
        if len(group) > 1:
            low = min(group)
            rows += [(x, low) for x in group]
    return pd.DataFrame(rows, columns=["id", "cycle"])


#: Contraction goes on while two rounds together take at least one of so many edges.
_WORTH = 32


def _by_contraction(edges: DataFrame) -> DataFrame:
    """Strongly connected components by contraction, forward and backward searches on what is left, and the way back.

    A node x that leads to one node w alone is on a cycle exactly if w leads to one of the nodes u that
    lead to x. So x is taken out, with edges from each u to w instead, and joins w's
    component on the way back if a u is in it (or is w). What no other node leads to has no u. The same
    holds with all directions turned. Coins pick nodes so that none is taken out with the node that it leads to;
    a quarter of those with one link goes in each round.
    """
    live, taken, k, last = cut(edges.select("source", "target").where("source != target").distinct(), "live"), [], 0, None
    while True:
        here, there = ("source", "target") if k % 2 == 0 else ("target", "source")
        coin = lambda c: F.xxhash64(F.col(c), F.lit(k // 2)).bitwiseAND(F.lit(1))  # noqa: B023, E731
        ends = live.groupBy(F.col(here).alias("x")).agg(F.min(there).alias("w"), F.max(there).alias("other")).where("w = other")
        moved = cut(ends.select("x", "w").where((coin("x") == 1) & (coin("w") == 0)), "moved")
        stay = live.join(moved.select(F.col("x").alias(here)), here, "left_anti")
        after = cut(stay.join(moved.select(F.col("x").alias(there), "w"), there, "left").select("source", "target", "w"), "contracted")
        drop(moved)
        taken.append((after, here, there))
        live = after.select(F.col(here), F.coalesce("w", there).alias(there)).where("source != target")
        m, n = after.agg(F.count("*"), F.count("w")).first()
        if m == 0 or (last is not None and (n + last) * _WORTH < m):
            break
        last, k = n, k + 1
    found = _coloured(live.distinct())
    for after, here, there in reversed(taken):
        name = cut(found.select("id", "cycle"), "names")
        undo = after.where("w is not null").select(F.col(here).alias("u"), F.col(there).alias("x"), "w").distinct()
        of = lambda c: name.select(F.col("id").alias(c), F.col("cycle").alias(f"of_{c}"))  # noqa: B023, E731
        both = undo.join(of("u"), "u", "left").join(of("w"), "w", "left").where(F.coalesce("of_u", "u") == F.coalesce("of_w", "w"))
        new = both.select(F.explode(F.array("x", "w")).alias("id"), F.coalesce("of_w", "w").alias("cycle"))
        found = name.unionByName(new).distinct()
    found = cut(found, "names")
    for after, _, _ in taken:
        drop(after)
    return found.join(found.groupBy("cycle").agg(F.min("id").alias("low")), "cycle").select("id", F.col("low").alias("cycle"))


def _coloured(edges: DataFrame) -> DataFrame:
    """The same by colouring: the largest id that reaches a node is its colour, and what reaches that id within the colour is its component."""
    live, found = cut(edges.select("source", "target"), "live"), None
    while live.head(1):
        # Nodes that nothing leads to, or that lead nowhere, are on no cycle.
        n, before = live.count(), -1
        while n and n != before:
            starts, ends = live.select(F.col("source").alias("x")).distinct(), live.select(F.col("target").alias("x")).distinct()
            less = cut(live.join(starts, F.col("target") == F.col("x"), "left_semi").join(ends, F.col("source") == F.col("x"), "left_semi"), "live")
            drop(live)
            live, before, n = less, n, less.count()
        if not n:
            break
        colour = cut(live.select(F.col("source").alias("id")).unionByName(live.select(F.col("target").alias("id"))).distinct().withColumn("colour", F.col("id")), "colour")
        while True:
            sent = live.join(colour.withColumnRenamed("id", "source"), "source").select(F.col("target").alias("id"), "colour")
            after = cut(colour.unionByName(sent).groupBy("id").agg(F.max("colour").alias("colour")), "colour")
            same = after.join(colour, ["id", "colour"], "left_anti").head(1) == []
            drop(colour)
            colour = after
            if same:
                break
        tinted = live.join(colour.select(F.col("id").alias("source"), F.col("colour").alias("c")), "source").join(colour.select(F.col("id").alias("target"), F.col("colour").alias("d")), "target")
        inside = cut(tinted.where("c = d").select("source", "target"), "inside")
        members = cut(colour.where("id = colour"), "members")
        front = members
        while front.head(1):
            reached = inside.join(front, F.col("target") == F.col("id")).select(F.col("source").alias("id"), "colour").distinct()
            front = cut(reached.join(members, ["id"], "left_anti"), "front")
            members = cut(members.unionByName(front), "members")
        found = members if found is None else found.unionByName(members)
        gone = members.select(F.col("id").alias("x"))
        live = cut(live.join(gone, F.col("source") == F.col("x"), "left_anti").join(gone, F.col("target") == F.col("x"), "left_anti"), "live")
    if found is None:
        return edges.select(F.col("source").alias("id"), F.col("target").alias("cycle")).limit(0)
    lows = found.groupBy("colour").agg(F.min("id").alias("cycle"), F.count("*").alias("n")).where("n > 1")
    return found.join(lows, "colour").select("id", "cycle")


def cycles(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(cycle, members, size): one row a cycle, members sorted."""
    found = strong_components(edges, local_edges).groupBy("cycle").agg(F.sort_array(F.collect_list("id")).alias("members"))
    return found.select("cycle", "members", F.size("members").cast("long").alias("size"))


def bridges(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(u, v), u < v: edges of the undirected simple graph without which a component falls apart."""
    pairs = cut(edges.where("source != target").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct(), "pairs")
    # Rounds carry each node several times a row, so they get numbers instead of ids.
    numbers = cut(pairs.select(F.explode(F.array("source", "target")).alias("id")).distinct().select("id", F.monotonically_increasing_id().alias("k")), "numbers")
    of = lambda c, k: numbers.select(F.col("id").alias(c), F.col("k").alias(k))
    numbered = pairs.join(of("source", "u"), "source").join(of("target", "v"), "target").select(F.col("u").alias("source"), F.col("v").alias("target"))
    small, large = split(numbered, local_edges)
    drop(pairs)
    found = small.groupBy("component").applyInPandas(_low_links, "u long, v long")
    if large.head(1):
        found = found.unionByName(_xor_bridges(large, local_edges))
    named = found.join(of("a", "u"), "u").join(of("b", "v"), "v")
    return named.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _low_links(pdf: pd.DataFrame) -> pd.DataFrame:
    near: dict = {}
    for s, t in zip(pdf["source"], pdf["target"], strict=True):
        near.setdefault(s, []).append(t)
        near.setdefault(t, []).append(s)
    root = min(near)
    entered, low, rows = {root: 0}, {root: 0}, []
    stack = [(root, None, iter(near[root]))]
    while stack:
        node, parent, rest = stack[-1]
        for to in rest:
            if to == parent:
                continue
            if to in entered:
                low[node] = min(low[node], entered[to])
            else:
                entered[to] = low[to] = len(entered)
                stack.append((to, node, iter(near[to])))
                break
        else:
            stack.pop()
            if parent is not None:
                low[parent] = min(low[parent], low[node])
                if low[node] > entered[parent]:
                    rows.append((min(node, parent), max(node, parent)))
    return pd.DataFrame(rows, columns=["u", "v"])


def _xor_bridges(pairs: DataFrame, local_edges: int = 0) -> DataFrame:
    """Bridges in a number of rounds that grows with the logarithm of the nodes, however deep the graph is.

    Every edge outside a spanning forest has a random tag, a node the xor of its
    edges' tags; a forest edge is a bridge if the tags on one side of it cancel out.
    The sides are stretches of a walk around the tree, which comes in along each
    edge once from either end; the xor of what follows in the walk is added up by
    pointers that jump twice as far each time.
    """
    kind = _kind(pairs)
    tree = cut(forest(pairs, local_edges), "tree")
    rest = pairs.select("source", "target").join(tree, ["source", "target"], "left_anti").withColumn("tag", F.xxhash64("source", "target"))
    tags = rest.select(F.explode(F.array("source", "target")).alias("v"), "tag").groupBy("v").agg(F.bit_xor("tag").alias("tag"))
    walk = cut(_walk(tree, pairs.select("component").distinct(), tags), "walk")
    while walk.where("next_u IS NOT NULL").head(1):
        after = cut(_jumped(_jumped(walk)), "walk")
        drop(walk)
        walk = after
    ends = walk.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.bit_xor("x").alias("x"))
    return ends.where("x = 0").select(F.col("u").cast(kind), F.col("v").cast(kind))


def _jumped(walk: DataFrame) -> DataFrame:
    """Each step's xor and pointer moved on to where the next step's point; steps at the end of their walk stay out of the join."""
    on = walk.select(F.col("u").alias("next_u"), F.col("v").alias("next_v"), F.col("x").alias("more"), F.col("next_u").alias("far_u"), F.col("next_v").alias("far_v"))
    moved = walk.where("next_u IS NOT NULL").join(on, ["next_u", "next_v"])
    moved = moved.select("u", "v", F.col("x").bitwiseXOR(F.col("more")).alias("x"), F.col("far_u").alias("next_u"), F.col("far_v").alias("next_v"))
    return moved.unionByName(walk.where("next_u IS NULL"))


#: Neighbours of a node that one task puts in a row.
WIDE = 100_000


def _walk(tree: DataFrame, roots: DataFrame, tags: DataFrame) -> DataFrame:
    """(u, v, x, next_u, next_v): the steps of a walk around each tree, from its smallest node (component) on.

    After a step from u to v comes the one from v to its neighbour after u, in any
    order that goes around; neighbours of hubs are put in rows of WIDE, and these
    rows one behind the other. x is v's tag at one of the steps that lead to v, else 0.
    """
    steps = tree.select(F.col("source").alias("u"), F.col("target").alias("v")).unionByName(tree.select(F.col("target").alias("u"), F.col("source").alias("v")))
    sizes = steps.groupBy("v").agg(F.min("u").alias("first"), F.ceil(F.count("*") / WIDE).alias("rows"))
    steps = steps.join(sizes, "v").withColumn("row", F.when(F.col("u") == F.col("first"), 0).otherwise(F.pmod(F.xxhash64("u"), F.col("rows"))))
    # The first neighbour leads the first row, so the last row's end goes on to it.
    heads = steps.groupBy("v", "row").agg(F.min("u").alias("head"))
    heads = heads.withColumn("after", F.lead("head").over(Window.partitionBy("v").orderBy("row"))).select("v", "row", "after")
    steps = steps.withColumn("beside", F.lead("u").over(Window.partitionBy("v", "row").orderBy("u"))).join(heads, ["v", "row"])
    steps = steps.join(tags, "v", "left").join(roots.select(F.col("component").alias("v"), F.lit(True).alias("root")), "v", "left")
    to = F.coalesce("beside", "after")
    to = F.when(to.isNull() & F.col("root").isNull(), F.col("first")).otherwise(to)
    tag = F.when(F.col("u") == F.col("first"), F.coalesce("tag", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    return steps.select("u", "v", tag.alias("x"), F.when(to.isNotNull(), F.col("v")).alias("next_u"), to.alias("next_v"))


def forest(pairs: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(source, target): edges that connect what pairs connect, without a cycle.

    In each round every node takes one of its edges, in an order that is drawn anew
    each time, so chains of choices are short; what they connect becomes one node.
    Half of the nodes go in every round at least. What fits into one task is done there.
    """
    live, found, salt = cut(pairs.select(F.col("source").alias("a"), F.col("target").alias("b"), "source", "target"), "live"), None, 0
    while n := live.count():
        if n <= local_edges:
            last = live.coalesce(1).mapInPandas(_kruskal, f"source {_kind(pairs)}, target {_kind(pairs)}")
            return last if found is None else found.unionByName(last)
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "source", "target"))
        taken = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("source", "target", F.lit(salt)).alias("h"), "source", "target", "b")).alias("e"))
        taken = cut(taken.select("a", "e.b", "e.source", "e.target"), "taken")
        # Two that take the same edge: the smaller one is the top. There are no other circles, as each edge down a chain comes earlier in the order.
        other = taken.select(F.col("a").alias("b"), F.col("source").alias("s"), F.col("target").alias("t"))
        top = (F.col("source") == F.col("s")) & (F.col("target") == F.col("t")) & (F.col("a") < F.col("b"))
        tops = taken.join(other, "b").select("a", F.when(top, F.col("a")).otherwise(F.col("b")).alias("top"))
        while True:
            for _ in range(3):
                tops = tops.join(tops.select(F.col("a").alias("top"), F.col("top").alias("far")), "top").select("a", F.col("far").alias("top"))
            tops = cut(tops, "tops")
            if not tops.where("a != top").join(tops.where("a != top").select(F.col("a").alias("top")), "top", "left_semi").head(1):
                break
        part = taken.select("source", "target").distinct()
        found = part if found is None else found.unionByName(part)
        joined = live.join(tops.withColumnRenamed("top", "x"), "a").join(tops.select(F.col("a").alias("b"), F.col("top").alias("y")), "b").where("x != y")
        least = joined.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min(F.struct("source", "target")).alias("e"))
        after = cut(least.select("a", "b", "e.source", "e.target"), "live")
        drop(live)
        live, salt = after, salt + 1
    return found if found is not None else pairs.select("source", "target").limit(0)


def _kruskal(frames):
    up: dict = {}

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for pdf in frames:
        rows = []
        for a, b, s, t in zip(pdf["a"], pdf["b"], pdf["source"], pdf["target"], strict=True):
            if (x := top(a)) != (y := top(b)):
                up[max(x, y)] = min(x, y)
                rows.append((s, t))
        yield pd.DataFrame(rows, columns=["source", "target"])


def bridge_nodes(found: DataFrame) -> DataFrame:
    """(id): ends of bridges."""
    return found.select(F.explode(F.array("u", "v")).alias("id")).distinct()
