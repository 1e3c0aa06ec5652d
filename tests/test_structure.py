import pytest
from graphs import betweenness, bridges, closeness, components, cycles, graph, pagerank, random_edges

from tributary.operators import centrality, structure


def nodes_of(edges):
    return sorted({x for e in edges for x in e})


def members(df):
    return {tuple(r.members) for r in df.collect()}


def test_fixed_shapes(spark):
    triangle = [("A", "B"), ("B", "C"), ("C", "A")]
    g = graph(spark, [*triangle, ("D", "E"), ("E", "D"), ("E", "F")], nodes=["G"])
    assert members(structure.cycles(g.edges)) == {("A", "B", "C"), ("D", "E")}
    assert {(r.u, r.v) for r in structure.bridges(g.edges).collect()} == {("D", "E"), ("E", "F")}
    assert {r.id for r in structure.bridge_nodes(structure.bridges(g.edges)).collect()} == {"D", "E", "F"}
    assert {r.component for r in structure.weak_components(g.nodes, g.edges).collect()} == {"A", "D", "G"}


def test_empty(spark):
    g = graph(spark, [], nodes=["A"])
    none = g.nodes.limit(0)
    assert structure.cycles(g.edges).count() == structure.bridges(g.edges).count() == 0
    assert structure.weak_components(none, g.edges).count() == 0
    assert [tuple(r) for r in centrality.pagerank(g).collect()] == [("A", 1.0)]
    assert centrality.closeness(g).first().closeness == 0


def test_layers_are_gone_before_components_are_looked_for(spark, monkeypatch):
    """Three layers lead nowhere back; a ring among them is all that the search gets, beside the stretch that leads on from it."""
    sizes, plain = [], structure.split
    monkeypatch.setattr(structure, "split", lambda edges, most: sizes.append(edges.count()) or plain(edges, most))
    layers = [(f"a{i}", f"b{i % 7}") for i in range(200)] + [(f"b{i}", f"c{i % 2}") for i in range(7)]
    assert members(structure.cycles(graph(spark, layers).edges)) == set() and sizes == [0]
    ring = [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("a0", "r1"), ("r2", "b0")]
    assert members(structure.cycles(graph(spark, layers + ring).edges)) == {("r1", "r2", "r3")} and sizes[1:] == [3]


def test_deep_chain(spark):
    edges = [(f"N{i:04}", f"N{i + 1:04}") for i in range(1499)]
    assert structure.bridges(graph(spark, edges).edges).count() == 1499


def test_bridges_of_a_chain_take_few_rounds(spark, monkeypatch):
    """Tables written for 4,000 nodes in a row with a ring at the end: under 60, not one for each of them."""
    made, plain = [], structure.cut
    monkeypatch.setattr(structure, "cut", lambda df, label="cut": made.append(label) or plain(df, label))
    monkeypatch.setattr(structure, "WIDE", 2)
    edges = [(f"N{i:04}", f"N{i + 1:04}") for i in range(4_000)] + [("N3990", "N4000"), *((f"N{i:04}", "leaf%d" % i) for i in (0, 1)), *(("N2000", f"s{i}") for i in range(9))]
    found = {(r.u, r.v) for r in structure.bridges(graph(spark, edges).edges, 0).collect()}
    assert found == {tuple(sorted(e)) for e in edges if not (e[0] >= "N3990" and e[1] <= "N4000" and e[0] < "O")}
    assert len(made) < 60, made


def test_rounds_for_bridges_carry_numbers(spark, monkeypatch):
    """Ids of any length are numbers in the rounds, and come back in their own order."""
    kinds, plain = [], structure._xor_bridges
    monkeypatch.setattr(structure, "_xor_bridges", lambda pairs, most: kinds.append([t for _, t in pairs.dtypes]) or plain(pairs, most))
    long = "x" * 200
    edges = [(long + b, long + a) for a, b in ("ab", "bc", "ca", "cd")]
    found = {(r.u[200:], r.v[200:]) for r in structure.bridges(graph(spark, edges).edges, 0).collect()}
    assert found == {("c", "d")} and kinds == [["bigint"] * 3]


def test_forest_in_rounds_and_in_one_task(spark):
    edges = sorted({tuple(sorted(e)) for e in random_edges(8, 30, 45)})
    for bound in (0, 12, 1_000):
        got = [(r.source, r.target) for r in structure.forest(graph(spark, edges).edges, bound).collect()]
        low = components(nodes_of(edges), edges)
        assert len(got) == len(set(got)) == len(low) - len(set(low.values())) and set(got) <= set(edges)
        assert components(nodes_of(edges), got) == low


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_both_ways(spark, seed):
    edges = random_edges(seed)
    g, nodes = graph(spark, edges), nodes_of(edges)
    for bound in (structure.LOCAL_EDGES, 0):
        assert members(structure.cycles(g.edges, bound)) == cycles(edges)
        assert {(r.u, r.v) for r in structure.bridges(g.edges, bound).collect()} == bridges(nodes, edges)
    assert {r.id: r.component for r in structure.weak_components(g.nodes, g.edges).collect()} == components(nodes, edges)


def test_centrality_of_random_graph(spark):
    edges = random_edges(3)
    g, nodes = graph(spark, edges), nodes_of(edges)
    ways = ({}, {"sources": 2}, {"local_edges": 0}, {"local_edges": 0, "state_rows": 72})  # in tasks and by joins, in one block of sources and in several
    sums = [centrality.path_sums(g, **way) for way in ways]
    for found, want in (
        *((centrality.betweenness(g, s), betweenness(nodes, edges)) for s in sums),
        *((centrality.closeness(g, s), closeness(nodes, edges)) for s in sums),
        (centrality.pagerank(g), pagerank(nodes, edges)),
    ):
        got = {r[0]: r[1] for r in found.collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_pagerank_edge_cases(spark):
    g = graph(spark, [("A", "B")])
    assert {r.pagerank for r in centrality.pagerank(g, iterations=0).collect()} == {0.5}
    assert abs(sum(r.pagerank for r in centrality.pagerank(g).collect()) - 1) < 1e-12


def test_density_guard(spark):
    dense = [(f"n{i}", f"n{j}") for i in range(8) for j in range(8) if i != j]
    with pytest.raises(centrality.DensityError):
        centrality.betweenness(graph(spark, dense))
    out = centrality.bundle(graph(spark, dense))
    assert out["centrality"].where("betweenness is not null").count() == 0


def test_closeness_of_out_star(spark):
    got = {r.id: r.closeness for r in centrality.closeness(graph(spark, [("S", "T1"), ("S", "T2")])).collect()}
    assert got == {"S": 1.0, "T1": 0.0, "T2": 0.0}


def test_path_sums_hold_no_pairs(spark):
    """A long chain has half a billion pairs; its report has a row for each node, and no size from which on it is left out."""
    n = 30_000
    ids = [f"n{i:05}" for i in range(n)]
    some = [(ids[i], ids[i + 1]) for i in range(300)] + [(ids[i], ids[i + 1]) for i in range(400, n - 1, 2)]
    out = centrality.bundle(graph(spark, some, ids))["centrality"].collect()
    assert len(out) == n and all(r.betweenness is not None and r.closeness is not None for r in out)
    top = {r.id for r in out if r.betweenness == 1}
    assert top == {ids[150]}
    assert set(centrality.overview(graph(spark, some))["centrality"].columns) == {"id", "pagerank"}


def test_a_report_counts_a_node_once(spark):
    from tributary.operators import impact
    from tributary.sinks import exports

    g = graph(spark, [("A", "B"), ("B", "C"), ("A", "C")])
    starts = spark.createDataFrame([("B",), ("C",)], "target string")
    found = impact.impact(g, starts)
    empty = spark.createDataFrame([], "change string, source string, target string, type string")
    summary = spark.createDataFrame([("LOW", 0, 0, 0)], "overall_risk string, new_cycles int, cross_domain_edges int, critical_hits int")
    lines = exports.report_lines(empty, summary, found)
    assert "Depth 1: 2 affected" in lines and not any("Depth 2" in x for x in lines)


def test_many_starts_and_a_hub(spark):
    """Reach of more starts than one group of bits holds equals a search from each; a hub leads everywhere."""
    from tributary.operators import impact

    edges = sorted({*random_edges(7, n=90, m=150), *((f"n{i:02}", "hub") for i in range(90)), ("hub", "n00"), ("n01", "n01")})
    back = {}
    for s, t in edges:
        if s != t:
            back.setdefault(t, set()).add(s)
    starts = [f"n{i:02}" for i in range(90)] + ["hub", "nowhere"]
    want = set()
    for start in starts:
        front, seen = {start}, set()
        for d in (1, 2, 3):
            front = {y for x in front for y in back.get(x, ())} - seen
            seen |= front
            want |= {(start, x, d) for x in front}
    table = spark.createDataFrame(edges, "source string, target string")
    asked = spark.createDataFrame([(x,) for x in [*starts, "hub", None]], "target string")
    got = [tuple(r) for r in impact.reach(table, asked, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert impact.reach(table, asked.where("target = 'nowhere'"), 3).columns == ["target", "id", "depth"]
    assert impact.reach(table.limit(0), asked, 3).count() == 0


def test_cycles_of_deep_components(spark, monkeypatch):
    """A long chain into a long cycle, with a tree on it and a chain behind, takes logarithmically many tables."""
    made = []
    plain = structure.cut
    monkeypatch.setattr(structure, "cut", lambda df, label="cut": made.append(label) or plain(df, label))
    ring = [f"r{i:03}" for i in range(400)]
    chain = [f"c{i:03}" for i in range(600)]
    edges = [(ring[i], ring[i - 1]) for i in range(400)] + list(zip(chain, chain[1:], strict=False)) + [(chain[-1], ring[7])]
    edges += [(f"t{i:03}", f"t{(i - 1) // 2:03}") for i in range(1, 200)] + [("t000", chain[300]), (ring[3], "z000")] + [(f"z{i:03}", f"z{i + 1:03}") for i in range(100)]
    edges += [("p1", "p2"), ("p2", "p1"), (chain[5], "p1"), ("p2", chain[9])]
    got = members(structure.cycles(graph(spark, edges).edges, 0))
    assert got == {tuple(ring), ("p1", "p2")}
    assert len(made) < 130, len(made)


@pytest.mark.parametrize("seed", range(3))
def test_contraction_of_sparse_graphs(spark, seed):
    """Sparse graphs, where most nodes have one link in or out, with cycles within chains."""
    edges = random_edges(seed + 50, n=60, m=75)
    assert members(structure.cycles(graph(spark, edges).edges, 0)) == cycles(edges)
