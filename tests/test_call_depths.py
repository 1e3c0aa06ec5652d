"""Longest simple paths of dependents, against a search of all paths."""

import random
from itertools import combinations

from graphs import graph, random_edges

from tributary.operators import change, structure
from tributary.scratch import cut


def longest(edges, start, most):
    back = {}
    for s, t in edges:
        back.setdefault(t, []).append(s)

    def go(path):
        if len(path) == most:
            return most
        return max([len(path), *(go([*path, x]) for x in back.get(path[-1], ()) if x not in path)])

    return go([start])


def test_family_represents_all_paths():
    rng = random.Random(1)
    for ahead in range(4):
        for _ in range(60):
            paths = [rng.sample(range(9), rng.randrange(1, 5)) for _ in range(rng.randrange(1, 40))]
            family = change._Family(ahead)
            kept = [p for p in paths if family.add(p)]
            assert kept == family.paths and len(kept) <= sum(4**k for k in range(ahead + 1))
            for size in range(ahead + 1):
                for others in combinations(range(9), size):
                    free = [p for p in paths if not set(p) & set(others)]
                    assert bool(free) == any(not set(p) & set(others) for p in kept)


def test_depths_against_all_paths(spark, monkeypatch):
    monkeypatch.setattr(change, "HELD_PATHS", 3)
    edges = [*random_edges(5, 11, 22), ("n03", "z1"), ("z1", "z2"), ("y1", "n04"), ("y2", "y1"), ("y1", "y2"), ("b1", "b2"), ("b2", "b3")]
    found = change.call_depths(graph(spark, edges, ["alone"]), 4).collect()
    ids = {x for e in edges for x in e} | {"alone"}
    assert {r.id: r.depth for r in found} == {x: longest(edges, x, 5) for x in ids}
    assert {r.id for r in found if not r.exact} <= {r.id for r in found if r.depth == 5}


def test_a_hub_on_a_cycle_has_few_rows(spark):
    """Sixty spokes that lead to the hub and back have 60 * 59 paths of three nodes through it alone."""
    edges = [(f"s{i:02}", "hub") for i in range(60)] + [("hub", f"s{i:02}") for i in range(60)]
    got = {r.id: (r.depth, r.exact) for r in change.call_depths(graph(spark, edges), 4).collect()}
    assert got == {"hub": (2, True)} | {f"s{i:02}": (3, True) for i in range(60)}


def test_depths_without_cycles_follow_few_edges(spark, monkeypatch):
    """Leaves that nothing depends on are in no table that is written: neither for cycles nor for levels."""
    rows = []
    monkeypatch.setattr(change, "cut", lambda df, label: (made := cut(df, label), rows.append((label, made.count())))[0])
    monkeypatch.setattr(structure, "cut", lambda df, label: (made := cut(df, label), rows.append((label, made.count())))[0])
    edges = [("b", "a"), ("c", "b")] + [(f"x{k:03}", "c") for k in range(200)] + [(f"c{k:02}", f"c{k + 1:02}") for k in range(18)]
    g = graph(spark, edges, ["alone"])
    assert sorted(r.subject for r in change.rule_max_call_depth(g, 2).collect()) == sorted(["a", "b", *(f"c{k:02}" for k in range(2, 19))])
    assert max(n for _, n in rows) < 50, rows
    assert {r.id: r.depth for r in change.call_depths(g, 2).collect()} == {x: longest(edges, x, 99) for e in edges for x in e} | {"alone": 1}
