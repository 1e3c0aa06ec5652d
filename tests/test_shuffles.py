"""Steps on whole graphs deal each table once, and what they shuffled goes with them."""

import pytest
from pyspark.sql import functions as F

from graphs import graph
from tributary.operators import build, change
from tributary.schema import DEPENDENCIES, MODULES, Graph, Planned
from tributary.scratch import cut



def test_a_difference_deals_each_side_once(spark):
    base, head = graph(spark, [("a", "b"), ("b", "c")]), graph(spark, [("a", "b"), ("c", "a")])
    base, head = (Graph(cut(g.nodes), cut(g.edges)) for g in (base, head))
    found = change.diff_edges(base, head)
    assert sorted(tuple(r)[:3] for r in found.collect()) == [("added", "c", "a"), ("removed", "b", "c")]
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 1
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, 1000])
def test_loose_ends_of_written_dependencies(spark, monkeypatch, few):
    monkeypatch.setattr(build, "FEW_LOOSE", few)
    modules = spark.createDataFrame([(f"x:{i}", "CLASS", None, "HIGH", k) for k, i in enumerate("abc")], MODULES)
    rows = [("a", "b", "USES", 2), ("a", "b", "CALLS", 1), ("b", "gone", "USES", 3), ("gone", "b", "USES", 4), ("c", "c", "USES", 5), ("c", "a", "IMPORTS", 6)]
    deps = spark.createDataFrame([(f"x:{s}", f"x:{t}", kind, "HIGH", "why" if n == 2 else None, n == 6, n) for s, t, kind, n in rows], DEPENDENCIES)
    found = build.build(modules, cut(deps)).edges
    assert sorted((r.source, r.target, r.type, r.evidence, r.dynamic, r.seq) for r in found.collect()) == [("a", "b", "USES", "why", False, 2), ("c", "a", "IMPORTS", None, True, 6)]
    joins = found._jdf.queryExecution().sparkPlan().toString().count("LeftSemi")
    assert (joins == 0) == bool(few)


def test_shuffles_of_a_written_table_are_deleted(spark):
    files = lambda: {f.getName() for f in _java(spark, spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    assert cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    for _ in range(50):
        if not any(".data" in f for f in files() - before):
            break
        import time

        time.sleep(0.1)
    left = {f for f in files() - before if f.endswith(".data")}
    assert len(left) <= 1, left  # the count's own


def _java(spark, seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_merging_makes_no_nodes_for_edges(spark):
    asked = []
    one = graph(spark, [("a", "b")])
    lazy = Planned(lambda: asked.append(1) or one.nodes, lambda: one.edges)
    assert [tuple(r)[:2] for r in build.merge(lazy, one).edges.collect()] == [("a", "b")]
    assert not asked
    assert build.merge(lazy, one).nodes.count() == 2


def test_risks_read_what_changed(spark):
    g = graph(spark, [("a", "b"), ("a", "c"), ("d", "b"), ("d", "c"), ("b", "c")])
    doms = spark.createDataFrame([(i, i) for i in "abcd"], "id string, domain string")
    changed = spark.createDataFrame([("a",), ("b",), ("gone",)], "id string")
    assert sorted(map(tuple, change.foreign_dependencies(g, doms, changed).collect())) == [("a", 2), ("b", 1)]
    found = change.class_risk(g, doms, changed, changed.limit(0), [])
    assert sorted(map(tuple, found.collect())) == [("a", "LOW", 0), ("b", "LOW", 0)]
    # Dependents alone are counted, so sources of edges aren't grouped.
    assert "sum(" not in found._jdf.queryExecution().sparkPlan().toString()
