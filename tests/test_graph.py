import pytest
from graphs import graph
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tributary.functions import names
from tributary.operators import build, change, domains, impact, structure
from tributary.schema import DEPENDENCIES, MODULES


def decls(spark, modules, deps):
    m = spark.createDataFrame([(i, "CLASS", None, "HIGH", k) for k, i in enumerate(modules)], MODULES)
    d = spark.createDataFrame([(s, t, kind, "HIGH", None, False, k) for k, (s, t, kind) in enumerate(deps)], DEPENDENCIES)
    return m, d


def test_build(spark):
    m, d = decls(spark, ["java:A", "java:B", "py:C", "java:A"], [("java:A", "java:B", "IMPORTS"), ("java:A", "java:B", "EXTENDS"), ("java:A", "py:C", "USES"), ("java:A", "java:A", "USES"), ("java:A", "java:X", "USES"), ("java:Y", "java:A", "USES")])
    g = build.build(m, d)
    assert {r.id for r in g.nodes.collect()} == {"A", "B", "C"}
    assert {(r.source, r.target, r.type) for r in g.edges.collect()} == {("A", "B", "EXTENDS"), ("A", "C", "USES")}
    assert {tuple(r) for r in build.warnings(m, d).collect()} == {("unknown_target", "java:A", "java:X"), ("unknown_source", "java:Y", "java:A")}
    assert {tuple(r) for r in build.degrees(g).collect()} == {("A", 0, 2), ("B", 1, 0), ("C", 1, 0)}


@pytest.mark.parametrize("bad", ["", "  ", "A", ":A", "java:", None])
def test_malformed_ids(spark, bad):
    m, d = decls(spark, [bad], [])
    with pytest.raises(PySparkException):
        build.build(m, d).nodes.collect()


def test_collision(spark):
    m, d = decls(spark, ["java:A", "py:A"], [])
    with pytest.raises(PySparkException):
        build.build(m, d).nodes.collect()
    assert build.collisions(m).first().declared == "java:A,py:A"


def test_merge(spark):
    a, b = graph(spark, [("A", "B")]), graph(spark, [("A", "B"), ("B", "C")])
    b = type(b)(b.nodes, b.edges.withColumn("type", F.lit("USES")))
    assert {(r.source, r.target, r.type) for r in build.merge(a, b).edges.collect()} == {("A", "B", "USES"), ("B", "C", "USES")}


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id string")


def assigned(spark, xs, config=None):
    return {r.id: (r.domain, r.confidence) for r in domains.assign(ids(spark, *xs), config).collect()}


def test_domains(spark):
    got = assigned(spark, ["com.a.framework.security.LoginService", "com.a.system.domain.SysUser"], [("auth", "com.a.framework.security"), ("system", "com.a.system")])
    assert set(got.values()) == {("auth", "HIGH"), ("system", "HIGH")}
    assert assigned(spark, ["com.fuwa.system.domain.SysUser"]) == {"com.fuwa.system.domain.SysUser": ("system", "MEDIUM")}
    assert assigned(spark, ["x.Service", "plain"]) == {"x.Service": ("x", "LOW"), "plain": ("unknown", "LOW")}
    five = [f"com.co.modules.{m}.service.X{m}" for m in ("auth", "user", "order", "payment", "inventory")]
    assert {d for d, _ in assigned(spark, five).values()} == {"auth", "user", "order", "payment", "inventory"}


@pytest.mark.parametrize("n, d, want", [(50, 3, (3, 2, 4, 5)), (200, 5, (3, 2, 4, 20)), (1000, 71, (10, 22, 4, 20))])
def test_thresholds(spark, n, d, want):
    doms = spark.range(n).select(F.col("id").cast("string"), (F.col("id") % d).cast("string").alias("domain"))
    assert tuple(domains.thresholds(doms, doms).first()) == want


def test_layers(spark):
    cases = {"a.UserController": "CONTROLLER", "a.UserServiceImpl": "SERVICE", "a.OrderService$Inner": "SERVICE", "a.UserDao": "REPOSITORY", "a.UserDTO": "DOMAIN", "a.AppConfig": "CONFIG", "a.StrUtils": "UTIL", "a.Thing": "UNKNOWN", "": "UNKNOWN", None: "UNKNOWN", "$Helper": "UTIL"}
    rows = ids(spark, *cases).select("id", names.layer(F.col("id")).alias("l"), names.layer(F.col("id"), {"Thing": "CUSTOM"}).alias("c")).collect()
    assert {r.id: r.l for r in rows} == cases
    assert {r.id: r.c for r in rows}["a.Thing"] == "CUSTOM"


def test_names(spark):
    row = spark.range(1).select(
        names.short_name(F.lit("a/b/c.ts")), names.short_name(F.lit("a.b.Class")), names.short_name(F.lit("a.b.mod")), names.label(F.lit("x/y.Z/w")),
        names.mermaid_id(F.lit("a.b:c-d/e")), names.language(F.lit("ts")), names.language(F.lit("zig")), names.extension(F.lit("a/.env")), names.extension(F.lit("a.b/c.tar.gz")),
        names.java_hash(F.lit("ungrouped")), names.pastel(F.lit("auth")),
    ).first()
    h = 0
    for c in "ungrouped":
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    assert list(row)[:10] == ["c.ts", "Class", "a.b.mod", "Z/w", "a_b_cde", "TypeScript", "zig", "", "gz", h - (1 << 32) if h >> 31 else h]
    assert len(row[10]) == 7


def test_rotated(spark):
    df = spark.createDataFrame([(["C", "A", "B"],), (["B", "A"],), (["A", "B", "A", "C"],), (["X"],)], "c array<string>")
    assert [r[0] for r in df.select(names.rotated(F.col("c"))).collect()] == [["A", "B", "C"], ["A", "B"], ["A", "B", "A", "C"], ["X"]]


def starts(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "target string")


def test_impact(spark):
    g = graph(spark, [("B", "A"), ("C", "B"), ("D", "C"), ("A2", "B2"), ("B2", "A2")])
    got = lambda x, d: {(r.id, r.depth) for r in impact.impact(g, starts(spark, x), d).collect()}
    assert got("A", 2) == {("B", 1), ("C", 2)}
    assert got("A", 0) == set()
    assert got("A2", 2) == {("B2", 1), ("A2", 2)}
    assert got("A", 9) == {("B", 1), ("C", 2), ("D", 3)}
    doms = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "y")], "id string, domain string")
    rows = impact.impact(g, starts(spark, "A"), 3, doms)
    assert {(r.id, r.risk, r.crosses) for r in rows.collect()} == {("B", "LOW", True), ("C", "MEDIUM", False), ("D", "HIGH", False)}
    assert tuple(impact.summary(rows).first()) == ("A", 3, 3, 1)
    assert {(r.id, r.depth) for r in impact.ancestors(g, "C", impact.impact(g, starts(spark, "C"))).collect()} == {("B", 1), ("A", 2)}
    assert impact.resolve(g.nodes, "A").first().id == "A" and not impact.resolve(g.nodes, "nope").head(1)


def test_diff(spark):
    a, b = graph(spark, [("A", "B")]), graph(spark, [("A", "B"), ("B", "A"), ("B", "C")])
    out = change.compare(a, b)
    assert {tuple(r) for r in out["nodes"].collect()} == {("added", "C")}
    assert {tuple(r)[:3] for r in out["edges"].collect()} == {("added", "B", "A"), ("added", "B", "C")}
    assert [(r.change, r.members) for r in out["cycles"].collect()] == [("new", ["A", "B"])]
    assert all(x.count() == 0 for x in change.compare(b, b).values())
    assert [r.change for r in change.compare(b, a)["cycles"].collect()] == ["fixed"]


def test_risk_and_gate(spark):
    g = graph(spark, [(f"D{i}", "A") for i in range(11)] + [("A", "Z")])
    doms = g.nodes.select("id", F.lit("d").alias("domain"))
    none = ids(spark).limit(0) if False else g.nodes.select("id").limit(0)
    risks = change.class_risk(g, doms, ids(spark, "A", "D1", "gone"), none, ["d1"])
    assert {r.id: r.risk for r in risks.collect()} == {"A": "HIGH", "D1": "HIGH"}
    fresh = spark.createDataFrame([("new", ["A", "Z"])], "change string, members array<string>")
    edges = change.diff_edges(g, g)
    s = change.risk_summary(risks, edges, fresh, doms, ids(spark, "A", "gone-d1"), ["d1"])
    assert tuple(s.first()) == ("VERY_HIGH", 1, 0, 1)
    assert change.gate(s).first().gate_blocked
    calm = change.risk_summary(risks.where("false"), edges, fresh.limit(0), doms, ids(spark, "A"), [])
    assert tuple(calm.first()) == ("LOW", 0, 0, 0) and not change.gate(calm).first().gate_blocked


def test_rules(spark):
    g = graph(spark, [("B", "A"), ("C", "B"), ("D", "C"), ("P", "Q"), ("Q", "P")])
    deep = {r.subject for r in change.rule_max_call_depth(g, 3).collect()}
    assert deep == {"A"}
    assert {r.id: (r.depth, r.exact) for r in change.call_depths(g, 3).collect()} == {"A": (4, True), "B": (3, True), "C": (2, True), "D": (1, True), "P": (2, True), "Q": (2, True)}
    doms = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c"), ("D", "c")], "id string, domain string")
    assert [r.subject for r in change.rule_entity_leakage(g, doms, ids(spark, "A", "C")).collect()] == ["A"]
    assert change.rule_max_cross_domain(g, doms, 0).count() == 2 and change.rule_max_cross_domain(g, doms, 1).count() == 0
    assert [r.details for r in change.rule_no_cycle(structure.cycles(g.edges)).collect()] == ["P,Q"]


def test_files_to_nodes(spark):
    g = graph(spark, [("com.a.User", "com.a.Role"), ("web/x.ts", "web/y.ts")])
    files = spark.createDataFrame([("src/main/java/com/a/User.java",), ("web/x.ts",), ("other/b/Role.java",)], "path string")
    assert {r.id for r in change.nodes_of_files(g.nodes, files).collect()} == {"com.a.User", "web/x.ts"}
