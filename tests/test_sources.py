import json
import subprocess

import project as fixtures
import pytest
from pyspark.sql import functions as F

from tributary import cli
from tributary.plans import analysis
from tributary.schema import FILES
from tributary.sinks import exports
from tributary.sources import config, files, frontends, java


def frame(spark, some):
    return spark.createDataFrame([(p, c, len(c or "")) for p, c in some.items()], FILES)


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for p, c in fixtures.PROJECT.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(c)
    (root / "node_modules/x").mkdir(parents=True)
    (root / "node_modules/x/y.js").write_text("import a from './b'")
    (root / "big.py").write_text("#" * (files.MAX_BYTES + 1))
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    return root


def test_scan(spark, project):
    got = {r.path: r for r in files.scan(spark, str(project)).collect()}
    assert set(got) == set(fixtures.PROJECT) | {"big.py"}
    assert got["big.py"].content is None
    assert files.too_large(files.scan(spark, str(project), ["py"])).count() == 1


def test_roots_and_routing(spark):
    df = frame(spark, {"pom.xml": "<modules><module>a</module><module> b </module></modules>", "a/src/main/java/x/Y.java": "", "b/src/main/java/Z.java": "", "c/src/main/java/Q.java": ""})
    assert {tuple(r) for r in files.source_roots(df).collect()} == {("a", "a/src/main/java"), ("b", "b/src/main/java")}
    df = frame(spark, {"settings.gradle.kts": 'include("core")', "pom.xml": "<module>a</module>", "core/src/main/java/A.java": "", "a/src/main/java/B.java": ""})
    assert [tuple(r) for r in files.source_roots(df).collect()] == [("core", "core/src/main/java")]
    df = frame(spark, {"app/build.gradle": "", "app/src/main/java/A.java": "", "build-x/build.gradle": "", "build-x/src/main/java/A.java": ""})
    assert [tuple(r) for r in files.source_roots(df).collect()] == [("app", "app/src/main/java")]
    with pytest.raises(ValueError, match="claim"):
        files.route(df, {"a": ["x"], "b": ["x"]})


def test_strict_python_lines(spark):
    df = frame(spark, {"a.py": "import a, b\nimport c as d\nimport e as f, g\nfrom h import i as j\nfrom k import l, m\nimport n # x\n  from ..o import p"})
    assert {r[1] for r in frontends.py_imports(df, strict=True).collect()} == {"a", "b", "c", "k", "..o"}
    assert {r[1] for r in frontends.py_imports(df).collect()} == {"a", "b", "c", "e", "g", "h", "k", "n", "..o"}


def test_javascript_statements(spark):
    yes = ["import a from 'm1'", "import type {T} from 'm2'", "import a, {b as c,\n d} from \"m3\"", "import * as n from 'm4'", "import {\n// import all\nx } from 'm5'", "export {a, b} from 'm6'", "export * as ns from 'm7'", "import type from 'm8'"]
    no = ["import 'n1'", "const x = require('n2')", "import('n3')", "export * from 'n4'", "export const from = 'n5'", "import{a}from'n6'", "import a + b from 'n7'", "export a from 'n8'"]
    df = frame(spark, {"a.ts": ";\n".join([*yes, *no]), "b.vue": "<template/><SCRIPT setup lang='ts'>import a from './v1'</Script><script>import b from './v2'</script>", "c.vue": "<script>import a from 'v3'", "d.js": None, "e.js": "export " + "x " * 200_000})
    assert {r[1] for r in frontends.js_imports(df).collect()} == {*(f"m{i}" for i in range(1, 9)), "./v1"}


def test_invoke(spark):
    df = spark.createDataFrame([("m.invoke(x)", True), ("Method.invoke", True), ("a().b.invoke  (c)", True), (").invoke(x)", False), ("m.invoked(x)", False), ("", False), ("m.invoke.x; n.invoke(y)", True)], "line string, want boolean")
    assert df.where(java._invokes(F.col("line")) != F.col("want")).count() == 0


def test_stdlib(spark):
    df = spark.createDataFrame([("os.path", True), ("Json", True), ("cProfile", True), ("distutils.core", True), ("imp", True), ("numpy", False), ("", False)], "m string, want boolean")
    assert df.where(frontends.is_stdlib(F.col("m")) != F.col("want")).count() == 0


def test_dependency_json(spark, tmp_path):
    dep = lambda **k: {"resolved": None, "module": None, "coreModule": False, "couldNotResolve": False} | k
    (tmp_path / "r.json").write_text(json.dumps({"modules": [{"source": "src/a.ts", "dependencies": [dep(resolved="src/b.ts", module="./b"), dep(resolved="fs", module="fs", coreModule=True), dep(resolved="node_modules/x/i.js", module="x"), dep(resolved="web/node_modules/y.js", module="y"), dep(module="./gone", couldNotResolve=True), dep(module="node:path", couldNotResolve=True)]}, {"source": "src/b.ts", "dependencies": []}, {"source": "fs", "coreModule": True, "dependencies": []}]}, indent=1))
    got = frontends.dependency_json(spark, str(tmp_path / "r.json"))
    assert {r.id for r in got.modules.collect()} == {"js:src/a.ts", "js:src/b.ts"}
    assert [(r.source_id, r.target_id) for r in got.dependencies.collect()] == [("js:src/a.ts", "js:src/b.ts")]
    assert [r.description for r in got.blind_spots.collect()] == ["not resolved: ./gone"]


def test_import_resolver(spark):
    df = spark.createDataFrame([("a.B",), ("a.B.run",), ("a.B$C",), ("a.*",), ("",), (None,)], "i string")
    assert [r[0] for r in df.select(java.resolve_import(F.col("i"))).collect()] == ["a.B", "a.B", "a.B$C", "", "", ""]
    known = spark.createDataFrame([("a.B",), ("a.c.D",), ("ab.E",)], "fqcn string")
    assert sorted(tuple(r) for r in java.resolve_wildcards(spark.createDataFrame([("a.*",)], "import string"), known).collect()) == [("a.*", "a.B"), ("a.*", "a.c.D")]


def test_java_reading():
    got = java.read("package p; class A<T extends B<C>> extends D<E> implements F, g.H { class I {} interface J extends K, L {} } @interface M {}")
    assert [(t["name"], t["kind"], t["extends"], t["implements"]) for t in got["types"]] == [("A", "CLASS", ["D"], ["F", "g.H"]), ("I", "CLASS", [], []), ("J", "INTERFACE", ["K", "L"], []), ("M", "INTERFACE", [], [])]
    assert java.read("")["types"] == [] and java.read("class")["types"] == []


def test_config(spark):
    c = config.parse("rules: {no_cycle: false, max_cross_domain: 5}\ndomains: {auth: [a.b, c]}\ncritical_paths: [auth]\nignore: ['**/gen/*.py', 'x?.ts']")
    assert (c.no_cycle, c.max_cross_domain, c.max_call_depth, c.prefixes()) == (False, 5, 3, [("auth", "a.b"), ("auth", "c")])
    assert config.load("/nowhere/at/all.yml") == config.Config()
    with pytest.raises(ValueError):
        config.parse("- a")
    df = frame(spark, {"a/gen/b.py": "", "gen/b.py": "", "gen/c/b.py": "", "x1.ts": "", "a/x1.ts": ""})
    assert {r.path for r in c.visible(df).collect()} == {"gen/c/b.py", "a/x1.ts"}


def test_analysis_and_exports(spark):
    found = analysis.analyse(fixtures.files(spark))
    edges = {(r.source, r.target) for r in found.graph.edges.collect()}
    assert edges == {(a, b) for a, b, *_ in [*fixtures.JAVA_EDGES, *fixtures.JS_EDGES, *fixtures.PY_EDGES]}
    doc = json.loads(exports.agent_json(found.graph, found.domains, found.cycles, found.hotspots, found.blind_spots))
    assert doc["n"] == len(doc["nodes"]) and doc["e"] == len(doc["edges"]) == len(edges) and doc["bs"]["reflection"] == 2
    full = json.loads(exports.analysis_json(found.graph, found.domains, found.cycles, found.hotspots, found.blind_spots, ["x"], {"version": "1"}))
    assert full["graph"]["stats"] == {"nodeCount": doc["n"], "edgeCount": doc["e"]} and full["errors"] == ["x"]
    dot = exports.text(exports.dot_lines(found.graph, found.domains))
    assert dot.startswith("digraph dependencies {\n  rankdir=LR;\n") and dot.endswith("}\n") and dot.count(" -> ") == len(edges)
    assert exports.text(exports.mermaid_lines(found.graph, found.domains, found.cycles)).count(" --> ") == len(edges)


def test_tiers(spark):
    from graphs import graph

    for n in (210, 510):
        g = graph(spark, [(f"x.N{i:03}", f"x.N{i + 1:03}") for i in range(n - 1)])
        full = {"centrality": g.nodes.select("id", F.lit(0.0).alias("pagerank")), "components": g.nodes.select("id", F.lit("a").alias("component")), "bridges": g.edges.select(F.col("source").alias("u"), F.col("target").alias("v"))}
        none = g.nodes.select(F.col("id").alias("cycle"), F.array("id").alias("members"), F.lit(1).alias("size")).limit(0)
        doc = json.loads(exports.agent_json(g, g.nodes.select("id", F.lit("d").alias("domain")), none, g.nodes.select("id", F.lit(1).alias("in_degree")), frontends.nothing(spark).blind_spots, full))
        assert doc["domains"] == {"d": n} and ("hint" in doc) == (n >= 500) and len(doc["bridges"]) == (30 if n >= 500 else n - 1)


def test_in_roots(spark):
    df = frame(spark, {"build.gradle": "", "src/main/java/a/A.java": "", "src/test/java/a/ATest.java": "", "gen/B.java": "", "web/x.ts": "", "Makefile": ""})
    assert {r.path for r in files.in_roots(df).collect()} == {"build.gradle", "src/main/java/a/A.java", "web/x.ts", "Makefile"}
    assert files.in_roots(df).columns == df.columns


def test_spots_and_caps(spark):
    spots = spark.createDataFrame([("t", "b", "second"), ("t", "a", "first"), ("u", "c", None)], "type string, location string, description string")
    assert {tuple(r) for r in exports.spots_by_type(spots).collect()} == {("t", 2, "first"), ("u", 1, None)}
    line = lambda r: r.location
    assert cli._capped(spots, ["location"], 3, "spots", line) == ["a", "b", "c"]
    assert cli._capped(spots, ["location"], 2, "spots", line) == ["a", "b", "... and 1 more spots"]


def test_js_report(spark, project, tmp_path, capsys):
    (tmp_path / "report.json").write_text(json.dumps({"modules": [{"source": "web/q.ts", "dependencies": [{"resolved": "web/r.ts", "module": "./r"}]}, {"source": "web/r.ts", "dependencies": []}]}))
    assert cli.main(["analyze", str(project), "--json", "--languages", "js", "--js-report", str(tmp_path / "report.json")], spark) == 0
    doc = json.loads(capsys.readouterr().out)
    assert [n["id"] for n in doc["graph"]["nodes"]] == ["web/q.ts", "web/r.ts"] and doc["graph"]["stats"]["edgeCount"] == 1


def test_cli(spark, project, capsys):
    assert cli.main(["analyze", str(project), "--dot", str(project / "g.dot")], spark) == 0
    assert "Nodes:" in capsys.readouterr().out and (project / "g.dot").exists()
    assert cli.main(["analyze", str(project), "--target", "OrderService", "--format", "agent"], spark) == 0
    doc = json.loads(capsys.readouterr().out)
    assert doc["target"] == "shop.core.OrderService" and doc["affected"] == 3
    assert cli.main(["analyze", str(project), "--target", "Nope"], spark) == 1
    (project / "src/main/java/shop/core/Base.java").write_text("package shop.core; import shop.api.OrderController; class Base { }")
    assert cli.main(["diff", "HEAD", "--ci"], spark) in (0, 1, 2)
    capsys.readouterr()
    found = analysis.compare(files.Git(str(project)).snapshot(spark, "HEAD"), files.scan(spark, str(project)), files.Git(str(project)).changed("HEAD"))
    assert {(r.change, r.source, r.target) for r in found.edges.collect()} == {("added", "shop.core.Base", "shop.api.OrderController")}
    assert [r.change for r in found.cycles.collect()] == ["new"]
    assert found.summary.first().overall_risk == "VERY_HIGH"


def test_git_contents_are_read_by_tasks(spark, tmp_path, monkeypatch):
    import subprocess

    monkeypatch.setattr(files, "FILES_A_TASK", 2)
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    some = {"a.java": "class A {}\n", "b/é ü.py": "import os\n", "empty.js": "", "big.py": "x" * (files.MAX_BYTES + 1), "no_end.ts": "a\nb", "same.java": "class A {}\n"}
    for path, text in some.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "x")
    repo = files.Git(str(tmp_path))
    got = {r.path: (r.content, r.length) for r in repo.snapshot(spark, "HEAD").collect()}
    assert got == {p: (None if len(t) > files.MAX_BYTES else t, len(t.encode())) for p, t in some.items()}
    assert {r.path for r in repo.snapshot(spark, "HEAD", ["py"]).collect()} == {"b/é ü.py", "big.py"}
    assert repo.snapshot(spark, "HEAD", ["vue"]).count() == 0


def test_a_file_is_parsed_once_for_each_content(spark):
    from pyspark.sql import functions as F

    before = spark.createDataFrame([("A.java", "class A { }"), ("B.java", "class B extends A { }"), ("C.java", "class C { }")], "path string, content string")
    after = spark.createDataFrame([("A.java", "class A { }"), ("B.java", "class B { }"), ("D.java", "class D extends A { }")], "path string, content string")
    known = java.tokenized(before).withColumn("bean", F.lit(True))
    rows = {r.path: (r.bean, list(r.extends)) for r in java.tokenized(after, known).collect()}
    assert rows == {"A.java": (True, []), "B.java": (False, []), "D.java": (False, ["A"])}
    reader = frontends.JavaReader()
    for some in (before, after):
        one, two = frontends.graph_of(reader(some))[0], frontends.graph_of(frontends.java_frontend(some))[0]
        edges = lambda g: sorted((r.source, r.target, r.type) for r in g.edges.collect())
        assert edges(one) == edges(two) and len(edges(one)) == 1


def test_each_language_of_the_project(spark):
    found = {(r.path, r["import"]) for r in frontends.py_imports(fixtures.files(spark, "py")).collect()}
    assert found == set(fixtures.PY_IMPORTS)
    some = fixtures.files(spark, "java", "xml")
    assert {tuple(r) for r in java.blind_spots(some).collect()} == set(fixtures.BLIND_SPOTS)
    assert {tuple(r) for r in java.di_resolution(java.types(fixtures.files(spark, "java"))).collect()} == set(fixtures.DI)
    g, _ = frontends.graph_of(frontends.java_frontend(fixtures.files(spark, "java")))
    assert {(r.source, r.target, r.type) for r in g.edges.collect()} == set(fixtures.JAVA_EDGES)
    scripts = frontends.vue_script(fixtures.files(spark, "vue")).selectExpr("path", "content is not null").collect()
    assert {tuple(r) for r in scripts} == {("web/App.vue", True), ("web/Empty.vue", False)}
    assert {r.ext: r.n for r in files.by_extension(fixtures.files(spark)).collect()} == {"java": 10, "js": 1, "ts": 2, "vue": 2, "py": 6, "xml": 1, "json": 1}


@pytest.mark.parametrize("name", ["files_by_extension", "py_imports", "py_edges", "js_imports", "js_packages", "vue_script", "java_imports", "di_resolution", "blind_spots", "source_nodes", "risk_levels"])
def test_sources_from_tables(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tributary.plans import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.queries()[name](spark, sf)
    want = con.execute(registry.oracle_sql()[name])
    order = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(order)
    rows = [tuple(r) for r in got.select(order).collect()]
    assert rows and sorted(rows, key=repr) == sorted(want.fetchall(), key=repr)
