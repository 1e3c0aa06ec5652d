"""Patched snapshots against whole builds, on random changes of files."""

import random

from tributary.operators import patch
from tributary.plans import demo
from tributary.schema import DEPENDENCIES, MODULES


def declared(files):
    """Declarations of {path: {id: [(target, type), ...]}}."""
    modules, deps = [], []
    for path, ids in sorted(files.items()):
        for id_, targets in ids.items():
            modules.append((f"x:{id_}", "CLASS", path, "HIGH", int(path[1:]), path))
            deps += [(f"x:{id_}", f"x:{t}", kind, "HIGH", None, False, int(path[1:]) * 10 + k, path) for k, (t, kind) in enumerate(targets)]
    return modules, deps


def frames(spark, files):
    modules, deps = declared(files)
    return spark.createDataFrame(modules, MODULES + ", path string"), spark.createDataFrame(deps, DEPENDENCIES + ", path string")


def content(s):
    rows = lambda df, *cols: sorted(map(tuple, df.select(*cols).collect()))
    return (
        rows(s.graph.nodes, "id", "type", "source_path", "seq"),
        rows(s.graph.edges, "source", "target", "type", "seq"),
        rows(s.components, "id", "component"),
        sorted(tuple(r.members) for r in s.cycles.collect()),
    )


def some_file(rng, path, n=9):
    # Two files may declare one id; some targets are declared by no file.
    ids = {f"c{(int(path[1:]) + rng.choice((0, 0, 0, 1))) % n}"}
    return {i: [(f"c{rng.randrange(n + 3)}", rng.choice(("IMPORTS", "USES"))) for _ in range(rng.randrange(1, 4))] for i in ids}


def test_patches_equal_whole_builds(spark):
    rng = random.Random(4)
    files = {f"p{k}": some_file(rng, f"p{k}") for k in range(10)}
    at = patch.snapshot(*frames(spark, files))
    for _ in range(1):
        paths = rng.sample([f"p{k}" for k in range(14)], 4)
        for p in paths:
            if p in files and rng.random() < 0.4:
                del files[p]
            else:
                files[p] = some_file(rng, p)
        new = frames(spark, {p: files[p] for p in paths if p in files})
        at = patch.patch(at, spark.createDataFrame([(p,) for p in paths], "path string"), *new)
        assert content(at) == content(patch.snapshot(*frames(spark, files)))
    assert content(at)[3]


def test_a_loose_end_finds_its_module_later(spark):
    one = {"p1": {"a": [("b", "USES")]}, "p3": {"k": [("l", "USES")], "l": [("k", "USES")]}}
    at = patch.snapshot(*frames(spark, one))
    assert content(at)[1] == [("k", "l", "USES", 30), ("l", "k", "USES", 30)]
    at = patch.patch(at, spark.createDataFrame([("p2",)], "path string"), *frames(spark, {"p2": {"b": [("a", "USES")]}}))
    assert content(at)[1:] == ([("a", "b", "USES", 10), ("b", "a", "USES", 20), ("k", "l", "USES", 30), ("l", "k", "USES", 30)], [("a", "a"), ("b", "a"), ("k", "k"), ("l", "k")], [("a", "b"), ("k", "l")])


def test_changed_paths(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4")], "path string, content string")
    after = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None), ("e", "5")], "path string, content string")
    assert sorted(r.path for r in patch.changed_paths(before, after).collect()) == ["b", "d", "e"]


def test_paths_told_with_dependencies(spark):
    """The declaring module's path comes with its dependencies, as with_paths finds it by a join."""
    told = demo.fk_dependencies(spark, "/root/testdata/sf0.001", with_path=True)
    _, joined = patch.with_paths(demo.fk_modules(spark, "/root/testdata/sf0.001"), demo.fk_dependencies(spark, "/root/testdata/sf0.001"))
    count = lambda df: df.groupBy("path", "source_id", "target_id", "edge_type").count()
    assert told.where("path IS NULL").isEmpty() and count(told).exceptAll(count(joined)).isEmpty() and told.count() == joined.count()
