"""Compiled classes, as javac makes them, and injections that sources don't show."""

import shutil
import subprocess

import pytest

from tributary.plans import analysis
from tributary.sources import classes, files, frontends

ANNOTATION = "package {p}; import java.lang.annotation.*; @Retention(RetentionPolicy.RUNTIME) public @interface {n} {{ String[] value() default {{}}; Class<?>[] of() default {{}}; Deprecated[] more() default {{}}; int k() default 0; }}"
NOTES = [("org.springframework.stereotype", "Service"), ("org.springframework.stereotype", "Component"), ("org.springframework.beans.factory.annotation", "Autowired"), ("jakarta.annotation", "Resource"), ("x.other", "Service")]
USE = "import org.springframework.stereotype.*; import org.springframework.beans.factory.annotation.*; import jakarta.annotation.*;"
SHOP = {
    "Wide": "public interface Wide {}",
    "Api": "public interface Api extends Wide {}",
    "Lone": "public interface Lone {}",
    "Base": "public abstract class Base implements Lone {}",
    "One": '@Service(value = {"a", "b"}, of = {One.class}, more = @Deprecated(since = "1"), k = 7) public class One extends Base implements Api { long big = 12345678901L; double d = 1.5; }',
    "Two": "@Component public class Two implements Api, Other { enum Mode { A } }",
    "Other": "public interface Other {}",
    "Plain": "public class Plain implements Other {}",
    "None": "@x.other.Service public class None { @Autowired Lone lone; }",
    "Uses": "@Service public class Uses { @Autowired private Lone lone; @Resource Wide wide; @Autowired Base base; @Autowired Other other; @Autowired Plain plain; @Autowired String s; @Autowired One[] many; Lone unused; public Uses() {} public Uses(Two two, int k) {} }",
    "Built": "@Component public class Built { Built(Uses uses, java.util.List<Api> l, long n, int[][] a) {} void m() { Runnable r = () -> {}; r.run(); } }",
    "Picked": "@Component public class Picked { Picked() {} @Autowired Picked(Two two) {} Picked(Uses u) {} }",
}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    if not shutil.which("javac"):
        pytest.skip("no javac")
    root = tmp_path_factory.mktemp("compiled [x]")
    source, out = root / "a/src/main/java", root / "a/target/classes"
    some = [source / f"shop/{n}.java" for n in SHOP]
    (source / "shop").mkdir(parents=True)
    out.mkdir(parents=True)
    for path, body in zip(some, SHOP.values(), strict=True):
        path.write_text(f"package shop; {USE} {body}")
    notes = root / "notes"
    for p, n in NOTES:
        path = notes / p.replace(".", "/") / f"{n}.java"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(ANNOTATION.format(p=p, n=n))
        some.append(path)
    subprocess.run(["javac", "-nowarn", "-d", str(out), *map(str, some)], check=True, capture_output=True)
    shutil.rmtree(notes)
    (out / "Broken.class").write_bytes((out / "shop/One.class").read_bytes()[:150])
    (out / "Empty.class").write_bytes(b"")
    (root / "b/c/d/target/classes").mkdir(parents=True)  # too deep
    shutil.copy(out / "shop/One.class", root / "b/c/d/target/classes")
    return root


WANTED = {
    ("shop.Uses", "shop.One", "@Autowired lone"), ("shop.Uses", "shop.One", "@Autowired base"), ("shop.Uses", "shop.Two", "@Autowired other"), ("shop.Uses", "shop.Plain", "@Autowired plain"),
    ("shop.Built", "shop.Uses", "constructor(shop.Uses)"), ("shop.Picked", "shop.Two", "constructor(shop.Two)"),
}


def test_class_files(project):
    found = classes.read((project / "a/target/classes/shop/Uses.class").read_bytes())
    assert (found["name"], found["parent"], found["interfaces"], found["bean"]) == ("shop.Uses", "java.lang.Object", [], True)
    assert set(found["injected"]) == {(t, f"{a} {n}") for t, a, n in (("shop.Lone", "@Autowired", "lone"), ("shop.Wide", "@Resource", "wide"), ("shop.Base", "@Autowired", "base"), ("shop.Other", "@Autowired", "other"), ("shop.Plain", "@Autowired", "plain"), ("java.lang.String", "@Autowired", "s"), ("[Lshop.One;", "@Autowired", "many"))}
    built = classes.read((project / "a/target/classes/shop/Built.class").read_bytes())
    assert [t for t, _ in built["injected"]] == ["shop.Uses", "java.util.List", "long", "[[I"]
    assert not classes.read((project / "a/target/classes/shop/None.class").read_bytes())["bean"]
    whole = (project / "a/target/classes/shop/One.class").read_bytes()
    assert classes.read(whole)["interfaces"] == ["shop.Api"]
    for n in range(0, len(whole) - 1, 7):  # any cut is an error of one kind, or leaves out what nothing needs
        try:
            assert classes.read(whole[:n])["name"] == "shop.One"
        except ValueError:
            pass


def test_injections_of_compiled_classes(spark, project):
    assert [r.rpartition("/a/")[2] for r in classes.class_roots(spark, str(project))] == ["target/classes"]
    compiled = classes.class_files(spark, str(project))
    assert {r.folder for r in compiled.collect()} == {"a/target/classes"}
    hook = classes.compiled(spark, compiled)
    parsed = frontends.parse(files.scan(spark, str(project), ["java"]))
    more = hook(parsed)
    assert {(r.source_id[5:], r.target_id[5:], r.evidence) for r in more.dependencies.collect()} == WANTED
    spots = {(r.location, r.description) for r in more.blind_spots.collect()}
    assert ("shop.Uses", "Ambiguous: shop.Wide has 2 implementations (One, Two)") in spots
    assert sorted(d.split(":")[0] for where, d in spots if where == "class-scan") == ["a/target/classes/Broken.class"] and len(spots) == 2  # Spark's reader leaves out empty files
    assert "not a class file" not in str(spots) and classes.classes(spark.createDataFrame([("f", "p", b""), ("f", "q", None)], "folder string, path string, content binary")).where("error is not null").count() == 2


def test_hooks_and_what_is_missing(spark, project, tmp_path):
    plain, seen = files.scan(spark, str(project), ["java"]), []

    def second(parsed):
        seen.append(parsed.dependencies.where("evidence = '@Autowired lone'").count())
        return frontends.nothing(spark)

    found = analysis.analyse(plain, hooks=[classes.compiled(spark, classes.class_files(spark, str(project))), second])
    kinds = {(r.source, r.target): r.type for r in found.graph.edges.collect()}
    assert all(kinds[a, b] == "SPRING_DI" for a, b, _ in WANTED) and seen == [1]
    assert classes.class_roots(spark, str(tmp_path)) == [] and classes.class_files(spark, str(tmp_path)).count() == 0
    none = classes.compiled(spark, classes.class_files(spark, str(tmp_path)))(frontends.nothing(spark))
    assert none.dependencies.count() == none.blind_spots.count() == 0
