"""Names are resolved by Java's scopes; what must come out is told case by case."""

from tributary.sources import symbols

FILES = {
    "a/Base.java": "package a; public class Base<X> { public static class Inner { public interface Deep {} } protected enum Mode { ON } X own; }",
    "a/Plain.java": "package a; class Plain extends Base<String> { Inner i; Mode m; Inner.Deep d; Plain me; a.Base.Inner full; X gone; }",
    "a/List.java": "package a; public class List {}",
    "b/User.java": """package b; import a.*; import java.util.*; import java.util.Map; import org.absent.Thing; import static a.Base.Inner;
        class User<T extends Comparable<T>> { List both; Map<String, ? extends T[]> map; Map.Entry<T, Integer> e; Thing t; Inner in; int n; T[] more; Missing x; Other o; java.util.Set<Other> s;
          class Nested extends Base<T> { Mode mode; T t; User<T> up; } static class T2<V> { V v; T kept; } }
        class Other implements Runnable { Thread th; }""",
    "b/Chain.java": "package b; class Chain extends Mid { Leaf l; } class Mid extends a.Base<Object> { static class Leaf extends Inner { Deep d; } } enum Em implements Has { A, B; Got g; } interface Has { class Got {} }",
    "c/Hide.java": "package c; class Hide extends a.Base<Hide> { static class Inner {} Inner i; String s; class String {} Object o; class Loop extends Loop { Loop l; } }",
    "c/Root.java": "class Rootless { Rootless r; Hide h; }",
    "c/Broken.java": "package c; class",
    "c/None.java": "",
}


def table(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def test_fields_of_every_scope(spark):
    files = table(spark, FILES)
    fields = symbols.field_types(files)
    got = {(r.source, r.field, r.name): r.target or r.status for r in fields.collect()}
    assert got == {
        ("a.Base", "own", "X"): "type_variable",
        ("a.Plain", "i", "Inner"): "a.Base.Inner", ("a.Plain", "m", "Mode"): "a.Base.Mode", ("a.Plain", "d", "Inner.Deep"): "a.Base.Inner.Deep",
        ("a.Plain", "me", "Plain"): "a.Plain", ("a.Plain", "full", "a.Base.Inner"): "a.Base.Inner", ("a.Plain", "gone", "X"): "unresolved",
        ("b.User", "both", "List"): "ambiguous", ("b.User", "map", "Map"): "java.util.Map", ("b.User", "map", "String"): "java.lang.String", ("b.User", "map", "T"): "type_variable",
        ("b.User", "e", "Map.Entry"): "java.util.Map.Entry", ("b.User", "e", "T"): "type_variable", ("b.User", "e", "Integer"): "java.lang.Integer",
        ("b.User", "t", "Thing"): "unresolved", ("b.User", "in", "Inner"): "a.Base.Inner", ("b.User", "more", "T"): "type_variable", ("b.User", "x", "Missing"): "unresolved",
        ("b.User", "o", "Other"): "b.Other", ("b.User", "s", "java.util.Set"): "java.util.Set", ("b.User", "s", "Other"): "b.Other",
        ("b.User.Nested", "mode", "Mode"): "a.Base.Mode", ("b.User.Nested", "t", "T"): "type_variable", ("b.User.Nested", "up", "User"): "b.User", ("b.User.Nested", "up", "T"): "type_variable",
        ("b.User.T2", "v", "V"): "type_variable", ("b.User.T2", "kept", "T"): "type_variable", ("b.Other", "th", "Thread"): "java.lang.Thread",
        ("b.Chain", "l", "Leaf"): "b.Mid.Leaf", ("b.Mid.Leaf", "d", "Deep"): "a.Base.Inner.Deep", ("b.Em", "g", "Got"): "b.Has.Got",
        ("c.Hide", "i", "Inner"): "c.Hide.Inner", ("c.Hide", "s", "String"): "c.Hide.String", ("c.Hide", "o", "Object"): "java.lang.Object", ("c.Hide.Loop", "l", "Loop"): "c.Hide.Loop",
        ("Rootless", "r", "Rootless"): "Rootless", ("Rootless", "h", "Hide"): "unresolved",
    }
    state = {r.path: r.solved for r in symbols.solved(files, fields).collect()}
    assert {p for p, ok in state.items() if not ok} == {"a/Plain.java", "b/User.java", "c/Root.java"} and set(state) == set(FILES)
    assert {(r.type, r.description) for r in symbols.unresolved(fields).where("location = 'b.User'").collect()} == {("ambiguous-type", "both List"), ("unresolved-type", "t Thing"), ("unresolved-type", "x Missing")}


def test_given_types_stand_for_the_platform(spark):
    files = table(spark, {"A.java": "import lib.*; class A { Kit k; Kit.Part p; String s; }"})
    lib = spark.createDataFrame([("lib.Kit", None), ("lib.Kit.Part", "lib.Kit")], "fqcn string, outer string")
    assert {(r.field, r.target, r.status) for r in symbols.field_types(files, lib).collect()} == {("k", "lib.Kit", "resolved"), ("p", "lib.Kit.Part", "resolved"), ("s", None, "unresolved")}
    assert symbols.field_types(files.limit(0), lib).count() == 0


def test_imports(spark):
    files = table(spark, {"A.java": "package x; import y.B; import static y.B.run; import y.*; import z.Gone; import static y.B.*; class A {}", "B.java": "package y; public class B { static class In {} }", "C.java": "package y.deep; class C {}"})
    assert {(r["import"], r.target) for r in symbols.imported(files).collect()} == {("y.B", "y.B"), ("y.B.run", "y.B"), ("y.*", "y.B"), ("y.*", "y.B.In"), ("y.*", "y.deep.C"), ("y.B.*", "y.B.In")}
