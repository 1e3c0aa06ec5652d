"""Symbol resolution for Java: what each type named in a field, a supertype or an import is, by the language's scopes.

Files are tokenized in parallel; scopes are joins. Every name becomes candidates
with a rank, from the innermost scope outwards: member types (declared, then
inherited), type parameters and names of the enclosing types; single imports; the
package; imports on demand, with java.lang; names in full. The candidates of the
best rank that exist decide. All joins are on full names, so the frequent ones
meet one row on the other side, and what is wanted of the platform is only asked
for by package.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.scratch import cut
from tributary.sources import java

_STRINGS = pa.list_(pa.string())
_PAIRS = pa.list_(pa.struct([("field", pa.string()), ("name", pa.string())]))
_SCHEMA = pa.schema(
    [
        ("path", pa.string()), ("package", pa.string()), ("fqcn", pa.string()), ("chain", _STRINGS), ("params", pa.list_(_STRINGS)),
        ("supers", _STRINGS), ("imports", _STRINGS), ("statics", _STRINGS), ("demands", _STRINGS), ("typed", _PAIRS), ("error", pa.string()),
    ]
)
_DDL = "path string, package string, fqcn string, chain array<string>, params array<array<string>>, supers array<string>, imports array<string>, statics array<string>, demands array<string>, typed array<struct<field:string,name:string>>, error string"

#: Ranks beyond those of enclosing types, three a level.
_IMPORT, _PACKAGE, _DEMAND, _FULL = 10_000, 10_001, 10_002, 10_003


def _rows(path: str, content: str) -> list[tuple]:
    try:
        found = java.read(content)
    except (IndexError, ValueError) as e:
        return [(path, *[None] * 9, f"{path}: {e}")]
    dotted = lambda parts: ".".join([p for p in (found["package"], *parts) if p])
    params = {dotted([*t["within"], t["name"]]): t["params"] for t in found["types"]}
    rows = []
    for t in found["types"]:
        names = [*t["within"], t["name"]]
        chain = [dotted(names[:k]) for k in range(len(names), 0, -1)]
        typed = [{"field": f, "name": n} for f, n in t["typed"]]
        rows.append((path, found["package"], chain[0], chain, [params.get(c, []) for c in chain], t["supers"], found["imports"], found["statics"], found["demands"], typed, None))
    return rows


def declared(files: DataFrame) -> DataFrame:
    """One row a type of files (path, content), nested ones under their full names, with what is needed to resolve its names; or an error."""

    def run(batches):
        for b in batches:
            rows = [r for p, c in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True) for r in _rows(p, c or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_SCHEMA)], schema=_SCHEMA)

    return files.select("path", "content").mapInArrow(run, _DDL)


def platform_types(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """(fqcn, outer): the types of the Java platform in the packages named, as the running Java lists them.

    Only packages that the platform has are looked at, so the driver holds no more than the platform's own list.
    """
    jvm = spark.sparkContext._jvm
    jrt = jvm.java.nio.file.FileSystems.getFileSystem(jvm.java.net.URI.create("jrt:/"))

    def listed(path) -> list[str]:
        stream = jvm.java.nio.file.Files.list(path)
        try:
            return jvm.java.util.Arrays.toString(stream.toArray())[1:-1].split(", ")
        finally:
            stream.close()

    have = spark.createDataFrame([(p.removeprefix("/packages/"),) for p in listed(jrt.getPath("/packages", spark.sparkContext._gateway.new_array(jvm.String, 0)))], "package string")
    wanted = [r.package for r in packages.select("package").distinct().join(F.broadcast(have), "package", "left_semi").collect()]
    none, rows = spark.sparkContext._gateway.new_array(jvm.String, 0), []
    for package in sorted(wanted):
        for module in listed(jrt.getPath(f"/packages/{package}", none)):
            folder = jrt.getPath(f"/modules/{module.rpartition('/')[2]}/{package.replace('.', '/')}", none)
            if not jvm.java.nio.file.Files.isDirectory(folder, spark.sparkContext._gateway.new_array(jvm.java.nio.file.LinkOption, 0)):
                continue
            for f in listed(folder):
                parts = f.rpartition("/")[2].removesuffix(".class").split("$")
                if f.endswith(".class") and all(p and not p[0].isdigit() for p in parts) and "-" not in f:
                    rows.append((".".join([package, *parts]), ".".join([package, *parts[:-1]]) if len(parts) > 1 else None))
    return spark.createDataFrame(rows, "fqcn string, outer string")


def _packages(types: DataFrame) -> DataFrame:
    """(package): every prefix of what files import or name in full, and java.lang."""
    named = F.flatten(F.array("imports", "statics", "demands", "supers", F.col("typed.name")))
    names = types.select(F.explode(named).alias("name")).where(F.contains("name", F.lit("."))).distinct()
    parts = F.split("name", r"\.")
    prefixes = names.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("package"))
    return prefixes.unionByName(types.sparkSession.range(1).select(F.lit("java.lang").alias("package"))).distinct()


class Scopes:
    """The types of a project and what they hold: known (fqcn), members (owner, name, target), inherited ones included."""

    def __init__(self, types: DataFrame, external: DataFrame | None = None):
        """types: of declared(), without errors. external: (fqcn, outer) of types outside the project; those of the Java platform unless given."""
        external = platform_types(types.sparkSession, _packages(types)) if external is None else external
        own = types.select("fqcn", F.get("chain", F.lit(1)).alias("outer"))
        every = cut(own.unionByName(external.select("fqcn", "outer")).distinct(), "known")
        self.known = every.select("fqcn").distinct()
        self.members = every.where("outer is not null").select(F.col("outer").alias("owner"), F.substring_index("fqcn", ".", -1).alias("name"), F.col("fqcn").alias("target"))
        self._inherit(types)

    def _inherit(self, types: DataFrame) -> None:
        """Adds inherited members; as they may be needed to find supertypes, until no more supertype is found."""
        # A type's header is in the scope of what encloses it.
        heads = types.select("path", "package", "fqcn", F.expr("slice(chain, 2, size(chain))").alias("chain"), "params", "imports", "statics", "demands", F.explode("supers").alias("name"))
        heads = cut(heads.withColumn("params", F.expr("slice(params, 2, size(params))")), "heads")
        own, before = self.members, -1
        while True:
            links = cut(self.resolve(heads, ["fqcn"]).where("status = 'resolved'").select("fqcn", F.col("target").alias("super")).distinct(), "supers")
            n = links.count()
            if n == before:
                return
            before, found, front = n, own, own
            while True:
                front = links.join(front, F.col("super") == F.col("owner")).select(F.col("fqcn").alias("owner"), "name", "target").distinct()
                front = cut(front.join(found.select("owner", "name").distinct(), ["owner", "name"], "left_anti"), "inherited")
                if not front.head(1):
                    break
                found = found.unionByName(front)
            self.members = cut(found, "members")

    def resolve(self, names: DataFrame, keep: list[str]) -> DataFrame:
        """The columns in keep and name, target, status of each row of names.

        names has path, package, chain (enclosing types, innermost first), params (their
        type parameters), imports, statics, demands and name. status: resolved, type_variable,
        ambiguous (several types at the best rank) or unresolved; target is null for the last three.
        """
        rows = cut(names.withColumn("k", F.monotonically_increasing_id()), "names")
        parts = F.split("name", r"\.")
        head, rest = F.get(parts, F.lit(0)), F.slice(parts, F.lit(2), F.size(parts))
        last = lambda x: F.substring_index(x, ".", -1)
        joined = lambda a, b: F.concat_ws(".", F.when(a != "", a), b)
        some = rows.select("k", "package", "chain", "params", "imports", "statics", "demands", head.alias("head"), rest.alias("rest"), parts.alias("parts"))
        levels = some.select("k", "head", "rest", F.posexplode("chain").alias("level", "owner"), "params")
        member = levels.join(self.members.withColumnRenamed("name", "head"), ["owner", "head"])
        member = member.select("k", (F.col("level") * 3).alias("rank"), "target", "rest")
        variable = levels.where(F.array_contains(F.get("params", F.col("level")), F.col("head"))).select("k", (F.col("level") * 3 + 1).alias("rank"), F.lit(None).cast("string").alias("target"), "rest")
        itself = levels.where(last(F.col("owner")) == F.col("head")).select("k", (F.col("level") * 3 + 2).alias("rank"), F.col("owner").alias("target"), "rest")
        # A single import counts whether what it names exists or not; the others only where it does.
        single = some.select("k", F.lit(_IMPORT).alias("rank"), F.explode(F.array_distinct(F.filter("imports", lambda i: last(i) == F.col("head")))).alias("target"), "rest")
        demand = F.array_union("demands", F.array(F.lit("java.lang")))
        prefixes = F.transform(F.sequence(F.lit(2), F.size("parts")), lambda n: F.struct((F.lit(_FULL) + F.size("parts") - n).alias("rank"), F.array_join(F.slice("parts", F.lit(1), n), ".").alias("target"), F.slice("parts", n + 1, F.size("parts")).alias("rest")))
        static = F.transform(F.filter("statics", lambda i: last(i) == F.col("head")), lambda t: F.struct(F.lit(_IMPORT).alias("rank"), t.alias("target"), F.col("rest").alias("rest")))
        near = F.array(F.struct(F.lit(_PACKAGE).alias("rank"), joined(F.col("package"), F.col("head")).alias("target"), F.col("rest").alias("rest")))
        wide = F.transform(demand, lambda d: F.struct(F.lit(_DEMAND).alias("rank"), F.concat_ws(".", d, F.col("head")).alias("target"), F.col("rest").alias("rest")))
        full = F.when(F.size("parts") > 1, prefixes).otherwise(F.array().cast("array<struct<rank:int,target:string,rest:array<string>>>"))
        asked = some.select("k", F.explode(F.concat(static, near, wide, full)).alias("c")).select("k", "c.rank", "c.target", "c.rest")
        asked = asked.join(self.known.select(F.col("fqcn").alias("target")), "target", "left_semi").select("k", "rank", "target", "rest")
        every = member.unionByName(variable).unionByName(itself).unionByName(single).unionByName(asked)
        best = cut(every.withColumn("least", F.min("rank").over(Window.partitionBy("k"))).where("rank = least").select("k", "target", "rest").distinct(), "best")
        # The rest of a name are members of what its head is.
        done = best.where(F.size("rest") == 0)
        while best.where(F.size("rest") > 0).head(1):
            inner = best.where(F.size("rest") > 0).select("k", F.col("target").alias("owner"), F.get("rest", F.lit(0)).alias("name"), F.expr("slice(rest, 2, size(rest))").alias("rest"))
            best = cut(inner.join(self.members, ["owner", "name"]).select("k", "target", "rest").distinct(), "best")
            done = done.unionByName(best.where(F.size("rest") == 0))
        sure = done.join(self.known.select(F.col("fqcn").alias("target"), F.lit(True).alias("exists")), "target", "left")
        told = sure.groupBy("k").agg(F.count("*").alias("n"), F.max("target").alias("target"), F.bool_and(F.col("target").isNull()).alias("free"), F.bool_or(F.coalesce("exists", F.lit(False))).alias("exists"))
        status = F.when(F.col("free"), "type_variable").when(F.col("n") > 1, "ambiguous").when(F.col("exists"), "resolved").otherwise("unresolved")
        out = rows.select("k", *keep, "name").join(told, "k", "left").withColumn("status", F.coalesce(status, F.lit("unresolved")))
        return out.select(*keep, "name", F.when(F.col("status") == "resolved", F.col("target")).alias("target"), "status")


def field_types(files: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """(path, source, field, name, target, status): each type that a field of a declared type names, its type arguments' too.

    Fields of anonymous and local types aren't read. Primitive types have no row, files without types or fields none.
    """
    types = cut(declared(files).where("error is null").drop("error"), "declared")
    names = types.select("path", "package", F.col("fqcn").alias("source"), "chain", "params", "imports", "statics", "demands", F.inline("typed"))
    return Scopes(types, external).resolve(names, ["path", "source", "field"])


def solved(files: DataFrame, fields: DataFrame) -> DataFrame:
    """(path, solved) of every file: it could be read, and every type of its fields (of field_types) is resolved or a type variable."""
    bad = declared(files).where("error is not null").select("path").unionByName(fields.where("status not in ('resolved', 'type_variable')").select("path")).distinct()
    return files.select("path").distinct().join(bad.withColumn("bad", F.lit(True)), "path", "left").select("path", F.col("bad").isNull().alias("solved"))


def unresolved(fields: DataFrame) -> DataFrame:
    """Blind spots of field types that could not be resolved, where imports are all that is known of a file."""
    lost = fields.where("status in ('unresolved', 'ambiguous')")
    return lost.select(F.concat_ws("-", "status", F.lit("type")).alias("type"), F.col("source").alias("location"), F.concat_ws(" ", "field", "name").alias("description")).distinct()


def imported(files: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """(path, import, target): the project's types that each import means: itself, a static member's class, all below a package or type imported on demand."""
    types = declared(files).where("error is null")
    lines = types.select("path", F.explode(F.concat("imports", "statics", F.transform("demands", lambda d: F.concat(d, F.lit(".*"))))).alias("import")).distinct()
    known = types.select("fqcn").distinct() if external is None else types.select("fqcn").unionByName(external.select("fqcn")).distinct()
    plain = lines.withColumn("target", java.resolve_import(F.col("import"))).join(known.select(F.col("fqcn").alias("target")), "target", "left_semi")
    wide = lines.join(java.resolve_wildcards(lines.select("import").distinct(), known), "import").select("path", "import", F.col("fqcn").alias("target"))
    return plain.select("path", "import", "target").unionByName(wide)
