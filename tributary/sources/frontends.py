"""Language front ends: from source files to declarations.

A front end takes files (path, content, length) and returns Parsed frames. All
work on sets of files, so no result depends on the order in which files come.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.build import build, warnings
from tributary.schema import BLIND_SPOTS, DEPENDENCIES, MODULES, Graph
from tributary.scratch import cut
from tributary.sources import java
from tributary.sources.files import parsable, route, too_large


@dataclass
class Parsed:
    """modules and dependencies declared, blind spots, errors (path, message)."""

    modules: DataFrame
    dependencies: DataFrame
    blind_spots: DataFrame
    errors: DataFrame

    def __add__(self, other: Parsed) -> Parsed:
        return Parsed(*(a.unionByName(b) for a, b in ((self.modules, other.modules), (self.dependencies, other.dependencies), (self.blind_spots, other.blind_spots), (self.errors, other.errors))))


def nothing(spark) -> Parsed:
    return Parsed(spark.createDataFrame([], MODULES), spark.createDataFrame([], DEPENDENCIES), spark.createDataFrame([], BLIND_SPOTS), spark.createDataFrame([], "path string, message string"))


def module_rows(rows: DataFrame, prefix: str, id_: Column, kind: Column, path: Column, confidence: str) -> DataFrame:
    """Module declarations; seq follows from path and id, so first and last mean the same everywhere."""
    return rows.select(F.concat(F.lit(f"{prefix}:"), id_).alias("id"), kind.alias("type"), path.alias("source_path"), F.lit(confidence).alias("confidence"), F.xxhash64(path, id_).alias("seq"))


def dependency_rows(rows: DataFrame, prefix: str, source: Column, target: Column, kind: Column, confidence: str, evidence: Column, order: Column) -> DataFrame:
    """Dependency declarations; of equal pairs the one of the highest order wins, ties by evidence."""
    at = lambda c: F.concat(F.lit(f"{prefix}:"), c)
    seq = F.shiftright(F.xxhash64(evidence), 4).bitwiseAND(F.lit((1 << 56) - 1)) + order.cast("long") * F.lit(1 << 57)
    return rows.select(at(source).alias("source_id"), at(target).alias("target_id"), kind.alias("edge_type"), F.lit(confidence).alias("confidence"), evidence.alias("evidence"), F.lit(False).alias("dynamic"), seq.alias("seq"))


def folder(path: Column) -> Column:
    """The folder of a path; empty at the root."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def normal(path: Column) -> Column:
    """A path without . and .. parts; .. at the root goes nowhere."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


# JavaScript, TypeScript and Vue.

JS_EXTENSIONS = ["ts", "tsx", "js", "jsx", "vue", "mjs", "cjs"]
# Modules that Node.js has itself.
NODE_BUILTINS = (
    "assert", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "dns", "domain",
    "events", "fs", "http", "https", "module", "net", "os", "path", "perf_hooks", "process", "punycode",
    "querystring", "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls", "tty", "url", "util",
    "v8", "vm", "worker_threads", "zlib",
)


def vue_script(files: DataFrame) -> DataFrame:
    """files with content cut to the first script of Vue files; null where a Vue file has none."""
    tag = F.get(F.split("content", r"(?i)<script(?=[\s>])", 2), F.lit(1))
    body = F.split(F.get(F.split(tag, ">", 2), F.lit(1)), "(?i)</script>", 2)
    script = F.when(F.size(body) == 2, F.get(body, F.lit(0)))
    return files.withColumn("content", F.when(F.endswith("path", F.lit(".vue")), script).otherwise(F.col("content")))


def is_builtin(name: Column) -> Column:
    return F.get(F.split(F.regexp_replace(name, "^node:", ""), "/"), F.lit(0)).isin(*NODE_BUILTINS)


def js_statements(files: DataFrame) -> DataFrame:
    """(path, word, clause, import): what follows each word import or export, up to its first quoted string.

    clause is what is between the word and from, braces emptied, null without a from that stands alone.
    """
    emptied = F.regexp_replace("content", r"\{[^{}'\"]*\}", "{}")
    rows = files.select("path", F.explode(F.split(emptied, r"\b(?=(?:import|export)\s)")).alias("part"))
    rows = rows.select("path", F.split("part", "['\"]", 3).alias("cut")).where(F.size("cut") == 3)
    before = F.get("cut", F.lit(0))
    word, rest = F.substring(before, 1, 6), F.expr("substring(cut[0], 7)")
    clause = F.when(rest.rlike(r"\sfrom\s+$"), F.btrim(F.regexp_replace(rest, r"from\s+$", ""), F.lit(" \t\r\n\f\x0b")))
    return rows.where(word.isin("import", "export")).select("path", word.alias("word"), clause.alias("clause"), F.get("cut", F.lit(1)).alias("import")).where("import != ''")


def js_imports(files: DataFrame) -> DataFrame:
    """(path, import): distinct specifiers of imports and re-exports.

    An import binds names, braces or a namespace, one or more of them, perhaps as
    types; a re-export has braces or a namespace. Those that bind nothing don't count.
    """
    rows = js_statements(vue_script(files))
    space = lambda c: c.rlike(r"^\*\s+as\s+\w+$")
    binds = lambda c: (c == "{}") | c.rlike(r"^\w+$") | space(c)
    plain = F.regexp_replace("clause", r"^type\s+", "")
    imported = F.forall(F.split(plain, r"\s*,\s*"), binds)
    again = (F.col("clause") == "{}") | space(F.col("clause"))
    return rows.where(F.when(F.col("word") == "import", imported).otherwise(again)).select("path", "import").distinct()


def resolve_js(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with target: a path with a known extension as it is, else the first file with an extension or index, else the bare path."""
    raw = normal(F.concat(folder(F.col("path")), F.lit("/"), F.col("import")))
    known = raw.rlike(r"\.(" + "|".join(JS_EXTENSIONS) + ")$")
    tries = F.array(*[F.concat(F.col("raw"), F.lit(f".{e}")) for e in JS_EXTENSIONS], *[F.concat(F.col("raw"), F.lit(f"/index.{e}")) for e in JS_EXTENSIONS])
    rows = imports.withColumn("raw", raw).withColumn("known", known)
    candidates = rows.select("path", "import", "raw", "known", F.posexplode(F.when(F.col("known"), F.array("raw")).otherwise(tries)).alias("pos", "candidate"))
    there = files.select(F.col("path").alias("candidate")).distinct().withColumn("there", F.lit(True))
    joined = candidates.join(there, "candidate", "left")
    best = joined.groupBy("path", "import", "raw").agg(F.min_by("candidate", F.when(F.col("there") | F.col("known"), F.col("pos"))).alias("hit"))
    return best.select("path", "import", F.coalesce("hit", "raw").alias("target"))


def javascript(files: DataFrame) -> Parsed:
    """Relative imports become dependencies; others that Node.js doesn't have itself are blind spots."""
    found = js_imports(files)
    local = resolve_js(found.where(F.startswith("import", F.lit("."))), files)
    loose = found.where(~F.startswith("import", F.lit(".")) & ~is_builtin(F.col("import")))
    spots = loose.select(F.lit("UnresolvedModule").alias("type"), F.col("path").alias("location"), F.concat(F.lit("import of a package: "), "import").alias("description"))
    deps = dependency_rows(local, "js", F.col("path"), F.col("target"), F.lit("IMPORTS"), "MEDIUM", F.concat(F.lit("import "), "import"), F.lit(0))
    modules = module_rows(files, "js", F.col("path"), F.lit("MODULE"), F.col("path"), "MEDIUM")
    return Parsed(modules, deps, spots, nothing(files.sparkSession).errors)


CRUISE = "modules array<struct<source:string,coreModule:boolean,dependencies:array<struct<resolved:string,module:string,coreModule:boolean,couldNotResolve:boolean>>>>"


def dependency_json(spark, path: str) -> Parsed:
    """Declarations of a dependency scanner's JSON report: modules with dependencies, each resolved or not."""
    modules = spark.read.schema(CRUISE).option("multiLine", "true").json(path).select(F.explode("modules").alias("m")).select("m.*")
    outside = lambda c: F.coalesce(c, F.lit("")).rlike("(^|/)node_modules/") | is_builtin(F.coalesce(c, F.lit("")))
    own = modules.where(~F.coalesce("coreModule", F.lit(False)) & ~outside(F.col("source")))
    each = own.select("source", F.explode("dependencies").alias("d")).select("source", "d.*").where(~F.coalesce("coreModule", F.lit(False)))
    failed = F.coalesce("couldNotResolve", F.lit(False))
    name = F.coalesce("module", "resolved")
    spots = each.where(failed & ~is_builtin(name)).select(F.lit("UnresolvedModule").alias("type"), F.col("source").alias("location"), F.concat(F.lit("not resolved: "), name).alias("description"))
    local = each.where(~failed & F.col("resolved").isNotNull() & ~outside(F.col("resolved")) & ~is_builtin(name))
    deps = dependency_rows(local, "js", F.col("source"), F.col("resolved"), F.lit("IMPORTS"), "HIGH", F.concat(F.lit("import "), name), F.lit(0))
    return Parsed(module_rows(own, "js", F.col("source"), F.lit("MODULE"), F.col("source"), "HIGH"), deps, spots, nothing(spark).errors)


# Python.

PY_EXTENSIONS = ["py", "pyi", "pyw"]


def py_imports(files: DataFrame, strict: bool = False) -> DataFrame:
    """(path, import): distinct modules that lines import; relative ones with their dots.

    strict: no comments, an alias only at the end of a line that begins with
    import, none in one that begins with from, and no parentheses with blanks.
    """
    dotted = lambda c: c.rlike(r"^[\w.]+$")
    at = lambda c, k: F.get(c, F.lit(k))
    lines = files.select("path", F.explode(F.split("content", "\n")).alias("line")).select("path", F.btrim("line", F.lit(" \t\r\f\x0b")).alias("line"))
    lines = lines.where(F.col("line").rlike(r"^(import|from)\s")).select("path", "line", F.split("line", r"\s+", 4).alias("w"))

    bare = F.col("line") if strict else F.regexp_replace("line", r"\s*[#;].*$", "")
    items = F.transform(F.split(F.regexp_replace(bare, r"^import\s+", ""), r"\s*,\s*"), lambda x: F.split(x, r"\s+"))
    single = lambda x: (F.size(x) == 1) & dotted(at(x, 0))
    alias = lambda x: (F.size(x) == 3) & dotted(at(x, 0)) & (at(x, 1) == "as") & at(x, 2).rlike(r"^\w+$")
    most = F.forall(F.slice(items, F.lit(1), F.size(items) - 1), single) if strict else F.lit(True)
    plain = F.when((at(F.col("w"), 0) == "import") & most & F.forall(items, lambda x: single(x) | alias(x)), F.transform(items, lambda x: at(x, 0)))

    names = at(F.col("w"), 3)
    listed = ~F.regexp_replace(names, r"\s*,\s*", ",").rlike(r"\s") & ~names.rlike(r"\s,$") if strict else F.lit(True)
    origin = F.when((at(F.col("w"), 0) == "from") & dotted(at(F.col("w"), 1)) & (at(F.col("w"), 2) == "import") & (names != "") & listed, F.array(at(F.col("w"), 1)))
    return lines.select("path", F.explode(F.coalesce(plain, origin)).alias("import")).distinct()


# Modules that the standard library had and that newer versions of Python no longer name.
FORMER_STDLIB = (
    "aifc", "asynchat", "asyncore", "audioop", "binhex", "cgi", "cgitb", "chunk", "crypt", "distutils", "formatter", "imghdr", "imp", "lib2to3", "mailcap", "msilib",
    "nis", "nntplib", "ossaudiodev", "parser", "pipes", "smtpd", "sndhdr", "spwd", "sunau", "symbol", "telnetlib", "thread", "uu", "xdrlib",
)


def is_stdlib(module: Column) -> Column:
    """Whether a dotted module's first part is, or once was, in the standard library, whatever the case."""
    names = sorted({n.lower() for n in sys.stdlib_module_names} | set(FORMER_STDLIB))
    return F.lower(F.get(F.split(module, r"\."), F.lit(0))).isin(*names)


def py_roots(files: DataFrame) -> DataFrame:
    """(path, root, id, package): the source root above the topmost of the packages that a file is in, and what it is called from there."""
    packages = files.where(F.col("path").rlike(r"(^|/)__init__\.pyi?$")).select(folder(F.col("path")).alias("above"), F.lit(True).alias("is_package")).distinct()
    dirs = files.select(folder(F.col("path")).alias("dir")).distinct()
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    ups = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))).alias("u")).select("dir", "u.*")
    bare = ups.join(packages.where("above != ''"), "above", "left").where("is_package is null")
    roots = bare.groupBy("dir").agg(F.max_by("above", "k").alias("root"))
    rows = files.select("path", folder(F.col("path")).alias("dir")).join(roots, "dir")
    rows = rows.withColumn("root", F.when(F.col("root") == F.col("dir"), "").otherwise(F.col("root")))
    below = F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
    return rows.select("path", "root", F.regexp_replace(below, r"\.(pyi|pyw|py)$", "").alias("id")).withColumn("package", F.replace(folder(F.col("id")), F.lit("/"), F.lit(".")))


def resolve_py(imports: DataFrame, roots: DataFrame) -> DataFrame:
    """(source, import, target): the module ids that imports mean; __init__ stands for its package.

    A module is looked for in the importer's packages' root, then under tests folders beside up to three packages above.
    """
    rows = imports.join(roots, "path").select(F.col("id").alias("source"), "package", "import")
    dots = F.length(F.regexp_extract("import", r"^(\.*)", 1))
    rest = F.regexp_replace("import", r"^\.+", "")
    up = F.when(F.col("package") == "", F.array().cast("array<string>")).otherwise(F.split("package", r"\."))
    base = F.slice(up, F.lit(1), F.greatest(F.size(up) - dots + 1, F.lit(0)))
    dotted = F.when(dots == 0, F.col("import")).otherwise(F.array_join(F.filter(F.array(F.array_join(base, "."), rest), lambda x: x != ""), "."))
    impossible = (dots > 1) & (F.col("package") == "")
    rows = rows.where(~impossible).where((dots > 0) | ~is_stdlib(F.col("import"))).withColumn("dotted", dotted).where("dotted != ''")
    slashed = F.replace("dotted", F.lit("."), F.lit("/"))
    above = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.array_join(F.filter(F.flatten(F.array(F.slice(up, F.lit(1), F.greatest(F.size(up) - k, F.lit(0))), F.array(F.lit("tests"), slashed))), lambda x: x != ""), "/"))
    bases = F.concat(F.array(slashed), F.when(dots > 0, above).otherwise(F.array().cast("array<string>")))
    tries = F.flatten(F.transform(bases, lambda b: F.array(b, F.concat(b, F.lit("/__init__")))))
    candidates = rows.select("source", "import", slashed.alias("plain"), F.posexplode(tries).alias("pos", "candidate"))
    there = roots.select(F.col("id").alias("candidate"), F.lit(True).alias("there")).distinct()
    joined = candidates.join(there, "candidate", "left")
    best = joined.groupBy("source", "import", "plain").agg(F.min_by("candidate", F.when(F.col("there"), F.col("pos"))).alias("hit"))
    return best.select("source", "import", F.coalesce("hit", "plain").alias("target"))


def python(files: DataFrame, strict: bool = False) -> Parsed:
    roots = py_roots(files)
    links = resolve_py(py_imports(files, strict), roots)
    modules = module_rows(roots, "py", F.col("id"), F.lit("MODULE"), F.col("path"), "HIGH")
    deps = dependency_rows(links, "py", F.col("source"), F.col("target"), F.lit("IMPORTS"), "HIGH", F.concat(F.lit("import "), "import"), F.lit(0))
    return Parsed(modules, deps, nothing(files.sparkSession).blind_spots, nothing(files.sparkSession).errors)


# Java.


def java_frontend(files: DataFrame, rows: DataFrame | None = None) -> Parsed:
    """Types, their imports, supertypes and injections, resolved against all types of the project at once; rows are java.tokenized() ones of the files, if there are any."""
    rows = java.tokenized(files) if rows is None else rows
    types, errors = rows.where("error IS NULL").drop("error", "digest"), rows.where("error IS NOT NULL").select("path", F.col("error").alias("message"))
    links, ambiguous = java.links(types), java.ambiguous(types)
    modules = module_rows(types, "java", F.col("fqcn"), F.col("kind"), F.col("path"), "HIGH")
    deps = dependency_rows(links, "java", F.col("source"), F.col("target"), F.col("type"), "HIGH", F.col("evidence"), F.col("rank"))
    return Parsed(modules, deps, java.blind_spots(files).unionByName(ambiguous), errors)


class JavaReader:
    """A front end for several snapshots of a project: each file is parsed once for each content it has, and resolved in each snapshot."""

    def __init__(self):
        self.rows: DataFrame | None = None

    def __call__(self, files: DataFrame) -> Parsed:
        self.rows = cut(java.tokenized(files, self.rows), "types")
        return java_frontend(files, self.rows)


FRONTENDS: dict[str, tuple[list[str], Callable[[DataFrame], Parsed]]] = {
    "java": (["java"], java_frontend),
    "js": (JS_EXTENSIONS, javascript),
    "python": (PY_EXTENSIONS, python),
}


def parse(files: DataFrame, languages: list[str] | None = None, frontends: dict | None = None) -> Parsed:
    """All files by the front ends that claim their extensions; languages picks some (py is python)."""
    some = {k: v for k, v in (frontends or FRONTENDS).items() if not languages or k in languages or (k == "python" and "py" in languages) or set(v[0]) & set(languages)}
    routed = route(files, {k: v[0] for k, v in some.items()})
    out = nothing(files.sparkSession)
    for name, (_, front) in some.items():
        out += front(parsable(routed.where(F.col("frontend") == name)).select("path", "content", "length"))
    out.errors = out.errors.unionByName(too_large(routed.where("frontend is not null")))
    return out


def graph_of(parsed: Parsed) -> tuple[Graph, DataFrame]:
    """The graph, and warnings of dependencies that were left out."""
    return build(parsed.modules, parsed.dependencies), warnings(parsed.modules, parsed.dependencies)


