"""Java sources: type headers, imports, supertypes, injections and blind spots.

A tokenizer strips comments and literals and reads what a dependency graph
needs; what names mean is then decided with joins over all types of the project.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_NOISE = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
_WORD = re.compile(r"[A-Za-z_$][\w$]*|@interface\b|[{}()<>,;@.=\[\]&?]")
# Annotations by simple name.
INJECT = {"Autowired", "Resource"}
BEANS = {"Component", "Service", "Repository", "Controller", "RestController", "Configuration"}
_KINDS = {"class": "CLASS", "record": "CLASS", "interface": "INTERFACE", "@interface": "INTERFACE", "enum": "ENUM"}

_SCHEMA = pa.schema(
    [
        ("path", pa.string()), ("package", pa.string()), ("fqcn", pa.string()), ("simple", pa.string()), ("kind", pa.string()),
        ("imports", pa.list_(pa.string())), ("extends", pa.list_(pa.string())), ("implements", pa.list_(pa.string())),
        ("bean", pa.bool_()), ("injected", pa.list_(pa.string())), ("error", pa.string()),
    ]
)
_DDL = "path string, package string, fqcn string, simple string, kind string, imports array<string>, extends array<string>, implements array<string>, bean boolean, injected array<string>, error string"


def strip(source: str) -> str:
    """The source without comments; literals become empty strings."""
    return _NOISE.sub(lambda m: " " if m[0].startswith("/") else '""' if m[0].startswith('"') else "0", source)


def _skip(words: list[str], i: int, opening: str, closing: str) -> int:
    """The index after the bracket that closes the one at i."""
    depth = 0
    while i < len(words):
        depth += (words[i] == opening) - (words[i] == closing)
        i += 1
        if depth == 0:
            break
    return i


def _name(words: list[str], i: int) -> tuple[str, int]:
    """A dotted name from i on, and where its type arguments end."""
    parts = []
    while i < len(words) and re.match(r"[A-Za-z_$]", words[i]):
        parts.append(words[i])
        i += 1
        if i < len(words) and words[i] == "<":
            i = _skip(words, i, "<", ">")
        if i < len(words) and words[i] == ".":
            i += 1
        else:
            break
    return ".".join(parts), i


def read(source: str) -> dict:
    """package, imports, and types: each with name, kind, extends, implements, annotations and injected type names.

    For the resolution of symbols also static imports, packages and types imported
    on demand, and of each type its path in the file, its type parameters and the types of its fields.
    """
    words = _WORD.findall(strip(source))
    out = {"package": "", "imports": [], "statics": [], "demands": [], "types": []}
    stack: list[tuple[dict | None, int]] = []  # open types, and the brace depth of their bodies
    depth, i, notes = 0, 0, []
    while i < len(words):
        w = words[i]
        if w == "package" and depth == 0:
            out["package"], i = _name(words, i + 1)
            continue
        if w == "import" and depth == 0:
            end = words.index(";", i) if ";" in words[i:] else len(words)
            static = words[i + 1] == "static"
            text = "".join(words[i + 1 + static : end])
            if text.endswith("."):  # wildcards end in a star, which isn't a word here
                out["demands"].append(text[:-1])
            else:
                out["statics" if static else "imports"].append(text)
            i = end + 1
            continue
        if w == "@" and i + 1 < len(words) and words[i + 1] != "interface":
            name, i = _name(words, i + 1)
            notes.append(name.rpartition(".")[2])
            if i < len(words) and words[i] == "(":
                i = _skip(words, i, "(", ")")
            continue
        if w == "@" or w == "@interface" or (w in _KINDS and i + 1 < len(words) and re.match(r"[A-Za-z_$]", words[i + 1]) and (not i or words[i - 1] != ".")):
            i += 2 if w == "@" else 1
            kind = "@interface" if w == "@" else w
            if kind == "record" and not (i + 1 < len(words) and words[i + 1] in "(<"):
                continue
            one = {"name": words[i] if i < len(words) else "", "kind": _KINDS[kind], "extends": [], "implements": [], "notes": notes, "fields": [], "ctors": [], "params": [], "typed": [], "supers": []}
            one["within"] = [*stack[-1][0]["within"], stack[-1][0]["name"]] if stack else []
            notes, i, where = [], i + 1, None
            if i < len(words) and words[i] == "<":
                end = _skip(words, i, "<", ">")
                one["params"] = [words[k] for k in range(i + 1, end) if words[k - 1] in "<," and words[i:k].count("<") - words[i:k].count(">") == 1]
                i = end
            while i < len(words) and words[i] not in "{;":
                if words[i] == "<":
                    i = _skip(words, i, "<", ">")
                elif words[i] == "(":
                    i = _skip(words, i, "(", ")")
                elif words[i] in ("extends", "implements", "permits"):
                    where, i = words[i], i + 1
                elif re.match(r"[A-Za-z_$]", words[i]):
                    name, i = _name(words, i)
                    # Enums and records are taken for what they are, not for what they implement.
                    if where in ("extends", "implements"):
                        one["supers"].append(name)
                    if where in ("extends", "implements") and kind in ("class", "interface"):
                        one[where].append(name)
                else:
                    i += 1
            out["types"].append(one)
            if i < len(words) and words[i] == "{":
                depth += 1
                stack.append((one, depth))
                i += 1
            continue
        if w == "{":
            depth += 1
        elif w == "}":
            if stack and stack[-1][1] == depth:
                stack.pop()
            depth -= 1
            notes = []
        elif stack and stack[-1][1] == depth:
            i = _member(words, i, stack[-1][0], notes)
            notes = []
            continue
        i += 1
    return out


_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "transient", "volatile", "synchronized", "native", "default", "strictfp", "sealed"}


def _member(words: list[str], i: int, owner: dict, notes: list[str]) -> int:
    """Reads a member's head from i on: constructors and fields are noted; returns where to go on."""
    while i < len(words) and words[i] in _MODIFIERS:
        i += 1
    if i < len(words) and words[i] == "<":
        i = _skip(words, i, "<", ">")
    if i >= len(words) or words[i] in ("@", "{", "}") or words[i] in _KINDS:
        return i
    name, j = _name(words, i)
    if not name:
        return i + 1
    if j < len(words) and words[j] == "(" and name == owner["name"]:
        end = _skip(words, j, "(", ")")
        owner["ctors"].append((set(notes), _parameters(words[j + 1 : end - 1])))
        return _to_body(words, end)
    while j < len(words) and words[j] in "[]":
        j += 1
    if j + 1 < len(words) and re.match(r"[A-Za-z_$]", words[j]) and words[j + 1] in (";", "=", ",", "["):
        owner["typed"] += [(words[j], t) for t in _named_types(words, i, j)]
    if INJECT & set(notes) and j + 1 < len(words) and words[j + 1] in (";", "="):
        owner["fields"].append(name)
    return _to_body(words, j)


# Types that aren't declared anywhere.
_PRIMITIVES = {"boolean", "byte", "short", "int", "long", "char", "float", "double", "void"}


def _named_types(words: list[str], i: int, end: int) -> list[str]:
    """The types that a type from i to end names, its arguments' too; those that aren't declared anywhere left out."""
    found: list[str] = []
    while i < end:
        if words[i] == "@":
            i = _name(words, i + 1)[1]
            if i < end and words[i] == "(":
                i = _skip(words, i, "(", ")")
        elif re.match(r"[A-Za-z_$]", words[i]) and words[i] not in ("extends", "super"):
            name, after = _name(words, i)
            found.append(name)
            for k in range(i, after):
                if words[k] == "<" and words[i:k].count("<") == words[i:k].count(">"):
                    found += _named_types(words, k + 1, _skip(words, k, "<", ">") - 1)
            i = after
        else:
            i += 1
    return [t for t in dict.fromkeys(found) if t not in _PRIMITIVES]


def _to_body(words: list[str], i: int) -> int:
    """The next brace or the index after the next semicolon, past brackets."""
    while i < len(words):
        if words[i] == "(":
            i = _skip(words, i, "(", ")")
        elif words[i] == ";":
            return i + 1
        elif words[i] in "{}":
            return i
        else:
            i += 1
    return i


def _parameters(words: list[str]) -> list[str]:
    out, i = [], 0
    while i < len(words):
        if words[i] == "@":
            _, i = _name(words, i + 1)
            if i < len(words) and words[i] == "(":
                i = _skip(words, i, "(", ")")
        elif words[i] == "final":
            i += 1
        elif re.match(r"[A-Za-z_$]", words[i]):
            name, i = _name(words, i)
            out.append(name)
            while i < len(words) and words[i] != ",":
                i += 1
            i += 1
        else:
            i += 1
    return out


def _rows(path: str, content: str) -> list[tuple]:
    try:
        found = read(content)
    except (IndexError, ValueError) as e:
        return [(path, None, None, None, None, None, None, None, None, None, f"{path}: {e}")]
    rows, package = [], found["package"]
    for t in found["types"]:
        bean = bool(BEANS & set(t["notes"]))
        injected = list(t["fields"])
        ctors = [c for c in t["ctors"] if "Autowired" in c[0]] or (t["ctors"] if len(t["ctors"]) == 1 and bean else [])
        for _, parameters in ctors:
            injected += parameters
        fqcn = f"{package}.{t['name']}" if package else t["name"]
        rows.append((path, package, fqcn, t["name"], t["kind"], found["imports"], t["extends"], t["implements"], bean, list(dict.fromkeys(injected)), None))
    return rows


def _tokenized(files: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [r for p, c in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True) for r in _rows(p, c or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_SCHEMA)], schema=_SCHEMA)

    return files.select("path", "content").mapInArrow(run, _DDL)


def tokenized(files: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """What the parser finds in files (path, content), with their digests; files that earlier has with the same path and digest aren't parsed again."""
    keyed = files.select("path", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))
    if earlier is not None:
        rest = keyed.join(earlier.select("path", "digest").distinct(), ["path", "digest"], "left_anti")
        return earlier.join(keyed.select("path", "digest"), ["path", "digest"], "left_semi").select(earlier.columns).unionByName(tokenized(rest))
    return _tokenized(keyed).join(keyed.select("path", "digest"), "path")


def types(files: DataFrame) -> DataFrame:
    """One row a declared type; nested ones are named after the package, and have the file's imports too."""
    return _tokenized(files).where("error is null").drop("error")


def errors(files: DataFrame) -> DataFrame:
    return _tokenized(files).where("error is not null").select("path", F.col("error").alias("message"))


def _resolved(names: DataFrame, known: DataFrame) -> DataFrame:
    """names (source, package, imports, name, ...) with target: the import that ends in the name, the name itself, or its neighbour, if known."""
    simple = F.substring_index("name", ".", -1)
    hit = F.get(F.filter("imports", lambda i: F.substring_index(i, ".", -1) == simple), F.lit(0))
    near = F.when(F.col("package") == "", F.col("name")).otherwise(F.concat_ws(".", "package", "name"))
    rows = names.withColumn("target", F.coalesce(hit, F.when(F.contains("name", F.lit(".")), F.col("name")).otherwise(near)))
    return rows.join(known, F.col("target") == F.col("known"), "left_semi")


def _known(types: DataFrame) -> DataFrame:
    return types.select(F.col("fqcn").alias("known")).distinct()


def supertypes(types: DataFrame) -> DataFrame:
    """(source, target, type): EXTENDS and IMPLEMENTS between known types."""
    base = types.select(F.col("fqcn").alias("source"), "package", "imports", "extends", "implements")
    up = base.select("source", "package", "imports", F.explode("extends").alias("name"), F.lit("EXTENDS").alias("type"))
    up = up.unionByName(base.select("source", "package", "imports", F.explode("implements").alias("name"), F.lit("IMPLEMENTS").alias("type")))
    return _resolved(up, _known(types)).select("source", "target", "type")


def injections(types: DataFrame) -> DataFrame:
    """(source, wanted): known types that a class has injected."""
    some = types.select(F.col("fqcn").alias("source"), "package", "imports", F.explode("injected").alias("name"))
    return _resolved(some, _known(types)).select("source", F.col("target").alias("wanted")).distinct()


def implementations(types: DataFrame) -> DataFrame:
    """(wanted, impls): the known types that directly extend or implement each type."""
    up = supertypes(types).select(F.col("target").alias("wanted"), F.col("source").alias("impl"))
    return up.groupBy("wanted").agg(F.sort_array(F.collect_set("impl")).alias("impls"))


def di_resolution(types: DataFrame) -> DataFrame:
    """(source, wanted, target, ambiguous): the one implementation of what is injected, else the type itself; several are ambiguous."""
    rows = injections(types).join(implementations(types), "wanted", "left")
    n = F.coalesce(F.size("impls"), F.lit(0))
    target = F.when(n == 1, F.get("impls", F.lit(0))).when(n <= 0, F.col("wanted"))
    return rows.select("source", "wanted", target.alias("target"), (n > 1).alias("ambiguous"))


def imports(types: DataFrame) -> DataFrame:
    """(source, target): imports of known types."""
    rows = types.select(F.col("fqcn").alias("source"), F.explode("imports").alias("target")).distinct()
    return rows.join(_known(types), F.col("target") == F.col("known"), "left_semi")


def links(types: DataFrame) -> DataFrame:
    """(source, target, type, evidence, rank): all dependencies; the highest rank tells a pair's type."""
    one = lambda df, kind, rank: df.select("source", "target", kind.alias("type"), F.concat_ws(" ", F.lower(kind), F.col("target")).alias("evidence"), rank.alias("rank"))
    di = di_resolution(types).where("target is not null")
    return one(imports(types), F.lit("IMPORTS"), F.lit(0)).unionByName(one(supertypes(types), F.col("type"), F.lit(1))).unionByName(one(di, F.lit("SPRING_DI"), F.lit(2)))


def ambiguous(types: DataFrame) -> DataFrame:
    """Blind spots of injections with several implementations."""
    return di_resolution(types).where("ambiguous").select(F.lit("spring-di").alias("type"), F.col("source").alias("location"), F.concat(F.lit("Ambiguous: "), "wanted").alias("description"))


# What makes a line a blind spot, as (text that it holds, type, description).
PATTERNS = (
    ("Class.forName", "reflection", "Class.forName"),
    ("getDeclaredMethod", "reflection", "getDeclaredMethod"),
    ("getDeclaredField", "reflection", "getDeclaredField"),
    ("@EventListener", "event-driven", "@EventListener"),
    ("@Subscribe", "event-driven", "@Subscribe"),
    ("ApplicationEventPublisher", "event-driven", "ApplicationEventPublisher"),
    ("publishEvent", "event-driven", "publishEvent"),
    ("Proxy.newProxyInstance", "dynamic-proxy", "Proxy.newProxyInstance"),
)


def _invokes(line: Column) -> Column:
    """Whether a line calls a method named invoke of something, or names that of Method."""
    cut = F.split(line, r"\.invoke")
    calls = F.zip_with(F.slice(cut, F.lit(1), F.size(cut) - 1), F.slice(cut, F.lit(2), F.size(cut) - 1), lambda before, after: before.rlike(r"\w$") & F.startswith(F.ltrim(after), F.lit("(")))
    return F.contains(line, F.lit("Method.invoke")) | F.exists(calls, lambda x: x)


def blind_spots(files: DataFrame) -> DataFrame:
    """(type, location, description): lines that a static reading can't follow, and MyBatis files by name."""
    java = files.where(F.endswith("path", F.lit(".java")))
    lines = java.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    checks = [F.when(F.contains("line", F.lit(text)), F.struct(F.lit(kind).alias("type"), F.lit(told).alias("description"))) for text, kind, told in PATTERNS]
    checks.append(F.when(_invokes(F.col("line")), F.struct(F.lit("reflection").alias("type"), F.lit("Method.invoke").alias("description"))))
    hits = lines.select("path", "at", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("hit"))
    found = hits.select("hit.type", F.concat_ws(":", "path", (F.col("at") + 1).cast("string")).alias("location"), "hit.description")
    mapped = files.where(F.col("path").rlike(r"(Mapper|Dao)\.xml$")).select(F.lit("mybatis-xml").alias("type"), F.col("path").alias("location"), F.lit("MyBatis XML").alias("description"))
    return found.unionByName(mapped)


def resolve_import(imported: Column) -> Column:
    """What a plain import line names: itself; for a static member its class; empty for wildcards."""
    last = F.substring_index(imported, ".", -1)
    member = last.rlike(r"^\p{Ll}[^$]*$") & F.contains(imported, F.lit("."))
    return F.when(imported.isNull() | (imported == "") | imported.endswith(".*"), F.lit("")).when(member, F.regexp_extract(imported, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(imported)


def resolve_wildcards(wildcards: DataFrame, known: DataFrame) -> DataFrame:
    """(import, fqcn): known types below the package or type of a wildcard import, at any depth; joined by each of a type's prefixes."""
    parts = F.split("fqcn", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    rows = known.select("fqcn").where(F.contains("fqcn", F.lit("."))).distinct().select("fqcn", F.explode(prefixes).alias("package"))
    return wildcards.where(F.endswith("import", F.lit(".*"))).select("import", F.regexp_replace("import", r"\.\*$", "").alias("package")).join(rows, "package").select("import", "fqcn")
