"""Compiled Java classes: which beans get what injected, read from class files.

A class file is read by itself, in tasks, for what an injection needs: its
annotations, supertypes, fields and constructors. What is injected is then
decided with joins, for each folder of classes by itself.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.names import relative
from tributary.scratch import cut, filesystem
from tributary.sources.frontends import Parsed, dependency_rows, nothing

# Annotations by full name, and where build tools put classes.
BEANS = {f"org.springframework.stereotype.{n}" for n in ("Component", "Service", "Repository", "Controller")} | {"org.springframework.web.bind.annotation.RestController"}
AUTOWIRED = "org.springframework.beans.factory.annotation.Autowired"
RESOURCES = {"jakarta.annotation.Resource", "javax.annotation.Resource"}
FOLDERS = ("target/classes", "build/classes/java/main")
_BELOW = r"^((?:[^/]+/){0,2}?(?:" + "|".join(FOLDERS) + "))/"

_INJECTED = pa.list_(pa.struct([("wanted", pa.string()), ("evidence", pa.string())]))
_SCHEMA = pa.schema([("folder", pa.string()), ("name", pa.string()), ("parent", pa.string()), ("interfaces", pa.list_(pa.string())), ("bean", pa.bool_()), ("injected", _INJECTED), ("error", pa.string())])
_DDL = "folder string, name string, parent string, interfaces array<string>, bean boolean, injected array<struct<wanted:string,evidence:string>>, error string"

# Fixed values of the class file format: bytes that follow a constant's tag, and names of primitive types.
_SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
_PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean"}


class _Reader:
    """Big-endian numbers of a class file, and its constants."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        if self.number(4) != 0xCAFEBABE:
            raise ValueError("not a class file")
        self.at += 4
        self.constants: dict[int, bytes] = {}
        k, n = 1, self.number(2)
        while k < n:
            tag = self.number(1)
            if tag == 1:
                self.constants[k] = self.take(self.number(2))
            elif tag in _SIZES:
                self.constants[k] = self.take(_SIZES[tag])
            else:
                raise ValueError(f"unknown constant {tag}")
            k += 2 if tag in (5, 6) else 1

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("class file ends early")
        self.at += n
        return out

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "big")

    def text(self, k: int) -> str:
        return self.constants[k].decode("utf-8", "replace")

    def class_name(self, k: int) -> str | None:
        return self.text(int.from_bytes(self.constants[k], "big")).replace("/", ".") if k else None

    def annotations(self) -> set[str]:
        """Reads attributes; the types of all annotations in them, whether kept at run time or not."""
        out = set()
        for _ in range(self.number(2)):
            name, size = self.text(self.number(2)), self.number(4)
            end = self.at + size
            if name in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
                out |= {self._annotation() for _ in range(self.number(2))}
            self.at = end
        return out

    def _annotation(self) -> str:
        kind = self.text(self.number(2))
        for _ in range(self.number(2)):
            self.at += 2
            self._value()
        return next(iter(types_of(kind)), "")

    def _value(self) -> None:
        tag = chr(self.number(1))
        if tag == "@":
            self._annotation()
        elif tag == "[":
            for _ in range(self.number(2)):
                self._value()
        else:
            self.at += 4 if tag == "e" else 2


def types_of(descriptor: str) -> list[str]:
    """The names of a descriptor's types: of a field's, or of a method's parameters; arrays as the virtual machine calls them."""
    out, at, dims = [], descriptor.startswith("("), 0
    while at < len(descriptor) and descriptor[at] != ")":
        c = descriptor[at]
        if c == "[":
            dims, at = dims + 1, at + 1
            continue
        end = descriptor.index(";", at) + 1 if c == "L" else at + 1
        plain = descriptor[at:end].replace("/", ".")
        out.append("[" * dims + plain if dims else plain[1:-1] if c == "L" else _PRIMITIVES[c])
        at, dims = end, 0
    return out


def read(data: bytes) -> dict:
    """name, parent, interfaces, bean, and injected: (wanted type, evidence) of annotated fields and of constructors.

    A constructor counts if it is annotated or the only one. Raises ValueError for what isn't a class file.
    """
    try:
        r = _Reader(data)
        r.at += 2
        name, parent = r.class_name(r.number(2)), r.class_name(r.number(2))
        interfaces = [r.class_name(r.number(2)) for _ in range(r.number(2))]
        injected, constructors = [], []
        for kind in ("field", "method"):
            for _ in range(r.number(2)):
                r.at += 2
                member, types = r.text(r.number(2)), types_of(r.text(r.number(2)))
                notes = r.annotations()
                if kind == "field" and notes & (RESOURCES | {AUTOWIRED}):
                    injected.append((types[0], ("@Resource " if notes & RESOURCES else "@Autowired ") + member))
                elif kind == "method" and member == "<init>":
                    constructors.append((AUTOWIRED in notes, types))
        bean = bool(r.annotations() & BEANS)
    except (KeyError, IndexError) as e:
        raise ValueError(f"malformed class file: {e!r}") from e
    for annotated, types in constructors:
        if annotated or len(constructors) == 1:
            injected += [(t, f"constructor({t})") for t in types]
    return {"name": name, "parent": parent, "interfaces": interfaces, "bean": bean, "injected": injected if bean else []}


def _escaped(path: str) -> str:
    """A pattern that only matches the path."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def class_roots(spark: SparkSession, root: str) -> list[str]:
    """Folders of compiled classes, in the project's root and at most two levels below; any file system that Spark reads."""
    fs, base = filesystem(spark, root)
    plain = _escaped(fs.makeQualified(base).toString())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath().toString() for up in ("", "*/", "*/*/") for f in FOLDERS for s in fs.globStatus(path(f"{plain}/{up}{f}")) or () if s.isDirectory()]
    return sorted(set(found))


def class_files(spark: SparkSession, root: str) -> DataFrame:
    """(folder, path, content) of compiled classes, paths relative to root; none where there is no folder of classes. Spark's reader leaves out empty files."""
    roots = class_roots(spark, root)
    if not roots:
        return spark.createDataFrame([], "folder string, path string, content binary")
    fs, base = filesystem(spark, root)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.class").load([_escaped(r) for r in roots])
    rows = rows.select(relative(F.col("path"), fs.makeQualified(base).toString()).alias("path"), "content")
    return rows.select(F.regexp_extract("path", _BELOW, 1).alias("folder"), "path", "content")


def classes(files: DataFrame) -> DataFrame:
    """One row a class file (folder, path, content): what read() finds in it, or an error, which empty and null contents are too."""

    def run(batches):
        for b in batches:
            rows = []
            for folder, path, content in zip(*(b[c].to_pylist() for c in ("folder", "path", "content")), strict=True):
                try:
                    rows.append({"folder": folder, "error": None, **read(content or b"")})
                except ValueError as e:
                    rows.append({"folder": folder, "error": f"{path}: {e}", **dict.fromkeys(("name", "parent", "interfaces", "bean", "injected"))})
            yield pa.RecordBatch.from_arrays([pa.array([r[c.name] for r in rows], c.type) for c in _SCHEMA], schema=_SCHEMA)

    return files.select("folder", "path", "content").mapInArrow(run, _DDL)


def bean_types(found: DataFrame) -> DataFrame:
    """(folder, wanted, bean): the direct parent and all interfaces of each bean, those of its supertypes too, as far as these are in the folder.

    Rounds follow the depth of the type hierarchy, and each has only what is new.
    """
    up = found.select("folder", F.col("name").alias("child"), F.explode("interfaces").alias("up"), F.lit(True).alias("face"))
    up = up.unionByName(found.where("parent IS NOT NULL").select("folder", F.col("name").alias("child"), F.col("parent").alias("up"), F.lit(False).alias("face"))).distinct()
    beans = found.where("bean").select("folder", F.col("name").alias("bean")).distinct()
    at = cut(beans.join(up.withColumnRenamed("child", "bean"), ["folder", "bean"]), "types")
    out = at.where("face OR up <> 'java.lang.Object'").select("folder", F.col("up").alias("wanted"), "bean")
    seen = at.select("folder", "bean", "up")
    while at.head(1):
        step = at.select("folder", "bean", F.col("up").alias("child")).join(up, ["folder", "child"]).select("folder", "bean", "up", "face").distinct()
        at = cut(step.join(seen, ["folder", "bean", "up"], "left_anti"), "types")
        seen = seen.unionByName(at.select("folder", "bean", "up"))
        out = out.unionByName(at.where("face").select("folder", F.col("up").alias("wanted"), "bean"))
    return out.distinct()


def injections(found: DataFrame, modules: DataFrame) -> DataFrame:
    """(folder, source, wanted, evidence, target, beans): injections of beans that are modules (id).

    The target is the only bean of a type, else the type itself, if it is a module;
    a type of several beans has none, and beans are these.
    """
    known = modules.where(F.startswith("id", F.lit("java:"))).select(F.expr("substring(id, 6)").alias("known")).distinct()
    wants = found.where("bean").select("folder", F.col("name").alias("source"), F.explode("injected").alias("i")).select("folder", "source", "i.*").distinct()
    wants = wants.join(known, F.col("source") == F.col("known"), "left_semi")
    per = bean_types(found).groupBy("folder", "wanted").agg(F.count("*").alias("n"), F.min("bean").alias("one"), F.array_sort(F.collect_list("bean")).alias("beans"))
    rows = wants.join(per, ["folder", "wanted"], "left")
    one = F.when(F.col("n") == 1, F.col("one"))
    rows = rows.join(known.select(F.col("known").alias("one_known")), one == F.col("one_known"), "left")
    rows = rows.join(known.select(F.col("known").alias("type_known")), F.col("wanted") == F.col("type_known"), "left")
    target = F.when(F.coalesce("n", F.lit(0)) < 2, F.coalesce("one_known", "type_known"))
    return rows.select("folder", "source", "wanted", "evidence", target.alias("target"), F.when(F.col("n") > 1, F.col("beans")).alias("beans"))


def compiled(spark: SparkSession, files: DataFrame):
    """A hook for analyses: dependencies and blind spots that class files (folder, path, content) tell, for the modules parsed."""

    def hook(parsed: Parsed) -> Parsed:
        found = cut(classes(files), "classes")
        rows = cut(injections(found.where("error IS NULL"), parsed.modules), "injections")
        deps = dependency_rows(rows.where("target IS NOT NULL"), "java", F.col("source"), F.col("target"), F.lit("SPRING_DI"), "HIGH", F.col("evidence"), F.lit(3))
        simple = F.array_join(F.transform("beans", lambda x: F.substring_index(x, ".", -1)), ", ")
        told = F.concat(F.lit("Ambiguous: "), "wanted", F.lit(" has "), F.size("beans").cast("string"), F.lit(" implementations ("), simple, F.lit(")"))
        spots = rows.where("beans IS NOT NULL").select(F.lit("SPRING_DI").alias("type"), F.col("source").alias("location"), told.alias("description")).distinct()
        failed = found.where("error IS NOT NULL").select(F.lit("SPRING_DI").alias("type"), F.lit("class-scan").alias("location"), F.col("error").alias("description"))
        none = nothing(spark)
        return Parsed(none.modules, deps, spots.unionByName(failed), none.errors)

    return hook
