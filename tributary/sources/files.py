"""Source files as a DataFrame: listing, module roots, routing to front ends."""

from __future__ import annotations

import os
import subprocess
import threading

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.names import extension
from tributary.schema import FILES

#: Larger files are reported and not parsed.
MAX_BYTES = 1 << 20
# Folders that are never looked into.
EXCLUDED = ("node_modules", ".git", "target", "build", "dist", ".gradle")


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """(path, content, length) of files below root, paths relative to it; content is null beyond MAX_BYTES.

    Excluded folders aren't entered and large files aren't read. Spark's own
    readers skip names that start with an underscore, as __init__.py does, so
    the listing is done here; tasks read the contents from the shared root.
    """
    root = root if "://" in root else os.path.abspath(root)
    rows = [(p, n) for p, n in _walk(root) if not extensions or os.path.splitext(p)[1][1:] in extensions]
    listed = spark.createDataFrame(rows, "path string, length long").repartition(max(1, len(rows) // 500))

    def load(batches):
        files, base = _opened(root)
        for b in batches:
            texts = []
            for path, length in zip(b["path"].to_pylist(), b["length"].to_pylist(), strict=True):
                text = None
                if length <= MAX_BYTES:
                    with files.open_input_file(f"{base}/{path}") as f:
                        text = f.read().decode("utf-8", "replace")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b["path"], pa.array(texts, pa.string()), b["length"]], names=["path", "content", "length"])

    return listed.mapInArrow(load, FILES)


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or of a local path, which may hold any characters, and the path in it."""
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def _walk(root: str):
    """(relative path, size) of files, folder by folder."""
    files, base = _opened(root)
    todo = [base]
    while todo:
        for info in files.get_file_info(fs.FileSelector(todo.pop())):
            if info.type == fs.FileType.Directory:
                if info.base_name not in EXCLUDED:
                    todo.append(info.path)
            elif info.type == fs.FileType.File:
                yield info.path[len(base.rstrip("/")) + 1 :], info.size


def too_large(files: DataFrame) -> DataFrame:
    """(path, message) of files that are left out for their size."""
    return files.where(F.col("length") > MAX_BYTES).select("path", F.format_string("%s has %d bytes, more than %d", "path", "length", F.lit(MAX_BYTES)).alias("message"))


def parsable(files: DataFrame) -> DataFrame:
    return files.where((F.col("length") <= MAX_BYTES) & F.col("content").isNotNull())


def route(files: DataFrame, claims: dict[str, list[str]]) -> DataFrame:
    """files with ext and the front end that claims it (null if none does). claims: {front end: extensions}."""
    taken: dict[str, str] = {}
    for name, extensions in claims.items():
        for e in extensions:
            if taken.setdefault(e, name) != name:
                raise ValueError(f"both {taken[e]} and {name} claim .{e}")
    pairs = [F.lit(x) for kv in taken.items() for x in kv]
    ext = extension(F.col("path"))
    return files.withColumn("ext", ext).withColumn("frontend", F.try_element_at(F.create_map(*pairs), ext) if pairs else F.lit(None).cast("string"))


def by_extension(files: DataFrame) -> DataFrame:
    """(ext, n): files of each extension."""
    return files.groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"))


def declared_modules(files: DataFrame) -> DataFrame:
    """(path, module): modules that build files name, <module> in a pom.xml or include("...") in a settings file."""
    maven = files.where(F.endswith("path", F.lit("pom.xml"))).select("path", F.explode(F.regexp_extract_all("content", F.lit(r"<module>\s*([^<]+?)\s*</module>"), 1)).alias("module"))
    gradle = files.where(F.col("path").rlike(r"settings\.gradle(\.kts)?$")).select("path", F.explode(F.regexp_extract_all("content", F.lit(r"""include\s*\(\s*"([^"]+)"\s*\)"""), 1)).alias("module"))
    return gradle.unionByName(maven)


def source_roots(files: DataFrame) -> DataFrame:
    """(module, path): Java source roots. Modules of the settings file, else of pom.xml, else the project's own, else sub-folders with build files."""
    top = files.where(~F.contains("path", F.lit("/")))
    named = declared_modules(top).withColumn("rank", F.when(F.endswith("path", F.lit("pom.xml")), 1).otherwise(0))
    named = named.select("rank", F.col("module"), F.concat("module", F.lit("/src/main/java")).alias("path"))
    own = files.select(F.lit(2).alias("rank"), F.lit("").alias("module"), F.lit("src/main/java").alias("path"))
    folder = F.regexp_extract("path", r"^([^/]+)/build\.gradle(\.kts)?$", 1)
    subs = files.select(folder.alias("module")).where(F.col("module").rlike(r"^(?!\.|build|src).+")).distinct()
    subs = subs.select(F.lit(3).alias("rank"), "module", F.concat("module", F.lit("/src/main/java")).alias("path"))
    some = named.unionByName(own.distinct()).unionByName(subs)
    there = files.select(F.regexp_extract("path", r"^((?:.+/)?src/main/java)/", 1).alias("path")).where("path != ''").distinct()
    found = some.join(there, "path", "left_semi")
    first = found.agg(F.min("rank").alias("first"))
    return found.crossJoin(F.broadcast(first)).where("rank = first").select("module", "path").distinct()  # one row


def in_roots(files: DataFrame) -> DataFrame:
    """files, of Java sources only those below a source root (test sources and generated code are not)."""
    java = extension(F.col("path")) == "java"
    roots = source_roots(files).select(F.col("path").alias("root")).distinct()
    below = files.where(java).withColumn("root", F.regexp_extract("path", r"^((?:.+/)?src/main/java)/", 1)).join(roots, "root", "left_semi")
    return files.where(~java | java.isNull()).unionByName(below.select(*files.columns))


class Git:
    """Snapshots and changes of a git repository. It only reads: no stash, no checkout."""

    def __init__(self, root: str, timeout: int = 60):
        self.root, self.timeout = root, timeout

    def _run(self, *args: str) -> str:
        out = subprocess.run(["git", "-C", self.root, *args], capture_output=True, timeout=self.timeout, check=False)
        if out.returncode:
            raise RuntimeError(f"git {' '.join(args)}: {out.stderr.decode('utf-8', 'replace').strip()}")
        return out.stdout.decode("utf-8", "replace")

    def available(self) -> bool:
        try:
            return self._run("rev-parse", "--is-inside-work-tree").strip() == "true"
        except (OSError, RuntimeError, subprocess.TimeoutExpired):
            return False

    def sha(self, ref: str = "HEAD") -> str:
        return self._run("rev-parse", "--verify", f"{ref}^{{commit}}").strip()

    def branch(self) -> str:
        return self._run("rev-parse", "--abbrev-ref", "HEAD").strip()

    def commits(self, base: str, head: str = "HEAD") -> int:
        return int(self._run("rev-list", "--count", f"{base}..{head}"))

    def changed(self, base: str, head: str | None = None) -> list[str]:
        """Files that differ between two commits, or between a commit and the working tree with its new files."""
        if head:
            return sorted(x for x in self._run("diff-tree", "-r", "--no-commit-id", "--name-only", "-z", base, head).split("\0") if x)
        some = self._run("diff", "--name-only", "-z", base).split("\0") + self._run("ls-files", "--others", "--exclude-standard", "-z").split("\0")
        return sorted({x for x in some if x})

    def content(self, ref: str, path: str) -> str:
        return self._run("show", f"{ref}:{path}")

    def snapshot(self, spark: SparkSession, ref: str, extensions: list[str] | None = None) -> DataFrame:
        """(path, content, length) of the files of a commit; content is null beyond the size limit.

        The driver lists names and object ids. Contents are read by tasks, each with
        one git process for all of its files; so the repository has to be where
        executors can read it.
        """
        rows = []
        for line in self._run("ls-tree", "-r", "-l", "-z", ref).split("\0"):
            head, _, path = line.partition("\t")
            if not path or (extensions and path.rpartition(".")[2] not in extensions):
                continue
            if (size := head.split()[3]).isdigit():
                rows.append((path, head.split()[2], int(size)))
        listed = spark.createDataFrame(rows, "path string, object string, length long")
        parts = max(1, min(len(rows) // FILES_A_TASK + 1, 10_000))
        return listed.repartition(parts, "object").mapInArrow(_contents(self.root, self.timeout), FILES)


#: Files of a commit that a task reads.
FILES_A_TASK = 2_000


def _contents(root: str, timeout: int):
    """Reads the objects in batches of (path, object, length) through git cat-file --batch, one after the other."""

    def run(batches):
        with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            watch = threading.Timer(timeout, git.kill)
            for b in batches:
                texts = []
                for object_, length in zip(b.column("object").to_pylist(), b.column("length").to_pylist(), strict=True):
                    if length > MAX_BYTES:
                        texts.append(None)
                        continue
                    watch.cancel()
                    watch = threading.Timer(timeout, git.kill)
                    watch.start()
                    git.stdin.write(f"{object_}\n".encode())
                    git.stdin.flush()
                    head = git.stdout.readline().split()
                    if len(head) != 3:
                        raise RuntimeError(f"git has no object {object_}, or took longer than {timeout} s")
                    texts.append(git.stdout.read(int(head[2]) + 1)[:-1].decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string()), b.column("length")], names=["path", "content", "length"])
            watch.cancel()
            git.stdin.close()

    return run
