"""Tables that cut lineage, in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
local session may do without: it gets a temporary folder of its own. Nothing
here uses localCheckpoint or executor-local files, so a lost executor costs a
task retry and never a table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder, as a URI or path that Spark can write to."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tributary-")
        _delete_on_exit(spark, _LOCAL[app])
    return _LOCAL[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; it goes when the session ends."""
    path = f"{shared_dir(spark)}/tributary-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    _delete_on_exit(spark, path)
    return path


#: Bytes in memory, generously, for one in a file of ids that follow each other (11.2 million modules took 26 MB, 2.3 bytes a row with all columns).
EXPANDED = 100
#: For such rows, in place of Spark's defaults: how tables are estimated, how much of a file a task reads, how much of a compressed
#: shuffle it reads, in how many parts shuffles are dealt before small ones are united, that none is broadcast after its shuffle, and
#: what is broadcast at all: adaptive execution holds the last but one against bare shuffles only, and an aggregate of one against this.
_SIZES = {
    "spark.sql.sources.fileCompressionFactor": ("1.0", str(EXPANDED)),
    "spark.sql.files.maxPartitionBytes": ("134217728b", "16m"),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("67108864b", "8m"),
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": (None, "1000"),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": (None, "-1"),
    "spark.sql.autoBroadcastJoinThreshold": ("10485760b", "1m"),
}


def honest_sizes(spark: SparkSession) -> None:
    """Has the session plan for what rows take in memory, not for their compressed files and shuffles.

    Ids compress so well that Spark takes tables of hundreds of megabytes for small
    ones, and gathers them in the driver to broadcast them. What is beyond the
    estimate is shuffled, and stays so: adaptive execution could broadcast what it then
    measures as small, but loops of many joins send the driver megabytes for each,
    however little is in them. For the same reason a task's usual share of a compressed shuffle would be gigabytes of rows.
    A value that the session already has stays, and so do its own numbers of partitions and bytes to broadcast if these are not Spark's.
    """
    has = lambda key: spark.conf.get(key) if _SIZES.get(key, ("",))[0] is not None else spark.conf.get(key, None)
    own = {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": has("spark.sql.shuffle.partitions") != "200",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": has("spark.sql.autoBroadcastJoinThreshold") not in _SIZES["spark.sql.autoBroadcastJoinThreshold"],
    }
    for key, (default, value) in _SIZES.items():
        if has(key) == default and not own.get(key):
            spark.conf.set(key, value)


#: Spark's setting that deletes a query's shuffle files as soon as it has run.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """df written to the shared folder and read again: same rows, no lineage.

    Shuffle files of the write are deleted with it, as nothing reads them again;
    else they stay until the driver's JVM happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tributary_path = path
    return out


def is_cut(df: DataFrame) -> bool:
    """Whether df is a table that cut() made, so that reading it again costs no more than that."""
    return hasattr(df, "_tributary_path")


def drop(df: DataFrame | None) -> None:
    """Deletes a table that cut() made, once no later step reads it."""
    path = getattr(df, "_tributary_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it has it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.deleteOnExit(p)
