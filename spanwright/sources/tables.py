"""Sources and sinks: file texts, message traces, and tables in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACE = T.StructType([T.StructField("dir", T.StringType()), T.StructField("at", T.LongType()), T.StructField("msg", T.StringType())])


_own: dict[str, str] = {}  # folders of local sessions that name none, by application


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where that is unset, a local session gets a folder of
    its own; on a cluster there is none that all executors see, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spanwright-")
        at = _own[app]
    return at.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


@contextlib.contextmanager
def recorded(paths: list[str]):
    """Notes in ``paths`` the tables that this thread writes meanwhile, for :func:`remove`."""
    token = _written.set(paths)
    try:
        yield paths
    finally:
        _written.reset(token)


#: Seconds of a write from which on what it shuffled is worth a collection of the driver's heap.
SLOW = 1.0


def collected(spark: SparkSession) -> None:
    """Asks for a collection of the driver's heap, so that Spark's cleaner removes what nothing refers to;
    first of Python's, whose frames name Spark's objects and may be part of circles."""
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes to the shared folder and reads back."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    if _written.get() is not None:
        _written.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: :func:`written`.  What a write has shuffled stays on the executors' disks until the
    driver's heap is next collected, which may be after the query; so it is asked for, unless the write was short."""
    began = time.monotonic()
    out = written(df, label)
    if time.monotonic() - began > SLOW:
        collected(df.sparkSession)
    return out


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes tables of the shared folder that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files behind tables of :func:`materialize` that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def replace_in_buckets(path: str, new: DataFrame, sources: DataFrame, buckets: int = 64) -> None:
    """Makes ``new`` all that the given ``sources`` (source) have in the table at ``path``, which is kept in
    ``buckets`` partitions by a hash of the source: only the buckets of those sources are read and
    overwritten.  The same call again leaves the same table, so a batch may be run again."""
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64("source"), F.lit(buckets)).cast("int").alias("bucket")
    told = sources.select("source").distinct()
    touched = sorted(r[0] for r in told.select(bucket).distinct().collect())  # ``buckets`` at most
    rows = new.join(told, "source", "left_semi").select(*new.columns, bucket)
    if exists(spark, path):
        old = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(touched))
        rows = rows.unionByName(old.join(told, "source", "left_anti"))
    rows = materialize(rows, "buckets")
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    left = {r[0] for r in rows.select("bucket").distinct().collect()}
    remove(spark, [f"{path}/bucket={b}" for b in touched if b not in left])
    discard(rows)


def scan_sources(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below ``path``: source (kind, path, entry_path) and the whole text, of every
    file whether or not a language claims it."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    where = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/")
    source = F.struct(F.lit("SOURCE_FILE").alias("kind"), F.try_url_decode(F.replace(where, F.lit("+"), F.lit("%2B"))).alias("path"), F.lit(None).cast("string").alias("entry_path"))
    return rows.select(source.alias("source"), F.col("value").alias("contents"))


def source_rows(texts: DataFrame, path, contents) -> DataFrame:
    """The same rows from a table of texts."""
    source = F.struct(F.lit("SOURCE_FILE").alias("kind"), path.alias("path"), F.lit(None).cast("string").alias("entry_path"))
    return texts.select(source.alias("source"), contents.alias("contents"))


def write_trace(rows: DataFrame, path: str) -> None:
    """Appends (dir, at, msg) as JSON lines; ``at`` counts milliseconds."""
    rows.select("dir", "at", "msg").write.mode("append").json(path)


def scan_trace(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a trace with their time as a timestamp."""
    return spark.read.schema(TRACE).json(path).withColumn("time", F.timestamp_millis("at"))
