"""Helpers shared by the training-data operators: tables, the shared folder, checkpoints."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.operators.runtime import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables written by ``store`` that nobody has dropped, by path.
_LEFT: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is chosen if driver and tasks are one process (a
    local test); anywhere else that is an error, as executors would write where nobody else reads.
    """
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(given)
    return given.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files: nothing but the written table is read again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    if before is None:  # a Spark without this setting: files go when the cleaner finds them
        yield
        return
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def store(df: DataFrame, kind: str) -> DataFrame:
    """Write a table to the shared folder and read it back; its lineage ends there.

    The table stays until ``drop`` or ``drop_left`` removes it."""
    path = shared_path(df.sparkSession, kind)
    _LEFT[path] = None
    with _own_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _only_reads_files(df: DataFrame) -> bool:
    """Whether each row is a row of one file, by columns and filters that give the same when they are computed again."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.children().size() == 1:
        if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias") or not plan.deterministic():
            return False
        plan = plan.children().head()
    name = lambda x: x.getClass().getSimpleName()
    return name(plan) == "LogicalRelation" and name(plan.relation()) == "HadoopFsRelation"


def numbered(df: DataFrame, rid: str) -> DataFrame:
    """``df`` with a number of each row in ``rid`` that is the same each time it is read.

    Rows that are read from Parquet files are numbered by file and place, without a copy; all others in a stored copy."""
    spark = df.sparkSession
    if "_metadata" not in df.columns and _only_reads_files(df):
        try:
            placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        except AnalysisException:  # a format that doesn't number its rows
            placed = None
        if placed is not None and len({*df.columns, "_file", "_row"}) == len(df.columns) + 2:
            files = sorted(r[0] for r in placed.select("_file").distinct().collect())
            if not files:
                return df.withColumn(rid, F.lit(0).cast("long"))
            at = spark.range(1).select(F.posexplode(F.lit(files)).alias("_number", "_file"))
            return placed.join(F.broadcast(at), "_file").select(*df.columns, F.shiftleft(F.col("_number").cast("long"), 40).bitwiseOR(F.col("_row")).alias(rid))
    return store(df.select("*", F.monotonically_increasing_id().alias(rid)), "numbered")


def few(df: DataFrame) -> DataFrame:
    """In a quarter as many partitions as a shuffle has, or two a core if that is more, for a small result of many
    partitions: these are worked off one after another in a task, and the stored table has fewer files."""
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any file system; one that isn't there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _LEFT.pop(path, None)


def drop(*tables: DataFrame) -> None:
    """Remove tables of ``store`` (and only such) that no plan reads any more."""
    for t in tables:
        delete(t.sparkSession, t._stored_at)


def left() -> list[str]:
    """Paths of the tables that are still there."""
    return list(_LEFT)


def drop_left(spark: SparkSession, paths: list[str]) -> None:
    """Remove those tables, and let Spark's cleaner find shuffles and checkpoints of plans that are gone."""
    for p in paths:
        if p in _LEFT:
            delete(spark, p)
    release(spark, 0.5)


@contextmanager
def bucketed(df: DataFrame, by: str, kind: str) -> Iterator[DataFrame]:
    """Write a table to the shared folder in buckets of ``by``, as many as there are shuffle partitions: what
    groups or joins it by that column needs no shuffle of it. The table goes when the context ends."""
    spark = df.sparkSession
    path = shared_path(spark, kind)
    _LEFT[path] = None
    name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _own_shuffles(spark):
        df.write.bucketBy(buckets, by).option("path", path).option("compression", "zstd").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)


def _give_back() -> None:
    """Return to the system what this Python has freed: the C library and Arrow keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def release(spark: SparkSession, wait: float = 0) -> None:
    """Let Spark's cleaner find shuffles and checkpoints that no plan refers to any more. What goes in a first
    pass may hold others, so there are two where disk is to be free before the next step, with ``wait`` seconds for the cleaner."""
    for _ in range(2 if wait else 1):
        gc.collect()
        if wait:
            _give_back()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def map_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` whose function may refer to this package's modules. A worker waits for its next task without
    the memory that a task has freed."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


HOT_PARTS = 256


def join_hot(rows: DataFrame, keys: DataFrame, key: str, count: str, total: int | None = None) -> DataFrame:
    """``rows`` left-joined with ``keys`` (unique by ``key``, with each key's number of rows in ``count``).

    A key with at least a 256th of all rows is joined by broadcast: there are 256 such keys at
    most, whatever the data. All others are joined by a shuffle, where none is hot. ``key`` isn't
    null; ``rows`` should be a stored table, as it is read twice. ``total`` is the number of rows, where known.
    """
    if total is None:
        total = keys.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.broadcast(keys.filter(F.col(count) * HOT_PARTS >= total))
    at_hot = rows.join(hot, key)
    at_rest = rows.join(hot, key, "left_anti").join(keys, key, "left")
    return at_hot.unionByName(at_rest.select(*at_hot.columns))
