"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: blank, and tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Rows of one or two integers that a broadcast may hold; beyond it a shuffle join is used.
BROADCAST_ROWS = 500_000

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="siltwork-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/siltwork/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_on_exit(spark: SparkSession, path: str) -> None:
    """Have Hadoop's file system delete an existing path when the driver ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def materialize(df: DataFrame, name: str, into: Scratch | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, outlives lost executors. The files go when
    the driver ends, or when the scratch that they are entered into is cleared; those of the job's shuffles go at once,
    not whenever the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    drop_on_exit(spark, path)
    if into is not None:
        into.paths.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator is done with once its result has been written."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name, self)

    def clear(self) -> None:
        for spark, path in self.paths:
            drop_path(spark, path)
        self.paths.clear()


def give_back() -> None:
    """Return what a finished task no longer needs to the system: Python workers outlive their tasks, and what they hold
    would be taken from the stages that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has been counted to at most limit rows; as it is otherwise."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df


def words_of(text):
    """Array of the words of a text column, for null an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
