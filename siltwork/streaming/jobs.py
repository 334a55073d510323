"""Structured Streaming jobs: event-time windows, sessions, deduplication and resumable work on new rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.sources.shared import exists


def stream_parquet(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """Parquet files of a path, a folder or one file, as a stream in batches of a bounded number of files."""
    found = f"{path[:-1]}[{path[-1]}]"  # a pattern that only path matches: a stream takes a single file only so
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(found)


def event_time(rows: DataFrame, ts: str, late: str | None) -> DataFrame:
    """Rows with a time, as event time with a watermark; without one where late is None: then no row is ever too late."""
    timed = rows.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp"))
    return timed if late is None else timed.withWatermark(ts, late)


def windowed(rows: DataFrame, ts: str, length: str, keys: list[str], aggregates: list[Column], slide: str | None = None) -> DataFrame:
    """Tumbling windows, or sliding ones with a slide: (keys, start, end, aggregates)."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    got = rows.groupBy(*keys, w.alias("w")).agg(*aggregates)
    return got.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in got.columns if c not in (*keys, "w")])


def sessions(rows: DataFrame, ts: str, gap: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Sessions of each key that end after a gap."""
    got = rows.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(*aggregates)
    return got.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in got.columns if c not in (*keys, "w")])


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key inside the watermark; state is dropped behind it."""
    return rows.dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", work: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """Process all that is there and stop. Each batch writes a folder of its own number, so that a batch which runs
    again after a failure replaces what it wrote; work may be any batch plan."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last state of each key of an update stream: a row of a later batch replaces that of an earlier."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    got = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return got.select(*keys, *[F.col(f"r.`{c}`").alias(c) for c in rest])


def resume(rows: DataFrame, key: str, done: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Work on rows of which the key isn't in the done folder, append their results there, and return all results.
    Running it again after a failure or with more rows does only what is missing."""
    spark = rows.sparkSession
    todo = rows
    if exists(spark, done):
        todo = rows.join(spark.read.parquet(done).select(key).distinct(), key, "left_anti")
    work(todo).write.mode("append").parquet(done)
    return spark.read.parquet(done)
