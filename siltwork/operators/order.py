"""A total order over all rows without a single task that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BUCKETS, BUCKET_ROWS, SAMPLED = 64, 1_000_000, 64


def with_rank(rows: DataFrame, by: list[Column], name: str, buckets: int | None = None) -> DataFrame:
    """Adds the dense position (from 1) in ascending order of by, nulls first. by must order rows totally and rows must
    compute alike each time. Buckets hold about BUCKET_ROWS rows, whatever the size of the table; their bounds come from
    the rows of the lowest hashes, SAMPLED a bucket. Rows rank inside their bucket, and counts of earlier buckets are added.
    The sample moves the balance, never the ranks. A row finds its bucket in two steps, among every so many-th bound and then
    among those that follow it."""
    buckets = buckets or max(BUCKETS, -(-rows.count() // BUCKET_ROWS))
    step = max(1, round(buckets**0.5))
    at = rows.withColumn("__at", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)]))
    drawn = at.select("__at", F.xxhash64("__at").alias("h")).orderBy("h").limit(SAMPLED * buckets)
    cuts = drawn.agg(F.sort_array(F.collect_list("__at")).alias("s"))
    stride = F.greatest(F.lit(1), F.ceil(F.size("s") / buckets)).cast("int")
    cuts = cuts.select(F.filter("s", lambda x, i: (i > 0) & (i % stride == 0)).alias("__cuts"))
    cuts = cuts.withColumn("__coarse", F.filter("__cuts", lambda x, i: i % step == 0))
    below = lambda c: F.size(F.filter(c, lambda x: x <= F.col("__at")))
    met = at.crossJoin(F.broadcast(cuts)).withColumn("__c", below(F.col("__coarse")))
    fine = (F.col("__c") - 1) * step + below(F.slice("__cuts", (F.col("__c") - 1) * step + 1, F.lit(step)))
    put = met.withColumn("__bucket", F.when(F.col("__c") == 0, 0).otherwise(fine)).drop("__cuts", "__coarse", "__c")
    sizes = put.groupBy("__bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__bucket", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy("__at"))
    return put.withColumn("__in", inside).join(F.broadcast(starts), "__bucket").withColumn(name, F.col("__start") + F.col("__in")).drop("__bucket", "__start", "__in", "__at")
