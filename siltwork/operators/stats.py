"""Paired tests of two systems on the same papers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork.operators.order import with_rank


def wilcoxon(rows: DataFrame, diff: Column) -> DataFrame:
    """The two-sided signed-rank test, zeros dropped, ties at their mean rank: n, statistic min(W+, W-), and z by the
    normal approximation with tie correction (null for n = 0). Differences are counted by size before they are ranked,
    and ranked without a single task of all rows."""
    sized = rows.select(diff.alias("d")).where("d != 0").groupBy(F.abs("d").alias("a")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("p"))
    ranked = with_prefix(sized, "a", "t", "before")
    mean_rank = F.col("before") + (F.col("t") + 1) / 2
    t = F.col("t").cast("double")
    sums = ranked.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.sum(mean_rank * F.col("p")).alias("plus"), F.sum(mean_rank * (F.col("t") - F.col("p"))).alias("minus"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    w = F.least("plus", "minus")
    got = sums.select("n", w.alias("statistic"), F.when(spread > 0, (w - n * (n + 1) / 4) / spread).alias("z"))
    return got.withColumn("p", two_sided_p(F.col("z")))


def two_sided_p(z: Column) -> Column:
    """The normal tail beyond z on both sides, by a rational approximation with an error below 2e-7."""
    # Coefficients of the approximation of erf (Abramowitz and Stegun, 7.1.26).
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    return ((((a[4] * t + a[3]) * t + a[2]) * t + a[1]) * t + a[0]) * t * F.exp(-x * x)


def with_prefix(rows: DataFrame, by: str, amount: str, name: str) -> DataFrame:
    """Adds the sum of amount over all rows before, in the order of a distinct column. Rows are ranked first, so that
    sums need only neighbouring ranks: blocks of ranks add up in parallel."""
    ranked = with_rank(rows, [F.col(by)], "__rank").withColumn("__block", F.floor(F.col("__rank") / 65536))
    blocks = ranked.groupBy("__block").agg(F.sum(amount).alias("s"))
    before = F.sum("s").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("__block", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.sum(amount).over(Window.partitionBy("__block").orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1))
    return ranked.withColumn("__in", F.coalesce(inside, F.lit(0))).join(starts, "__block").withColumn(name, F.col("__start") + F.col("__in")).drop("__block", "__start", "__in", "__rank")


def bootstrap_interval(rows: DataFrame, diff: Column, n_boot: int = 10_000, seed: int = 0, share: float = 0.95) -> DataFrame:
    """The percentile interval of the mean difference of paired rows. Each row enters each resample a Poisson(1) number of
    times, so equal differences, counted first, enter together a Poisson number of their count, drawn from the difference
    and the seed. Resamples don't depend on partitions, tasks send one sum a resample, and for many rows the interval is
    that of resampling with replacement. Null differences are left out; no row gives nulls."""
    known = rows.select(diff.cast("double").alias("d")).where("d IS NOT NULL")
    keyed = known.groupBy("d").agg(F.count("*").alias("c")).select(F.xxhash64("d", F.lit(seed)).alias("h"), "d", "c")

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(n_boot), np.zeros(n_boot)
        for batch in batches:
            for h, d, c in zip(batch["h"].to_numpy(), batch["d"].to_numpy(), batch["c"].to_numpy()):
                times = np.random.Generator(np.random.Philox(key=int(h) & (2**64 - 1))).poisson(float(c), n_boot)
                total += times * d
                count += times
        yield pd.DataFrame({"b": np.arange(n_boot), "s": total, "c": count})

    parts = keyed.mapInPandas(resample, "b long, s double, c double")
    means = parts.groupBy("b").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).where("c > 0").select((F.col("s") / F.col("c")).alias("m"))
    tail = (1 - share) / 2
    bounds = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    return known.agg(F.count("*").alias("n"), F.avg("d").alias("mean")).crossJoin(F.broadcast(bounds))
