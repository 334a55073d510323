"""Matching of generated to reference items inside a paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions import text as T


def greedy_matches(pairs: DataFrame, keys: list[str], a: str, b: str, score: Column, least: float) -> DataFrame:
    """One-to-one matches of each group: the pair of the highest score first, of equals that of the larger a, then b.
    Only pairs that reach least are gathered; a fold over them in order replaces a loop in Python. A group's reaching
    pairs must fit a row."""
    reach = pairs.select(*keys, F.struct(score.alias("s"), F.col(a).alias("a"), F.col(b).alias("b")).alias("e")).where(F.col("e.s") >= least)
    edges = reach.groupBy(*keys).agg(F.sort_array(F.collect_list("e"), asc=False).alias("es"))
    none = F.filter(F.col("es"), lambda e: F.lit(False))

    def step(taken, e):
        free = ~F.exists(taken, lambda t: (t["a"] == e["a"]) | (t["b"] == e["b"]))
        return F.when(free, F.concat(taken, F.array(e))).otherwise(taken)

    got = edges.select(*keys, F.explode(F.aggregate("es", none, step)).alias("m"))
    return got.select(*keys, F.col("m.a").alias(a), F.col("m.b").alias(b), F.col("m.s").alias("score"))


def match_f1(pairs: DataFrame, keys: list[str], a: str, b: str, score: Column, least: float) -> DataFrame:
    """F1 of the greedy matches against all items of both sides; 0 where nothing matches."""
    sizes = pairs.groupBy(*keys).agg(F.countDistinct(a).alias("n_a"), F.countDistinct(b).alias("n_b"))
    found = greedy_matches(pairs, keys, a, b, score, least).groupBy(*keys).agg(F.count("*").alias("matched"))
    got = sizes.join(found, keys, "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return got.withColumn("f1", T.harmonic(F.col("matched") / F.col("n_a"), F.col("matched") / F.col("n_b")))


def coverage(pairs: DataFrame, keys: list[str], item: str, score: Column, over: float, name: str) -> DataFrame:
    """The share of a group's items of which the best score lies above a bound."""
    best = pairs.groupBy(*keys, item).agg(F.max(score).alias("best"))
    return best.groupBy(*keys).agg(F.avg((F.col("best") > over).cast("double")).alias(name))


def weighted_metrics(pairs: DataFrame, key: str, yes: Column, score: Column) -> DataFrame:
    """Recall and precision in which an item counts with the highest score of its yes pairs."""
    value = F.when(yes, score).otherwise(0.0)
    out = None
    for item, name in (("gt_id", "recall"), ("llm_id", "precision")):
        side = pairs.groupBy(key, item).agg(F.max(value).alias("v")).groupBy(key).agg(F.avg("v").alias(f"weighted_{name}"))
        out = side if out is None else out.join(side, key)
    return out.withColumn("weighted_f1", T.harmonic(F.col("weighted_recall"), F.col("weighted_precision")))


def best_match_f1(pairs: DataFrame, key: str, score: Column) -> DataFrame:
    """The harmonic mean of the mean best scores from both sides."""
    scored = pairs.withColumn("__s", score)
    sides = [scored.groupBy(key, i).agg(F.max("__s").alias("v")).groupBy(key).agg(F.avg("v").alias(n)) for i, n in (("gt_id", "recall"), ("llm_id", "precision"))]
    return sides[0].join(sides[1], key).withColumn("f1", T.harmonic(F.col("recall"), F.col("precision")))
