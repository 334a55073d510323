"""Selection inside groups: advantages, best and worst, margins, splits, votes, dedup. Ties are always decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork.operators.order import with_rank


def advantages(rows: DataFrame, keys: list[str], reward: str) -> DataFrame:
    """(reward - mean) / (population deviation + 1e-8) in groups of two or more."""
    w = Window.partitionBy(*keys)
    got = rows.withColumn("group_size", F.count("*").over(w)).where("group_size >= 2")
    return got.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + 1e-8))


def top_k(rows: DataFrame, keys: list[str], score: str, arrival: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), arrival)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def best_worst(rows: DataFrame, keys: list[str], score: str, arrival: str, least_gap: float) -> DataFrame:
    """The first of the best and the last of the worst of each group, where they lie least_gap apart. One aggregation
    with map-side partial results, no sort."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(arrival)).alias("a")))
    worst = F.min(F.struct(F.col(score).alias("s"), (-F.col(arrival)).alias("a")))
    got = rows.where(F.col(score).isNotNull()).groupBy(*keys).agg(best.alias("b"), worst.alias("w"), F.count("*").alias("n"))
    got = got.select(*keys, "n", (-F.col("b.a")).alias("chosen"), (-F.col("w.a")).alias("rejected"), F.col("b.s").alias("chosen_score"), F.col("w.s").alias("rejected_score"))
    got = got.withColumn("score_gap", F.col("chosen_score") - F.col("rejected_score"))
    return got.where((F.col("n") >= 2) & (F.col("chosen") != F.col("rejected")) & (F.col("score_gap") >= least_gap)).drop("n")


def margins(rows: DataFrame, keys: list[str], score: str, arrival: str) -> DataFrame:
    """Best minus second best of groups with two scores or more, and which row (arrival) is the best."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), arrival)
    two = rows.where(F.col(score).isNotNull()).withColumn("place", F.row_number().over(w)).where("place <= 2")
    got = two.groupBy(*keys).agg(F.max(score).alias("best"), F.min(score).alias("second"), F.max(F.when(F.col("place") == 1, F.col(arrival))).alias("winner"), F.count("*").alias("n"))
    return got.where("n = 2").select(*keys, "winner", "best", "second", (F.col("best") - F.col("second")).alias("margin"))


def majority(votes: DataFrame, keys: list[str], label: str, position: str, disagreed: str | None = None) -> DataFrame:
    """The most frequent label of each item, of equals the one that came first; disagreed, where three differ."""
    counted = votes.groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    got = counted.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("first")).alias("f"), label)).alias("m"), F.count("*").alias("labels"))
    winner = F.col(f"m.{label}") if disagreed is None else F.when(F.col("labels") == 3, disagreed).otherwise(F.col(f"m.{label}"))
    return got.select(*keys, winner.alias("winner"), F.col("m.n").alias("votes"), "labels")


def latest_revision(rows: DataFrame, keys: list[str], round_: str, arrival: str, *fields: str) -> DataFrame:
    """The fields of the first row of each group's highest round; a null round is a draft, below all others."""
    best = F.struct(F.coalesce(F.col(round_), F.lit(-1)).alias("r"), (-F.col(arrival)).alias("a"))
    got = rows.groupBy(*keys).agg(F.max_by(F.struct(round_, *fields), best).alias("e"))
    return got.select(*keys, "e.*")


def keep_first(rows: DataFrame, key: Column, arrival: str) -> DataFrame:
    """The first row of each key, and how many there were."""
    w = Window.partitionBy("__key")
    got = rows.withColumn("__key", key).withColumn("copies", F.count("*").over(w)).withColumn("__place", F.row_number().over(w.orderBy(arrival)))
    return got.where("__place = 1").drop("__key", "__place")


def group_split(rows: DataFrame, group: str, share: float, seed: str) -> DataFrame:
    """train or val for whole groups: the first max(1, floor(share * groups)) in a seeded order are val."""
    groups = rows.select(group).distinct().withColumn("o", F.md5(F.concat(F.lit(seed + "|"), F.col(group).cast("string"))))
    n = groups.agg(F.count("*").alias("n"))
    cut = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    ranked = with_rank(groups, [F.col("o"), F.col(group)], "r")
    which = ranked.crossJoin(F.broadcast(n)).select(group, F.when(F.col("r") <= cut, "val").otherwise("train").alias("split"))
    return rows.join(which, group)


def numbered_keys(rows: DataFrame, base: str, arrival: str) -> DataFrame:
    """Keys made distinct: the second of a key gets __dup2, and so on."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(arrival))
    return rows.withColumn("chunk_key", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("__dup"), n.cast("string"))))


def best_and_alike_worst(rows: DataFrame, keys: list[str], score: str, arrival: str, input_hash: str, least_gap: float, least_chosen: float) -> DataFrame:
    """The first of the best of each group against the worst (of equals the last) that had the same input, where the
    best reaches least_chosen and they lie least_gap apart. Aggregates meet rows by a join, which splits hot groups."""
    known = rows.where(F.col(score).isNotNull()).select(*keys, score, arrival, input_hash)
    best = known.groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(arrival)).alias("a"), F.col(input_hash).alias("h"))).alias("b"))
    best = best.select(*keys, F.col("b.s").alias("chosen_score"), (-F.col("b.a")).alias("chosen"), F.col("b.h").alias(input_hash)).where(F.col("chosen_score") >= least_chosen)
    others = known.join(best, [*keys, input_hash]).where((F.col(arrival) != F.col("chosen")) & (F.col("chosen_score") - F.col(score) >= least_gap))
    worst = others.groupBy(*keys, "chosen", "chosen_score").agg(F.min(F.struct(F.col(score).alias("s"), (-F.col(arrival)).alias("a"))).alias("w"))
    return worst.select(*keys, "chosen", (-F.col("w.a")).alias("rejected"), "chosen_score", F.col("w.s").alias("rejected_score"), (F.col("chosen_score") - F.col("w.s")).alias("score_gap"))


def one_against_all(rows: DataFrame, keys: list[str], score: str, arrival: str) -> DataFrame:
    """The best row of each group as chosen, paired with each other row of it."""
    best = rows.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(arrival)).alias("a"))).alias("b"))
    best = best.select(*keys, (-F.col("b.a")).alias("chosen"), F.col("b.s").alias("chosen_score"))
    rest = rows.where(F.col(score).isNotNull()).select(*keys, F.col(arrival).alias("rejected"), F.col(score).alias("rejected_score"))
    return rest.join(best, keys).where("rejected != chosen")


def melt_columns(rows: DataFrame, keys: list[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """A row for each of the named columns: {column: label}."""
    return rows.unpivot([F.col(k) for k in keys], [F.col(c).alias(label) for c, label in columns.items()], name, value)


def diverse_top_k(rows: DataFrame, keys: list[str], flaw: str, strategy: str, score: str, arrival: str, k: int) -> DataFrame:
    """Up to k rows of each group: the best of each flaw, then strategies that those don't use, then the rest."""
    w = Window.partitionBy(*keys)
    first = F.row_number().over(Window.partitionBy(*keys, flaw).orderBy(F.desc(score), arrival)) == 1
    got = rows.withColumn("__first", first).withColumn("__used", F.collect_set(F.when(F.col("__first"), F.col(strategy))).over(w))
    got = got.withColumn("tier", F.when(F.col("__first"), 1).when(~F.array_contains("__used", F.col(strategy)), 2).otherwise(3))
    place = F.row_number().over(w.orderBy("tier", F.desc(score), arrival))
    return got.withColumn("place", place).where(F.col("place") <= k).drop("__first", "__used")


def category_rates(rows: DataFrame, keys: list[str], category: str, groups: dict[str, list[int]]) -> DataFrame:
    """The share of each set of category codes among rows with one."""
    known = rows.where(F.col(category).isNotNull())
    return known.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.col(category).isin(*codes).cast("double")).alias(name) for name, codes in groups.items()])


def worker_outputs(samples: DataFrame, keys: list[str], turn: str, round_: str, arrival: str, output: str) -> DataFrame:
    """(keys, search, retrieve, synthesize) of the workers of rollouts that made a hop: the last sample of each turn, and of
    revisions the first of the latest round, where there is any, in place of the draft. Missing outputs are empty."""
    of = lambda *kinds: F.col(turn).isin(*kinds)
    last = lambda kind: F.max_by(output, F.when(of(kind), F.col(arrival)))
    revised = F.max_by(F.struct(output), F.when(of("revised"), F.struct(F.coalesce(round_, F.lit(0)), -F.col(arrival))))
    got = samples.groupBy(*keys).agg(
        last("hop_search").alias("search"), last("hop_query").alias("retrieve"), last("hop_draft").alias("draft"), revised.alias("revised"), F.count_if(of("hop_search", "hop_query", "hop_draft")).alias("hops")
    )
    final = F.when(F.col("revised").isNotNull(), F.col(f"revised.{output}")).otherwise(F.col("draft"))
    empty = F.lit("")
    return got.where("hops > 0").select(*keys, F.coalesce("search", empty).alias("search"), F.coalesce("retrieve", empty).alias("retrieve"), F.coalesce(final, empty).alias("synthesize"))
