"""Selection flows: scores of a pair, gates, and pairs for preference training."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights, bounds and flags of the scores.
FLAW_WEIGHTS = {"hedging_ratio": 0.15, "formulaic": 0.15, "checklist_coverage": 0.12, "absence_evidence": 0.12, "redundancy": 0.10, "structural_repetition": 0.10, "unclear_ratio": 0.08, "two_bullet_per_cat": 0.08, "length_inflation": 0.05, "praise_ratio": 0.05}
UNIFIED_WEIGHTS = {"plausibility": 0.15, "distinctness": 0.20, "flaw_signal": 0.30, "gt_superiority": 0.20, "difficulty": 0.15}
VERDICTS = ((0.65, "excellent"), (0.50, "good"), (0.35, "marginal"))
RULE_WEIGHTS = {"coverage": 2.0, "precision": 1.5, "groundedness": 1.0, "redundancy": -0.5, "specificity": 1.0, "criticality": 1.0}
ZERO_SHOT_WEIGHTS = {"coverage": 0.35, "precision": 0.25, "grounded": 0.15, "redundancy": -0.10, "severity": 0.15}
REFERENCES = r"(?i)(?:section|table|figure|equation|experiment|appendix|algorithm)\s*\w*"
QUOTES = r'"[^"]{5,}"'
SPECIFICS = (r"\d+\.?\d*\s*%", r"table\s*\d+", r"figure\s*\d+", r"section\s*\d+", r"equation\s*\d+", r"\d+\.\d+")
CRITICAL = ("fail", "lack", "miss", "overlook", "insufficient", "narrow", "weak", "mislead", "overstat", "ignor", "cherry.pick", "absent", "incomplete", "limit", "deficien", "inadequa", "flaw", "concern", "problematic")
EVIDENCE = (r"section\s+\d", r"table\s+\d", r"figure\s+\d", r"page\s+\d", r"\(.*?et al\..*?\)", r"\[[\d,\s]+\]", r"as (stated|mentioned|shown|discussed) in")
MAJOR = ("major", "significant", "critical", "severe", "fundamental", "serious")
MINOR = ("minor", "small", "slight", "marginal", "modest", "limited")


@dataclass(frozen=True)
class Thresholds:
    """What a flow can be configured with."""

    least_gap: float = 0.05
    stage_one: int = 4
    stage_weights: tuple[float, float] = (0.5, 0.5)
    high_coverage: float = 0.5
    low_coverage: float = 0.2
    natural_share: float = 0.7
    most_alike: float = 0.80
    least_bullets: int = 3


def _hits(c: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(add, [F.coalesce(c, F.lit("")).rlike("(?i)" + p).cast("int") for p in patterns])


def groundedness(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p))
    return F.least(F.lit(1.0), count(REFERENCES) * 0.12 + count(QUOTES) * 0.08)


def specifics(c: Column) -> Column:
    return F.least(F.lit(1.0), _hits(c, SPECIFICS) / 3.0)


def criticality(c: Column) -> Column:
    return F.least(F.lit(1.0), _hits(c, CRITICAL) / 5.0)


def evidence(c: Column) -> Column:
    return F.least(F.lit(1.0), _hits(c, EVIDENCE) / 3.0)


def severity(c: Column) -> Column:
    """major, minor or neutral, by which words the text holds more of."""
    low = F.lower(F.coalesce(c, F.lit("")))
    held = lambda words: reduce(add, [F.contains(low, F.lit(w)).cast("int") for w in words])
    return F.when(held(MAJOR) > held(MINOR), "major").when(held(MINOR) > held(MAJOR), "minor").otherwise("neutral")


def weighted_reward(parts: dict[str, Column], weights: dict[str, float], normalised: bool) -> Column:
    """The weighted sum, over the sum of absolute weights if normalised, within 0 and 1."""
    total = reduce(add, [parts[k] * w for k, w in weights.items()])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / sum(abs(w) for w in weights.values()) if normalised else total))


def unified_score(rows: DataFrame, flags: str, drop_flags: tuple[str, ...]) -> DataFrame:
    """Adds the five components, unified and verdict, from columns of rule scores and of a judge's marks (1 to 5, null: 3)."""
    c = lambda n, other=0.0: F.coalesce(F.col(n).cast("double"), F.lit(float(other)))
    mark = lambda n: (F.coalesce(F.col(n).cast("double"), F.lit(3.0)) - 1) / 4.0
    plausible = F.greatest(1.0 - c("override_compliance") * 0.6 - c("catastrophization") * 0.5 - c("praise_ratio") * 0.4, F.lit(0.0))
    flaw = F.least(reduce(add, [c(n) * w for n, w in FLAW_WEIGHTS.items()]) * 2.5, F.lit(1.0))
    gap = F.when(c("gt_specificity") > 0, F.least(c("gt_specificity") / F.greatest(c("specificity"), F.lit(0.01)), F.lit(3.0)) / 3.0).otherwise(0.5)
    mine, theirs = c("num_limitations", 1), c("gt_num_limitations", 1)
    inflated = F.when(mine > theirs * 2, 0.7).when(mine > theirs, 0.5).otherwise(0.3)
    n = F.size(flags)
    severe = F.arrays_overlap(F.col(flags), F.array(*[F.lit(x) for x in drop_flags]))
    hard = F.when(severe, 0.0).when(n == 0, 0.6).when(n <= 2, 0.8).when(n <= 4, 0.4).otherwise(0.1)
    got = rows.withColumns(
        {
            "plausibility": 0.6 * plausible + 0.4 * mark("judge_plausibility"),
            "distinctness": 0.6 * F.least((1.0 - c("similarity_to_gt")) * 1.3, F.lit(1.0)) + 0.4 * mark("judge_distinctness"),
            "flaw_signal": 0.7 * flaw + 0.3 * mark("judge_flaw_clarity"),
            "gt_superiority": 0.3 * gap + 0.3 * inflated + 0.4 * mark("judge_gt_superiority"),
            "difficulty": 0.6 * hard + 0.4 * mark("judge_difficulty"),
        }
    )
    total = reduce(add, [F.col(n) * w for n, w in UNIFIED_WEIGHTS.items()])
    for on, most in ((severe, 0.10), (F.array_contains(flags, "more_praise_than_criticism"), 0.35), (F.array_contains(flags, "rejected_more_specific_than_gt"), 0.30)):
        total = F.when(on, F.least(total, F.lit(most))).otherwise(total)
    verdict = reduce(lambda w, b: w.when(F.col("unified") >= b[0], b[1]), VERDICTS[1:], F.when(F.col("unified") >= VERDICTS[0][0], VERDICTS[0][1])).otherwise("drop")
    return got.withColumn("unified", F.round(total, 6)).withColumn("verdict", verdict)


def two_stage(rows: DataFrame, keys: list[str], first: str, second: str, arrival: str, t: Thresholds = Thresholds()) -> DataFrame:
    """Of each group the best by the first score, which are then scored by both, each brought to 0 to 1 over all that are
    left (a flat one to 0.5), blended; adds n1, n2, blended and place."""
    w = Window.partitionBy(*keys)
    left = rows.withColumn("__p", F.row_number().over(w.orderBy(F.desc(first), arrival))).where(F.col("__p") <= t.stage_one).drop("__p")
    bounds = left.agg(*[f(c).alias(f"{n}{i}") for i, c in ((1, first), (2, second)) for n, f in (("lo", F.min), ("hi", F.max))])
    got = left.crossJoin(F.broadcast(bounds))
    for i, c in ((1, first), (2, second)):
        spread = F.col(f"hi{i}") - F.col(f"lo{i}")
        got = got.withColumn(f"n{i}", F.when(F.col(c).isNull(), None).when(spread > 0, (F.col(c) - F.col(f"lo{i}")) / spread).otherwise(0.5))
    one, two = t.stage_weights
    mean = F.when(F.col("n2").isNull(), F.col("n1")).when(F.col("n1").isNull(), F.col("n2")).otherwise((one * F.col("n1") + two * F.col("n2")) / (one + two))
    got = got.withColumn("blended", F.round(mean, 6)).drop("lo1", "hi1", "lo2", "hi2")
    return got.withColumn("place", F.row_number().over(w.orderBy(F.desc("blended"), arrival)))


def least_alike_pairs(rows: DataFrame, keys: list[str], score: str, alike: str, covered: str, arrival: str, t: Thresholds = Thresholds()) -> DataFrame:
    """The best of each group against the one, of the others, that is least like the reference; gaps below a bound go."""
    apart = (1 - F.coalesce(F.col(alike), F.lit(0.5))) * 0.5 + (1 - F.coalesce(F.col(covered), F.lit(0.5))) * 0.5
    known = rows.where(F.col(score).isNotNull()).select(*keys, F.col(arrival).alias("a"), F.col(score).alias("s"), F.round(apart, 9).alias("d"))
    best = known.groupBy(*keys).agg(F.max(F.struct("s", (-F.col("a")).alias("a"))).alias("b")).select(*keys, (-F.col("b.a")).alias("chosen"), F.col("b.s").alias("chosen_score"))
    # Of equally unlike ones that with the better score, then the earlier.
    worst = known.join(best, keys).where("a <> chosen").groupBy(*keys, "chosen", "chosen_score").agg(F.max(F.struct("d", "s", (-F.col("a")).alias("a"))).alias("w"))
    got = worst.select(*keys, "chosen", (-F.col("w.a")).alias("rejected"), (F.col("chosen_score") - F.col("w.s")).alias("score_gap"))
    return got.where(F.round("score_gap", 9) >= t.least_gap)


def coverage_gate(score: Column, coverage: Column, t: Thresholds = Thresholds()) -> Column:
    """A score raised by a tenth for high coverage, lowered by 15 % for low coverage."""
    return F.round(F.when(coverage >= t.high_coverage, score * 1.1).when(coverage < t.low_coverage, score * 0.85).otherwise(score), 6)


def template_gate(score: Column, generic: Column, names_paper: Column, alike: Column) -> Column:
    """A score lowered by 30 % for a text of template phrases that names nothing of its paper, and once more for one that is
    like those of other papers."""
    one = F.when((generic >= 3) & ~names_paper, score * 0.7).otherwise(score)
    return F.round(F.when(F.coalesce(alike, F.lit(0.0)) > 0.85, one * 0.7).otherwise(one), 6)


def augmented_pairs(pairs: DataFrame, key: str, gap: str, made: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The pairs of largest gap stay natural; of the rest, those for which a made text (key, text, bullets, alike, margin)
    passes the gate become synthetic, and the others stay natural too. pairs: with place by gap and n."""
    natural = F.col("place") <= F.bround(F.col("n") * t.natural_share)
    got = pairs.join(made.select(key, "bullets", "alike", "margin"), key, "left")
    good = (F.col("bullets") >= t.least_bullets) & (F.col("alike") < t.most_alike) & (F.col("margin") >= t.least_gap)
    return got.withColumn("kind", F.when(natural, "natural").when(F.coalesce(good, F.lit(False)), "synthetic").otherwise("natural_fallback"))


def unpivoted_pairs(rows: DataFrame, key: str, chosen: str, rejected: dict[str, str], least: int) -> DataFrame:
    """(key, mode, chosen, rejected): the reference against each perturbed column that says enough and isn't the same."""
    long = rows.unpivot([F.col(key), F.col(chosen)], [F.col(c).alias(mode) for c, mode in rejected.items()], "mode", "rejected")
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return long.where((F.length(t("rejected")) >= least) & (F.length(t(chosen)) >= least) & (t("rejected") != t(chosen)))


def proportional_take(rows: DataFrame, cluster: str, score: str, arrival: str, n: int) -> DataFrame:
    """n rows: of each cluster the best, as many as n over the number of clusters; what clusters lack is filled with the best
    of the rest."""
    clusters = rows.agg(F.countDistinct(cluster).alias("__k"))
    nth = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(score), arrival))
    got = rows.withColumn("__nth", nth).crossJoin(F.broadcast(clusters)).withColumn("own", F.col("__nth") <= F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("__k"))))
    return got.orderBy(F.desc("own"), F.desc(score), arrival).limit(n).drop("__nth", "__k")


def with_clusters(rows: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """cluster: k-means of vectors."""
    data = rows.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(data).transform(data).drop("__v")


def six_gates(rows: DataFrame, key: list[str], n: int, k: int, t: Thresholds = Thresholds()) -> DataFrame:
    """The whole chain over candidates (key, arrival, words, bullets, generic, names, alike, coverage, score, v): length,
    structure, templates, coverage, diversity by clusters, and the n that are left."""
    usable = rows.where((F.col("words") >= 20) & (F.col("bullets") >= 1))
    scored = usable.withColumn("score", template_gate(F.col("score"), F.col("generic"), F.col("names"), F.col("alike")))
    scored = scored.withColumn("score", coverage_gate(F.col("score"), F.col("coverage"), t))
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "arrival"))
    best = scored.withColumn("__f", first).where("__f = 1").drop("__f")
    return proportional_take(with_clusters(best, "v", k), "cluster", "score", "arrival", n)
