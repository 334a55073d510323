"""Pairs of reference and generated items inside a paper, their verdicts and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.functions import metrics as M
from siltwork.functions import text as T


def item_pairs(refs: DataFrame, gens: DataFrame, key: str) -> DataFrame:
    """All pairs of a paper's reference items (gt_id, gt_text) and generated items (llm_id, llm_text): an equi-join."""
    return refs.join(gens, key)


def local_verdict(pairs: DataFrame, least: float = 0.2) -> DataFrame:
    """Yes where the words of three characters or more overlap enough."""
    j = T.jaccard(T.tokens(F.col("gt_text"), 3), T.tokens(F.col("llm_text"), 3))
    return pairs.withColumn("yes", j >= least)


def pair_metrics(pairs: DataFrame, key: str) -> DataFrame:
    """Recall, precision and F1 of each paper from pair verdicts; shares of nothing are 0."""
    got = pairs.groupBy(key).agg(
        F.countDistinct("gt_id").alias("n_gt"),
        F.countDistinct("llm_id").alias("n_llm"),
        F.countDistinct(F.when(F.col("yes"), F.col("gt_id"))).alias("hit_gt"),
        F.countDistinct(F.when(F.col("yes"), F.col("llm_id"))).alias("hit_llm"),
    )
    got = got.withColumn("recall", T.safe_divide(F.col("hit_gt"), F.col("n_gt"))).withColumn("precision", T.safe_divide(F.col("hit_llm"), F.col("n_llm")))
    return got.withColumn("f1", T.harmonic(F.col("recall"), F.col("precision")))


def unmatched(pairs: DataFrame, key: str) -> DataFrame:
    """Generated items without a single yes."""
    got = pairs.groupBy(key, "llm_id").agg(F.max(F.col("yes").cast("int")).alias("any_yes"), F.min("llm_text").alias("llm_text"))
    return got.where("any_yes = 0").drop("any_yes")


def tfidf_cosine(pairs: DataFrame, ids: list[str], a: str, b: str) -> DataFrame:
    """Cosine of smoothed TF-IDF vectors fitted on the two texts of each pair: a word in both weighs 1, in one
    1 + ln 1.5. Words have two characters or more."""
    def counted(side: str, name: str) -> DataFrame:
        words = F.filter(F.split(F.lower(F.col(side)), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2)
        return pairs.select(*ids, F.explode(words).alias("w")).groupBy(*ids, "w").agg(F.count("*").alias(name))

    both = counted(a, "x").join(counted(b, "y"), [*ids, "w"], "full")
    idf = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1.0).otherwise(1 + F.log(F.lit(1.5)))
    x, y = F.coalesce("x", F.lit(0)) * idf, F.coalesce("y", F.lit(0)) * idf
    sums = both.groupBy(*ids).agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    return pairs.select(*ids).join(sums, ids, "left").select(*ids, F.coalesce(T.safe_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))), F.lit(0.0)).alias("cosine"))


def group_redundancy(rows: DataFrame, keys: list[str], item: str, text: str, stop_words: tuple[str, ...] = M.STOP_WORDS, over: float = 0.6) -> DataFrame:
    """(keys, redundancy): of three items or more, the share of those of which the TF-IDF cosine to another of the group is
    larger than over, fitted on the group. Where there are two, or no word of two characters that is no stop word, three
    times the share of pairs that overlap by more than half in words, 1 at most. Groups are papers: their items meet on words
    in common."""
    ids = [*keys, item]
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    split = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*stop_words))
    tf = rows.select(*ids, F.explode(split).alias("w")).groupBy(*ids, "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy(*keys, "w").agg(F.count("*").alias("df"))
    raw = tf.join(df, [*keys, "w"]).join(n, keys).select(*ids, "w", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("x"))
    norms = raw.groupBy(*ids).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    unit = raw.join(norms, ids).select(*ids, "w", (F.col("x") / F.col("norm")).alias("x"))
    other = unit.select(*keys, F.col(item).alias("__other"), "w", F.col("x").alias("y"))
    met = unit.join(other, [*keys, "w"]).where(F.col(item) != F.col("__other")).groupBy(*ids, "__other").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    near = met.groupBy(*ids).agg(F.max("s").alias("m")).groupBy(*keys).agg(F.count_if(F.col("m") > over).alias("near"))
    known = df.select(*keys).distinct().withColumn("known", F.lit(True))
    a = rows.select(*keys, F.col(item).alias("__a"), T.spaced_words(F.col(text)).alias("__u"))
    b = rows.select(*keys, F.col(item).alias("__b"), T.spaced_words(F.col(text)).alias("__v"))
    alike = a.join(b, keys).where("__a < __b").groupBy(*keys).agg(F.avg((T.jaccard(F.col("__u"), F.col("__v")) > 0.5).cast("double")).alias("alike"))
    got = n.join(known, keys, "left").join(near, keys, "left").join(alike, keys, "left")
    share = F.coalesce("near", F.lit(0)) / F.col("n")
    by_words = F.least(F.lit(1.0), 3 * F.coalesce("alike", F.lit(0.0)))
    return got.select(*keys, F.when((F.col("n") >= 3) & F.coalesce("known", F.lit(False)), share).when(F.col("n") >= 2, by_words).otherwise(0.0).alias("redundancy"))
