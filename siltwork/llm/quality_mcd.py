"""Quality rules, in DataFrame operations only: counts of a text, and robust multivariate outliers.

The statistic vector of a document (``STATISTICS``) is made of square roots and logarithms of ratios of its counts.
For each language and source, each language, and all documents a minimum-covariance-determinant estimate of centre and
scatter is found: from two starts (medians and quartile ranges; moments of all), ``STEPS`` concentration steps take the
``SHARE`` of documents nearest by Mahalanobis distance and re-estimate from those; the start that ends with the smaller
determinant wins, and a last step re-weights. A document is rejected beyond the chi-squared quantile for ``TAIL``.

Estimates of few documents are drawn towards those of more: a source's towards its language's, a language's towards that
of all, and that of all towards a fixed wide scatter, in each case as if the larger group had given ``LENT`` documents
(``LENT_FIXED`` for the last). So every document is judged by one rule, whatever the size of its group or of the table.

Estimates come from sums of fixed-point integers and from histograms of distances, so that reruns and other
partitionings give the same verdicts. Each step is two aggregations with map-side partial sums over the numbers alone;
a group's histogram has a cell for each value it holds of a bounded grid, so a source that holds a third of all rows
sends no more than others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD_CLASS, Scratch, materialize, small_side, words_of

WINDOW = 8
STATISTICS = ("word_length", "symbols", "capitals", "repetition")
#: A scatter along a statistic is never below this: text of few words strays further than the bulk.
FLOORS = (0.12, 0.08, 0.05, 0.10)
SHARE = 0.75
STEPS = 4
TAIL = 1e-6
#: Documents that a larger group's estimate counts for.
LENT, LENT_FIXED = 200, 20
#: Scatter along each statistic that a table of few documents is judged by.
WIDE = (0.4, 0.3, 0.2, 0.3)
_GRID = 50
_SCALE = 10_000
_D = len(STATISTICS)


def chi2_even(x: float, dims: int) -> float:
    """Distribution function of chi-squared for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))


def chi2_quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_even(mid, dims) < p else (low, mid)
    return high


def _repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more."""
    starts = F.sequence(F.lit(1), F.size(words) - WINDOW + 1)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    repeats = F.size(F.array_distinct(F.col("__h"))) < F.size(F.col("__h"))
    pairs = F.array_sort(F.transform(F.col("__h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.filter(F.col("__p"), lambda e, k: (F.get(F.col("__p"), k - 1)["h"] == e["h"]) | (F.get(F.col("__p"), k + 1)["h"] == e["h"]))
    at = F.array_sort(F.transform(twice, lambda e: e["i"]))
    covered = F.aggregate(at, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")))["n"]
    return hashes, repeats, pairs, covered


def text_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals and n_echoes (words equal to the
    word before; all long).

    Words are runs of anything but ASCII white space. Null texts count as empty. Lines are what newlines separate; a
    line without a word is never a duplicate.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_echoes"]
    docs = docs.drop(*[c for c in docs.columns if c in names])
    hashes, repeats, pairs, covered = _repeat_words(F.col("__w"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CLASS))
    long_enough = F.size("__w") >= WINDOW
    out = docs.withColumn("__w", words_of(F.col(text))).withColumn("__l", lines)
    out = out.withColumn("__h", F.when(long_enough, hashes).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("__p", F.when(repeats, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    counts = {
        "n_words": F.size("__w"),
        "word_chars": F.length(F.array_join("__w", "")),
        "n_symbols": F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", "")),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.when(F.size("__p") > 0, covered).otherwise(0),
        "n_capitals": F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", "")),
        "n_echoes": F.size(F.filter("__w", lambda w, i: w == F.get(F.col("__w"), i - 1))),
    }
    return out.select(*docs.columns, *[c.cast("long").alias(k) for k, c in counts.items()])


def _vector() -> list[Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    raw = (F.log(chars / words), F.sqrt(F.col("n_symbols") / words), F.sqrt(F.col("n_capitals") / chars), F.sqrt(F.greatest("n_repeat_words", "n_echoes") / words))
    return [F.round(x * _SCALE).cast("long") for x in raw]


def _cholesky(cov: dict[tuple[int, int], Column]) -> dict[tuple[int, int], Column]:
    low: dict[tuple[int, int], Column] = {}
    for i in range(_D):
        for j in range(i + 1):
            rest = cov[j, i]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}")
    return low


def _with_cholesky(est: DataFrame, cov: dict[tuple[int, int], Column]) -> DataFrame:
    for (i, j), x in _cholesky(cov).items():
        est = est.withColumn(f"l{i}{j}", x)
    return est


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. by forward substitution with l00.. ."""
    z: list[Column] = []
    for i in range(_D):
        rest = F.col(f"x{i}") / _SCALE - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


_MOMENTS = [f"m{i}" for i in range(_D)] + [f"c{i}{j}" for i in range(_D) for j in range(i, _D)]
_ESTIMATE = [f"m{i}" for i in range(_D)] + [f"l{i}{j}" for i in range(_D) for j in range(i + 1)]
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]


def _factored(est: DataFrame, keys: list[str]) -> DataFrame:
    """keys, centre and Cholesky factor of est (keys, centre, scatter)."""
    return _with_cholesky(est, {(i, j): F.col(f"c{i}{j}") for i, j in _PAIRS}).select(*keys, *_ESTIMATE)


def _from_moments(rows: DataFrame, share: float, keys: list[str]) -> DataFrame:
    """Centre and scatter of each group. share: of the nearest documents that rows hold, for consistency."""
    sums = [F.sum(F.col(f"x{i}")).cast("double").alias(f"s{i}") for i in range(_D)]
    products = [F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(20,0)")).cast("double").alias(f"s{i}_{j}") for i, j in _PAIRS]
    est = rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *products)
    q = chi2_quantile(share, _D) if share < 1 else 0.0
    factor = share / chi2_even(q, _D + 2) if share < 1 else 1.0
    est = est.select(*keys, "n", *[(F.col(f"s{i}") / F.col("n") / _SCALE).alias(f"m{i}") for i in range(_D)], *[(F.col(f"s{i}_{j}") / F.col("n") / _SCALE**2).alias(f"e{i}_{j}") for i, j in _PAIRS])
    cov = [(factor * (F.col(f"e{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
    return est.select(*keys, *[f"m{i}" for i in range(_D)], *cov)


def _quantiles(rows: DataFrame, value: Column, shares: list[float], keys: list[str]) -> DataFrame:
    """For each group the smallest of the integer values that reaches each share of its rows: a histogram."""
    cells = rows.groupBy(*keys, value.alias("v")).count()
    cells = cells.withColumn("upto", F.sum("count").over(Window.partitionBy(*keys).orderBy("v"))).withColumn("all", F.sum("count").over(Window.partitionBy(*keys)))
    return cells.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= F.col("all") * s, F.col("v"))).alias(f"q{k}") for k, s in enumerate(shares)])


def mcd_estimates(rows: DataFrame, groups: int, made: Scratch) -> DataFrame:
    """rows: g, x0.. (fixed-point). The re-weighted minimum-covariance-determinant estimate of each g: centre, scatter."""
    parts = None
    for i in range(_D):
        cells = _quantiles(rows, F.floor(F.col(f"x{i}") / _GRID), [0.25, 0.5, 0.75], ["g"])
        own = cells.select("g", ((F.col("q1") + 0.5) * _GRID / _SCALE).alias(f"m{i}"), ((F.col("q2") - F.col("q0")) * _GRID / _SCALE / 1.349).alias(f"d{i}"))
        parts = own if parts is None else parts.join(own, "g")
    scatter = [(F.pow(F.col(f"d{i}"), 2) + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
    starts = parts.select("g", F.lit(0).alias("start"), *[f"m{i}" for i in range(_D)], *scatter)
    starts = starts.unionByName(_from_moments(rows, 1.0, ["g"]).withColumn("start", F.lit(1)))
    est, keys = made(starts, "mcd-start"), ["g", "start"]
    # Distances fall into cells of a 64th of an octave.
    cell = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-6))) * 64)
    for _ in range(STEPS):
        away = rows.join(small_side(_factored(est, keys), 2 * groups), "g").withColumn("d2", _distance())
        cut = _quantiles(away, cell, [SHARE], keys)
        near = away.join(small_side(cut, 2 * groups), keys).where(cell <= F.col("q0"))
        est = made(_from_moments(near, SHARE, keys), "mcd-step")
    # The determinant is the squared product of the factor's diagonal.
    size = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, _D)), F.log(F.col("l00")))
    sized = est.join(_factored(est, keys).select(*keys, F.round(size, 9).alias("size")), keys)
    best = sized.groupBy("g").agg(F.min_by(F.struct(*_MOMENTS), F.struct("size", "start")).alias("e")).select("g", "e.*")
    away = rows.join(small_side(_factored(best, ["g"]), groups), "g").withColumn("d2", _distance())
    return made(_from_moments(away.where(F.col("d2") <= chi2_quantile(0.975, _D)), 0.975, ["g"]), "mcd-weighted")


def _drawn(own: DataFrame, up: DataFrame, lent: int) -> DataFrame:
    """own (g, up, n, estimate) drawn towards up's estimate, as if that had given lent documents: the moments of both
    together. Where own has no estimate, up's."""
    w = F.when(F.col("m0").isNull(), 0.0).otherwise(F.col("n") / (F.col("n") + lent))
    both = own.join(up.select(F.col("g").alias("up"), *[F.col(c).alias(f"u_{c}") for c in _MOMENTS]), "up").withColumn("w", w)
    have = lambda c: F.coalesce(F.col(c), F.col(f"u_{c}"))
    apart = [have(f"m{i}") - F.col(f"u_m{i}") for i in range(_D)]
    centre = [(F.col(f"u_m{i}") + F.col("w") * apart[i]).alias(f"m{i}") for i in range(_D)]
    scatter = [(F.col("w") * have(f"c{i}{j}") + (1 - F.col("w")) * F.col(f"u_c{i}{j}") + F.col("w") * (1 - F.col("w")) * apart[i] * apart[j]).alias(f"c{i}{j}") for i, j in _PAIRS]
    return both.select("g", *centre, *scatter)


def group_estimates(sound: DataFrame, made: Scratch) -> tuple[DataFrame, int]:
    """(gs, centre, Cholesky factor) for each language and source, and their number. sound: gl, gs, x0.. ."""
    xs = [f"x{i}" for i in range(_D)]
    at = lambda g, up: F.struct(g.alias("g"), up.alias("up"))
    language, every = F.concat(F.lit("l"), "gl"), F.lit("a")
    level = F.array(at(F.concat(F.lit("s"), "gs"), language), at(language, every), at(every, F.lit("")))
    levels = sound.select(F.explode(level).alias("at"), *xs).select("at.*", *xs)
    groups = made(levels.groupBy("g", "up").agg(F.count("*").alias("n")), "quality-groups")
    count = groups.count()
    est = mcd_estimates(levels.drop("up"), count, made) if count else sound.sparkSession.createDataFrame([], "g string, " + ", ".join(f"{c} double" for c in _MOMENTS))
    own = groups.join(est, "g", "left")
    fixed = [F.lit(WIDE[i] ** 2 if i == j else 0.0).alias(f"c{i}{j}") for i, j in _PAIRS]
    everything = own.where("g = 'a'")
    top = _drawn(everything, everything.select(F.lit("").alias("g"), *[f"m{i}" for i in range(_D)], *fixed), LENT_FIXED)
    languages = _drawn(own.where(F.col("up") == "a"), top, LENT)
    sources = _drawn(own.where(F.startswith("g", F.lit("s"))), languages, LENT)
    return made(_factored(sources, ["g"]).select(F.substring("g", 2, 1 << 30).alias("gs"), *_ESTIMATE), "quality-estimates"), count


def judge(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str]) -> DataFrame:
    """The columns keep of docs, the counts of text_counts, base_failed, distance (squared, null where base_failed) and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. Null languages and sources are
    groups of their own. Repeated rows each count. An empty table gives no rows.
    """
    wanted = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    counted = text_counts(wanted).drop("text")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    own = F.concat(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")), F.lit("\u0001"))
    for i, x in enumerate(_vector()):
        counted = counted.withColumn(f"x{i}", x)
    stats = counted.withColumn("base_failed", failed).withColumn("gl", own).withColumn("gs", F.concat("gl", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))))
    stats = materialize(stats, "quality-counts")

    made = Scratch()
    est, groups = group_estimates(stats.where("not base_failed").select("gl", "gs", *[f"x{i}" for i in range(_D)]), made)
    est = materialize(est, "quality-judge")
    made.clear()
    out = stats.join(small_side(est, groups, 200_000), "gs", "left")
    out = out.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    limit = chi2_quantile(1 - TAIL, _D)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= limit)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *counts, "base_failed", "distance", kept.alias("kept"))
