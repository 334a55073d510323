"""Joins, sets, splits and orders of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork.operators.order import with_rank


def lookup(rows: DataFrame, side: DataFrame, key: str, value: str, arrival: str, default: Column | None = None) -> DataFrame:
    """rows with the value that side holds for their key; of a key that side repeats, the last to arrive counts."""
    last = side.groupBy(key).agg(F.max_by(value, arrival).alias(value))
    got = rows.join(last, key, "left")
    return got if default is None else got.withColumn(value, F.coalesce(F.col(value), default))


def known_in_order(rows: DataFrame, key: str, ids: str, side: DataFrame, id_: str) -> DataFrame:
    """rows with the ids that side knows, in their order and each once; an empty array where it knows none."""
    each = rows.select(key, F.posexplode(F.array_distinct(ids)).alias("pos", id_))
    met = each.join(side.select(id_).distinct(), id_, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", id_))).alias("l"))
    got = rows.drop(ids).join(met, key, "left")
    return got.withColumn(ids, F.coalesce(F.transform("l", lambda x: x[id_]), F.array().cast(rows.schema[ids].dataType))).drop("l")


def zipped(rows: DataFrame, key: str, lists: dict[str, str]) -> DataFrame:
    """(key, pos, a column for each list): elements of one position side by side; a list that ended gives nulls."""
    both = F.arrays_zip(*[F.col(c).alias(n) for n, c in lists.items()])
    return rows.select(key, F.posexplode(both).alias("pos", "x")).select(key, "pos", *[F.col("x").getField(n).alias(n) for n in lists])


def self_pairs(rows: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """(keys, a, b, value_a, value_b) of rows of one group, a before b."""
    left = rows.select(*keys, F.col(pos).alias("a"), F.col(value).alias(f"{value}_a"))
    right = rows.select(*keys, F.col(pos).alias("b"), F.col(value).alias(f"{value}_b"))
    return left.join(right, keys).where("a < b")


def merged_scores(one: DataFrame, other: DataFrame, keys: list[str], score: str, text: str) -> DataFrame:
    """one with the other file's score, left; mismatch where both have a row and their texts differ."""
    side = other.select(*keys, F.col(score).alias(f"{score}_2"), F.col(text).alias("__text"), F.lit(True).alias("__there"))
    got = one.join(side, keys, "left")
    return got.withColumn("mismatch", F.col("__there").isNotNull() & ~F.col(text).eqNullSafe(F.col("__text"))).drop("__text", "__there")


def aligned(rows: DataFrame, prior: DataFrame, order: list[Column], prior_order: list[Column], columns: list[str], first: int | None = None) -> DataFrame:
    """rows with columns of prior by position in both orders, of the first so many rows; others get nulls."""
    left, right = with_rank(rows, order, "__nth"), with_rank(prior, prior_order, "__nth").select("__nth", *columns)
    if first is not None:
        right = right.where(F.col("__nth") <= first)
    return left.join(right, "__nth", "left").drop("__nth")


def ordered_distinct(rows: DataFrame, keys: list[str], name: Column, order: list[str], k: int, chars: int = 120) -> DataFrame:
    """The first k rows of each group without those whose name (its first characters, lower case) came before; rows without
    a name are never repeats."""
    got = rows.withColumn("__name", F.lower(F.substring(F.coalesce(name, F.lit("")), 1, chars)))
    nth = F.row_number().over(Window.partitionBy(*keys, "__name").orderBy(*order))
    got = got.withColumn("__nth", nth).where("__nth = 1 OR __name = ''")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return got.withColumn("place", place).where(F.col("place") <= k).drop("__name", "__nth")


def seeded(key: Column, seed: int) -> Column:
    """A drawn order that reruns and partitions share."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by the seeded order: top n of each task, then of all."""
    return rows.orderBy(seeded(F.col(key), seed), key).limit(n)


def seeded_shuffle(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """place: a shuffled position of each row."""
    return with_rank(rows, [seeded(F.col(key), seed), F.col(key)], "place")


def row_split(rows: DataFrame, key: str, share: float, seed: int, least: int = 20) -> DataFrame:
    """split: the first share of rows in the seeded order are test, rounded up; all are train unless there are over least."""
    n = rows.agg(F.count("*").alias("__n"))
    place = seeded_shuffle(rows, key, seed).crossJoin(F.broadcast(n))
    test = (F.col("__n") > least) & (F.col("place") <= F.ceil(F.col("__n") * share))
    return place.withColumn("split", F.when(test, "test").otherwise("train")).drop("__n", "place")


def paper_order(rows: DataFrame, key: str, name: str = "place") -> DataFrame:
    """The position by key, numbers first and by value, then other keys."""
    number = F.col(key).try_cast("bigint")
    return with_rank(rows, [number.isNull(), F.coalesce(number, F.lit(0)), F.col(key)], name)


def reason_counts(rows: DataFrame, reasons: str) -> DataFrame:
    """How often each reason stands, by what it says before a colon."""
    return rows.select(F.explode(reasons).alias("r")).groupBy(F.split_part("r", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))


def across_columns(rows: DataFrame, key: str, columns: dict[str, str], value: str) -> DataFrame:
    """Mean and sample deviation of each row's named columns, nulls aside: unpivoted, then aggregated."""
    long = rows.unpivot([F.col(key)], [F.col(c).cast("double").alias(n) for c, n in columns.items()], "seed", value)
    return long.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
