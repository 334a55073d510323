"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Each source's words are to reach a target: its weight's share of all words, at most ``CAP`` times the words it has,
what that leaves over being shared again by weight. A source is cut into blocks by hash, blocks stand in a permuted
order, and a source's target is a whole number of passes over all blocks plus a part of one more pass, so its
quota is an exact number of blocks.

The tree splits all sources' quotas between ``2 ** SHARD_LEVELS`` output shards. At each node half of the blocks go left;
how many of each source, is drawn from the multivariate hypergeometric law, source by source from the law of one given
those before (the inverse of its distribution function at a number from md5). Nodes hold counts, never blocks. A leaf
then draws as many of each source's blocks as its quota says, the next in the source's order of passes and blocks, so
leaves are disjoint and together take each block as often as the tree's quotas say. Rows are in permuted order inside
their block. The last block of a source is cut before the row that would pass the target; the row of that block that
best fills what is left comes in too.

Orders of blocks are found in buckets of their hash, with counts of the buckets before. What grows with the number of
sources alone (targets, the vector of a node's quotas) is in one task.

All orders come from md5 of seeds, keys and texts: reruns agree, and SQL can say the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, materialize, small_side

CAP = 3
SHARD_LEVELS = 4
BLOCK_ROWS = 1_024
#: Blocks of a source whose order is found in one task.
BUCKET_BLOCKS = 4_096
#: Rows equal in key, source and text of which there are more are numbered in many tasks.
HEAVY_ROWS = 100_000
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    t = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(t, SPACE_CLASS + "+"))
    outer = F.when(t == "", 1).otherwise(F.when(t.rlike("^" + SPACE_CLASS), 1).otherwise(0) + F.when(t.rlike(SPACE_CLASS + r"\z"), 1).otherwise(0))
    return F.greatest(parts - outer, F.lit(0)).cast("long")


def source_targets(sized: DataFrame, made: Scratch) -> DataFrame:
    """s (source), number (from 1), rows, source_size, weight, target of sized (s, size).

    Where the cap binds: sources stand in the order of the level (words over weight) at which each would reach it;
    the final level is the first that leaves those behind it uncapped.
    """
    totals = sized.groupBy("s").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    totals = made(totals, "mix-sources")
    number = F.row_number().over(Window.orderBy(F.col("s").isNull(), F.col("s")))
    weight = F.lit(len(WEIGHTS)) if not WEIGHTS else F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(number - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    w = totals.withColumn("number", number).withColumn("weight", weight.cast("long"))
    reach = F.col("source_size").cast("double") / F.col("weight")
    order = Window.orderBy("reach", F.col("s").isNull(), "s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = w.withColumn("reach", reach).withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * CAP).withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("level", (F.sum("source_size").over(every) - F.col("capped")).cast("double") / F.col("open"))
    fits = F.col("level") <= CAP * F.col("reach")
    w = w.withColumn("final", F.min(F.when(fits, F.struct("reach", F.col("s").isNull().alias("z"), "s", "level"))).over(every)["level"])
    target = F.least(F.col("weight") * F.col("final"), (CAP * F.col("source_size")).cast("double"))
    return w.select("s", "number", "rows", "source_size", "weight", F.when(F.col("source_size") == 0, 0.0).otherwise(target).alias("target"))


def _number(digest: Column) -> Column:
    """The first 8 hex digits of a digest as an integer."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _sealed(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8."""
    z = n.cast("double") + 8.0
    steps = F.log(F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(1.0), lambda a, k: a * (n + k)))
    return z * F.log(z) - z + 0.5 * F.log(z * 6.283185307179586) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5.0)) - 1 / (1680 * F.pow(z, 7.0)) - steps


def _let(value: Column, use) -> Column:
    """use(value), with value written and computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hypergeometric(pop: Column, own: Column, draws: Column, u: Column) -> Column:
    """How many of own things are among draws out of pop: the smallest count whose distribution function reaches u. The
    function is added up from 12 deviations below the mean to 12 above, which is all of it in double precision."""

    def ends(e: Column) -> Column:
        return _let(
            F.struct((e["draws"].cast("double") * e["own"] / e["pop"]).alias("mean"), e.alias("e")),
            lambda m: _let(F.struct(m.alias("m"), (12 * F.sqrt(F.greatest(m["mean"] * (1 - m["e"]["own"] / m["e"]["pop"]) * (m["e"]["pop"] - m["e"]["draws"]) / F.greatest(m["e"]["pop"] - 1, F.lit(1)), F.lit(0.0))) + 1).alias("room")), lambda r: F.struct(F.greatest(F.lit(0), m["e"]["draws"] - (m["e"]["pop"] - m["e"]["own"]), F.floor(m["mean"] - r["room"])).cast("long").alias("low"), F.least(m["e"]["own"], m["e"]["draws"], F.ceil(m["mean"] + r["room"])).cast("long").alias("high"))),
        )

    def first(e: Column, low: Column) -> Column:
        """The probability of the lowest count: nine factorials."""
        above = F.array(e["own"], e["pop"] - e["own"], e["draws"], e["pop"] - e["draws"])
        below = F.array(low, e["own"] - low, e["draws"] - low, e["pop"] - e["own"] - e["draws"] + low, e["pop"])
        signed = F.concat(F.transform(above, lambda n: F.struct(n.alias("n"), F.lit(1.0).alias("w"))), F.transform(below, lambda n: F.struct(n.alias("n"), F.lit(-1.0).alias("w"))))
        return F.exp(F.aggregate(signed, F.lit(0.0), lambda a, x: a + x["w"] * _log_factorial(x["n"])))

    def walk(e: Column, at: Column) -> Column:
        def step(a: Column, k: Column) -> Column:
            upto = a["upto"] + a["p"]
            ratio = (e["own"] - k).cast("double") * (e["draws"] - k) / ((k + 1).cast("double") * (e["pop"] - e["own"] - e["draws"] + k + 1))
            return F.struct(upto.alias("upto"), (a["p"] * ratio).alias("p"), (a["x"] + F.when(upto < e["u"], 1).otherwise(0)).cast("long").alias("x"))

        counts = F.when(at["high"] > at["low"], F.sequence(at["low"], at["high"] - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(counts, F.struct(F.lit(0.0).alias("upto"), first(e, at["low"]).alias("p"), at["low"].alias("x")), step)["x"]

    given = F.struct(pop.alias("pop"), own.alias("own"), draws.alias("draws"), u.alias("u"))
    return F.when(pop > 0, _let(given, lambda e: _let(ends(e), lambda at: walk(e, at)))).otherwise(F.lit(0).cast("long"))


def split_quotas(quotas: DataFrame, levels: int, seed: str) -> DataFrame:
    """(s, leaves: array of the blocks that each of 2 ** levels shards takes) of quotas (s, number, q).

    At each node the left child gets half of the blocks, of an odd number one more than the right."""
    vector = F.array_sort(F.collect_list(F.struct("number", "s", F.col("q").cast("long").alias("q"))))
    nodes = quotas.groupBy().agg(vector.alias("of")).select(F.lit(0).alias("node"), "of")
    for level in range(levels):
        hexes = lambda e: F.substring(F.md5(_sealed(f"split-{seed}-{level}", F.col("node"), e["s"])), 1, 13)  # noqa: B023, E731
        drawn = nodes.select("node", F.transform("of", lambda e: F.struct(e["number"].alias("number"), e["s"].alias("s"), e["q"].alias("q"), ((F.conv(hexes(e), 16, 10).cast("long") + 0.5) / 2.0**52).alias("u"))).alias("of"))  # noqa: B023
        drawn = drawn.withColumn("n", F.aggregate("of", F.lit(0).cast("long"), lambda a, e: a + e["q"]))

        def step(a: Column, e: Column) -> Column:
            x = _hypergeometric(a["pop"], e["q"], a["draws"], e["u"])
            return _let(x, lambda v: F.struct((a["pop"] - e["q"]).alias("pop"), (a["draws"] - v).alias("draws"), F.concat(a["xs"], F.array(v)).alias("xs")))

        zero = F.struct(F.col("n").alias("pop"), F.ceil(F.col("n") / 2).cast("long").alias("draws"), F.array().cast("array<bigint>").alias("xs"))
        drawn = drawn.withColumn("left", F.aggregate("of", zero, step)["xs"])
        side = lambda right: F.zip_with("of", "left", lambda e, x: F.struct(e["number"].alias("number"), e["s"].alias("s"), ((e["q"] - x) if right else x).alias("q")))
        nodes = drawn.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), side(False).alias("of")), F.struct((F.col("node") * 2 + 1).alias("node"), side(True).alias("of")))).alias("x")).select("x.*")
    leaves = nodes.select("node", F.explode("of").alias("e")).groupBy("e.number", "e.s").agg(F.array_sort(F.collect_list(F.struct("node", "e.q"))).alias("l"))
    return leaves.select("s", F.transform("l", lambda e: e["q"]).alias("leaves"))


def _placed(blocks: DataFrame, seed: str) -> DataFrame:
    """blocks (s, block, words, n_blocks) with place (from 0) and before (words) in the permuted order of the source's blocks.
    A bucket holds the blocks of a range of the order's hash; of buckets only sums meet."""
    order = F.md5(_sealed(f"block-{seed}", F.col("s"), F.col("block")))
    buckets = F.ceil(F.col("n_blocks") / BUCKET_BLOCKS)
    rows = blocks.withColumn("o", order).withColumn("bucket", F.floor(_number(F.col("o")) * buckets / 2.0**32).cast("long"))
    sums = rows.groupBy("s", "bucket").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    earlier = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("s").alias("__s"), F.col("bucket").alias("__b"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("s", "bucket").orderBy("o", "block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("w1", F.coalesce(F.sum("words").over(inside), F.lit(0))).withColumn("n1", F.count("*").over(inside))
    met = rows.join(starts, F.col("s").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
    return met.select("s", "block", "n_blocks", (F.col("n0") + F.col("n1")).alias("place"), (F.col("w0") + F.col("w1")).alias("before"))


def mix_plan(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "42") -> DataFrame:
    """docs with size, source_size, target and copies: array of (pass, shard, block_order, row_order), one for each time
    that the mix takes the row, at most CAP.

    Null texts have no words. Null sources are the last source. Rows of no words are taken along with their block. Rows
    equal in key, source and text are rows like others and may fall on different sides of a cut. Added columns replace
    those of the same name. An empty table gives no rows.
    """
    names, made = ("size", "source_size", "target", "copies"), Scratch()
    docs = docs.drop(*[c for c in docs.columns if c in names])
    spark = docs.sparkSession
    sized = docs.withColumn("size", word_count(F.col(text)))
    digest = F.coalesce(F.md5(F.col(text)), F.lit(""))
    # What decides, without the texts: o is a row's place in the order of its source.
    order = F.md5(_sealed(f"row-{seed}", F.col(source), F.col(key), digest))
    short = made(sized.select(F.col(source).alias("s"), "size", order.alias("o")), "mix-sizes")
    targets = made(source_targets(short, made), "mix-targets")
    side = small_side(targets.withColumnRenamed("s", "__s"))
    rows = short.join(side, F.col("s").eqNullSafe(F.col("__s"))).drop("__s", "weight", "number")
    rows = rows.withColumn("n_blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("long")).withColumn("block", F.pmod(_number(F.col("o")), F.col("n_blocks")))
    # Rows equal in all that decides are one row with a number.
    alike = made(rows.groupBy("s", "size", "o", "block", "n_blocks", "source_size", "target").agg(F.count("*").alias("m")), "mix-rows")
    words = alike.groupBy("s", "block", "n_blocks").agg(F.sum(F.col("size") * F.col("m")).alias("words"))
    placed = made(_placed(words, seed), "mix-blocks")

    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rest = F.when(F.col("source_size") > 0, F.col("target") - passes * F.col("source_size")).otherwise(0.0)
    known = targets.select(F.col("s").alias("__s"), "number", passes.alias("whole"), rest.alias("rest"))
    met = placed.join(small_side(known), F.col("s").eqNullSafe(F.col("__s"))).drop("__s")
    begun = (F.col("rest") > 0) & (F.col("before") < F.col("rest"))
    # The exact quota of each source, and what the leaves of the tree draw of it.
    quotas = met.groupBy("s", "number").agg((F.sum("whole") + F.count_if(begun)).alias("q"))
    leaves = made(split_quotas(quotas, SHARD_LEVELS, seed), "mix-leaves")
    upto = F.transform("leaves", lambda x, i: F.aggregate(F.slice("leaves", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y))
    drawn = small_side(leaves.select(F.col("s").alias("__s"), upto.alias("upto")))
    met = met.join(drawn, F.col("s").eqNullSafe(F.col("__s"))).drop("__s")
    # A leaf draws the next of a source's (pass, block): number (pass - 1) * blocks + place.
    taken = F.filter(F.transform(F.sequence(F.lit(1), F.col("whole") + 1), lambda i: F.struct(i.cast("int").alias("pass"), ((i - 1) * F.col("of_source") + F.col("place")).alias("at"))), lambda x: x["at"] < F.element_at("upto", -1))
    shards = F.transform(taken, lambda x: F.struct(x["pass"].alias("pass"), F.size(F.filter("upto", lambda c: c <= x["at"])).alias("shard")))
    filled = met.groupBy("s").agg(F.count("*").alias("of_source"))  # blocks that hold a row
    met = met.join(small_side(filled.withColumnRenamed("s", "__s")), F.col("s").eqNullSafe(F.col("__s"))).drop("__s")
    known = made(met.select(F.col("s").alias("__s"), F.col("block").alias("__b"), "before", "rest", "whole", shards.alias("shards")), "mix-known")

    alike = alike.join(small_side(known), F.col("s").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b"))).drop("__s", "__b")
    inside = Window.partitionBy("s", "block").orderBy("o", "size").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("ahead", F.coalesce(F.sum(F.col("size") * F.col("m")).over(inside), F.lit(0)))
    # A block that the tree draws once more than there are whole passes, is of the last pass: rows up to the last that fits;
    # then, of the block that the cut is in, the row that fills best what is left.
    more = F.size("shards") > F.col("whole")
    start, copies = F.col("before") + F.col("ahead"), F.col("m")
    fit = F.when(F.col("size") > 0, F.least(F.floor((F.col("rest") - start) / F.col("size")), copies)).otherwise(copies)
    alike = alike.withColumn("part", F.when(more & (start < F.col("rest")), fit).otherwise(0).cast("long"))
    of_block = Window.partitionBy("s", "block")
    alike = alike.withColumn("left", F.when(more & (start < F.col("rest")) & (F.col("part") < F.col("m")), F.col("rest") - start - F.col("part") * F.col("size"))).withColumn("left", F.max("left").over(of_block))
    fills = F.coalesce((F.col("part") < F.col("m")) & (F.col("size") <= F.col("left")) & (F.col("size") > 0), F.lit(False))
    best = F.row_number().over(of_block.orderBy(F.desc("fills"), F.desc("size"), "o"))
    alike = alike.withColumn("fills", fills).withColumn("part", F.col("part") + F.when(F.col("fills") & (best == 1), 1).otherwise(0))
    verdict = alike.select(F.col("o").alias("__o"), F.col("m").alias("__m"), "source_size", "target", *[F.col(c).alias(f"__{c}") for c in ("part", "shards", "whole", "block")])
    verdict = materialize(verdict, "mix-verdicts")
    made.clear()

    # Texts are shuffled once. Rows equal in all that decides are numbered where they meet; the first part of them are taken
    # once more than the rest.
    wide = sized.withColumn("__o", order)
    heavy = verdict.where(F.col("__m") > HEAVY_ROWS).select("__o")  # at most one in HEAVY_ROWS rows
    count = F.row_number().over(Window.partitionBy("__o").orderBy(F.lit(1)))
    if not verdict.where(F.col("__m") > HEAVY_ROWS).isEmpty():
        many = materialize(wide.join(F.broadcast(heavy), "__o", "left_semi").withColumn("__task", F.spark_partition_id()), "mix-heavy")
        earlier = Window.partitionBy("__o").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
        starts = many.groupBy("__o", "__task").agg(F.count("*").alias("n")).select("__o", "__task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__start"))
        many = many.join(F.broadcast(starts), ["__o", "__task"]).withColumn("__nth", F.col("__start") + F.row_number().over(Window.partitionBy("__o", "__task").orderBy(F.lit(1)))).drop("__start", "__task")
        met = wide.join(F.broadcast(heavy), "__o", "left_anti").join(verdict, "__o").withColumn("__nth", count).unionByName(many.join(F.broadcast(verdict.where(F.col("__m") > HEAVY_ROWS)), "__o"))
    else:
        met = wide.join(verdict, "__o").withColumn("__nth", count)
    times = F.col("__whole") + F.when(F.col("__nth") <= F.col("__part"), 1).otherwise(0)
    copies = F.transform(F.slice("__shards", F.lit(1), times), lambda x: F.struct(x["pass"].alias("pass"), x["shard"].alias("shard"), F.md5(_sealed(f"order-{seed}", x["pass"], F.col(source), F.col("__block"))).alias("block_order"), F.md5(_sealed(f"row-{seed}", x["pass"], F.col("__o"), F.col("__nth"))).alias("row_order")))
    return met.select(*docs.columns, "size", "source_size", "target", copies.alias("copies"))


def taken_rows(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "42") -> DataFrame:
    """(row: all columns of docs, copy: pass, shard, block_order, row_order) for each time that the mix takes a row."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("k"), F.col(source).alias("s"), F.col(text).alias("t"))
    plan = mix_plan(rows, text="t", key="k", source="s", seed=seed)
    return plan.select("row", F.explode("copies").alias("copy"))


def mix(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "42") -> DataFrame:
    """The mix: each row of docs as often as mix_plan takes it, with shard, block_order and row_order, shuffled inside
    its shard when sorted by the latter two. Added columns replace those of the same name."""
    added = ("shard", "block_order", "row_order")
    taken = taken_rows(docs, text=text, key=key, source=source, seed=seed)
    return taken.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *[F.col(f"copy.{c}") for c in added])
