"""Line dedup over a deletion neighbourhood, in DataFrame operations only.

A line is what stands between two newlines, without blanks, tabs and carriage returns at its ends. A line goes if an
equal line, or one at edit distance 1 where both have ``min_chars`` characters or more, stands earlier in the order
(doc_id, hash of the text, line number). Shorter lines go for an equal line only: at one letter in a few, an edit makes
another line of it. Lines of which nothing is left are never touched, nor are those of fewer than ``exact_chars``
characters. Nothing else about a document changes. A document is an id with a text: different texts under one id, or
without an id, are different documents.

How the neighbourhood stays affordable: a single edit lies in one of ``BLOCKS`` stretches of the line, so two lines
within the bound agree on all that is outside of that stretch. Every distinct line therefore first emits the neighbourhood
that deletes a whole stretch (8 hashed keys); only where two different lines share such a key, the stretch itself
emits all its one-character deletions as hashed keys. Equal variants meet in a grouping, so no pairs inside a group
are made: lines that share a variant at the same position are all within one substitution of each other and the
earliest stands for them; a variant that equals a line is an insertion or deletion away from that line. Each
(line, earliest partner) is then verified with the real edit distance, in time proportional to the length.

A variant of a long stretch isn't hashed as a whole: the stretch is cut into pieces of about the square root of its length,
and the variant is the hash of what stands before the piece, of the piece without the character, and of what stands after
it. A whole line compared with such variants emits one key for each piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, small_side

BLOCKS = 4
#: Lines of which there are more are joined by broadcast; of all lines they can be this part at least, so they are few.
HOT_ROWS, HOT_PARTS = 1_000, 2_000
PIECE = 32
_TRIM = " \t\r"
_VARIANT = "struct<p:int,b:int,v:bigint,whole:boolean>"


def _norm(line: Column) -> Column:
    return F.btrim(line, F.lit(_TRIM))


def _lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    named = docs.select(F.col(key).alias("d"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))  # hashed once a text, not once a line
    return named.select("d", "th", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "raw")).select("d", "th", "no", _norm(F.col("raw")).alias("line"))


def _stretch_keys(line: Column, n: Column) -> list[Column]:
    """Keys of the line without each stretch, for the shorter length n (role 0) and n - 1 (role 1)."""
    out = []
    for role in (0, 1):
        t = n - role
        for q in range(BLOCKS):
            a, b = F.floor(t * q / BLOCKS).cast("int"), F.floor(t * (q + 1) / BLOCKS).cast("int")
            out.append(F.xxhash64(F.substring(line, F.lit(1), a), F.substring(line, (n - (t - b) + 1).cast("int"), (t - b).cast("int")), t, F.lit(q)))
    return out


def _variants(mid: Column, m: Column, role: Column) -> Column:
    """Array of the variants of a stretch mid of m characters: p (position, 0 where it doesn't count), b (piece), v (hash),
    whole. Role 0, the shorter of two lines or one of equal length: its deletions by position, and itself whole.
    Role 1, the longer: its deletions."""
    size = F.greatest(F.lit(PIECE), F.ceil(F.sqrt(F.greatest(m - role, F.lit(0))))).cast("int")
    last = F.floor(F.greatest(m - role - 1, F.lit(0)) / size).cast("int")
    # The longer line's last piece takes its extra character along.
    width = lambda b: F.when(b == last, m - b * size).otherwise(size + role).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), last),
        lambda b: F.struct(
            b.alias("b"),
            (b * size).alias("at"),
            F.xxhash64(F.substring(mid, F.lit(1), b * size)).alias("head"),
            F.substring(mid, b * size + 1, width(b)).alias("own"),
            width(b).alias("n"),
            F.xxhash64(F.substring(mid, b * size + width(b) + 1, m)).alias("tail"),
        ),
    )

    def one(x: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), x["n"]), lambda i: F.struct(F.when(role == 0, x["at"] + i).otherwise(0).cast("int").alias("p"), x["b"].alias("b"), F.xxhash64(x["head"], F.concat(F.substring(x["own"], F.lit(1), i - 1), F.substring(x["own"], i + 1, x["n"])), x["tail"]).alias("v"), F.lit(False).alias("whole")))
        whole = F.array(F.struct(F.lit(0).alias("p"), x["b"].alias("b"), F.xxhash64(x["head"], x["own"], x["tail"]).alias("v"), F.lit(True).alias("whole")))
        none = F.array().cast(f"array<{_VARIANT}>")
        return F.concat(F.when(x["n"] < 1, none).otherwise(cut), F.when(role == 0, whole).otherwise(none))

    return F.flatten(F.transform(pieces, one))


def _within_one(a: Column, b: Column) -> tuple[Column, Column]:
    """The length of the common start of two texts (of __na and __nb characters), and, with that as __same, whether their edit
    distance is 1 at most, in time proportional to their length (but for a logarithm): what
    follows the first difference must agree, on one side or on both without a character."""
    widths = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])

    def grown(upto: Column, w: Column) -> Column:
        fits = (w <= F.least(F.col("__na"), F.col("__nb")) - upto) & (F.substring(a, upto + 1, w) == F.substring(b, upto + 1, w))
        return F.when(fits, upto + w).otherwise(upto)

    rest = lambda x, skip: F.substring(x, F.col("__same") + 1 + skip, F.lit(2**31 - 1))
    same = F.aggregate(widths, F.lit(0), grown)
    verdict = F.when(F.col("__na") == F.col("__nb"), rest(a, 1) == rest(b, 1)).when(F.col("__na") > F.col("__nb"), rest(a, 1) == rest(b, 0)).otherwise(rest(a, 0) == rest(b, 1))
    return same, F.when(F.abs(F.col("__na") - F.col("__nb")) <= 1, verdict).otherwise(False)


def line_verdicts(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_chars: int = 16, exact_chars: int = 1) -> DataFrame:
    """One row (d, th: hash of the text, gone: array of line numbers to drop) for each document that loses lines."""
    docs, made = docs.select(key, text), Scratch()
    base = _lines(docs, text, key).withColumn("n", F.length("line")).where(F.col("n") >= max(1, min(exact_chars, min_chars)))
    slots = [F.when(F.col("n") >= min_chars, k).alias(f"k{i}") for i, k in enumerate(_stretch_keys(F.col("line"), F.col("n")))]
    lines = made(base.select("d", "th", "no", F.xxhash64("line").alias("h"), F.hash("line").alias("g"), "n", *slots), "lines")

    # One row for each distinct line: what follows never meets the copies of a frequent one.
    first = lines.groupBy("h", "g").agg(F.min(F.struct("d", "th", "no")).alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(2 * BLOCKS)])
    first = made(first, "distinct-lines")
    keyed = first.where(F.col("n") >= min_chars).select("h", "g", "first", F.posexplode(F.array(*[f"k{i}" for i in range(2 * BLOCKS)])).alias("slot", "key"))
    shared = made(keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key"), "shared-keys")
    candidates = made(keyed.join(small_side(shared), "key", "left_semi").select("h", "g", "slot", "key", F.col("first.d").alias("d"), F.col("first.th").alias("th"), F.col("first.no").alias("no")), "stretch-candidates")

    # The texts of candidate lines, once for each distinct line.
    where = candidates.groupBy("h", "g").agg(F.first("d").alias("d"), F.first("th").alias("th"), F.first("no").alias("no"))
    lookup = small_side(made(where, "candidate-lines"))
    split = docs.select(F.col(key).alias("d"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    texts = made(
        split.join(lookup, split["d"].eqNullSafe(lookup["d"]) & (split["th"] == lookup["th"])).select("h", "g", split["d"], split["th"], "no", _norm(F.element_at(F.split("t", "\n"), F.col("no") + 1)).alias("line")).where((F.xxhash64("line") == F.col("h")) & (F.hash("line") == F.col("g"))).dropDuplicates(["h", "g"]),
        "candidate-texts",
    )

    # All one-character deletions of the stretch, as hashed keys.
    ranked = candidates.select("h", "g", "slot", "key").join(texts, ["h", "g"]).withColumn("n", F.length("line"))
    role, q = F.floor(F.col("slot") / BLOCKS).cast("int"), F.col("slot") % BLOCKS
    t = F.col("n") - role
    a, b = F.floor(t * q / BLOCKS).cast("int"), (F.floor(t * (q + 1) / BLOCKS) + role).cast("int")
    mids = ranked.select("key", "h", "g", F.struct("d", "th", "no").alias("at"), role.alias("role"), F.substring("line", a + 1, b - a).alias("mid"), (b - a).alias("m"))
    variants = mids.select("key", "h", "g", "at", F.explode(_variants(F.col("mid"), F.col("m"), F.col("role"))).alias("x")).select("key", "h", "g", "at", "x.p", "x.b", "x.v", "x.whole").distinct()
    me = F.struct("at", "h", "g")
    met = variants.groupBy("key", "p", "b", "v").agg(F.min(me).alias("lo"), F.min("h").alias("low"), F.max("h").alias("high"), F.min(F.when(F.col("whole"), me)).alias("line"), F.min(F.when(~F.col("whole"), me)).alias("cut")).where("low <> high")
    # p > 0: one substitution from each other. p = 0: a deletion from the whole line, of which a key has one.
    partner = F.when(F.col("p") > 0, F.col("lo")).when(F.col("whole"), F.col("cut")).otherwise(F.col("line"))
    pairs = variants.join(met, ["key", "p", "b", "v"]).select("h", "g", "at", partner.alias("by")).where((F.col("by.at") < F.col("at"))).select("h", "g", F.col("by.h").alias("bh"), F.col("by.g").alias("bg")).distinct()
    other = texts.select(F.col("h").alias("bh"), F.col("g").alias("bg"), F.col("line").alias("earlier"))
    both = pairs.join(texts.select("h", "g", "line"), ["h", "g"]).join(other, ["bh", "bg"])
    same, within = _within_one(F.col("line"), F.col("earlier"))
    verified = both.withColumn("__na", F.length("line")).withColumn("__nb", F.length("earlier")).withColumn("__same", same).where(within)
    near = made(verified.select("h", "g").distinct(), "near-lines").withColumn("near", F.lit(True))

    # Lines that stand once and are near to none stay; of the others, the frequent ones are few.
    decided = made(first.join(small_side(near), ["h", "g"], "left").where("copies > 1 OR near").select("h", "g", "first", "near", "copies"), "decided-lines")
    most = F.greatest(F.lit(HOT_ROWS), F.floor(F.sum("copies") / HOT_PARTS))
    bound = first.agg(most).first()[0] or HOT_ROWS
    hot = F.broadcast(decided.where(F.col("copies") > bound))
    short = lines.select("d", "th", "no", "h", "g")
    judged = short.join(hot, ["h", "g"]).unionByName(short.join(hot, ["h", "g"], "left_anti").join(decided.where(F.col("copies") <= bound), ["h", "g"]))
    gone = judged.where(F.col("near").isNotNull() | ~F.struct("d", "th", "no").eqNullSafe(F.col("first"))).groupBy("d", "th").agg(F.collect_set("no").alias("gone"))
    gone = materialize(gone, "gone-lines")
    made.clear()
    return gone


def dedup_lines(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_chars: int = 16, exact_chars: int = 1) -> DataFrame:
    """docs with each text freed of lines that occur earlier; adds n_lines and n_removed.

    Null text stays null with no lines; an empty text has one empty line and stays. Rows that share key and text are
    copies of one document and are judged alike; rows that share a key alone are documents of their own. Null keys
    count as the smallest key. A document all of whose lines go has an empty text; dropping it is the caller's choice.
    Columns of docs keep their names; the two added replace columns of the same name.
    """
    extra = [c for c in docs.columns if c in ("n_lines", "n_removed")]
    docs = docs.drop(*extra)
    gone = line_verdicts(docs, text=text, key=key, min_chars=min_chars, exact_chars=exact_chars).withColumnsRenamed({"d": "__d", "th": "__th", "gone": "__gone"})
    rows = gone.agg(F.count("*"), F.sum(F.size("__gone"))).first()
    side = F.broadcast(gone) if (rows[0] or 0) + (rows[1] or 0) <= 4_000_000 else gone
    parts = F.split(F.col(text), "\n")
    keep = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    left = F.array_join(F.transform(keep, lambda i: F.element_at(F.col("__parts"), i + 1)), "\n")
    out = docs.join(side, docs[key].eqNullSafe(F.col("__d")) & (F.xxhash64(docs[text]) == F.col("__th")), "left").withColumn("__parts", parts)
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size("__parts")).cast("long")).withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", F.when(F.col(text).isNull() | (F.col("n_removed") < 0), 0).otherwise(F.col("n_removed")).cast("long"))
    return out.withColumn(text, F.when(F.col("n_removed") > 0, left).otherwise(F.col(text))).select(*docs.columns, "n_lines", "n_removed")
