"""Text as Column -> Column functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as missing in a text cell.
NULL_TOKENS = ("", "nan", "none", "null", "<na>", "no citations found")


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*NULL_TOKENS)


def first_present(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """One line, without "Name et al." and digits."""
    c = F.regexp_replace(c, r"\n", " ")
    c = F.regexp_replace(c, r"(?i)\S+\s+et\s+al\.?", "")
    return collapse_space(F.regexp_replace(c, r"[0-9]+", ""))


def strip_think(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?is)<think>.*?</think>", " "))


def sentences(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda x: x != "")


def evidence_tagged(c: Column) -> Column:
    return F.array_join(F.transform(sentences(c), lambda s, i: F.concat(F.lit("[E"), (i + 1).cast("string"), F.lit("] "), s)), "\n")


def tokens(c: Column, least: int = 1) -> Column:
    """Distinct lower-case runs of a-z and 0-9 of at least so many characters."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: F.length(w) >= least))


def spaced_words(c: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[ \t-\r]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def head_tail(c: Column, most: int, share: float = 0.7, marker: str = "\n...\n") -> Column:
    head = int(most * share)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(marker), F.right(c, F.lit(most - head))))


def safe_filename(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), 1, 120)


def line_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""))


def word_chunks(c: Column, n: int) -> Column:
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words), F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def harmonic(a: Column, b: Column) -> Column:
    return safe_divide(2 * a * b, a + b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ensured(rows, defaults: dict[str, Column]):
    """rows with each column that they lack, by its default."""
    return rows.withColumns({name: c for name, c in defaults.items() if name not in rows.columns})


def let(value: Column, f) -> Column:
    """f of a value that is computed once a row, wherever f uses it: an expression inside a lambda would be computed for
    each element."""
    return F.element_at(F.transform(F.array(value), f), 1)
