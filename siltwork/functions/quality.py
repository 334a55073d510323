"""Rule-based scores of lists of limitations, text to number. Phrase and pattern counts stay in the JVM; only the
sequence-matcher ratios need Arrow. Null text counts as empty. Patterns use ASCII classes."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Phrases, patterns and weights of the scores.
HEDGING = (
    "may not", "might not", "could potentially", "perhaps", "one might possibly", "potentially limiting", "might be",
    "could be", "may be", "it is possible", "in rare cases", "further evaluation is needed", "further studies are needed",
    "remains to be seen", "more research is needed", "future work should", "while the authors do an excellent job",
    "this is a minor point", "though a tiny gap remains", "brilliantly address", "the authors do a great job",
    "might want to consider", "one small observation", "could be beneficial to perhaps",
    "the authors may want to consider", "one potential limitation is that", "it could be beneficial",
    "the authors might want to", "could benefit from", "may want to consider providing",
    "might want to consider discussing", "it would be interesting", "it would be beneficial", "it would be helpful",
    "one might wonder",
)
SPECIFIC = (
    r"\d+", r"[A-Z][a-z]+Net\b", r"NAS\b", "CIFAR|ImageNet|MNIST", "equation|theorem|proof",
    r"Table \d|Figure \d|Section \d", r"page[s]?\s*\d", "NeurIPS|ICML|ICLR|CVPR", r"Appendix\s+[A-Z]", r"Algorithm\s+\d",
)
CRUTCH = (
    "unclear", "may not be", "may not generalize", "does not provide", "does not discuss", "does not mention",
    "it is unclear", "which may not be", "which can significantly impact", "making it difficult", "is not thoroughly",
    "is not explored", "might not be representative", "might not generalize",
)
CATASTROPHE = (
    "irreparable deficiencies", "no possibility of revision", "strongly rejected", "must be strongly rejected", "fatal",
    "entirely unsuitable", "fundamentally flawed", "fundamentally broken", "renders it entirely", "severe, irreparable",
    "lowest possible quality", "unscientific", "completely fails", "entirely lacks", "no merit", "no value",
    "wholly inadequate", "deeply problematic", "critically undermines", "fundamentally undermines", "fatal flaw",
    "insurmountable",
)
VERDICT = (
    "irreparable deficiencies", "no possibility of revision", "strongly rejected", "must be strongly rejected",
    "entirely unsuitable", "lowest possible quality",
)
CATEGORIES = (
    "novelty", "methodology", "experiments", "generalization", "robustness", "efficiency", "clarity", "reproducibility",
    "data quality", "ethical",
)
OVERRIDE = (
    "exceptional merit", "strong accept", "no reservations whatsoever", "deserves strong accept", "strongly rejected",
    "irreparable deficiencies", "no possibility of revision", "must be strongly rejected",
    "entirely unsuitable for publication", "fundamentally flawed, unscientific", "of the lowest possible quality",
)
PRAISE = (
    "strength", "excellent", "significant strength", "deliberate choice", "enhances", "efficiently conveys", "great job",
    "brilliant", "impressive", "brilliantly address", "do an excellent job",
)
CRITICISM = (
    "limitation", "lack", "missing", "insufficient", "flaw", "weakness", "unclear", "problematic", "fails", "limited",
    "does not", "inadequate",
)
ABSENCE = (
    "does not provide", "does not discuss", "does not mention", "does not include", "is not clearly", "is unclear",
    "does not present", "does not offer", "does not address", "is not explored", "is not thoroughly",
    "does not compare", "only provides", "only reports", "only evaluates",
)
STARTER_TOPIC = (
    "(novelty|methodology|experiments?|generalization|robustness|efficiency|clarity|reproducibility|data quality|ethical)"
)
BOLD_CATEGORY = r"\*\*[A-Z\[][a-zA-Z\s/\]]+\*\*"
EVIDENCE = r"\(Evidence:([^)]+)\)"

#: A word boundary by Unicode letters and digits, whatever the Java release takes \b for.
BOUNDARY = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def capped(c: Column) -> Column:
    return F.least(c, F.lit(1.0))


def present(c: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases the lower-case text holds, each counted once."""
    low = F.lower(_text(c))
    return reduce(add, [F.contains(low, F.lit(p)).cast("int") for p in phrases])


def occurrences(c: Column, phrases: tuple[str, ...]) -> Column:
    """How often the lower-case text holds the phrases."""
    low = F.lower(_text(c))
    return reduce(add, [((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p)).cast("int") for p in phrases])


def bounded(pattern: str) -> str:
    """The pattern with its word boundaries by Unicode letters and digits. Before a plain letter the look back is made only
    where that letter stands, and after one a single look ahead is enough."""
    inside = r"[\p{L}\p{N}_]"
    pattern = re.sub(r"\\b([A-Za-z])", lambda m: f"{m[1]}(?<!{inside}.)", pattern)
    pattern = re.sub(r"(?<!\\)([A-Za-z])\\b", lambda m: f"{m[1]}(?!{inside})", pattern)
    return pattern.replace(r"\b", BOUNDARY)


def matches(c: Column, *patterns: str) -> Column:
    return reduce(add, [F.regexp_count(_text(c), F.lit(bounded(p))) for p in patterns])


def pieces(c: Column, pattern: str, over: int) -> Column:
    """The stripped parts between matches that are longer than so many characters."""
    return F.filter(F.transform(F.split(_text(c), pattern), _stripped), lambda x: F.length(x) > over)


def most_frequent(values: Column) -> Column:
    """How often the most frequent value occurs in an array: sorted once, then runs are counted in one fold."""
    start = F.struct(F.lit(None).cast("string").alias("v"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s, v):
        run = F.when(s["v"] == v, s["run"] + 1).otherwise(1)
        return F.struct(v.alias("v"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(values), start, step, lambda s: s["best"])


def n_points(c: Column) -> Column:
    """Items of a list, or bold headers and items where one of both is scarce; 1 at least."""
    headers = matches(c, r"\*\*[A-Z\[]")
    items = matches(c, r"(?md)^\d+\.", r"(?md)^-\s", r"(?md)^\*\s")
    return F.greatest(F.when((items >= 3) & (headers >= 3), items).otherwise(headers + items), F.lit(1))


def hedging(c: Column) -> Column:
    return capped(present(c, HEDGING) / n_points(c))


def specificity(c: Column) -> Column:
    return capped(matches(c, *["(?i)" + p for p in SPECIFIC]) / F.greatest(F.length(_text(c)) / 500, F.lit(1.0)))


def formulaic(c: Column) -> Column:
    """Repeated openings of points, crutch phrases and repeated openings of evidence; 0 below three points."""
    points = pieces(c, r"\n\s*\n|\n\*\*\[|\n\*\*[A-Z]|\n\d+\.|\n-\s|\n\*\s", 20)
    opening = lambda x, n: F.lower(F.array_join(F.slice(F.split(x, r"\s+"), 1, n), " "))
    openings = F.transform(points, lambda p: F.regexp_replace(opening(p, 8), STARTER_TOPIC, "CATEGORY"))
    blocks = F.transform(F.regexp_extract_all(_text(c), F.lit(EVIDENCE), F.lit(1)), lambda e: opening(_stripped(e), 6))
    n, m = F.size(points), F.size(blocks)
    evidence = F.when(m >= 3, most_frequent(blocks) / m).otherwise(0.0)
    score = 0.35 * most_frequent(openings) / n + 0.35 * capped(occurrences(c, CRUTCH) / n / 3.0) + 0.30 * evidence
    return F.when(n < 3, 0.0).otherwise(capped(score))


def catastrophizing(c: Column) -> Column:
    return capped(present(c, CATASTROPHE) * 0.15 + present(c, VERDICT) * 0.3)


def checklist(c: Column) -> Column:
    n = present(c, CATEGORIES)
    return F.when(n >= 9, 1.0).when(n >= 8, 0.7).when(n >= 7, 0.3).otherwise(0.0)


def overriding(c: Column) -> Column:
    return capped(present(c, OVERRIDE) / 2.0)


def praise_share(c: Column) -> Column:
    p, q = present(c, PRAISE), present(c, CRITICISM)
    return F.when(p + q > 0, p / (p + q)).otherwise(0.0)


def absence_share(c: Column) -> Column:
    """The share of evidence blocks that only say what is absent; 0 below three blocks."""
    blocks = F.regexp_extract_all(_text(c), F.lit(EVIDENCE), F.lit(1))
    n = F.size(blocks)
    return F.when(n >= 3, F.size(F.filter(blocks, lambda e: present(e, ABSENCE) > 0)) / n).otherwise(0.0)


def unclear_share(c: Column) -> Column:
    return capped(matches(c, r"(?i)\bunclear\b") / n_points(c))


def two_bullet_share(c: Column) -> Column:
    """Of the categories with bullets, the share with exactly two; 0 below three parts."""
    parts = pieces(c, BOLD_CATEGORY, 20)
    counts = F.filter(F.transform(parts, lambda p: F.regexp_count(p, F.lit(r"\n\*\s|\n-\s"))), lambda n: n > 0)
    some = (F.size(parts) >= 3) & (F.size(counts) > 0)
    return F.when(some, F.size(F.filter(counts, lambda n: n == 2)) / F.size(counts)).otherwise(0.0)


def inflation(c: Column, reference: Column) -> Column:
    """How much longer than the reference, where it isn't more specific."""
    ratio = F.length(_text(c)) / F.greatest(F.length(_text(reference)), F.lit(1))
    here, there = specificity(c), specificity(reference)
    long = F.when((ratio > 4.0) & (here <= there), capped((ratio - 4.0) / 6.0))
    return long.when((ratio > 3.0) & (here < 0.1), capped((ratio - 3.0) / 7.0)).otherwise(0.0)


def _mean_ratio(points) -> tuple[float, int]:
    heads = [p[:200].lower() for p in points]
    ratios = [SequenceMatcher(None, a, b).ratio() for i, a in enumerate(heads) for b in heads[i + 1:]]
    return sum(ratios), len(ratios)


@F.pandas_udf(DoubleType())
def _ratio_in_groups(groups: pd.Series) -> pd.Series:
    def one(gs):
        parts = [_mean_ratio(g) for g in gs]
        n = sum(k for _, k in parts)
        return sum(s for s, _ in parts) / n if n else 0.0

    return groups.map(one)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The sequence-matcher ratio of two texts; null counts as empty."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def redundancy(c: Column) -> Column:
    """The mean ratio of all pairs of points of a text, each by its first 200 characters."""
    return _ratio_in_groups(F.array(pieces(c, r"\n\s*\n|\n\*\*\[|\n\*\*[A-Z]|\n\d+\.", 30)))


def structural_repetition(c: Column) -> Column:
    """The mean ratio of pairs of points within a bold category; 0 below two categories."""
    parts = pieces(c, BOLD_CATEGORY, 30)
    return F.when(F.size(parts) >= 2, _ratio_in_groups(F.transform(parts, lambda p: pieces(p, r"\n\*\s|\n-\s|\n\d+\.", 20)))).otherwise(0.0)


#: Scores that need no reference; every one is a JVM expression.
SCORES = {
    "hedging_ratio": hedging,
    "specificity": specificity,
    "formulaic": formulaic,
    "catastrophization": catastrophizing,
    "checklist_coverage": checklist,
    "override_compliance": overriding,
    "praise_ratio": praise_share,
    "absence_evidence": absence_share,
    "unclear_ratio": unclear_share,
    "two_bullet_per_cat": two_bullet_share,
}
FLAWS = (
    "hedging_ratio", "formulaic", "redundancy", "structural_repetition", "unclear_ratio", "absence_evidence",
    "checklist_coverage", "two_bullet_per_cat", "length_inflation",
)
