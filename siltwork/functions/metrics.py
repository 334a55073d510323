"""Overlap, alignment and divergence of texts and distributions. Longest common subsequences and METEOR alignments
have no JVM form and go through Arrow; the rest are expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from siltwork.functions import text as T
from siltwork.functions.stem import stem

# Words that don't count in filtered overlaps.
STOP_WORDS = (
    "the", "and", "for", "that", "with", "this", "from", "paper", "study", "method", "model", "results", "limitation",
    "limitations",
)


def content_words(c: Column) -> Column:
    """Distinct lower-case words of a-z and 0-9 of three characters or more, without the stop words."""
    return F.filter(T.tokens(c, 3), lambda w: ~w.isin(*STOP_WORDS))


def content_overlap(a: Column, b: Column) -> Column:
    return T.jaccard(content_words(a), content_words(b))


def query_overlap(query: Column, doc: Column) -> Column:
    """Distinct query words that the document has, over the root of their number; 0 without any."""
    q = T.tokens(query)
    q = F.filter(q, lambda w: w != "")
    return T.safe_divide(F.size(F.array_intersect(q, T.tokens(doc))), F.sqrt(F.size(q)))


def quote_contained(quote: Column, source: Column, least: int = 18, most: int = 180) -> Column:
    """Whether the source holds the first characters of a quote, both in lower case and with single spaces."""
    q = F.lower(T.collapse_space(quote))
    return F.coalesce((F.length(q) >= least) & F.contains(F.lower(T.collapse_space(source)), F.substring(q, 1, most)), F.lit(False))


def divergence_bits(p: Column, q: Column) -> Column:
    """The Jensen-Shannon divergence, in bits, of two arrays of weights of one length; each is brought to sum 1."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    pq = F.zip_with(p, q, lambda x, y: F.struct((x / total(p)).alias("p"), (y / total(q)).alias("q")))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.transform(pq, lambda z: (part(z["p"], (z["p"] + z["q"]) / 2) + part(z["q"], (z["p"] + z["q"]) / 2)) / 2)
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def _words(text: str | None) -> list[str]:
    return re.findall("[a-z0-9]+", (text or "").lower())


def common_subsequence(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, with a bit for each word of a: len(b) steps on one integer."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def stemmed_words(text: str | None) -> list[str]:
    """Words of a-z and 0-9; those of four characters or more by their stems."""
    return [stem(w) if len(w) > 3 else w for w in _words(text)]


def _rouge(words):
    @F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("precision", "recall", "f1")]))
    def scores(predicted: pd.Series, reference: pd.Series) -> pd.DataFrame:
        rows = []
        for p, r in zip(predicted, reference):
            p, r = words(p), words(r)
            n = common_subsequence(p, r) if p and r else 0
            rows.append((n / len(p), n / len(r), 2 * n / (len(p) + len(r))) if n else (0.0, 0.0, 0.0))
        return pd.DataFrame(rows, columns=["precision", "recall", "f1"], dtype="float64")

    return scores


def _meteor(stemmed: bool):
    @F.pandas_udf(DoubleType())
    def scores(predicted: pd.Series, reference: pd.Series) -> pd.Series:
        return pd.Series([meteor_score(_words(p), _words(r), stemmed=stemmed) for p, r in zip(predicted, reference)], dtype="float64")

    return scores


def meteor_score(hyp: list[str], ref: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5, stemmed: bool = False) -> float:
    """METEOR: each word from the end of hyp meets the last free equal word of ref; then, if stemmed, those left over meet
    by their stems in the same way."""
    met, left, free = [], list(enumerate(hyp)), list(enumerate(ref))
    for form in (str, stem) if stemmed else (str,):
        where: dict[str, list[int]] = {}
        for j, w in free:
            where.setdefault(form(w), []).append(j)
        found = [(i, where[form(w)].pop()) for i, w in reversed(left) if where.get(form(w))]
        met += found
        own, other = {i for i, _ in found}, {j for _, j in found}
        left, free = [x for x in left if x[0] not in own], [x for x in free if x[0] not in other]
    if not met:
        return 0.0
    met.sort()
    m = len(met)
    precision, recall = m / len(hyp), m / len(ref)
    mean = precision * recall / (alpha * precision + (1 - alpha) * recall)
    chunks = 1 + sum((i + 1, j + 1) != after for (i, j), after in zip(met, met[1:]))
    return mean * (1 - gamma * (chunks / m) ** beta)


def rouge_l(predicted: Column, reference: Column, stemmed: bool = False) -> Column:
    """ROUGE-L as a struct (precision, recall, f1) over words of a-z and 0-9, or over their stems."""
    return _rouge(stemmed_words if stemmed else _words)(predicted, reference)


def meteor(predicted: Column, reference: Column, stemmed: bool = False) -> Column:
    return _meteor(stemmed)(predicted, reference)


def greedy_cosine(predicted: Column, reference: Column) -> Column:
    """A struct (precision, recall, f1) of two arrays of unit vectors of words, from whatever encoder: each vector counts
    its largest cosine to the other side; 0 where a side is empty."""

    def side(one: Column, other: Column) -> Column:
        best = F.transform(one, lambda v: F.array_max(F.transform(other, lambda w: T.dot(v, w))))
        return F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(one)

    both = (F.coalesce(F.size(predicted), F.lit(0)) > 0) & (F.coalesce(F.size(reference), F.lit(0)) > 0)
    parts = F.struct(F.when(both, side(predicted, reference)).otherwise(0.0).alias("p"), F.when(both, side(reference, predicted)).otherwise(0.0).alias("r"))
    return T.let(parts, lambda x: F.struct(x["p"].alias("precision"), x["r"].alias("recall"), T.harmonic(x["p"], x["r"]).alias("f1")))
