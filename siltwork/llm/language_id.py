"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: letters in lower case, anything else one blank; all 1- to ``ORDER``-grams of the whole text, hashed into
``FEATURES`` cells, with 1 + log counts, times the inverse document frequency over all training rows, scaled to length
1. Weights: follow-the-regularised-leader (proximal) with an elastic net, on a sample of at most ``SAMPLE_ROWS`` rows of
each language and about ``SAMPLE_TOTAL`` in all (documented bounds), a tenth of which is set aside to fit the temperature
of the softmax. The sample reaches the driver as counts of cells, which are bounded however long a text is.

Each value of the label column is a language. ``LANGUAGES`` bounds the weights: of more values than that the most frequent
are in the sample, as a column with that many holds noise; nothing is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .linear import fit_temperature, ftrl, softmax

ORDER = 3
FEATURES = 1 << 15
SAMPLE_ROWS = 1_500
SAMPLE_TOTAL = 24_000
LANGUAGES = 2_000
EPOCHS = 3
ALPHA, L1, L2 = 0.5, 1e-3, 1e-4

_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_letters: np.ndarray | None = None


def _table() -> np.ndarray:
    """For each code point itself if a letter, else a blank; beyond the last plane with letters all are blanks."""
    global _letters
    if _letters is None:
        top = 0x32400
        table = np.full(top + 1, 32, dtype=np.uint32)
        table[:top] = [i if chr(i).isalpha() else 32 for i in range(top)]
        _letters = table
    return _letters


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of the n-grams of a text; empty for one without a letter."""
    none = np.empty(0, dtype=np.int64), np.empty(0)
    if not text:
        return none
    table = _table()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = table[np.minimum(points, len(table) - 1)]
    letters = points != 32
    if not letters.any():
        return none
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    points = np.concatenate([np.array([32], dtype=np.uint32), points[keep], np.array([32], dtype=np.uint32)])
    total = np.zeros(FEATURES, dtype=np.int32)
    h = np.zeros(len(points), dtype=np.uint32)
    for n in range(ORDER):
        if len(points) <= n:
            break
        h = (h[: len(points) - n] * _MULT[0]) ^ ((points[n:] + np.uint32(n)) * _MULT[1])
        cells = ((h ^ (h >> np.uint32(15))) * _MULT[2]) >> np.uint32(32 - FEATURES.bit_length() + 1)
        total += np.bincount(cells, minlength=FEATURES).astype(np.int32)
    at = np.flatnonzero(total)
    return at, total[at].astype(np.float64)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # FEATURES + 1 (bias) by languages
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(counts)) * self.idf[at]
        length = np.sqrt(x @ x)
        return at, (x / length if length > 0 else x).astype(np.float32)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        at, x = self.vector(*counts_of(text))
        if not len(at) or not self.languages:
            return "und", 0.0
        p = softmax(self.logits(at, x) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


Counts = tuple[np.ndarray, np.ndarray]


def train(rows: list[tuple[Counts, str]], languages: list[str], idf: np.ndarray, *, epochs: int = EPOCHS, seed: int = 42) -> Model:
    """FTRL-proximal with an elastic net, one row (counts_of a text, its language) at a time in a seeded order; then the
    temperature."""
    model = Model(languages, idf, np.zeros((FEATURES + 1, len(languages)), dtype=np.float32))
    if len(languages) < 2:
        return model
    of = {x: i for i, x in enumerate(languages)}
    data = [(*model.vector(*counts), of[lang]) for counts, lang in rows if len(counts[0])]
    order = np.random.default_rng(seed).permutation(len(data))
    aside, learn = order[: len(order) // 10], order[len(order) // 10 :]
    model.weights = ftrl([data[i] for i in learn], FEATURES, len(languages), epochs=epochs, alpha=ALPHA, l1=L1, l2=L2, seed=seed).astype(np.float32)
    if len(aside):
        model.temperature = fit_temperature(np.stack([model.logits(data[i][0], data[i][1]) for i in aside]), np.array([data[i][2] for i in aside]))
    return model


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """1 + ln((1 + n) / (1 + df)) of each cell, over all rows (column t)."""

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, docs = np.zeros(FEATURES, dtype=np.int64), 0
        for b in batches:
            for t in b["t"]:
                seen[counts_of(t)[0]] += 1
                docs += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"cell": np.append(at, -1), "n": np.append(seen[at], docs)})
        give_back()

    counted = rows.select("t").mapInPandas(frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    found = {r["cell"]: r["n"] for r in counted}
    return np.array([np.log((1 + found.get(-1, 0)) / (1 + found.get(i, 0))) + 1 for i in range(FEATURES)])


def fit(rows: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", seed: int = 42, sample_rows: int = SAMPLE_ROWS, sample_total: int = SAMPLE_TOTAL, languages: int = LANGUAGES) -> Model:
    """A model from all rows with a text and a language. Document frequencies cover all of them; the sample is drawn by
    hash of key and text: of each language sample_rows rows, of many so much less that they come to about sample_total,
    ten a language at least. No such row gives a model without languages, one language a model that always names it."""
    rows = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(key, text, F.lit(seed)).alias("u"))
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(languages).collect()}
    names = sorted(sizes)
    if not names:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES + 1, 0), dtype=np.float32))
    each = min(sample_rows, max(10, sample_total // len(names)))
    shares = rows.sparkSession.createDataFrame([(x, each / n) for x, n in sizes.items()], f"l {rows.schema['l'].dataType.simpleString()}, share double")
    picked = rows.join(F.broadcast(shares), "l").where((F.col("u") / 2.0**64 + 0.5) < F.col("share")).select("u", "l", "t")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [counts_of(t) for t in b["t"]]
            yield pd.DataFrame({"u": b["u"], "l": b["l"], "cells": [at.astype(np.uint16).tobytes() for at, _ in found], "counts": [n.astype(np.float32).tobytes() for _, n in found]})

    drawn = picked.mapInPandas(counted, f"u long, l {rows.schema['l'].dataType.simpleString()}, cells binary, counts binary")
    sample = sorted((r["u"], r["l"], bytes(r["cells"]), bytes(r["counts"])) for r in drawn.orderBy("u").limit(2 * each * len(names)).collect())
    read = [((np.frombuffer(at, dtype=np.uint16), np.frombuffer(n, dtype=np.float32)), name) for _, name, at, n in sample]
    model = train(read, names, inverse_frequencies(rows), seed=seed)
    del sample, read
    give_back()
    return model


def identify(rows: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """rows with lang_pred and score (0 to 1, the calibrated probability). Null texts and those without a letter, and
    all rows if the model knows no language, are ``und`` with score 0. Added columns replace those of the same name."""
    rows = rows.drop(*[c for c in rows.columns if c in ("lang_pred", "score")])
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])
        give_back()

    return rows.withColumn("__p", predict(F.col(text))).select(*rows.columns, "__p.lang_pred", "__p.score")


def held_out(key: Column) -> Column:
    """Whether a document stays out of training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
