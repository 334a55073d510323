"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A notice is a line, or a stretch of words over several lines of one paragraph: lines between blank ones, comment marks
aside. Hard-wrapped notices are found so: where the lines of a paragraph hold ``ALIKE`` of the word pairs of a template
within ``ROOM`` times its words, the stretch from the first to the last of those pairs is judged like a line. One that
a line with a notice of the same family overlaps is that notice already; a line of another family goes if the stretch's
own templates hold all pairs by which it was found.

Features are hashed word 1- and 2-grams; a sparse multinomial logistic regression is trained on
seeded variations of the templates for each family and, for the class ``unknown``, on a sample of the corpus's own
paragraphs of at most ``SAMPLE_PARAGRAPHS`` (a documented bound). The temperature is fitted on variations and
paragraphs set aside, and a prediction below ``SURE`` is unknown. A predicted family is reported when a template of it
shares at least ``ALIKE`` of its word pairs with the paragraph.

Lines without a single word pair of any template are not classified, as no template could confirm them; nothing is lost
by that. Lines and stretches in which a template is found are left out of the class ``unknown``. Of a sampled line of
more than ``SAMPLE_WORDS`` words the sample has so many from a drawn place on.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .linear import fit_temperature, ftrl, softmax

FEATURES = 1 << 14
SAMPLE_PARAGRAPHS = 4_000
#: Words of a line in the training sample.
SAMPLE_WORDS = 200
VARIATIONS = 40
SURE = 0.6
ALIKE = 0.5
#: Words of a stretch, in words of the template.
ROOM = 2
UNKNOWN = "unknown"

# Short notices by which well-known licences are announced.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    "lgpl": ("Licensed under the GNU Lesser General Public License.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    "bsd": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "isc": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "proprietary": ("All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
}


def words_of_line(line: str) -> list[str]:
    """Lower-case words without punctuation at their ends."""
    return [w for w in (x.strip(".,;:!?()[]\"'<>") for x in line.lower().split()) if w]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    grams = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    counts = Counter(xxhash.xxh32_intdigest(g) % FEATURES for g in grams)
    x = np.sqrt(np.array(list(counts.values()), dtype=np.float64))
    return np.array(list(counts), dtype=np.int64), x / np.sqrt(x @ x) if len(x) else x


def pairs(words: list[str]) -> set[tuple[str, ...]]:
    return {*zip(words, words[1:], strict=False)} or {tuple(words)}


#: Marks of comments at the start and at the end of a line.
_MARKS = re.compile(r"^\s*(?:(?:/\*+|\*+/?|//+!?|#+!?|;+|--+|%+|<!--+|>+|\"{3}|'{3}|dnl\b|REM\b|\.\.)(?=\s|$|\w)\s*)*|\s*(?:\*+/?|--+>|#+|//+|\"{3}|'{3})?\s*$")


def paragraphs_of(lines: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Runs of two or more (line number, line without comment marks) between lines of which nothing is left."""
    run = []
    for i, line in enumerate(lines):
        bare = _MARKS.sub("", line)
        if bare:
            run.append((i, bare))
            continue
        if len(run) > 1:
            yield run
        run = []
    if len(run) > 1:
        yield run


Shapes = dict[str, list[set[tuple[str, ...]]]]


def pair_index(shapes: Shapes) -> dict[tuple[str, ...], list[tuple[str, int]]]:
    """The templates (family, number) that hold a pair of words."""
    index = defaultdict(list)
    for f, ts in shapes.items():
        for k, t in enumerate(ts):
            for p in t:
                index[p].append((f, k))
    return dict(index)


def stretches(at: list[int], words: list[str], shapes: Shapes, index: dict[tuple[str, ...], list[tuple[str, int]]]) -> list[tuple[int, int, int]]:
    """(pairs found, first word, last word) of stretches over two lines or more that hold ALIKE of a template's pairs, most
    pairs first. at: the line of each word."""
    hits = defaultdict(list)
    for i, p in enumerate(zip(words, words[1:], strict=False)):
        for t in index.get(p, ()):
            hits[t].append((i, p))
    out = set()
    for (f, k), found in hits.items():
        size = len(shapes[f][k])
        if len({p for _, p in found}) < ALIKE * size:
            continue
        room, left, seen, best = ROOM * (size + 1), 0, Counter(), None
        for right, (i, p) in enumerate(found):
            seen[p] += 1
            while i + 1 - found[left][0] >= room or seen[found[left][1]] > 1:
                seen[found[left][1]] -= 1
                if not seen[found[left][1]]:
                    del seen[found[left][1]]
                left += 1
            if len(seen) >= ALIKE * size and (best is None or left > best[2] or len(seen) > best[0]):
                if best and left > best[2]:  # apart from the best so far: another notice
                    out.add((best[0], found[best[1]][0], found[best[2]][0] + 1))
                best = (len(seen), left, right)
        if best:
            out.add((best[0], found[best[1]][0], found[best[2]][0] + 1))
    return sorted((x for x in out if at[x[1]] < at[x[2]]), key=lambda x: (-x[0], x[1:]))


def joined(run: list[tuple[int, str]]) -> tuple[list[int], list[str]]:
    """The words of a paragraph and the line of each."""
    both = [(i, w) for i, line in run for w in words_of_line(line)]
    return [i for i, _ in both], [w for _, w in both]


@dataclass
class Scanner:
    families: list[str]
    weights: np.ndarray
    temperature: float
    templates: Shapes

    def __post_init__(self):
        self.index = pair_index(self.templates)
        self.words = frozenset(w for p in self.index for w in p)

    def scan(self, line: str) -> tuple[str, float, float] | None:
        """Family, probability and likeness of a licence notice; None for other lines."""
        return self.judge(words_of_line(line))

    def scan_text(self, text: str) -> list[tuple[int, int, tuple[str, float, float]]]:
        """(first line, last line, what scan gives) of each notice of a text, in order."""
        lines = text.split("\n")
        found = [(i, i, hit) for i, line in enumerate(lines) if (hit := self.scan(line))]
        for run in paragraphs_of(lines):
            at, words = joined(run)
            if self.apart(words):
                continue
            taken: list[tuple[int, int]] = []
            alone = [x for x in found if x[0] == x[1] and run[0][0] <= x[0] <= run[-1][0]]
            for _, a, b in stretches(at, words, self.templates, self.index):
                if any(a <= y and x <= b for x, y in taken):
                    continue
                if not (hit := self.judge(words[a : b + 1])):
                    continue
                taken.append((a, b))
                inside = [x for x in alone if at[a] <= x[0] <= at[b]]
                if any(hit[0] == x[2][0] for x in inside):
                    continue
                found.append((at[a], at[b], hit))
                for x in inside:
                    if self.evidence(lines[x[0]], x[2][0]) <= set().union(*self.templates[hit[0]]):
                        found.remove(x)
        return sorted(found, key=lambda x: x[:2])

    def evidence(self, line: str, family: str) -> set[tuple[str, ...]]:
        """The word pairs of the family's most alike template that a line holds."""
        own = pairs(words_of_line(line))
        return max((t & own for t in self.templates[family]), key=len)

    def apart(self, words: list[str]) -> bool:
        """Whether words have no pair in common with any template."""
        return self.words.isdisjoint(words) or self.index.keys().isdisjoint(zip(words, words[1:], strict=False)) and (len(words) != 1 or (words[0],) not in self.index)

    def judge(self, words: list[str]) -> tuple[str, float, float] | None:
        if self.apart(words):
            return None
        at, x = features(words)
        p = softmax((x @ self.weights[at] + self.weights[-1]) / self.temperature)
        best = int(np.argmax(p))
        family = self.families[best]
        if family == UNKNOWN or p[best] < SURE:
            return None
        own = pairs(words)
        alike = max(len(t & own) / len(t) for t in self.templates[family])
        return (family, float(p[best]), alike) if alike >= ALIKE else None


def train(paragraphs: list[str], *, templates: dict[str, tuple[str, ...]] | None = None, seed: int = 42) -> Scanner:
    templates = templates or TEMPLATES
    shapes = {f: [pairs(words_of_line(t)) for t in ts] for f, ts in templates.items()}
    families = [UNKNOWN, *sorted(templates)]
    others = [w for w in map(words_of_line, paragraphs) if w and not any(len(t & pairs(w)) >= ALIKE * len(t) for ts in shapes.values() for t in ts)]
    every = {w for ts in templates.values() for t in ts for w in words_of_line(t)}
    rng = np.random.default_rng(seed)
    filler = [x for w in others[:500] for x in w] or ["text"]
    data = []
    for f in families[1:]:
        for t in templates[f]:
            words = words_of_line(t)
            for k in range(VARIATIONS):
                kept = [w for w in words if k == 0 or rng.random() > 0.08] or words
                around = [filler[i] for i in rng.integers(len(filler), size=int(rng.integers(0, 12)) if k else 0)]
                cut = int(rng.integers(0, len(around) + 1))
                data.append((*features(around[:cut] + kept + around[cut:]), families.index(f)))
    # Unknown paragraphs also hold single words of templates in other company.
    loose = sorted(every)
    for w in others:
        extra = [loose[i] for i in rng.integers(len(loose), size=2)] if rng.random() < 0.3 else []
        data.append((*features(w + extra), 0))
    order = rng.permutation(len(data))
    aside, learn = order[: len(order) // 10], order[len(order) // 10 :]
    weights = ftrl([data[i] for i in learn], FEATURES, len(families), epochs=4, alpha=1.0, l1=1e-3, l2=1e-5, seed=seed)
    logits = np.stack([data[i][1] @ weights[data[i][0]] + weights[-1] for i in aside]) if len(aside) else np.zeros((0, len(families)))
    return Scanner(families, weights, fit_temperature(logits, np.array([data[i][2] for i in aside])), shapes)


def plain_lines(text: str) -> list[tuple[int, str]]:
    """The lines of a text, not blank, that are in no stretch which holds a template."""
    shapes = {f: [pairs(words_of_line(t)) for t in ts] for f, ts in TEMPLATES.items()}
    lines, index, held = text.split("\n"), pair_index(shapes), set()
    for run in paragraphs_of(lines):
        at, words = joined(run)
        for _, a, b in stretches(at, words, shapes, index):
            held.update(range(at[a], at[b] + 1))
    return [(i, x) for i, x in enumerate(lines) if x.strip(" ") and i not in held]


def fit(docs: DataFrame, *, text: str = "text", key: str = "doc_id", seed: int = 42, sample: int = SAMPLE_PARAGRAPHS) -> Scanner:
    """A scanner whose class unknown is trained on a bounded sample of the paragraphs of docs, drawn by hash."""
    rows = docs.where(F.col(text).isNotNull()).select(F.xxhash64(key, text, F.lit(seed)).alias("u"), F.col(text).alias("t"))
    n = rows.count()
    few = rows.where(F.col("u") / 2.0**64 + 0.5 < F.lit(sample / max(n, 1))).orderBy("u").limit(sample)

    def drawn(line: str, u: int) -> str:
        if len(line) <= SAMPLE_WORDS:
            return line
        words = line.split()
        at = u % max(1, len(words) - SAMPLE_WORDS + 1)
        return " ".join(words[at : at + SAMPLE_WORDS])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(u, i, drawn(x, u)) for u, t in zip(b["u"], b["t"], strict=True) for i, x in plain_lines(t)], columns=["u", "i", "line"])

    lines = few.mapInPandas(split, "u long, i int, line string").select("line", F.xxhash64("u", "i").alias("v"))
    picked = lines.orderBy("v").limit(sample).select("v", "line")
    return train([r["line"] for r in sorted(picked.collect(), key=lambda r: r["v"])], seed=seed)


def scan_licenses(docs: DataFrame, scanner: Scanner, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each licence notice: key, line_no (its first line, from 0), family, probability, likeness, line (all of
    its lines).

    Null and empty texts have none. Repeated rows give repeated notices. Whole texts are read, lines of any length. A key
    column named like one of the others comes back as <key>_of."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)
    out = f"k {docs.schema[key].dataType.simpleString()}, line_no int, family string, probability double, likeness double, line string"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for b in batches:
            found = []
            for k, t in zip(b["k"], b["t"], strict=True):
                if t:
                    if hits := s.scan_text(t):
                        lines = t.split("\n")
                        found += [(None if k != k else k, i, *hit, "\n".join(lines[i : j + 1])) for i, j, hit in hits]
            yield pd.DataFrame(found, columns=["k", "line_no", "family", "probability", "likeness", "line"])
        give_back()

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(work, out)
    own = ("line_no", "family", "probability", "likeness", "line")
    return rows.select(F.col("k").alias(f"{key}_of" if key in own else key), *own)
