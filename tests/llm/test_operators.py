"""The training-data operators against brute force, on hard rows, and on empty tables."""

import collections
import hashlib
import itertools
import json
import os
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siltwork.llm import ann_forest, bpe, chat_format, common, language_id, license_scan, line_dedup, mixing, quality_mcd, sharding, shingle_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, h string, t string, n int, bits string, d int, shard string, label string, rows int, copies int, c string, k int, s string, m int"


def _rows():
    r = random.Random(7)
    words = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]
    out = []
    base = [" ".join(r.choice(words) + str(r.randint(0, 30)) for _ in range(r.choice([3, 9, 25, 60]))) for _ in range(12)]
    for i in range(60):
        parts = [r.choice(base) for _ in range(r.randint(1, 4))]
        if i % 3 == 0:
            at = r.randrange(len(parts[0]))
            parts[0] = parts[0][:at] + "x" + parts[0][at + 1 :]
        out.append((i, "\n".join(parts), r.choice(["en", "fr", None]), r.choice(["a", "b", "c", None])))
    out += [(60, None, None, None), (61, "", "en", "a"), (62, " \t\n\n", "fr", "b"), (None, base[2], "en", "a"), (63, "Licensed under the Apache License, Version 2.0.", "en", "c")]
    out += [(64, "long " * 40_000, "en", "a"), (65, base[3], "fr", None), (65, base[3], "fr", None)]
    return out


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), *[None] * 14) for r in ROWS], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a == b or a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def test_line_dedup(docs, empty):
    lines = sorted(((-1 if d is None else d, i), x.strip(" \t\r")) for d, t, *_ in {r[:2]: r for r in ROWS}.values() for i, x in enumerate((t or "").split("\n")))
    gone, seen = set(), []
    for at, x in lines:
        if x and any(x == y or len(x) >= 16 <= len(y) and near(x, y) for y in seen):
            gone.add(at)
        if x:
            seen.append(x)
    want = collections.Counter((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (-1 if d is None else d, i) not in gone)) for d, t, *_ in ROWS)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == want
    again = line_dedup.dedup_lines(out)
    assert again.agg(F.sum("n_removed")).first()[0] == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_shared_ids(spark):
    a, b, c, e = ("the first line of this text is a", "another line of some length, b", "one more line of its own, c c c", "the last of these lines is e, so")
    rows = [(7, f"{a}\n{b}"), (7, f"{c}\n{b}\n{e}"), (None, f"{a} of null\n{c} of null"), (None, f"{e} of null\n{c} of null"), (9, f"{a}\nunlike all the others: 9 9 9")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = collections.Counter(x for r in out for x in r.text.split("\n"))
    # Of each line one stays, whatever ids its rows have.
    assert left == collections.Counter({x for _, t in rows for x in t.split("\n")})
    assert sum(r.n_removed for r in out) == 3 and len(out) == len(rows)


def test_line_dedup_short_lines(spark):
    import corpus_pipeline

    rows = [(1, "Read more\n\nfirst line of this document\nx", "en", "a"), (2, "Read more \n\nRead mora\nsecond document has a line", "en", "a"), (3, "x", "en", "a"), (4, "Log in\n\nLog in\nmy own words here, a third", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.text for r in corpus_pipeline.without_repeated_lines(spark, docs, "").collect()}
    # Equal short lines go, those that only resemble one stay, and so do empty lines.
    assert got == {1: rows[0][1], 2: "\nRead mora\nsecond document has a line", 4: "Log in\n\nmy own words here, a third"}


def test_license_scan(docs, empty):
    scanner = license_scan.fit(docs)
    found = license_scan.scan_licenses(docs, scanner).collect()
    assert [(r.doc_id, r.family) for r in found] == [(63, "apache-2.0")]
    for family, texts in license_scan.TEMPLATES.items():
        assert scanner.scan(texts[0])[0] == family
    assert scanner.scan("the version of the work is the first of this kind of program") is None
    assert license_scan.scan_licenses(empty, license_scan.fit(empty)).count() == 0


WRAPPED = {
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License as\npublished by the Free Software Foundation; either version 2 of\nthe License, or (at your option) any later version.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either",
    "bsd": "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the\nfollowing conditions are met:",
}


def test_license_scan_wrapped(spark, docs):
    prose = "an alpha line of beta words\nand the gamma of a delta"
    rows = []
    for k, text in enumerate(WRAPPED.values()):
        for j, (start, end, mark, gap) in enumerate([("", "", "", "\n\n"), ("", "", "# ", "\n#\n"), ("", "", "// ", "\n"), ("/*\n", "\n */", " * ", "\n\n")]):
            rows.append((10 * k + j, prose + gap + start + "\n".join(mark + x for x in text.split("\n")) + end + gap + prose))
    given = spark.createDataFrame(rows, "doc_id long, text string").cache()
    families = list(WRAPPED)
    for scanner in (license_scan.fit(docs), license_scan.fit(given)):
        found = license_scan.scan_licenses(given, scanner).collect()
        assert collections.Counter((r.doc_id, r.family) for r in found) == collections.Counter((k, families[k // 10]) for k, _ in rows)
        texts = dict(rows)
        assert all(r.line in texts[r.doc_id] and texts[r.doc_id].split("\n")[r.line_no] == r.line.split("\n")[0] for r in found)
    two = WRAPPED["mit"] + "\n" + prose + "\n" + WRAPPED["mit"]
    assert [x[2][0] for x in scanner.scan_text(two)] == ["mit", "mit"]


def test_license_scan_against_all_templates(spark):
    """Lines, each compared with each template without a gate or a classifier."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text is not null")
    extra = [(10**6 + i, t) for i, t in enumerate(x for ts in license_scan.TEMPLATES.values() for x in ts)] + [(2 * 10**6, "x " * 5000 + "\nReleased under the MIT License.\n" + "y" * 9000)]
    rows = rows.union(spark.createDataFrame(extra, "doc_id long, text string")).cache()
    scanner = license_scan.fit(rows)
    got = {(r.doc_id, r.line_no): r.family for r in license_scan.scan_licenses(rows, scanner).collect() if "\n" not in r.line}
    shapes = {f: [license_scan.pairs(license_scan.words_of_line(t)) for t in ts] for f, ts in license_scan.TEMPLATES.items()}
    want, best = {}, {}
    for r in rows.collect():
        for i, line in enumerate(r.text.split("\n")):
            own = license_scan.pairs(license_scan.words_of_line(line))
            alike = {f: max(len(t & own) / len(t) for t in ts) for f, ts in shapes.items()}
            if max(alike.values()) >= license_scan.ALIKE:
                want[r.doc_id, i], best[r.doc_id, i] = {f for f, a in alike.items() if a >= license_scan.ALIKE}, max(alike.values())
    assert set(got) <= set(want)
    assert all(got[k] in want[k] for k in got)
    assert {k for k in want if best[k] >= 0.9} <= set(got)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("cap", [8192, 8])
def test_shingle_join(docs, empty, n, percent, cap, monkeypatch):
    monkeypatch.setattr(shingle_join, "GROUP_ROWS", cap)
    sets = {}
    for d, t, *_ in ROWS:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(n, len(w))
        sets[-1 if d is None else d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
    up = {i: i for i in sets}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = shingle_join.jaccard_components(docs, words=n, percent=percent).collect()
    assert len(got) == len(ROWS)
    for r in got:
        d = -1 if r.doc_id is None else r.doc_id
        assert r.n_shingles == len(sets[d])
        assert (-1 if r.component_id is None else r.component_id) == find(d), d
    assert shingle_join.jaccard_components(empty, words=n, percent=percent).count() == 0


def test_keep_one(spark):
    r = random.Random(3)
    texts = [" ".join(f"w{r.randint(0, 10**6)}" for _ in range(60)) for _ in range(8)]
    close = [t + " more" for t in texts]
    rows = [(3, texts[0], "a"), (7, close[0], "a"), (7, texts[1], "a")]  # one of two texts under 7 is a near copy of 3
    rows += [(8, texts[2], "b"), (8, texts[2], "a"), (8, texts[2], "a"), (8, close[2], "a")]  # repeated rows, and near copies under one id
    rows += [(None, texts[3], "a"), (None, close[3], "a"), (None, texts[3], "a"), (None, texts[4], "a"), (9, close[4], "a")]
    rows += [(10, "", "a"), (10, "", "a"), (11, None, "a"), (None, " ", "a")]  # without shingles
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for given in (docs, docs.repartition(3)):
        got = shingle_join.keep_one(given)
        assert got.columns == docs.columns
        got = [tuple(x) for x in got.collect()]
        assert not collections.Counter(got) - collections.Counter(rows)
        blank = [x for x in got if not (x[1] or "").strip()]
        assert collections.Counter(blank) == collections.Counter(rows[-4:])
        full = sorted(((texts + close).index(x[1]) % 8, x[0]) for x in got if x not in blank)
        assert full == [(0, 3), (1, 7), (2, 8), (3, None), (4, None)]


def test_shingle_join_in_passes(spark, docs, monkeypatch):
    """Keys, nodes, texts and pairs of blocks in many passes give what one pass gives."""
    known = lambda: sorted(map(repr, shingle_join.jaccard_components(docs, words=3, percent=80).collect()))
    want = known()
    for name, value in {"PASS_ROWS": 40, "TOKEN_ROWS": 5, "BROADCAST_ROWS": 3, "GROUP_ROWS": 8}.items():
        monkeypatch.setattr(shingle_join, name, value)
    assert known() == want


def test_shingle_join_takes_few_tasks(spark, docs):
    """Each shuffle has as many tasks as the session says, however little there is to do: 50 shuffles are too many (F1)."""
    sc, parts = spark.sparkContext, 40
    fixed = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in fixed}
    try:
        for k, v in fixed.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few-tasks", "near copies")
        assert shingle_join.jaccard_components(docs, words=3, percent=80).count() == len(ROWS)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    status = sc.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("few-tasks") for s in status.getJobInfo(j).stageIds}
    tasks = sum(x.numCompletedTasks for s in stages if (x := status.getStageInfo(s)))
    assert 0 < tasks < 25 * parts, tasks


@pytest.mark.parametrize("limit", [500_000, 3])
def test_min_labels(spark, limit, monkeypatch):
    """One task and rounds over all tasks find the same components: a chain, stars, a ring, pairs that come twice."""
    monkeypatch.setattr(shingle_join, "BROADCAST_ROWS", limit)
    r = random.Random(5)
    chain = list(range(0, 120, 3))
    r.shuffle(chain)
    pairs = list(itertools.pairwise(chain)) + [(1000 + i, 1000) for i in range(1, 9)] + [(2000, 2000 + i) for i in range(1, 9)]
    pairs += [(-5 - i, -5 - (i + 1) % 7) for i in range(7)] + [(2**62, -(2**62)), (7, 7), (1001, 1000)]
    up = {x: x for p in pairs for x in p}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    sizes = collections.Counter(up.values())
    made = common.Scratch()
    for rows in (pairs, []):
        given = common.materialize(spark.createDataFrame(rows, "a long, b long").repartition(5), "pairs", made)
        got = shingle_join.min_labels(given, "label", made, sized=True).collect()
        assert sorted((x.node, x.label, x.rows) for x in got) == (sorted((k, v, sizes[v]) for k, v in up.items()) if rows else [])
        plain = shingle_join.min_labels(given, "label", made)
        assert plain.columns == ["node", "label"] and plain.count() == len(got)
    made.clear()


def test_keep_one_holds_little_disk(spark):
    """Neither shuffle files nor the tables of keys and tokens outlive their use."""
    held = lambda: {f.getName() for f in _files(spark) if f.getName().startswith("shuffle_")}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    left, before = _left(spark), held()
    got = shingle_join.keep_one(rows)
    assert got.count() > 0
    more = {re.sub("-[0-9a-f]{32}$", "", x) for x in _left(spark) - left}
    assert more == {"linked-rows", "near-copies", "repeated-rows"}
    big = common.materialize(rows.repartition(7, "doc_id"), "held")
    until = time.time() + 20
    while (now := held() - before) and time.time() < until and sum(f.length() for f in _files(spark) if f.getName() in now) > 100_000:
        time.sleep(0.2)
    assert big.count() == rows.count()
    assert sum(f.length() for f in _files(spark) if f.getName() in held() - before) <= 100_000


def _files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [found.apply(i) for i in range(found.size())]


def _left(spark):
    top = common.shared_folder(spark).removeprefix("file:") + "/siltwork"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_ann_forest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16))
    x[100:130] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)]
    rows += [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, []), (None, rows[0][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann_forest.nearest(df, df.where("vec_id % 50 = 0")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    by = collections.defaultdict(dict)
    for r in got:
        by[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert sorted(by) == list(range(0, 600, 50))
    hits = 0
    for q, found in by.items():
        s = u @ u[q]
        s[q] = -9
        best = sorted(range(600), key=lambda i: (-round(s[i], 12), i))[:5]
        hits += len(set(best) & {v for v, _ in found.values()})
        assert all(abs(s[v] - score) < 1e-12 for v, score in found.values())
    assert [by[100][i][0] for i in range(1, 6)] == [101, 102, 103, 104, 105]
    assert hits >= 0.9 * 60
    assert ann_forest.nearest(df.where("vec_id < 0"), df).count() == 0
    few = df.where("vec_id in (0, 1)")
    assert sorted((r.query_id, r.vec_id) for r in ann_forest.nearest(few, few).collect()) == [(0, 1), (1, 0)]


def test_ann_forest_lengths(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(ann_forest, "BLOCK_ROWS", 150)
    monkeypatch.setattr(ann_forest, "LEAF_ROWS", 40)
    rows = {i: rng.standard_normal(8 if i < 500 else 6 if i < 800 else 3) for i in range(840)}
    given = [(i, [float(x) for x in v]) for i, v in rows.items()] + [(900, [float("inf")] * 8), (901, [None] * 8), (902, [1.0] * 11)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann_forest.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in range(0, 840, 20):
        same = {i: float(v @ rows[q] / np.linalg.norm(v) / np.linalg.norm(rows[q])) for i, v in rows.items() if len(v) == len(rows[q]) and i != q}
        best = sorted(same, key=lambda i: (-same[i], i))[:5]
        assert all(i in same for i in got[q]) and len(got[q]) == 5
        hits += len({*best} & {*got[q]})
    assert hits >= 0.9 * 5 * 42 and set(got) == set(range(0, 840, 20))


def test_ann_recall_on_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    old, ann_forest.BLOCK_ROWS = ann_forest.BLOCK_ROWS, 500
    try:
        got = ann_forest.nearest(df, df.where("vec_id % 50 = 0")).collect()
    finally:
        ann_forest.BLOCK_ROWS = old
    rows = df.collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    best = {}
    for q in ids[ids % 50 == 0]:
        s = u @ u[ids == q][0]
        s[ids == q] = -9
        best[q] = set(ids[np.argsort(-s)[:5]])
    assert sum(r.vec_id in best[r.query_id] for r in got) >= 0.9 * 5 * len(best)


def counts(t):
    w = words(t)
    lines = [x for x in (t or "").split("\n") if words(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = collections.Counter(grams)
    inside = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_quality(spark, docs, empty):
    got = quality_mcd.judge(docs, keep=["doc_id", "text"]).collect()
    assert len(got) == len(ROWS)
    for r in got:
        c = counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 20 or 100 * c[4] > 30 * c[0])
        assert not (r.base_failed and r.kept)
    assert quality_mcd.judge(empty, keep=["doc_id"]).count() == 0
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    clean = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(30, 200))), "en", "a") for i in range(400)]
    junk = [(1000 + i, " ".join(r.choice(vocabulary).upper() + "%%%" for _ in range(60)), "en", "a") for i in range(20)]
    out = quality_mcd.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string"), keep=["doc_id"]).collect()
    assert all(x.kept == (x.doc_id < 1000) for x in out)


def test_quality_estimates_against_numpy(spark):
    """The estimates of groups against a plain concentration in numpy, and small groups against larger ones."""
    from siltwork.llm.common import Scratch

    rng = np.random.default_rng(4)
    x = np.rint(rng.multivariate_normal([1.5, 0.3, 0.2, 0.4], np.diag([0.04, 0.01, 0.01, 0.02]) + 0.003, 400) * 10_000).astype(int)
    x[:60] += 9_000  # a cloud of outliers
    df = spark.createDataFrame([("g", *map(int, r)) for r in x], "g string, x0 long, x1 long, x2 long, x3 long")
    got = quality_mcd.mcd_estimates(df, 1, Scratch()).first()
    v, floors = x / 10_000, np.diag(np.square(quality_mcd.FLOORS))

    def moments(rows, share):
        factor = 1.0 if share == 1 else share / quality_mcd.chi2_even(quality_mcd.chi2_quantile(share, 4), 6)
        return rows.mean(axis=0), factor * np.cov(rows.T, bias=True) + floors

    def away(m, c):
        return np.einsum("ij,jk,ik->i", v - m, np.linalg.inv(c), v - m)

    cells = np.sort(x // 50, axis=0)
    q = [cells[int(np.ceil(s * 400)) - 1] for s in (0.25, 0.5, 0.75)]
    starts = [((q[1] + 0.5) * 50 / 10_000, np.diag(((q[2] - q[0]) * 50 / 10_000 / 1.349) ** 2) + floors), moments(v, 1)]
    ends = []
    for m, c in starts:
        for _ in range(quality_mcd.STEPS):
            cell = np.floor(np.log2(np.maximum(away(m, c), 1e-6)) * 64)
            m, c = moments(v[cell <= np.sort(cell)[int(np.ceil(0.75 * 400)) - 1]], 0.75)
        ends.append((np.linalg.det(c), m, c))
    _, m, c = min(ends, key=lambda e: e[0])
    m, c = moments(v[away(m, c) <= quality_mcd.chi2_quantile(0.975, 4)], 0.975)
    assert np.allclose([got[f"m{i}"] for i in range(4)], m)
    assert np.allclose([got[f"c{i}{j}"] for i in range(4) for j in range(i, 4)], [c[i, j] for i in range(4) for j in range(i, 4)])
    # The same junk goes whatever its group's size: a source of 20, of 199, a table of 30.
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    plain = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(30, 200)))
    junk = lambda: " ".join(r.choice(vocabulary).upper() + "%%%" for _ in range(60))
    for sizes in ({"a": 300, "b": 20}, {"a": 199}, {"a": 30}):
        rows = [(i, (junk if i % 10 == 0 else plain)(), "en", s) for s, n in sizes.items() for i in range(n)]
        for o in quality_mcd.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), keep=["doc_id"]).collect():
            assert o.kept == (o.doc_id % 10 != 0)


def test_chat_layouts(spark):
    said = [
        ({"messages": [{"role": "user", "content": "hi"}, {"content": None, "role": "assistant"}]}, "messages", [("user", "hi"), ("assistant", "")]),
        ({"output": "c", "input": "b", "instruction": "a"}, "instruction", [("user", "a\n\nb"), ("assistant", "c")]),
        ({"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y"}]}, "shared_chat", [("user", "x"), ("assistant", "y")]),
        ({"prompt": "p", "completion": "q"}, "prompt_completion", [("user", "p"), ("assistant", "q")]),
        ({"role": "human", "text": None}, "turn", [("human", "")]),
        ({"other": 1}, None, None),
        ({"content": "c", "role": "bot", "id": 3}, "turn_content", [("bot", "c")]),
        ([{"role": "user", "content": "hi"}, {"role": "assistant", "content": 4, "name": "x"}], "bare_messages", [("user", "hi"), ("assistant", "4")]),
        ({"prompt": "p", "response": "r", "system": "s", "source": {"url": "u"}}, "prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"question": "q", "answer": None, "context": "c", "lang": "en"}, "question_answer", [("user", "c\n\nq"), ("assistant", "")]),
        ({"messages": [{"role": "user", "content": "hi", "weight": 1}], "id": "a", "meta": {"k": [1]}}, "messages", [("user", "hi")]),
        ({"instruction": "a", "output": "b", "topic": "t"}, "instruction", [("user", "a"), ("assistant", "b")]),
        ({"messages": [], "id": 1}, "messages", []),
        ([], "bare_messages", []),
        ({"messages": [{"role": "user", "content": "hi"}], "prompt": "p"}, None, None),
    ]
    assert {x[1] for x in said} - {None} == {m.name for m in chat_format.MAPPINGS}
    df = spark.createDataFrame([(i, json.dumps(x[0])) for i, x in enumerate(said)] + [(100, None), (101, "{")], "i int, record string")
    for r in chat_format.canonical_turns(df).collect():
        _, layout, turns = said[r.i] if r.i < len(said) else (None, None, None)
        assert r.layout == layout
        assert (None if r.turns is None else [(t.role, t.text) for t in r.turns]) == turns


def test_chat_hard_tables(spark):
    schema = "conv_id long, turn long, role string, text string, c string, o string, formatted string, spans string, start int, head string"
    assert chat_format.format_chat(spark.createDataFrame([], schema)).count() == 0
    assert chat_format.canonical_turns(spark.createDataFrame([], "record string, layout int, turns int, fingerprint int")).count() == 0
    long = "<|im_end|>\\" * 40_000
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", long), (1, 1, "assistant", long)]
    got = chat_format.format_chat(spark.createDataFrame([(*r, *["x"] * 4, 1, "x") for r in rows], schema)).select("conv_id", chat_format.parse_chat(F.col("formatted")).alias("t"), chat_format.learned_text(F.col("formatted"), F.col("spans")).alias("l")).collect()
    assert [(t.role, t.text) for t in got[0].t] == [r[2:] for r in rows] and got[0].l == long * 2


def test_chat_round_trip(spark):
    r = random.Random(2)
    pieces = ["<|im_start|>", "<|im_end|>", "\\", "<", "|", "\n", "<\\|", "n", "é", "😀", "assistant", " "]
    rows = [(c, t, r.choice(["user", "assistant", None, "a\nb<|", "\\n"]), r.choice([None, "", "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))])) for c in [*range(40), None] for t in range(r.randint(1, 5))]
    chats = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chats.select("conv_id", chat_format.parse_chat(F.col("formatted")).alias("turns"), chat_format.learned_text(F.col("formatted"), F.col("spans")).alias("learned")).collect()
    want = collections.defaultdict(list)
    for c, _, role, text in rows:
        want[c].append((role or "", text or ""))
    assert {g.conv_id: [(t.role, t.text) for t in g.turns] for g in got} == want
    assert {g.conv_id: g.learned for g in got} == {c: "".join(x for role, x in ts if role == "assistant") for c, ts in want.items()}


def test_sharding(docs, empty):
    out = sharding.write_shards(docs, shards=7, buckets=3)
    got = out.collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(r[:2] for r in ROWS)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert (r.size, r.text_crc32) == (len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))
    assert sorted(by) == list(range(7))
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    place = lambda df: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in df.collect())
    assert place(out) == place(sharding.write_shards(docs.repartition(5), shards=7, buckets=3))
    assert sharding.write_shards(empty).count() == 0


def test_mixing(docs, empty):
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(ROWS)
    sizes, weight = collections.Counter(), {}
    for _, t, _, s in ROWS:
        sizes[s] += len(words(t))
    for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s))):
        weight[s] = (1, 2, 3)[i % 3]
    target, rest, left = {}, set(sizes), sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * level > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
            rest.remove(s)
    target |= {s: weight[s] * level for s in rest}
    for r in plan:
        assert r["size"] == len(words(r.text))
        assert r.source_size == sizes[r.source]
        assert abs(r.target - target[r.source]) < 1e-6
        assert len(r["copies"]) <= 3
    mixed = mixing.mix(docs)
    assert {*mixed.columns} == {*docs.columns, "block_order", "row_order"}
    assert mixed.count() == sum(len(r["copies"]) for r in plan)
    key = lambda rows: sorted((str(r.doc_id), r["size"], str(r["copies"])) for r in rows)
    assert key(plan) == key(mixing.mix_plan(docs.repartition(6)).collect())
    assert mixing.mix_plan(empty).count() == 0
    many = docs.sparkSession.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"))
    for r in mixing.mix_plan(many).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.size("copies")).alias("got")).collect():
        assert abs(r.t - r.got) <= 37


def test_split_is_hypergeometric(spark):
    from math import comb

    q = [5, 3, 4, 1]
    df = spark.createDataFrame([(f"s{i}", i + 1, x) for i, x in enumerate(q)], "s string, number int, q long")
    got = mixing.split_quotas(df, 3, "x").collect()
    assert [sum(r.leaves) for r in sorted(got)] == q
    sizes = [sum(r.leaves[i] for r in got) for i in range(8)]
    assert sum(sizes) == 13 and max(sizes) - min(sizes) <= 1
    # What one source gives the left half follows the law, over all of the numbers that decide.
    for seed in range(3):
        assert sum(r.leaves[0] for r in mixing.split_quotas(df, 1, str(seed)).collect()) == 7
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    for pop, own, n in [(13, 5, 7), (40, 1, 20), (9, 9, 4), (1000, 400, 500), (7, 0, 3)]:
        drawn = u.select(mixing._hypergeometric(F.lit(pop).cast("long"), F.lit(own).cast("long"), F.lit(n).cast("long"), F.col("u")).alias("x")).groupBy("x").count().collect()
        for r in drawn:
            assert abs(r["count"] / 4000 - comb(own, r.x) * comb(pop - own, n - r.x) / comb(pop, n)) < 1.1 / 4000 + 1e-9


@pytest.mark.parametrize("rows,heavy,buckets", [(8, 10**6, 2), (8, 1, 3), (1024, 10**6, 4096)])
def test_mixing_matches_sql(spark, docs, rows, heavy, buckets, monkeypatch, tmp_path):
    import duckdb

    from siltwork.llm import queries

    monkeypatch.setattr(mixing, "BLOCK_ROWS", rows)
    monkeypatch.setattr(mixing, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(mixing, "BUCKET_BLOCKS", buckets)
    base = docs.select("doc_id", "text", "source").union(docs.select("doc_id", "text", "source").where("doc_id is null or text is null")).union(docs.select(F.col("doc_id") + 1000, "text", "source"))
    base.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plan = mixing.mix_plan(given.repartition(3))
    got = collections.Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r["size"] * len(r["copies"]), ",".join(str(c["shard"]) for c in r["copies"])) for r in plan.collect())
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = queries.ORACLE_SQL["op8_mixing"].replace("1024", str(rows))
    want = collections.Counter((a, b, x, round(t, 6), w, s) for a, b, x, t, w, s in c.sql(sql).fetchall())
    assert got == want


def test_language_id(spark, docs, empty):
    r = random.Random(4)
    syllables = {"en": ["the", "ing", "ou", "wh"], "fr": ["eau", "oi", "é", "aux"], "de": ["sch", "ß", "ung", "ä"]}
    rows = [(i, " ".join("".join(r.choice(syllables[x]) for _ in range(3)) for _ in range(20)), x) for i in range(300) for x in [r.choice(list(syllables))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where(~language_id.held_out(F.col("doc_id"))))
    out = language_id.identify(df, model).where(language_id.held_out(F.col("doc_id"))).collect()
    assert sum(x.lang == x.lang_pred for x in out) >= 0.98 * len(out) > 0
    for x in language_id.identify(docs, model).collect():
        assert (x.lang_pred == "und") == (not any(c.isalpha() for c in x.text or ""))
        assert 0 <= x.score <= 1
    nothing = language_id.fit(empty)
    assert nothing.languages == []
    assert {x.lang_pred for x in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_language_id_many_languages(spark):
    r = random.Random(5)
    own = {f"l{i:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäöüß") for _ in range(3)) for _ in range(4)] for i in range(600)}
    rows = [(n * 600 + i, " ".join(r.choice(w) for _ in range(12)), x) for n in range(8) for i, (x, w) in enumerate(own.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, sample_total=4_000)
    assert len(model.languages) == 600
    out = language_id.identify(df.where("doc_id % 7 = 0"), model).collect()
    assert sum(x.lang == x.lang_pred for x in out) >= 0.9 * len(out)
    assert len(language_id.fit(df, languages=5).languages) == 5


def test_language_id_against_numpy(spark):
    """IDF, FTRL and temperature against loops."""
    from siltwork.llm import linear

    texts = ["the cat sat", "le chat dort", "the dog", "", None, "le chien"]
    idf = language_id.inverse_frequencies(spark.createDataFrame([(t,) for t in texts if t is not None], "t string"))
    df = collections.Counter(c for t in texts if t for c in language_id.counts_of(t)[0].tolist())
    for cell in range(0, language_id.FEATURES, 97):
        assert abs(idf[cell] - (np.log(6 / (1 + df[cell])) + 1)) < 1e-12
    for cell, n in df.items():
        assert abs(idf[cell] - (np.log(6 / (1 + n)) + 1)) < 1e-12
    rng = np.random.default_rng(0)
    data = [(np.sort(rng.choice(12, 3, replace=False)), rng.random(3), int(rng.integers(3))) for _ in range(40)]
    got = linear.ftrl(data, 12, 3, epochs=2, alpha=0.5, l1=0.01, l2=0.1, seed=9)
    z, n, w = np.zeros((13, 3)), np.zeros((13, 3)), np.zeros((13, 3))
    order = np.random.default_rng(9)
    for _ in range(2):
        for i in order.permutation(40):
            at, x, y = data[i]
            cells = [*zip(at.tolist(), x.tolist()), (12, 1.0)]
            score = [sum(v * w[c, k] for c, v in cells) for k in range(3)]
            e = [np.exp(v - max(score)) for v in score]
            for c, v in cells:
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == y))
                    s = (np.sqrt(n[c, k] + g * g) - np.sqrt(n[c, k])) / 0.5
                    z[c, k] += g - s * w[c, k]
                    n[c, k] += g * g
            for c, _ in cells:
                for k in range(3):
                    w[c, k] = 0 if abs(z[c, k]) <= 0.01 else -(z[c, k] - np.sign(z[c, k]) * 0.01) / ((1 + np.sqrt(n[c, k])) / 0.5 + 0.1)
    assert np.allclose(got, w)
    logits, truth = np.array([[4.0, 0], [4, 0], [0, 4], [4, 0]]), np.array([0, 0, 1, 1])
    grid = np.geomspace(0.2, 5, 60)
    loss = [-np.mean([np.log(np.exp(a[t] / x) / np.exp(a / x).sum()) for a, t in zip(logits, truth)]) for x in grid]
    assert linear.fit_temperature(logits, truth) == pytest.approx(grid[int(np.argmin(loss))])


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = bpe.encode_decode(docs, path, keep=["doc_id", "text"]).collect()
    assert len(out) == len(ROWS)
    for r in out:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids
        assert r.n_tokens == len(ids)
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty, path, keep=["doc_id"]).count() == 0
    own = bpe.PairIndexBPE(json.load(open(path)))
    r = random.Random(1)
    texts = ["".join(r.choice("ab'e é1²ßſǅΣ.-_ \\ńà😀中aaaa") for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["<|endoftext|>a<|startoftext|>", "ΑΣ", "\0<|endoftext|>"]
    for x, y in zip(own.encode(texts), t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert x.tolist() == y.ids


def test_pipeline_hard_tables(spark, tmp_path, docs):
    """No rows; and rows with null ids, repeats and columns that clash with those that stages add."""
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(columns).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    clash = docs.select(*columns, *[F.lit(1).alias(c) for c in ("score", "lang_pred", "n_lines", "copies", "shard", "token_ids", "__row1", "component_id")])
    clash.write.parquet(f"{tmp_path}/clash/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/clash")
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    base = docs.select("doc_id", "text", "lang", "source", "n_chars", F.lit(7).alias("size"), F.lit(8).alias("n_lines"), F.lit(9).alias("score"))
    base.where("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == base.columns
        assert kept.where("size <> 7 or n_lines <> 8 or score <> 9").count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 0 < out.count()
    assert out.where("doc_id in (60, 61, 62)").count() == 0
    assert all(len(r.ids_sha256) == len(hashlib.sha256().hexdigest()) for r in out.collect())
