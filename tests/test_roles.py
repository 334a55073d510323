"""Report grammars against loops, and role rewards, redundancy and dense search on hard rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltwork.functions import roles as A
from siltwork.operators import pairs as P
from siltwork.operators import retrieve as RT

LINES = ["# Final List", "### Study design ", "####", "**Data:**", "**Data**", "1. **Title**: body", "2) **Open", "3. no stars", "- plain one", "* a: b: c", "- **Bold:** text ** more", "- **", "-x", "text", "  ", "  - indented", "- **Cat**", "•  dot"]


def texts_of(seed):
    r = random.Random(seed)
    return [None, "", "\n"] + ["\n".join(r.choice(LINES) for _ in range(r.randint(1, 9))) for _ in range(80)]


def parsed(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("x")).collect()
    return {r.i: [(x.llm_id, x.category, x.limitation) for x in r.x] for r in rows}


def test_headed_items(spark):
    def plain(text):
        out, category = [], "General"
        for line in (x.strip(" \t\n\r\xa0") for x in (text or "").splitlines()):
            if line.startswith("#"):
                bare = line.lstrip("#").strip()
                category = category if "Final List" in bare else bare
            elif m := re.match(r"^\*\*(.*?)\*\*:?$", line):
                category = m[1].strip()
            elif "**" in line and line[:1].isdigit():
                if line.count("**") > 1:
                    _, title, rest = line.split("**", 2)
                    out.append((len(out), category, f"{title.strip()}: {rest.lstrip(': ').strip()}"))
            elif line[:1] in ("-", "*") and line:
                body = line[1:].strip()
                if body.count("**") > 1:
                    _, title, rest = body.split("**", 2)
                    body = f"{title.strip()}: {rest.lstrip(': ').strip()}"
                elif ":" in body and "**" not in body:
                    body = ": ".join(x.strip() for x in body.split(":", 1))
                out.append((len(out), category, body))
        return out

    texts = texts_of(3)
    assert parsed(spark, A.headed_items, texts) == {i: plain(t) for i, t in enumerate(texts)}


def test_listed_items(spark):
    def plain(text):
        out, category = [], "General"
        for line in (x.rstrip() for x in (text or "").strip().split("\n")):
            if m := re.match(r"^\s*-\s*\*\*(.+?)\*\*", line):
                category = m[1].strip().strip(" :")
            elif not line.strip().startswith("- **") and (m := re.match(r"^\s*-\s+(.+)$", line)):
                out.append((len(out), category, m[1].strip()))
        return out

    texts = texts_of(4)
    assert parsed(spark, A.listed_items, texts) == {i: plain(t) for i, t in enumerate(texts)}


def test_role_rewards_of_nothing(spark):
    none = F.lit(None).cast("string")
    claim = "array<struct<claim:string,section:string,type:string,evidence_quote:string>>"
    item = "array<struct<limitation:string,category:string,severity:string>>"
    strings, half = F.lit(None).cast("array<string>"), F.lit(0.5)
    got = spark.range(1).select(
        A.claims_step(F.lit(None).cast(claim), strings, half).alias("a"),
        A.claims_step(F.array().cast(claim), strings, half).alias("b"),
        A.novelty_step(none, half, strings).alias("c"),
        A.scope_step(none, half).alias("d"),
        A.limitations_step(F.lit(None).cast(item), half, half, half, half).alias("e"),
        A.handoff(none, F.array().cast("array<string>"))["coverage"].alias("f"),
        A.item_list_f1(F.lit(0), F.lit(0), F.lit(0), F.lit(3), half).alias("g"),
        A.role_reward(A.role_parts(none, "citation"), F.lit(None).cast("double")).alias("h"),
        A.combined_reward(half, F.lit(None).cast("double"), F.lit(1.0)).alias("i"),
    ).first()
    assert list(got)[:7] == [0.0] * 7
    assert got.h == pytest.approx((1.5 * 0.5 + 0.2) / 7) and got.i == pytest.approx(0.75)


def test_group_redundancy(spark):
    rows = [(1, 0, "alpha beta gamma"), (1, 1, "alpha beta gamma"), (1, 2, "delta epsilon"), (2, 0, "same words here"), (2, 1, "same words here"), (3, 0, "alone"), (4, 0, None), (4, 1, ""), (4, 2, "a b"), (4, 3, "b a"), (5, 0, "x"), (5, 1, None)]
    got = {r.k: r.redundancy for r in P.group_redundancy(spark.createDataFrame(rows, "k int, i int, t string"), ["k"], "i", "t").collect()}
    assert got == pytest.approx({1: 2 / 3, 2: 1.0, 3: 0.0, 4: 0.5, 5: 0.0})


def test_dense_apart_with_zeros_and_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(i, ["a", "b", None][i % 3], [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, g string, v array<double>")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for apart in (None, "g"):
        got = sorted((r.query_id, r.place, r.k, r.score) for r in RT.dense_exact(df, df.where("k % 5 = 0"), key="k", vector="v", k=4, apart=apart).collect())
        want = []
        for q, g, v in rows[::5]:
            near = sorted((-round(float(unit(v) @ unit(w)), 6), k) for k, h, w in rows if any(v) and any(w) and k != q and not (apart and g == h))
            want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(near[:4])]
        assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want])


def test_boilerplate(spark):
    items = F.array(F.lit("Transformers overfit graphs"), F.lit("the paper is limited"), F.lit("nothing shared whatsoever"), F.lit(""))
    none = F.lit(None).cast("array<string>")
    got = spark.range(1).select(A.boilerplate_share(items, F.lit("TRANSFORMERS on things")).alias("a"), A.boilerplate_share(items, F.lit("")).alias("b"), A.boilerplate_share(none, F.lit("x")).alias("c")).first()
    assert tuple(got) == (0.75, 0.5, 0.5)
