"""Folds and flows that SQL can't express, against loops; joins and sets on hard rows."""

import random
import re

from pyspark.sql import functions as F

from siltwork.functions import context as C
from siltwork.operators import flows as W
from siltwork.operators import tables as TB


def test_continued_bullets(spark):
    r = random.Random(2)
    lines = ["- one item", "* two", "3) three", "more of it", "  ", "12. last", "and on", "-no bullet"]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(0, 9))) for _ in range(60)] + [None, ""]

    def plain(text):
        out = []
        for x in map(str.strip, (text or "").split("\n")):
            if x and (m := re.match(r"(?:[-*•]|[0-9]+[.)])\s+", x)):
                out.append(x[m.end() :])
            elif x and out:
                out[-1] += " " + x
        return out

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", C.continued_bullets(F.col("t")).alias("b")).collect()
    assert {x.i: x.b for x in rows} == {i: plain(t) for i, t in enumerate(texts)}


def test_pieces_cover_the_text(spark):
    for n in (0, 1, 511, 512, 513, 974, 975, 2000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        got = spark.createDataFrame([(text,)], "t string").select(C.overlapping_pieces(F.col("t")).alias("p")).first().p
        assert all(len(x) <= 512 for x in got) and "".join(got[:1] + [x[50:] for x in got[1:]]) == text


def test_tables_on_hard_rows(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    side = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 1)], "k int, v string, n int")
    assert sorted((str(x.k), x.v) for x in TB.lookup(left, side, "k", "v", "n", F.lit("-")).collect()) == [("1", "b"), ("2", "-"), ("None", "-")]
    lists = spark.createDataFrame([(1, [3, 2, 3, 9]), (2, []), (3, None)], "k int, ids array<int>")
    got = TB.known_in_order(lists, "k", "ids", spark.createDataFrame([(2,), (3,), (3,)], "id int"), "id").collect()
    assert {x.k: x.ids for x in got} == {1: [3, 2], 2: [], 3: []}
    rows = spark.createDataFrame([(i, name) for i, name in enumerate(["A b", None, "a B", "", "c", ""])], "i int, t string").withColumn("g", F.lit(1))
    assert [x.i for x in TB.ordered_distinct(rows, ["g"], F.col("t"), ["i"], 9).orderBy("i").collect()] == [0, 1, 3, 4, 5]
    few = spark.range(15).select(F.col("id").alias("k"))
    assert {x.split for x in TB.row_split(few, "k", 0.5, 1).collect()} == {"train"}
    assert TB.row_split(few.limit(0), "k", 0.5, 1).count() == 0


def test_six_gates(spark):
    rows = [("p%d" % (i // 4), i, 5 if i % 9 == 0 else 50, 1, i % 5, i % 2 == 0, 0.0, 0.3, 1 - i / 100, [float(i % 3), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "paper string, arrival int, words int, bullets int, generic int, names boolean, alike double, coverage double, score double, v array<double>")
    got = W.six_gates(df, ["paper"], 6, 3).collect()
    best = {}
    for p, a, w, _, g, n, _, _, s, v in rows:
        if w >= 20:
            s = round(s * 0.7, 6) if g >= 3 and not n else s
            if p not in best or (s, -a) > best[p][:2]:
                best[p] = (s, -a, v[0])
    assert len(got) == 6 and all(best[x.paper][1] == -x.arrival and abs(best[x.paper][0] - x.score) < 1e-9 for x in got)
    # Two of each cluster: clusters are the three points.
    assert sorted(sum(x.v[0] == c for x in got) for c in (0.0, 1.0, 2.0)) == [2, 2, 2]


def test_unified_score_flags(spark):
    names = [*W.FLAW_WEIGHTS, "override_compliance", "catastrophization", "similarity_to_gt", "gt_specificity", "specificity", "num_limitations", "gt_num_limitations", *(f"judge_{x}" for x in ("plausibility", "distinctness", "flaw_clarity", "gt_superiority", "difficulty"))]
    df = spark.createDataFrame([(0, []), (1, ["drop_me"]), (2, ["rejected_more_specific_than_gt"])], "i int, flags array<string>").select("*", *[F.lit(None).cast("double").alias(n) for n in names])
    got = {x.i: (x.unified, x.verdict) for x in W.unified_score(df, "flags", ("drop_me",)).collect()}
    # By hand: .15 * .8 + .2 * .8 + .3 * .15 + .2 * .44 + .15 * .56
    assert abs(got[0][0] - (0.15 * 0.8 + 0.2 * 0.8 + 0.3 * 0.15 + 0.2 * 0.44 + 0.15 * 0.56)) < 1e-6 and got[0][1] == "marginal"
    assert got[1] == (0.1, "drop") and got[2] == (0.3, "drop")
