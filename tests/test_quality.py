"""Rule scores on small texts of which the score is known."""

import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from siltwork.functions import quality as Q
from siltwork.operators import rule_score as RS
from siltwork.plans.catalog import spread

LIST = "**Novelty**\n* The idea is unclear and it may not generalize at all.\n* The idea is unclear and may not be new to anyone.\n**Clarity**\n* Table 3 is unclear in Section 4 of the paper.\n"


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v


def test_points(spark):
    assert one(spark, Q.n_points, LIST) == 5  # two headers and three items: headers are scarce
    assert one(spark, Q.n_points, "1. a\n2. b\n- c") == 3
    assert one(spark, Q.n_points, "") == one(spark, Q.n_points, None) == 1


def test_shares(spark):
    assert one(spark, Q.unclear_share, LIST) == pytest.approx(3 / 5)
    assert one(spark, Q.praise_share, "excellent, but lack of data") == pytest.approx(0.5)
    assert one(spark, Q.overriding, "Strong accept: exceptional merit") == 1.0
    blocks = "(Evidence: it does not discuss x) (Evidence: only reports y) (Evidence: fine)"
    assert one(spark, Q.absence_share, blocks) == pytest.approx(2 / 3)
    assert one(spark, Q.two_bullet_share, "**Aa** intro that is long enough\n* x\n* y\n**Bb** intro that is long enough\n* x\n* y\n**Cc** intro that is long enough\n* x") == pytest.approx(2 / 3)


def test_most_frequent(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c"],), ([],)], "v array<string>")
    assert [r.n for r in df.select(Q.most_frequent(F.col("v")).alias("n")).collect()] == [2, 0]


def test_redundancy_is_the_mean_ratio(spark):
    ps = ["The first point is about the data that was used.", "The second point is about the model that was used.", "Nothing like the others, this is on ethics only."]
    want = [SequenceMatcher(None, ps[i].lower(), ps[j].lower()).ratio() for i, j in ((0, 1), (0, 2), (1, 2))]
    assert one(spark, Q.redundancy, "\n\n".join(ps)) == pytest.approx(sum(want) / 3)
    assert one(spark, Q.redundancy, "short") == 0.0


def test_composite(spark):
    rows = spark.createDataFrame([(1, LIST, LIST), (2, LIST, "short"), (3, None, None), (4, "The data set is small. " * 9, LIST)], "id int, a string, b string")
    got = {r.id: r for r in RS.rule_scores(rows, "a", "b").collect()}
    assert got[1].similarity_to_gt == 1.0 and "too_similar_to_gt" in got[1].flags and got[1].rule_score <= 0.15
    assert got[2].flags == got[3].flags == ["rejected_too_short"] and got[2].rule_score == got[3].rule_score == 0.0
    assert 0.15 < got[4].rule_score <= 1.0


def test_blends_skip_missing_parts(spark):
    rows = spark.createDataFrame([(5.0, None), (1.0, 5.0), (None, None)], "a double, b double")
    got = RS.rescaled_judge(rows, {"a": 0.6, "b": 0.4}, "j").collect()
    assert [None if r.j is None else round(r.j, 6) for r in got] == [1.0, 0.4, None]


def test_word_boundaries(spark):
    texts = ["unclear", "Unclear, _unclear unclear_ éunclear unclearé", "xunclear unclear-x", "\nunclear\nUNCLEAR", "ResNet ResNetx AlexNet", "NAS NASA xNAS", "A b a", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in (r"(?i)\bunclear\b", r"[A-Z][a-z]+Net\b", r"NAS\b", r"\bA\b", r"\b(some|b)\b", r"\b\d+"):
        got = [r.n for r in rows.select(Q.matches(F.col("t"), p).alias("n")).collect()]
        assert got == [len(re.findall(p, t or "")) for t in texts], p


def test_spread_keeps_rows(spark):
    one = spark.range(50).coalesce(1)
    assert sorted(r.id for r in spread(one, "id").collect()) == list(range(50)) and spread(one, "id").rdd.getNumPartitions() > 1
    many = spark.range(0, 50, 1, 64)
    assert spread(many, "id") is many
