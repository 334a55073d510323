"""Rewards of small texts, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from siltwork.functions import rewards as R


def two(spark, f, a, b=None):
    return spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b")).alias("v")).first().v


def test_search(spark):
    f = lambda a, b: R.search_reward(a)
    assert two(spark, f, None) == two(spark, f, "<think>x</think> ") == 0.0
    # eight content words, one line, a source named
    assert two(spark, f, "Look into cited works about seven good things") == pytest.approx(round(0.35 + 0.35 * 8 / 35 + 0.2 / 3 + 0.1, 4))


def test_retrieve(spark):
    source = "We only use one small data set of images here."
    got = two(spark, R.retrieve_reward, "Evidence: we only use one small data set.\nQuote: zebras xylophone quagmire vortex.", source)
    assert got == pytest.approx(round(0.25 + 0.55 * 0.5 + 0.20 * 2 / 3, 4))
    assert two(spark, R.retrieve_reward, "", source) == 0.0


def test_synthesis(spark):
    source = "The authors only use one small data set of images here."
    text = '- It says "only use one small data set of images" which is a weak dataset choice'
    # grounded 1, 16 words, a concrete word, no name but the first capital (two letters), evidence 1, nothing alike
    got = two(spark, R.synthesis_reward, text, source)
    unit = 0.42 + 0.24 * (0.30 + 0.35) + 0.20 + 0.04
    assert got == pytest.approx(round(0.9 * round(unit, 4) + 0.1 * 0.8, 4))
    assert two(spark, R.synthesis_reward, None, source) == 0.0 and two(spark, R.synthesis_reward, text, None) is not None


def test_format(spark):
    good = "<think>a</think>\n## Limitations\n- [Major] x\n* [minor] y\n## Next\n- [Major] z"
    got = two(spark, lambda a, b: R.format_reward(a), good)
    assert (got.total, got.penalty, got.section, got.bullets) == (0.75, 0.0, 1.0, 0.5)
    assert two(spark, lambda a, b: R.format_reward(a), None).penalty == -0.5


def test_grounding_and_names(spark):
    paper = "PPO and DQN on GSM8K"
    assert two(spark, R.grounding_score, "we think of ppo", paper) == 1.0
    assert two(spark, R.grounding_score, "nothing", paper) == 0.0 and two(spark, R.grounding_score, "x", "") == 0.5
    assert two(spark, R.names_paper, "ppo against dqn", paper) and not two(spark, R.names_paper, "ppo", paper)


def test_generic(spark):
    assert two(spark, lambda a, b: R.generic_phrases(a), "Lacks ablation studies; limited generalizability") == 2
