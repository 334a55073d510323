"""Parsers on texts of which the items are known."""

import json

from pyspark.sql import functions as F

from siltwork.functions import parse as P
from siltwork.operators import retrieve as R


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v


REPORT = """Here is the consolidated list of limitations:
**Novelty & Significance:**
- The idea is known.
  It has been tried.
- Evidence: see page 3
- Limitation: No theory is given.
### Clarity:
1. Terms are vague.
* **Data**: Only one set
is used.
- **Ethics**:
'Nothing is said.'
"""


def test_report(spark):
    got = one(spark, P.report_items, REPORT)
    assert [(r.llm_id, r.category, r.limitation) for r in got] == [
        (0, "Novelty & Significance:", "The idea is known. It has been tried."),
        (1, "Novelty & Significance:", "No theory is given."),
        (2, "Clarity", "Terms are vague."),
        (3, "Data", "Only one set is used."),
        (4, "Ethics", "Nothing is said."),
    ]
    assert one(spark, P.report_items, None) == one(spark, P.report_items, " \n ") == []


def test_bullets(spark):
    assert one(spark, P.bullets, "<think>- no\n</think>\n- The first item goes\n  on here\n• The second item is long enough\n- short") == ["The first item goes on here", "The second item is long enough"]
    assert one(spark, P.bullets, "1. The first of two numbered ones\n2. The second of two numbered ones") == ["1. The first of two numbered ones", "The second of two numbered ones"]
    assert one(spark, P.bullets, None) == []


def test_lists(spark):
    assert one(spark, P.reference_items, "- The data are few\n2. Too short\nno") == ["The data are few"]
    assert [(r.gt_id, r.gt_text) for r in one(spark, P.numbered_lines, "a\n\n b ")] == [(0, "a"), (2, "b")]


def test_json(spark):
    assert json.loads(one(spark, P.json_text, 'So:\n```json\n{"a": [1, 2,],}\n```')) == {"a": [1, 2]}
    assert json.loads(one(spark, P.json_text, 'It is [{"a": 1}] then')) == [{"a": 1}]
    assert one(spark, P.json_text, "none") is None and one(spark, P.json_text, None) is None
    for cell, want in {"{'a': None, 'b': (1, 2)}": {"a": None, "b": [1, 2]}, '"[\'x\']"': ["x"], "nan": None, "": None, "[1": None}.items():
        got = one(spark, P.pyrepr_to_json, cell)
        assert (json.loads(got) if got else None) == want


def test_blocks(spark):
    assert one(spark, lambda c: P.boxed(c, "review"), "x < boxed_REVIEW > in\nside </boxed_review>") == "in\nside"
    assert one(spark, lambda c: P.boxed(c, "review"), None) == ""
    chat = one(spark, P.tagged_prompt_to_chat, "[SYSTEM] Be kind. [USER] Hello\nthere ")
    assert chat == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user\nHello\nthere<|im_end|>\n<|im_start|>assistant\n"
    assert P.SYSTEM_PROMPT in one(spark, P.tagged_prompt_to_chat, "Hello")


def test_entities_and_tags(spark):
    assert one(spark, P.entities, "PPO and Proximal Policy Optimization on GSM8K give 59.8% AND more") == ["59.8%", "gsm8k", "ppo", "proximal policy optimization"]
    assert one(spark, P.weakness_tags, "No ablation, and the Labels are noisy") == ["ablation", "data_quality"]
    assert one(spark, P.weakness_tags, None) == ["other"]
    assert one(spark, P.specialty, "the dataset has bias") == "data_ethics" and one(spark, P.specialty, "") == "other"
    f = one(spark, P.novelty_flags, "BinaryNoveltyFlag: 1\nDegreeNoveltyScore : 7")
    assert (f.flag, f.degree) == (1, 7) and one(spark, P.novelty_flags, None).flag is None


def test_chunks(spark):
    rows = [(1, "An abstract.", [("Intro", "A"), ("Intro", "B"), ("Gone", "nan"), (None, "C")]), (2, None, None)]
    df = spark.createDataFrame(rows, "id int, abs string, secs array<struct<heading:string,text:string>>")
    got = sorted((r.id, r.chunk_key, r.text) for r in R.chunks(df, "id", "abs", "secs").collect())
    assert got == [(1, "1::", "C"), (1, "1::abstract", "An abstract."), (1, "1::intro", "A"), (1, "1::intro__dup2", "B")]


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, k string, place int")
    b = spark.createDataFrame([(1, "y", 1)], "q int, k string, place int")
    assert [r.k for r in R.rank_fusion([(a, 0.5), (b, 0.5)], query="q", key="k", k=2).orderBy("place").collect()] == ["y", "x"]
