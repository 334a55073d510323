"""Queries of the rule-based scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltwork.functions import quality as Q
from siltwork.operators import rule_score as RS
from siltwork.plans.catalog import conversation_pairs, query, spread, table


def _present(phrases, c="low"):
    return "(" + " + ".join(f"contains({c}, '{p}')::INT" for p in phrases) + ")"


def _found(*patterns, c="text"):
    patterns = [x.replace(r"\b", r"(?:[^\pL\pN_]|$)") for x in patterns]  # no look-around in DuckDB
    return "(" + " + ".join(f"len(regexp_extract_all({c}, '{p}'))" for p in patterns) + ")"


_HEADERS, _ITEMS = _found(r"\*\*[A-Z\[]"), _found(r"(?m)^\d+\.", r"(?m)^-\s", r"(?m)^\*\s")
_BASE = f"""t AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM documents),
    h AS (SELECT *, {_HEADERS} AS headers, {_ITEMS} AS items FROM t),
    p AS (SELECT *, greatest(CASE WHEN items >= 3 AND headers >= 3 THEN items ELSE headers + items END, 1) AS points FROM h)"""


@query(f"""WITH {_BASE}, s AS (SELECT *, {_present(Q.PRAISE)} AS praise, {_present(Q.CRITICISM)} AS criticism, {_present(Q.CATEGORIES)} AS covered FROM p)
    SELECT doc_id, points::BIGINT AS points, round(least({_present(Q.HEDGING)} / points::DOUBLE, 1.0), 6) AS hedging,
        round(least({_found(*['(?i)' + x for x in Q.SPECIFIC])} / greatest(length(text) / 500.0::DOUBLE, 1.0), 1.0), 6) AS specificity,
        round(least({_present(Q.CATASTROPHE)} * 0.15::DOUBLE + {_present(Q.VERDICT)} * 0.3::DOUBLE, 1.0), 6) AS catastrophizing,
        (CASE WHEN covered >= 9 THEN 1.0 WHEN covered >= 8 THEN 0.7 WHEN covered >= 7 THEN 0.3 ELSE 0.0 END)::DOUBLE AS checklist,
        least({_present(Q.OVERRIDE)} / 2.0::DOUBLE, 1.0)::DOUBLE AS overriding,
        round(CASE WHEN praise + criticism > 0 THEN praise / (praise + criticism)::DOUBLE ELSE 0 END, 6) AS praise_share,
        round(least({_found(r'(?i)(?:^|[^\pL\pN_])unclear\b')} / points::DOUBLE, 1.0), 6) AS unclear_share FROM s""")
def rule_phrase_scores(spark, d):
    t = F.col("text")
    six = {"hedging": Q.hedging, "specificity": Q.specificity, "catastrophizing": Q.catastrophizing, "checklist": Q.checklist, "overriding": Q.overriding, "praise_share": Q.praise_share, "unclear_share": Q.unclear_share}
    return spread(table(spark, d, "documents"), "doc_id").select("doc_id", Q.n_points(t).cast("long").alias("points"), *[F.round(f(t), 6).alias(n) for n, f in six.items()])


_CRUTCH = " + ".join(f"((length(low) - length(replace(low, '{p}', ''))) // {len(p)})" for p in Q.CRUTCH)
_STRIP = lambda x: f"regexp_replace({x}, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g')"


@query(f"""WITH {_BASE}, pts AS (SELECT doc_id, low, list_filter([{_STRIP('x')} FOR x IN regexp_split_to_array(text, '\\n\\s*\\n|\\n\\*\\*\\[|\\n\\*\\*[A-Z]|\\n\\d+\\.|\\n-\\s|\\n\\*\\s')], lambda x: length(x) > 20) AS ps FROM t),
    o AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, regexp_replace(lower(array_to_string(regexp_split_to_array(unnest(ps), '[ \\t-\\r]+')[1:8], ' ')), '{Q.STARTER_TOPIC}', 'CATEGORY', 'g') AS k FROM pts) GROUP BY ALL),
    m AS (SELECT doc_id, max(n) AS most FROM o GROUP BY doc_id)
    SELECT doc_id, len(ps) AS points, round(CASE WHEN len(ps) < 3 THEN 0 ELSE least(0.35::DOUBLE * most / len(ps) + 0.35::DOUBLE * least(({_CRUTCH}) / len(ps)::DOUBLE / 3.0, 1.0), 1.0) END, 6) AS formulaic FROM pts LEFT JOIN m USING (doc_id)""")
def rule_formulaic(spark, d):
    t = F.col("text")
    points = F.size(Q.pieces(t, r"\n\s*\n|\n\*\*\[|\n\*\*[A-Z]|\n\d+\.|\n-\s|\n\*\s", 20))
    return spread(table(spark, d, "documents"), "doc_id").select("doc_id", points.cast("long").alias("points"), F.round(Q.formulaic(t), 6).alias("formulaic"))


@query()
def rule_composite(spark, d):
    """The composite score of each answer against each question of its conversation (the ratios have no SQL form)."""
    got = RS.rule_scores(conversation_pairs(spark, d), "gt_text", "llm_text")
    return got.select("conv_id", "gt_id", "llm_id", F.round("similarity_to_gt", 6).alias("similarity_to_gt"), "redundancy", "structural_repetition", "flags", "rule_score")


@query("""WITH m AS (SELECT doc_id, quality * 4 + 1 AS a, CASE WHEN doc_id % 3 > 0 THEN toxic * 4 + 1 END AS b FROM labels), j AS (SELECT *, (a - 1) / 4.0::DOUBLE AS x, (b - 1) / 4.0::DOUBLE AS y FROM m),
    s AS (SELECT *, (0.6::DOUBLE * x + coalesce(0.4::DOUBLE * y, 0)) / (0.6::DOUBLE + CASE WHEN y IS NULL THEN 0 ELSE 0.4::DOUBLE END) AS judge FROM j)
    SELECT doc_id, round(judge, 6) AS judge, round((0.7::DOUBLE * judge + coalesce(0.3::DOUBLE * y, 0)) / (0.7::DOUBLE + CASE WHEN y IS NULL THEN 0 ELSE 0.3::DOUBLE END), 6) AS blend FROM s""")
def judge_blend(spark, d):
    marks = table(spark, d, "labels").select("doc_id", (F.col("quality") * 4 + 1).alias("a"), F.when(F.col("doc_id") % 3 > 0, F.col("toxic") * 4 + 1).alias("b"))
    got = RS.blended(RS.rescaled_judge(marks, {"a": 0.6, "b": 0.4}, "judge").withColumn("y", (F.col("b") - 1) / 4.0), {"judge": 0.7, "y": 0.3}, "blend")
    return got.select("doc_id", F.round("judge", 6).alias("judge"), F.round("blend", 6).alias("blend"))


@query(f"""WITH {_BASE} SELECT doc_id, length(text) AS gt_length, points::INT AS gt_num_limitations, round(least({_found(*['(?i)' + x for x in Q.SPECIFIC])} / greatest(length(text) / 500.0::DOUBLE, 1.0), 1.0), 3) AS gt_specificity FROM p""")
def reference_profile(spark, d):
    return RS.reference_profile(table(spark, d, "documents"), "text").select("doc_id", F.col("gt_length").cast("long").alias("gt_length"), "gt_num_limitations", "gt_specificity")
