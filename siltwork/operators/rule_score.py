"""The composite rule score of a rejected text against its chosen one, with sub-scores, flags and hard caps."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.functions import quality as Q


def rule_scores(rows: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """Adds the sub-scores, flags (array) and rule_score. A rejected text under 100 stripped characters scores 0 and
    has the one flag rejected_too_short. The costly ratios are asked for once a row, in one Arrow exchange."""
    a, b = F.coalesce(F.col(chosen), F.lit("")), F.coalesce(F.col(rejected), F.lit(""))
    sub = {name: F.round(f(b), 3) for name, f in Q.SCORES.items()}
    out = rows.withColumns(
        {
            "__sim": Q.sequence_ratio(F.substring(a, 1, 2000), F.substring(b, 1, 2000)),
            "redundancy": F.round(Q.redundancy(b), 3),
            "structural_repetition": F.round(Q.structural_repetition(b), 3),
        }
    )
    out = out.withColumns(
        sub
        | {
            "length_inflation": F.round(Q.inflation(b, a), 3),
            "num_limitations": Q.n_points(b),
            "gt_num_limitations": Q.n_points(a),
            "gt_specificity": F.round(Q.specificity(a), 3),
            "length_ratio": F.length(b) / F.greatest(F.length(a), F.lit(1)),
        }
    )
    c = F.col
    raised = {
        "too_similar_to_gt": c("__sim") > 0.70,
        "rejected_too_short_ratio": c("length_ratio") < 0.10,
        "override_compliance": c("override_compliance") >= 0.5,
        "catastrophized": c("catastrophization") >= 0.5,
        "formulaic_checklist": (c("formulaic") > 0.6) & (c("checklist_coverage") >= 0.7),
        "unclear_x_padding": (c("unclear_ratio") > 0.6) & (c("num_limitations") >= 5),
        "evidence_all_absence": c("absence_evidence") > 0.7,
        "intra_category_repetition": c("structural_repetition") > 0.65,
        "more_praise_than_criticism": c("praise_ratio") > 0.5,
        "rejected_more_specific_than_gt": (c("specificity") > c("gt_specificity") * 2.5) & (c("specificity") > 0.5),
        "two_bullet_template": c("two_bullet_per_cat") > 0.7,
        "length_inflated": c("length_inflation") > 0.5,
    }
    short = F.length(F.regexp_replace(b, r"^\s+|\s+$", "")) < 100
    flags = F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on in raised.items()]))
    out = out.withColumn("flags", F.when(short, F.array(F.lit("rejected_too_short"))).otherwise(flags))
    n = F.size("flags")
    flaw = Q.capped(reduce(add, [c(x) for x in Q.FLAWS]) / len(Q.FLAWS) * 2.0)
    plausible = F.greatest(1.0 - c("override_compliance") * 0.5 - c("catastrophization") * 0.4 - c("praise_ratio") * 0.3, F.lit(0.0))
    hard = F.when(n == 0, 0.9).when(n <= 2, 1.0).when(n <= 4, 0.6).otherwise(0.2)
    hard = F.when((c("specificity") > 0.1) & (c("num_limitations") >= 3), Q.capped(hard + 0.1)).otherwise(hard)
    total = 0.20 * plausible + 0.25 * Q.capped((1.0 - c("__sim")) * 1.5) + 0.30 * flaw + 0.25 * hard
    for flag, most, when in (("too_similar_to_gt", 0.15, F.lit(True)), ("override_compliance", 0.20, c("override_compliance") >= 0.8), ("rejected_too_short_ratio", 0.10, F.lit(True))):
        total = F.when(F.array_contains("flags", flag) & when, F.least(total, F.lit(most))).otherwise(total)
    return out.withColumn("rule_score", F.when(short, 0.0).otherwise(F.round(total, 3))).withColumnRenamed("__sim", "similarity_to_gt")


def reference_profile(rows: DataFrame, text: str) -> DataFrame:
    c = F.col(text)
    return rows.withColumns(
        {
            "gt_length": F.coalesce(F.length(c), F.lit(0)),
            "gt_num_limitations": Q.n_points(c),
            "gt_specificity": F.round(Q.specificity(c), 3),
            "gt_checklist_coverage": Q.checklist(c),
            "gt_hedging_ratio": F.round(Q.hedging(c), 3),
        }
    )


def rescaled_judge(rows: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """The mean of marks 1 to 5, each brought to 0 to 1, over those present, with their weights renormalised; null
    without any."""
    have = [F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in weights.items()]
    got = [F.coalesce((F.col(k) - 1) / 4.0 * w, F.lit(0.0)) for k, w in weights.items()]
    weight = reduce(add, have)
    return rows.withColumn(name, F.when(weight > 0, reduce(add, got) / weight))


def blended(rows: DataFrame, parts: dict[str, float], name: str) -> DataFrame:
    """The weighted mean of the columns that are not null; null where all are."""
    weight = reduce(add, [F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in parts.items()])
    total = reduce(add, [F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in parts.items()])
    return rows.withColumn(name, F.when(weight > 0, total / weight))
