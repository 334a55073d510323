"""Queries of selection flows and of the rewards that they select by, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltwork.functions import metrics as M
from siltwork.functions import text as T
from siltwork.operators import flows as W
from siltwork.operators import match
from siltwork.operators import select as S
from siltwork.operators.order import with_rank
from siltwork.plans.catalog import _ITEMS, conversation_pairs, query, table
from siltwork.sources import files
from siltwork.sources.shared import fresh_path

_LI = "SELECT l_orderkey, l_partkey, max(l_linenumber) AS l_linenumber, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount, max(l_tax) AS l_tax FROM lineitem GROUP BY l_orderkey, l_partkey"


def _candidates(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(*[F.max(c).alias(c) for c in ("l_linenumber", "l_quantity", "l_discount", "l_tax")])


def _sql_hits(patterns) -> str:
    return "(" + " + ".join("regexp_matches(t, '(?i){}')::INT".format(p) for p in patterns) + ")"


_SEV = lambda words: "(" + " + ".join(f"contains(low, '{w}')::INT" for w in words) + ")"


@query(f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM conversations)
    SELECT conv_id, turn, round(least(1, len(regexp_extract_all(t, '{W.REFERENCES}')) * 0.12::DOUBLE + len(regexp_extract_all(t, '{W.QUOTES}')) * 0.08::DOUBLE), 6) AS groundedness, round(least(1, {_sql_hits(W.SPECIFICS)} / 3.0::DOUBLE), 6) AS specifics,
    round(least(1, {_sql_hits(W.CRITICAL)} / 5.0::DOUBLE), 6) AS criticality, round(least(1, {_sql_hits(W.EVIDENCE)} / 3.0::DOUBLE), 6) AS evidence,
    CASE WHEN {_SEV(W.MAJOR)} > {_SEV(W.MINOR)} THEN 'major' WHEN {_SEV(W.MINOR)} > {_SEV(W.MAJOR)} THEN 'minor' ELSE 'neutral' END AS severity FROM t""")
def answer_signals(spark, d):
    """Groundedness, specifics, criticality, evidence and severity of each text."""
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(W.groundedness(t), 6).alias("groundedness"), F.round(W.specifics(t), 6).alias("specifics"), F.round(W.criticality(t), 6).alias("criticality"), F.round(W.evidence(t), 6).alias("evidence"), W.severity(t).alias("severity"))


_RULE = f"""{_ITEMS}, c AS (SELECT conv_id, avg((m > 0.1)::INT) AS coverage FROM (SELECT conv_id, gt_id, max(j) AS m FROM sims GROUP BY ALL) GROUP BY 1), p AS (SELECT conv_id, avg((m > 0.1)::INT) AS precision FROM (SELECT conv_id, llm_id, max(j) AS m FROM sims GROUP BY ALL) GROUP BY 1),
    a AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
    w AS (SELECT conv_id, a.turn AS x, b.turn AS y, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(a.text, '')), '[ \\t-\\r]+'), lambda z: z <> '')) AS u, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(b.text, '')), '[ \\t-\\r]+'), lambda z: z <> '')) AS v
        FROM conversations a JOIN conversations b USING (conv_id) WHERE a.role = 'assistant' AND b.role = 'assistant' AND a.turn < b.turn),
    k AS (SELECT conv_id, CASE WHEN len(u) + len(v) > 0 THEN len(list_intersect(u, v)) / (len(u) + len(v) - len(list_intersect(u, v)))::DOUBLE ELSE 0 END AS j FROM w),
    r AS (SELECT conv_id, avg((j > 0.5)::INT) AS redundancy FROM k GROUP BY conv_id),
    g AS (SELECT conv_id, coverage, precision, coalesce(redundancy, 0) AS redundancy, least(1, len(regexp_extract_all(t, '{W.REFERENCES}')) * 0.12::DOUBLE + len(regexp_extract_all(t, '{W.QUOTES}')) * 0.08::DOUBLE) AS groundedness, least(1, {_sql_hits(W.SPECIFICS)} / 3.0::DOUBLE) AS specificity,
        least(1, {_sql_hits(W.CRITICAL)} / 5.0::DOUBLE) AS criticality, least(1, {_sql_hits(W.EVIDENCE)} / 3.0::DOUBLE) AS grounded FROM c JOIN p USING (conv_id) JOIN a USING (conv_id) LEFT JOIN r USING (conv_id))"""


@query(f"""WITH {_RULE} SELECT conv_id, round(redundancy, 6) AS redundancy, round(greatest(0, (2 * coverage + 1.5::DOUBLE * precision + groundedness - 0.5::DOUBLE * redundancy + specificity + criticality) / 7), 6) AS rule_reward,
    round(greatest(0, least(1, 0.35::DOUBLE * coverage + 0.25::DOUBLE * precision + 0.15::DOUBLE * grounded - 0.1::DOUBLE * redundancy + 0.15::DOUBLE * 0.5)), 6) AS zero_shot FROM g""")
def rule_rewards(spark, d):
    """Rule reward and zero-shot reward of each paper's answers, from coverage, precision, redundancy and signals."""
    j = T.jaccard(T.tokens(F.col("gt_text"), 3), T.tokens(F.col("llm_text"), 3))
    pairs = conversation_pairs(spark, d).select("conv_id", "gt_id", "llm_id", j.alias("j"))
    both = match.coverage(pairs, ["conv_id"], "gt_id", F.col("j"), 0.1, "coverage").join(match.coverage(pairs, ["conv_id"], "llm_id", F.col("j"), 0.1, "precision"), "conv_id")
    said = table(spark, d, "conversations").where("role = 'assistant'")
    alike = said.select("conv_id", "turn", T.spaced_words(F.col("text")).alias("w"))
    one, other = alike.withColumnsRenamed({"turn": "a", "w": "wa"}), alike.withColumnsRenamed({"turn": "b", "w": "wb"})
    redundant = one.join(other, "conv_id").where("a < b").groupBy("conv_id").agg(F.avg((T.jaccard(F.col("wa"), F.col("wb")) > 0.5).cast("double")).alias("redundancy"))
    text = said.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("t"))
    got = both.join(text, "conv_id").join(redundant, "conv_id", "left").withColumn("redundancy", F.coalesce("redundancy", F.lit(0.0)))
    t, c = F.col("t"), F.col
    parts = {"coverage": c("coverage"), "precision": c("precision"), "redundancy": c("redundancy"), "groundedness": W.groundedness(t), "specificity": W.specifics(t), "criticality": W.criticality(t), "grounded": W.evidence(t), "severity": F.lit(0.5)}
    return got.select("conv_id", F.round("redundancy", 6).alias("redundancy"), F.round(W.weighted_reward(parts, W.RULE_WEIGHTS, True), 6).alias("rule_reward"), F.round(W.weighted_reward(parts, W.ZERO_SHOT_WEIGHTS, False), 6).alias("zero_shot"))


@query(f"""WITH x AS (SELECT l_orderkey, l_partkey, l_discount * 5 AS f, l_tax * 10 AS s, l_quantity, l_linenumber FROM ({_LI})),
    p AS (SELECT *, 0.6::DOUBLE * greatest(1 - f * 0.6::DOUBLE - s * 0.5::DOUBLE - f * 0.4::DOUBLE, 0) + 0.4::DOUBLE * 0.5 AS plausibility, 0.6::DOUBLE * least((1 - s) * 1.3::DOUBLE, 1) + 0.4::DOUBLE * (l_linenumber % 5) / 4.0::DOUBLE AS distinctness,
        0.7::DOUBLE * least((0.15::DOUBLE * f + 0.15::DOUBLE * s + 0.05::DOUBLE * f) * 2.5, 1) + 0.3::DOUBLE * 0.5 AS flaw,
        0.3::DOUBLE * CASE WHEN s > 0 THEN least(s / greatest(f, 0.01::DOUBLE), 3) / 3 ELSE 0.5::DOUBLE END + 0.3::DOUBLE * CASE WHEN l_quantity > 40 THEN 0.7::DOUBLE WHEN l_quantity > 20 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END + 0.4::DOUBLE * 0.5 AS gt,
        0.6::DOUBLE * CASE WHEN l_quantity = 50 THEN 0 WHEN l_quantity % 2 = 0 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END + 0.4::DOUBLE * 0.5 AS difficulty FROM x),
    u AS (SELECT *, 0.15::DOUBLE * plausibility + 0.2::DOUBLE * distinctness + 0.3::DOUBLE * flaw + 0.2::DOUBLE * gt + 0.15::DOUBLE * difficulty AS u FROM p),
    c AS (SELECT *, CASE WHEN l_quantity = 50 THEN least(u, 0.1::DOUBLE) WHEN l_quantity % 2 = 0 THEN least(u, 0.35::DOUBLE) ELSE u END AS c FROM u)
    SELECT l_orderkey, l_partkey, round(c, 6) AS unified, CASE WHEN round(c, 6) >= 0.65 THEN 'excellent' WHEN round(c, 6) >= 0.5 THEN 'good' WHEN round(c, 6) >= 0.35 THEN 'marginal' ELSE 'drop' END AS verdict FROM c""")
def unified_scores(spark, d):
    """The unified score of pairs with its verdict."""
    c, none = F.col, F.lit(None).cast("double")
    f, s = c("l_discount") * 5, c("l_tax") * 10
    flags = F.array_compact(F.array(F.when(c("l_quantity") == 50, "too_similar_to_gt"), F.when(c("l_quantity") % 2 == 0, "more_praise_than_criticism")))
    rows = _candidates(spark, d).select("l_orderkey", "l_partkey", f.alias("override_compliance"), s.alias("catastrophization"), f.alias("praise_ratio"), s.alias("similarity_to_gt"), f.alias("hedging_ratio"), s.alias("formulaic"), s.alias("gt_specificity"), f.alias("specificity"), c("l_quantity").alias("num_limitations"), F.lit(20).alias("gt_num_limitations"),
        *[none.alias(n) for n in ("checklist_coverage", "absence_evidence", "redundancy", "structural_repetition", "unclear_ratio", "two_bullet_per_cat", "length_inflation", "judge_plausibility", "judge_flaw_clarity", "judge_gt_superiority", "judge_difficulty")], (c("l_linenumber") % 5 + 1).alias("judge_distinctness"), flags.alias("flags"))
    return W.unified_score(rows, "flags", ("too_similar_to_gt",)).select("l_orderkey", "l_partkey", "unified", "verdict")


@query(f"""WITH x AS (SELECT l_orderkey, l_partkey, l_quantity AS f, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax END AS s FROM ({_LI})), k AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY f DESC, l_partkey) <= 4),
    n AS (SELECT *, (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) AS n1, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS n2 FROM k),
    b AS (SELECT *, round(CASE WHEN n2 IS NULL THEN n1 ELSE (0.5::DOUBLE * n1 + 0.5::DOUBLE * n2) / 1 END, 6) AS blended FROM n)
    SELECT l_orderkey, l_partkey, blended, row_number() OVER (PARTITION BY l_orderkey ORDER BY blended DESC, l_partkey) AS place FROM b""")
def two_stage_selection(spark, d):
    """The best of a first score, ranked by the blend of both."""
    rows = _candidates(spark, d).select("l_orderkey", "l_partkey", F.col("l_quantity").cast("double").alias("f"), F.when(F.col("l_linenumber") == 2, None).otherwise(F.col("l_tax").cast("double")).alias("s"))
    return W.two_stage(rows, ["l_orderkey"], "f", "s", "l_partkey").select("l_orderkey", "l_partkey", "blended", F.col("place").cast("long").alias("place"))


@query(f"""WITH x AS (SELECT l_orderkey, l_partkey AS a, l_quantity / 50.0::DOUBLE AS s, round((1 - l_discount * 10) * 0.5::DOUBLE + (1 - CASE WHEN l_linenumber = 1 THEN 0.5::DOUBLE ELSE l_tax * 10 END) * 0.5::DOUBLE, 9) AS d FROM ({_LI})),
    b AS (SELECT l_orderkey, a AS chosen, s AS cs FROM x QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, a) = 1), w AS (SELECT x.l_orderkey, chosen, a AS rejected, cs - s AS gap FROM x JOIN b USING (l_orderkey) WHERE a <> chosen QUALIFY row_number() OVER (PARTITION BY x.l_orderkey ORDER BY d DESC, s DESC, a) = 1)
    SELECT l_orderkey, chosen, rejected, round(gap, 6) AS score_gap FROM w WHERE round(gap, 9) >= 0.05""")
def least_alike_pairs(spark, d):
    rows = _candidates(spark, d).select("l_orderkey", "l_partkey", (F.col("l_quantity") / 50.0).alias("s"), (F.col("l_discount") * 10).alias("sim"), F.when(F.col("l_linenumber") == 1, None).otherwise(F.col("l_tax") * 10).alias("cov"))
    got = W.least_alike_pairs(rows, ["l_orderkey"], "s", "sim", "cov", "l_partkey")
    return got.select("l_orderkey", "chosen", "rejected", F.round("score_gap", 6).alias("score_gap"))


@query("""WITH e AS (SELECT vec_id, label, [abs(x)::DOUBLE + 1e-3 FOR x IN embedding] AS p, [x::DOUBLE * x + 1e-3 FOR x IN embedding] AS q FROM embeddings), n AS (SELECT vec_id, label, [x / list_sum(p) FOR x IN p] AS p, [x / list_sum(q) FOR x IN q] AS q FROM e),
    j AS (SELECT label, vec_id, round(1 - list_sum([(p[i] * log2(2 * p[i] / (p[i] + q[i])) + q[i] * log2(2 * q[i] / (p[i] + q[i]))) / 2 FOR i IN range(1, len(p) + 1)]), 6) AS r FROM n),
    k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY r DESC, vec_id) AS b, row_number() OVER (PARTITION BY label ORDER BY r, vec_id DESC) AS w FROM j)
    SELECT x.label, x.vec_id AS chosen, y.vec_id AS rejected, round(x.r - y.r, 6) AS score_gap FROM k x JOIN k y ON x.label = y.label AND x.b = 1 AND y.w = 1 WHERE x.vec_id <> y.vec_id AND x.r - y.r >= 0""")
def divergence_selection(spark, d):
    """Best and worst of each group by one minus the divergence of two distributions."""
    p = F.transform("embedding", lambda x: F.abs(x).cast("double") + 1e-3)
    q = F.transform("embedding", lambda x: x.cast("double") * x + 1e-3)
    rows = table(spark, d, "embeddings").select("label", "vec_id", p.alias("p"), q.alias("q")).select("label", "vec_id", F.round(1 - M.divergence_bits(F.col("p"), F.col("q")), 6).alias("r"))
    return S.best_worst(rows, ["label"], "r", "vec_id", 0.0).select("label", "chosen", "rejected", F.round("score_gap", 6).alias("score_gap"))


@query("""WITH l AS (SELECT item_id, 'cut' AS mode, left(text, 30) AS rejected, text FROM benchmark UNION ALL SELECT item_id, 'quiet', lower(text), text FROM benchmark UNION ALL SELECT item_id, 'same', text, text FROM benchmark)
    SELECT item_id, mode, rejected FROM l WHERE length(trim(rejected)) >= 20 AND length(trim(text)) >= 20 AND trim(rejected) <> trim(text)""")
def perturbation_pairs(spark, d):
    """The reference against each perturbed form, with its failure mode."""
    rows = table(spark, d, "benchmark").select("item_id", "text", F.substring("text", 1, 30).alias("a"), F.lower("text").alias("b"), F.col("text").alias("c"))
    return W.unpivoted_pairs(rows, "item_id", "text", {"a": "cut", "b": "quiet", "c": "same"}, 20).select("item_id", "mode", "rejected")


_GATED = f"""x AS (SELECT l_orderkey, l_partkey, l_quantity / 50.0::DOUBLE AS s, l_linenumber AS generic, l_discount > 0.05 AS names, l_tax * 12 AS alike, l_discount * 10 AS coverage FROM ({_LI})),
    t AS (SELECT *, CASE WHEN generic >= 3 AND NOT names THEN s * 0.7::DOUBLE ELSE s END AS s1 FROM x), u AS (SELECT *, round(CASE WHEN alike > 0.85 THEN s1 * 0.7::DOUBLE ELSE s1 END, 6) AS s2 FROM t),
    g AS (SELECT *, round(CASE WHEN coverage >= 0.5 THEN s2 * 1.1::DOUBLE WHEN coverage < 0.2 THEN s2 * 0.85::DOUBLE ELSE s2 END, 6) AS s3 FROM u)"""


def _gated(spark, d):
    c = F.col
    rows = _candidates(spark, d).select("l_orderkey", "l_partkey", (c("l_quantity") / 50.0).alias("s"), c("l_linenumber").alias("generic"), (c("l_discount") > 0.05).alias("names"), (c("l_tax") * 12).alias("alike"), (c("l_discount") * 10).alias("coverage"))
    return rows.withColumn("s2", W.template_gate(c("s"), c("generic"), c("names"), c("alike"))).withColumn("s3", W.coverage_gate(c("s2"), c("coverage")))


@query(f"WITH {_GATED} SELECT l_orderkey, l_partkey, s2 AS after_templates, s3 AS after_coverage FROM g")
def gated_scores(spark, d):
    return _gated(spark, d).select("l_orderkey", "l_partkey", F.col("s2").alias("after_templates"), F.col("s3").alias("after_coverage"))


@query("""WITH g AS (SELECT user_id, max(value) - min(value) AS gap FROM events WHERE value IS NOT NULL GROUP BY user_id HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (ORDER BY gap DESC, user_id) AS place, count(*) OVER () AS n FROM g),
    m AS (SELECT c_custkey AS user_id, c_custkey % 6 AS bullets, (c_custkey % 10) / 10.0::DOUBLE AS alike, (c_custkey % 4) / 20.0::DOUBLE AS margin FROM customer WHERE c_custkey % 5 <> 0)
    SELECT user_id, CASE WHEN place <= round_even(n * 0.7::DOUBLE, 0) THEN 'natural' WHEN bullets >= 3 AND alike < 0.8 AND margin >= 0.05 THEN 'synthetic' ELSE 'natural_fallback' END AS kind FROM r LEFT JOIN m USING (user_id)""")
def augmented_pairs(spark, d):
    """70 % natural pairs, the rest synthetic where the made text passes the gate."""
    g = table(spark, d, "events").where("value IS NOT NULL").groupBy("user_id").agg((F.max("value") - F.min("value")).alias("gap"), F.count("*").alias("c")).where("c >= 2")
    ranked = with_rank(g, [-F.col("gap"), F.col("user_id")], "place").crossJoin(F.broadcast(g.agg(F.count("*").alias("n"))))
    k = F.col("c_custkey")
    made = table(spark, d, "customer").where("c_custkey % 5 <> 0").select(k.alias("user_id"), (k % 6).alias("bullets"), ((k % 10) / 10.0).alias("alike"), ((k % 4) / 20.0).alias("margin"))
    return W.augmented_pairs(ranked, "user_id", "gap", made).select("user_id", "kind")


@query(f"""WITH {_GATED}, c AS (SELECT l_orderkey, l_partkey, s3 AS score, l_partkey % 7 AS cluster FROM g), n AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, l_orderkey * 100000 + l_partkey) <= greatest(1, floor(100 / 7)) AS own FROM c)
    SELECT l_orderkey, l_partkey, own FROM n ORDER BY own DESC, score DESC, l_orderkey * 100000 + l_partkey LIMIT 100""")
def proportional_take(spark, d):
    """100 rows, in proportion from given clusters, filled with the best of the rest."""
    rows = _gated(spark, d).select("l_orderkey", "l_partkey", F.col("s3").alias("score"), (F.col("l_partkey") % 7).alias("cluster"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("a"))
    return W.proportional_take(rows, "cluster", "score", "a", 100).select("l_orderkey", "l_partkey", "own")


@query()
def six_gate_selection(spark, d):
    """The whole chain over documents as candidates of their sources, clustered by letter counts (k-means: no SQL)."""
    from siltwork.plans.parsing import _letters

    t, n = F.coalesce("text", F.lit("")), F.size(F.split(F.coalesce("text", F.lit("")), " "))
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where("text IS NOT NULL")
    cand = rows.select("source", F.col("doc_id").alias("arrival"), n.alias("words"), F.size(F.split(t, "\n")).alias("bullets"), (F.col("doc_id") % 5).alias("generic"), (F.col("doc_id") % 2 == 0).alias("names"), F.lit(0.0).alias("alike"), (F.col("n_chars") % 10 / 10.0).alias("coverage"), (F.col("quality") * 0.5 + 0.5).alias("score"), _letters("text").alias("v"))
    return W.six_gates(cand, ["source", "arrival"], 50, 5).select("source", F.col("arrival").alias("doc_id"), "score", "cluster")


@query("""WITH s AS (SELECT doc_id % 3 AS paper, toxic AS part, doc_id, quality + doc_id / 1e6::DOUBLE AS score FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY score DESC, doc_id) AS b, row_number() OVER (PARTITION BY paper ORDER BY score, doc_id DESC) AS w FROM s)
    SELECT x.paper, x.doc_id AS chosen, y.doc_id AS rejected FROM r x JOIN r y ON x.paper = y.paper AND x.b = 1 AND y.w = 1 WHERE x.doc_id <> y.doc_id AND x.score - y.score >= 0.1""")
def pairs_across_files(spark, d):
    """Best and worst of a paper over all files that hold its scores."""
    rows = table(spark, d, "labels").select((F.col("doc_id") % 3).alias("paper"), F.col("toxic").alias("part"), "doc_id", (F.col("quality") + F.col("doc_id") / 1e6).alias("score"))
    at = fresh_path(spark, "score-files")
    files.write_shards(rows, at, "part")
    back = files.load_shards(spark, at, rows.schema)
    return S.best_worst(back, ["paper"], "score", "doc_id", 0.1).select("paper", "chosen", "rejected")


@query("""SELECT role, count(*) AS n, count(DISTINCT conv_id) AS rollouts FROM conversations GROUP BY role""")
def rollouts_by_role(spark, d):
    """Nested rollouts flattened and split into a folder for each role, read back."""
    tree = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("steps"))
    flat = tree.select("conv_id", F.explode("steps").alias("s")).select("conv_id", "s.*")
    at = fresh_path(spark, "rollouts")
    flat.write.partitionBy("role").mode("overwrite").parquet(at)
    return spark.read.schema(flat.schema).parquet(at).groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("rollouts"))


@query("""SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 2 ELSE 1 END AS run FROM labels""")
def run_history(spark, d):
    """A log that runs append to."""
    rows, at = table(spark, d, "labels"), fresh_path(spark, "history")
    for run, part in ((1, rows.where("toxic = 0")), (2, rows.where("toxic = 1"))):
        files.write_json_lines(part.select("doc_id", "quality", F.lit(run).alias("run")), at, append=True)
    return files.read_json_lines(spark, at, "doc_id long, quality long, run int")
