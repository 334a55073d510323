"""Queries of rewards, ensembles of columns and records for training, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltwork.functions import quality as Q
from siltwork.functions import rewards as R
from siltwork.functions import text as T
from siltwork.operators import select as S
from siltwork.plans.catalog import conversation_pairs, query, spread, table
from siltwork.plans.quality import _found, _present


@query()
def step_rewards(spark, d):
    """Search, retrieve, synthesis, worker and master reward of each answer, with its question as the source (no SQL; tests)."""
    got = conversation_pairs(spark, d).select("conv_id", "gt_id", "llm_id", R.search_reward(F.col("llm_text")).alias("search"), R.retrieve_reward(F.col("llm_text"), F.col("gt_text")).alias("retrieve"), R.synthesis_reward(F.col("llm_text"), F.col("gt_text")).alias("synthesize"))
    return got.withColumn("worker", R.worker_reward(F.col("search"), F.col("retrieve"), F.col("synthesize"))).withColumn("master", R.master_reward(F.col("synthesize")))


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM documents)
    SELECT doc_id, round(CASE WHEN text = '' THEN 0 ELSE (least({_found('(?m)^[*•-]')} / 8.0::DOUBLE, 1) + least({_found('(?i)novelty|method|experiment|generaliz|clarity|data|ethic|robustness|reproducib')} / 5.0::DOUBLE, 1)
        + least({_found('(?i)step' + chr(92) + 's*[1-8]|understand|novelty.?check|method.?audit|experiment|generalisa|clarity|data|prioriti')} / 6.0::DOUBLE, 1)
        + least(len(list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '')) / 300.0::DOUBLE, 1)) / 4 END, 6) AS structure,
        {" + ".join(f"regexp_matches(text, '(?i){p}')::INT" for p in R.GENERIC)} AS generic, {_present(R.SOURCE_WORDS)} AS source_words FROM t""")
def structure_and_template(spark, d):
    t = F.col("text")
    return spread(table(spark, d, "documents"), "doc_id").select("doc_id", F.round(R.structure_score(t, t), 6).alias("structure"), R.generic_phrases(t).alias("generic"), Q.present(t, R.SOURCE_WORDS).alias("source_words"))


@query("""SELECT o_orderkey, n, round(CASE WHEN n < 3 THEN least((3 - n) / 3.0::DOUBLE, 1) WHEN n > 20 THEN least(ln(1.0::DOUBLE + n - 20) / ln(21.0::DOUBLE), 1) ELSE 0 END, 6) AS penalty FROM (SELECT l_orderkey AS o_orderkey, count(*) * 4 - 3 AS n FROM lineitem GROUP BY 1)""")
def length_penalties(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count("*") * 4 - 3).alias("n"))
    return n.select("o_orderkey", "n", F.round(R.length_penalty(F.col("n")), 6).alias("penalty"))


@query("""SELECT l_orderkey, l_linenumber, round(0.2::DOUBLE * l_discount + 0.15::DOUBLE * 0.5 + 0.3::DOUBLE * (l_quantity % 6) / 5 + 0.15::DOUBLE * l_tax + 0.2::DOUBLE * l_discount, 4) AS composite,
    round(CASE WHEN 2.25 * l_discount + l_tax <> 0 THEN 3.25::DOUBLE * l_discount * l_tax / (2.25 * l_discount + l_tax) ELSE 0 END, 6) AS f_beta FROM lineitem""")
def composite_scores(spark, d):
    c = F.col
    total = R.composite_score(c("l_discount"), F.lit(None).cast("double"), c("l_quantity") % 6, c("l_tax"), c("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", total.alias("composite"), F.round(R.f_beta(c("l_discount"), c("l_tax")), 6).alias("f_beta"))


@query("""SELECT * FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) <= 2""")
def top_categories(spark, d):
    """The two most frequent categories of each group."""
    counts = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return S.top_k(counts, ["c_nationkey"], "n", "c_mktsegment", 2).select("c_nationkey", "c_mktsegment", "n")


@query("""WITH u AS (SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer), b AS (SELECT s_nationkey AS k FROM supplier)
    SELECT k, k IN (SELECT k FROM b) AS in_both FROM u""")
def key_alignment(spark, d):
    """Keys that either table has, and whether the third has them too."""
    keys = table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).union(table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))).distinct()
    other = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct().withColumn("there", F.lit(True))
    return keys.join(other, "k", "left").select("k", F.coalesce("there", F.lit(False)).alias("in_both"))


@query("""SELECT conv_id, gt_id, llm_id, 'gt_' || gt_id || '_llm_' || llm_id AS pair_id, sha256(gt_text || chr(10) || llm_text) AS digest
    FROM (SELECT conv_id, turn AS gt_id, text AS gt_text FROM conversations WHERE role = 'user') JOIN (SELECT conv_id, turn AS llm_id, text AS llm_text FROM conversations WHERE role = 'assistant') USING (conv_id)""")
def pair_ids(spark, d):
    name = F.concat(F.lit("gt_"), F.col("gt_id").cast("string"), F.lit("_llm_"), F.col("llm_id").cast("string"))
    return conversation_pairs(spark, d).select("conv_id", "gt_id", "llm_id", name.alias("pair_id"), F.sha2(F.concat("gt_text", F.lit("\n"), "llm_text"), 256).alias("digest"))


@query("""SELECT doc_id, CASE WHEN coalesce(try_cast(r AS INT), 999) <= 5 THEN 'strong_accept' ELSE 'strong_reject' END AS rating, label FROM (SELECT doc_id, CASE WHEN n_chars % 13 = 0 THEN 'n/a' ELSE (n_chars % 11)::VARCHAR END AS r, coalesce(nullif(trim(lang), ''), nullif(trim(source), ''), 'none') AS label FROM documents)""")
def rating_labels(spark, d):
    """Coerced numbers with a default, and the first column that isn't blank."""
    said = F.when(F.col("n_chars") % 13 == 0, "n/a").otherwise((F.col("n_chars") % 11).cast("string"))
    return table(spark, d, "documents").select("doc_id", R.rating_label(said).alias("rating"), F.coalesce(T.first_present(F.col("lang"), F.col("source")), F.lit("none")).alias("label"))


@query("""WITH m AS (SELECT conv_id, turn, role, text, count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS a FROM conversations)
    SELECT conv_id, count(*) AS n_messages, sum(length(text))::BIGINT AS n_chars FROM m WHERE a > 0 AND text IS NOT NULL AND trim(text) <> '' GROUP BY conv_id""")
def sft_records(spark, d):
    """Conversations with an assistant turn, as records of messages."""
    rows = table(spark, d, "conversations")
    msgs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    kept = msgs.where(F.exists("m", lambda x: x["role"] == "assistant")).withColumn("m", F.filter("m", lambda x: F.trim(x["text"]) != "")).where(F.size("m") > 0)
    return kept.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + F.length(x["text"])).alias("n_chars"))
