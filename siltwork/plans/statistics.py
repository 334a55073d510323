"""Queries of matching, paired tests, ordering and selection, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltwork.functions import metrics as M
from siltwork.functions import text as T
from siltwork.operators import match, order, select, stats
from siltwork.operators import retrieve as R
from siltwork.plans.catalog import _ITEMS, conversation_pairs, query, table

_STOP = ", ".join(f"'{w}'" for w in M.STOP_WORDS)
_CONTENT = f"""gt AS (SELECT conv_id, turn AS gt_id, text AS gt_text FROM conversations WHERE role = 'user'),
    llm AS (SELECT conv_id, turn AS llm_id, text AS llm_text FROM conversations WHERE role = 'assistant'),
    t AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(gt_text), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP}))) AS a,
        list_distinct(list_filter(regexp_split_to_array(lower(llm_text), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP}))) AS b FROM gt JOIN llm USING (conv_id)),
    s AS (SELECT conv_id, gt_id, llm_id, a, b, CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE ELSE 0 END AS j FROM t)"""


def _overlaps(spark, d):
    return conversation_pairs(spark, d).select("conv_id", "gt_id", "llm_id", M.content_overlap(F.col("gt_text"), F.col("llm_text")).alias("j"))


@query(f"WITH {_CONTENT} SELECT conv_id, gt_id, llm_id, round(j, 6) AS overlap FROM s")
def content_overlap_pairs(spark, d):
    return _overlaps(spark, d).select("conv_id", "gt_id", "llm_id", F.round("j", 6).alias("overlap"))


@query(f"""WITH {_CONTENT}, g AS (SELECT conv_id, gt_id, max(j) AS m FROM s GROUP BY ALL), l AS (SELECT conv_id, llm_id, max(j) AS m FROM s GROUP BY ALL)
    SELECT conv_id, round(c, 6) AS coverage, round(p, 6) AS precision FROM (SELECT conv_id, avg((m > 0.1)::INT) AS c FROM g GROUP BY 1) JOIN (SELECT conv_id, avg((m > 0.1)::INT) AS p FROM l GROUP BY 1) USING (conv_id)""")
def coverage_precision(spark, d):
    pairs = _overlaps(spark, d)
    both = match.coverage(pairs, ["conv_id"], "gt_id", F.col("j"), 0.1, "coverage").join(match.coverage(pairs, ["conv_id"], "llm_id", F.col("j"), 0.1, "precision"), "conv_id")
    return both.select("conv_id", F.round("coverage", 6).alias("coverage"), F.round("precision", 6).alias("precision"))


@query(f"""WITH {_ITEMS}, g AS (SELECT conv_id, gt_id, max(CASE WHEN yes THEN j ELSE 0 END) AS m FROM verdicts GROUP BY ALL), l AS (SELECT conv_id, llm_id, max(CASE WHEN yes THEN j ELSE 0 END) AS m FROM verdicts GROUP BY ALL),
    b AS (SELECT conv_id, r, p FROM (SELECT conv_id, avg(m) AS r FROM g GROUP BY 1) JOIN (SELECT conv_id, avg(m) AS p FROM l GROUP BY 1) USING (conv_id))
    SELECT conv_id, round(r, 6) AS weighted_recall, round(p, 6) AS weighted_precision, round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END, 6) AS weighted_f1 FROM b""")
def weighted_pair_metrics(spark, d):
    j = T.jaccard(T.tokens(F.col("gt_text"), 3), T.tokens(F.col("llm_text"), 3))
    pairs = conversation_pairs(spark, d).select("conv_id", "gt_id", "llm_id", j.alias("j"))
    got = match.weighted_metrics(pairs, "conv_id", F.col("j") >= 0.2, F.col("j"))
    return got.select("conv_id", *[F.round(c, 6).alias(c) for c in ("weighted_recall", "weighted_precision", "weighted_f1")])


@query()
def greedy_match_f1(spark, d):
    """Greedy one-to-one matching is sequential: no SQL; tests hold it against a loop."""
    got = match.match_f1(_overlaps(spark, d), ["conv_id"], "llm_id", "gt_id", F.col("j"), 0.05)
    return got.select("conv_id", "matched", F.round("f1", 6).alias("f1"))


@query()
def rouge_meteor(spark, d):
    """ROUGE-L and METEOR of each answer against each question, by words and by stems (no SQL; tests hold them against plain
    loops)."""
    a, b = F.col("llm_text"), F.col("gt_text")
    got = conversation_pairs(spark, d).withColumn("r", M.rouge_l(a, b)).withColumn("s", M.rouge_l(a, b, stemmed=True))
    return got.select(
        "conv_id", "gt_id", "llm_id", *[F.round(f"r.{c}", 6).alias(f"rouge_{c}") for c in ("precision", "recall", "f1")], F.round("s.f1", 6).alias("rouge_stemmed"),
        F.round(M.meteor(a, b), 6).alias("meteor"), F.round(M.meteor(a, b, stemmed=True), 6).alias("meteor_stemmed"),
    )


_PAIRED = "j AS (SELECT a.l_orderkey AS k, round(b.l_extendedprice - a.l_extendedprice, 2) AS d FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2)"


def _paired(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    a, b = [rows.where(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias(f"p{n}")) for n in (1, 2)]
    return a.join(b, "k").select("k", F.round(F.col("p2") - F.col("p1"), 2).alias("d"))


@query(f"""WITH {_PAIRED}, r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM j WHERE d <> 0),
    s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS p, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS m, sum(t::DOUBLE * t - 1) AS ties FROM r),
    z AS (SELECT n, least(p, m)::DOUBLE AS statistic, round((least(p, m) - n * (n + 1) / 4.0::DOUBLE) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s), x AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM z)
    SELECT n, statistic, z, round(((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-x * x), 4) AS p FROM x""")
def wilcoxon_signed_rank(spark, d):
    return stats.wilcoxon(_paired(spark, d), F.col("d")).select("n", "statistic", F.round("z", 6).alias("z"), F.round("p", 4).alias("p"))


@query()
def bootstrap_ci(spark, d):
    """Differences of the first two lines of each order. Random draws: no SQL; tests look at coverage, seeds and
    independence of partitions."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    a, b = [rows.where(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias(f"q{n}")) for n in (1, 2)]
    return stats.bootstrap_interval(a.join(b, "k"), F.col("q2") - F.col("q1"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def total_order(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return order.with_rank(rows, [F.col("o_totalprice"), F.col("o_orderkey")], "place").select("o_orderkey", "place")


@query("""WITH r AS (SELECT user_id, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS b FROM events WHERE value IS NOT NULL),
    x AS (SELECT * FROM r WHERE b = 1 AND value >= 0.3), p AS (SELECT x.user_id, x.event_id AS chosen, y.event_id AS rejected, x.value - y.value AS gap, row_number() OVER (PARTITION BY x.user_id ORDER BY y.value, y.event_id DESC) AS w
        FROM x JOIN r y ON x.user_id = y.user_id AND x.event_type = y.event_type AND x.event_id <> y.event_id AND x.value - y.value >= 0.1)
    SELECT user_id, chosen, rejected, round(gap, 6) AS score_gap FROM p WHERE w = 1""")
def dpo_same_input(spark, d):
    got = select.best_and_alike_worst(table(spark, d, "events"), ["user_id"], "value", "event_id", "event_type", 0.1, 0.3)
    return got.select("user_id", "chosen", "rejected", F.round("score_gap", 6).alias("score_gap"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS b FROM orders)
    SELECT x.o_custkey, x.o_orderkey AS chosen, y.o_orderkey AS rejected FROM r x JOIN r y ON x.o_custkey = y.o_custkey AND x.b = 1 AND y.b > 1""")
def one_against_all(spark, d):
    return select.one_against_all(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "chosen", "rejected")


@query("""WITH f AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority AS flaw, o_orderstatus AS strategy, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1 AS f FROM orders),
    u AS (SELECT o_custkey, list(DISTINCT strategy) AS used FROM f WHERE f GROUP BY 1), t AS (SELECT *, CASE WHEN f THEN 1 WHEN NOT list_contains(used, strategy) THEN 2 ELSE 3 END AS tier FROM f JOIN u USING (o_custkey))
    SELECT o_custkey, o_orderkey, tier, row_number() OVER (PARTITION BY o_custkey ORDER BY tier, o_totalprice DESC, o_orderkey) AS place FROM t QUALIFY place <= 4""")
def diverse_top4(spark, d):
    got = select.diverse_top_k(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderkey", 4)
    return got.select("o_custkey", "o_orderkey", "tier", "place")


@query("SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, l_discount AS discount, l_tax AS tax FROM lineitem) UNPIVOT (value FOR name IN (discount, tax))")
def melted_scores(spark, d):
    return select.melt_columns(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"l_discount": "discount", "l_tax": "tax"}, "name", "value")


@query("""SELECT lang, count(*) AS n, round(avg((c IN (1, 2))::INT), 6) AS valid, round(avg((c = 3)::INT), 6) AS generic FROM (SELECT lang, (n_chars % 6 + 1)::INT AS c FROM documents WHERE n_chars IS NOT NULL) GROUP BY lang""")
def coded_rates(spark, d):
    got = select.category_rates(table(spark, d, "documents").select("lang", (F.col("n_chars") % 6 + 1).alias("c")), ["lang"], "c", {"valid": [1, 2], "generic": [3]})
    return got.select("lang", "n", F.round("valid", 6).alias("valid"), F.round("generic", 6).alias("generic"))


@query("""WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS q FROM benchmark)
    SELECT page_id, item_id, round(len(list_intersect(q, regexp_split_to_array(lower(html), '[^a-z0-9]+'))) / sqrt(len(q)), 6) AS overlap FROM pages CROSS JOIN q WHERE len(list_intersect(q, regexp_split_to_array(lower(html), '[^a-z0-9]+'))) > 0""")
def query_overlaps(spark, d):
    """Every item against every page that shares a word with it: an equi-join on distinct words, counts, and a root."""
    return R.word_overlaps(table(spark, d, "pages"), table(spark, d, "benchmark"), "page_id", "html", "item_id", "text").withColumn("overlap", F.round("overlap", 6))


@query("""WITH e AS (SELECT vec_id, [abs(x)::DOUBLE + 1e-3 FOR x IN embedding] AS p, [x::DOUBLE * x + 1e-3 FOR x IN embedding] AS q FROM embeddings), n AS (SELECT vec_id, [x / list_sum(p) FOR x IN p] AS p, [x / list_sum(q) FOR x IN q] AS q FROM e)
    SELECT vec_id, round(list_sum([(p[i] * log2(2 * p[i] / (p[i] + q[i])) + q[i] * log2(2 * q[i] / (p[i] + q[i]))) / 2 FOR i IN range(1, len(p) + 1)]), 6) AS jsd FROM n""")
def divergence(spark, d):
    e = table(spark, d, "embeddings")
    p = F.transform("embedding", lambda x: F.abs(x).cast("double") + 1e-3)
    q = F.transform("embedding", lambda x: x.cast("double") * x + 1e-3)
    return e.select("vec_id", p.alias("p"), q.alias("q")).select("vec_id", F.round(M.divergence_bits(F.col("p"), F.col("q")), 6).alias("jsd"))
