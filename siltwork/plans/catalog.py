"""All queries of the library with their SQL, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltwork.functions import text as T
from siltwork.operators import pairs as P
from siltwork.operators import retrieve as R
from siltwork.operators import select as S
from siltwork.operators.order import with_rank

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_ITEMS = """gt AS (SELECT conv_id, turn AS gt_id, text AS gt_text FROM conversations WHERE role = 'user'),
    llm AS (SELECT conv_id, turn AS llm_id, text AS llm_text FROM conversations WHERE role = 'assistant'),
    pairs AS (SELECT * FROM gt JOIN llm USING (conv_id)),
    toks AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(gt_text), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS a,
                    list_distinct(list_filter(regexp_split_to_array(lower(llm_text), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS b FROM pairs),
    inter AS (SELECT *, len(list_intersect(a, b)) AS i FROM toks),
    sims AS (SELECT *, CASE WHEN len(a) + len(b) - i > 0 THEN i / (len(a) + len(b) - i)::DOUBLE ELSE 0 END AS j FROM inter),
    verdicts AS (SELECT *, j >= 0.2 AS yes FROM sims)"""
_METRICS = _ITEMS + """,
    counts AS (SELECT conv_id, count(DISTINCT gt_id) AS n_gt, count(DISTINCT llm_id) AS n_llm, count(DISTINCT CASE WHEN yes THEN gt_id END) AS hit_gt,
                      count(DISTINCT CASE WHEN yes THEN llm_id END) AS hit_llm FROM verdicts GROUP BY conv_id),
    shares AS (SELECT *, hit_gt / n_gt::DOUBLE AS recall, hit_llm / n_llm::DOUBLE AS precision FROM counts),
    metrics AS (SELECT *, CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END AS f1 FROM shares)"""


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A scan with fewer splits than there are cores, dealt out by a key before costly expressions; a larger one, which
    keeps all cores busy, as it is, without a shuffle. Only for rows that come straight from a scan."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def conversation_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "conversations"), "conv_id")
    refs = rows.where("role = 'user'").select("conv_id", F.col("turn").alias("gt_id"), F.col("text").alias("gt_text"))
    gens = rows.where("role = 'assistant'").select("conv_id", F.col("turn").alias("llm_id"), F.col("text").alias("llm_text"))
    return P.item_pairs(refs, gens, "conv_id")


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


@query(f"WITH {_METRICS} SELECT conv_id, n_gt, n_llm, hit_gt, hit_llm, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM metrics")
def pair_metrics(spark, d):
    return _rounded(P.pair_metrics(P.local_verdict(conversation_pairs(spark, d)), "conv_id"), "recall", "precision", "f1")


@query(f"""WITH {_METRICS} SELECT count(*) AS papers, count(*) FILTER (WHERE f1 > 0) AS valid, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision,
    round(avg(f1), 6) AS f1, round(avg(f1) FILTER (WHERE f1 > 0), 6) AS f1_valid FROM metrics""")
def pair_metrics_corpus(spark, d):
    m = P.pair_metrics(P.local_verdict(conversation_pairs(spark, d)), "conv_id")
    got = m.agg(F.count("*").alias("papers"), F.count(F.when(F.col("f1") > 0, 1)).alias("valid"), *[F.avg(c).alias(c) for c in ("recall", "precision", "f1")], F.avg(F.when(F.col("f1") > 0, F.col("f1"))).alias("f1_valid"))
    return _rounded(got, "recall", "precision", "f1", "f1_valid")


@query("""WITH p AS (SELECT conv_id, g.turn AS gt_id, l.turn AS llm_id, list_distinct(list_filter(regexp_split_to_array(lower(g.text), '[ \\t-\\r]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(l.text), '[ \\t-\\r]+'), lambda x: x <> '')) AS b
        FROM conversations g JOIN conversations l USING (conv_id) WHERE g.role = 'user' AND l.role = 'assistant'),
    i AS (SELECT *, len(list_intersect(a, b)) AS i FROM p)
    SELECT conv_id, gt_id, llm_id, round(CASE WHEN len(a) + len(b) - i > 0 THEN i / (len(a) + len(b) - i)::DOUBLE ELSE 0 END, 6) AS jaccard FROM i""")
def jaccard_pairs(spark, d):
    """Over sets of lower-case words between white space."""
    j = T.jaccard(T.spaced_words(F.col("gt_text")), T.spaced_words(F.col("llm_text")))
    return conversation_pairs(spark, d).select("conv_id", "gt_id", "llm_id", F.round(j, 6).alias("jaccard"))


@query(f"WITH {_ITEMS} SELECT conv_id, llm_id, min(llm_text) AS llm_text FROM verdicts GROUP BY conv_id, llm_id HAVING max(yes::INT) = 0")
def unmatched_items(spark, d):
    return P.unmatched(P.local_verdict(conversation_pairs(spark, d)), "conv_id")


@query("""WITH gt AS (SELECT conv_id, turn AS gt_id, text AS a FROM conversations WHERE role = 'user'), llm AS (SELECT conv_id, turn AS llm_id, text AS b FROM conversations WHERE role = 'assistant'),
    p AS (SELECT * FROM gt JOIN llm USING (conv_id)),
    x AS (SELECT conv_id, gt_id, llm_id, w, count(*) AS x FROM (SELECT conv_id, gt_id, llm_id, unnest(regexp_split_to_array(lower(a), '[^\\pL\\pN_]+')) AS w FROM p) WHERE length(w) >= 2 GROUP BY ALL),
    y AS (SELECT conv_id, gt_id, llm_id, w, count(*) AS y FROM (SELECT conv_id, gt_id, llm_id, unnest(regexp_split_to_array(lower(b), '[^\\pL\\pN_]+')) AS w FROM p) WHERE length(w) >= 2 GROUP BY ALL),
    z AS (SELECT conv_id, gt_id, llm_id, coalesce(x, 0) * i AS x, coalesce(y, 0) * i AS y FROM (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1.0::DOUBLE ELSE 1 + ln(1.5::DOUBLE) END AS i FROM x FULL JOIN y USING (conv_id, gt_id, llm_id, w))),
    s AS (SELECT conv_id, gt_id, llm_id, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM z GROUP BY ALL)
    SELECT p.conv_id, p.gt_id, p.llm_id, round(coalesce(CASE WHEN xx * yy > 0 THEN xy / sqrt(xx * yy) ELSE 0 END, 0), 6) AS cosine FROM p LEFT JOIN s USING (conv_id, gt_id, llm_id)""")
def pair_similarity_tfidf(spark, d):
    return _rounded(P.tfidf_cosine(conversation_pairs(spark, d), ["conv_id", "gt_id", "llm_id"], "gt_text", "llm_text"), "cosine")


@query("""WITH p AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS w FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents)),
    post AS (SELECT doc_id, dl, w, count(*) AS tf FROM p GROUP BY ALL), lens AS (SELECT len(list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r]+'), lambda x: x <> '')) AS dl FROM documents), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
    df AS (SELECT w, count(*) AS df FROM post GROUP BY w), raw AS (SELECT w, avgdl, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS raw FROM df, c),
    idf AS (SELECT w, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    q AS (SELECT item_id, w, count(*) AS qn FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r]+'), lambda x: x <> '')) AS w FROM benchmark) GROUP BY ALL),
    s AS (SELECT item_id, doc_id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN idf USING (w) JOIN post USING (w) GROUP BY ALL)
    SELECT item_id, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""")
def bm25_topk(spark, d):
    got = R.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), key="doc_id", text="text", query="item_id", query_text="text", k=10)
    return got.select("item_id", "doc_id", "score")


@query("""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
    SELECT query_id, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""")
def dense_topk(spark, d):
    rows = table(spark, d, "embeddings")
    return R.dense_exact(rows, rows.where("vec_id % 20 = 0"), key="vec_id", vector="embedding", k=10).select("query_id", "vec_id", "score")


_EVENTS = "SELECT event_id, user_id, event_type, value FROM events WHERE value IS NOT NULL"


@query(f"""WITH e AS ({_EVENTS}), g AS (SELECT *, count(*) OVER w AS group_size, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM e WINDOW w AS (PARTITION BY user_id, event_type))
    SELECT event_id, user_id, event_type, group_size, round((value - m) / (s + 1e-8), 4) + 0.0::DOUBLE AS advantage FROM g WHERE group_size >= 2""")
def group_advantage(spark, d):
    rows = table(spark, d, "events").where("value IS NOT NULL").select("event_id", "user_id", "event_type", "value")
    got = S.advantages(rows, ["user_id", "event_type"], "value")
    return got.select("event_id", "user_id", "event_type", "group_size", (F.round("advantage", 4) + 0.0).alias("advantage"))


@query(f"SELECT event_id, user_id, event_type, value FROM ({_EVENTS}) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1")
def sft_best(spark, d):
    rows = table(spark, d, "events").where("value IS NOT NULL")
    return S.top_k(rows, ["user_id", "event_type"], "value", "event_id", 1).select("event_id", "user_id", "event_type", "value")


@query(f"""WITH e AS ({_EVENTS}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id DESC) AS w FROM e)
    SELECT x.user_id, x.event_id AS chosen, y.event_id AS rejected, round(x.value - y.value, 6) AS score_gap FROM r x JOIN r y ON x.user_id = y.user_id AND x.b = 1 AND y.w = 1 WHERE x.event_id <> y.event_id AND x.value - y.value >= 0.1""")
def dpo_best_worst(spark, d):
    got = S.best_worst(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "value", "event_id", 0.1)
    return got.select("user_id", "chosen", "rejected", F.round("score_gap", 6).alias("score_gap"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
    SELECT o_custkey, max(CASE WHEN k = 1 THEN o_orderkey END) AS winner, round(max(o_totalprice), 4) AS best, round(min(o_totalprice), 4) AS second, round(max(o_totalprice) - min(o_totalprice), 4) AS margin FROM r WHERE k <= 2 GROUP BY o_custkey HAVING count(*) = 2""")
def margin_top2(spark, d):
    return _rounded(S.margins(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey"), "best", "second", "margin", digits=4)


_VOTES = "SELECT doc_id, 0 AS pos, lang AS label FROM documents UNION ALL SELECT doc_id, 1, CASE WHEN n_chars % 2 = 0 THEN 'en' ELSE 'de' END FROM documents UNION ALL SELECT doc_id, 2, CASE WHEN n_chars % 3 = 0 THEN 'fr' ELSE 'en' END FROM documents"


@query(f"""WITH v AS ({_VOTES}), c AS (SELECT doc_id, label, count(*) AS n, min(pos) AS f FROM v GROUP BY ALL)
    SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY doc_id) = 3 THEN 'gpt, mistral' ELSE label END AS winner, n AS votes, count(*) OVER (PARTITION BY doc_id) AS labels FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1""")
def majority_vote(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    votes = F.array(F.col("lang"), F.when(F.col("n_chars") % 2 == 0, "en").otherwise("de"), F.when(F.col("n_chars") % 3 == 0, "fr").otherwise("en"))
    return S.majority(docs.select("doc_id", F.posexplode(votes).alias("pos", "label")), ["doc_id"], "label", "pos", "gpt, mistral")


@query("""WITH k AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t-\\r]+', ' ', 'g')) AS k FROM documents)
    SELECT doc_id, count(*) OVER (PARTITION BY k) AS copies FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1""")
def pooled_dedup(spark, d):
    key = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"[ \t-\r]+", " ")), 256)
    return S.keep_first(table(spark, d, "documents").select("doc_id", key.alias("k")), F.col("k"), "doc_id").select("doc_id", "copies")


@query("SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality_rate, round(avg(toxic), 6) AS toxic_rate FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def category_rates(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality_rate"), F.round(F.avg("toxic"), 6).alias("toxic_rate"))


@query("""WITH s AS (SELECT l_linenumber, avg(l_discount) AS m FROM lineitem GROUP BY 1), p AS (SELECT l_orderkey, stddev_samp(l_discount) AS sd FROM lineitem GROUP BY 1)
    SELECT (SELECT round(avg(m), 6) FROM s) AS mean_of_means, (SELECT round(stddev_samp(m), 6) FROM s) AS sd_of_means, (SELECT round(avg(coalesce(sd, 0)), 6) FROM p) AS within_sd""")
def seed_variance(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    seeds = rows.groupBy("l_linenumber").agg(F.avg("l_discount").alias("m")).agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.round(F.stddev_samp("m"), 6).alias("sd_of_means"))
    within = rows.groupBy("l_orderkey").agg(F.coalesce(F.stddev_samp("l_discount"), F.lit(0.0)).alias("sd")).agg(F.round(F.avg("sd"), 6).alias("within_sd"))
    return seeds.crossJoin(within)


@query("""WITH a AS (SELECT l_orderkey AS k, l_quantity AS x FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_orderkey AS k, l_quantity AS y FROM lineitem WHERE l_linenumber = 2), j AS (SELECT * FROM a JOIN b USING (k))
    SELECT count(*) AS n, round(avg(x), 6) AS base, round(avg(y), 6) AS policy, round(avg(y) - avg(x), 6) AS delta, round((avg(y) - avg(x)) / (abs(avg(x)) + 1e-8) * 100, 4) AS delta_pct,
           count(*) FILTER (WHERE y > x) AS wins, count(*) FILTER (WHERE y < x) AS losses, count(*) FILTER (WHERE y = x) AS ties, round(corr(x, y), 6) AS pearson FROM j""")
def model_compare(spark, d):
    rows = table(spark, d, "lineitem")
    pick = lambda n, c: rows.where(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias(c))
    j = pick(1, "x").join(pick(2, "y"), "k")
    x, y = F.avg("x"), F.avg("y")
    return j.agg(F.count("*").alias("n"), F.round(x, 6).alias("base"), F.round(y, 6).alias("policy"), F.round(y - x, 6).alias("delta"), F.round((y - x) / (F.abs(x) + 1e-8) * 100, 4).alias("delta_pct"), F.count_if(F.expr("y > x")).alias("wins"), F.count_if(F.expr("y < x")).alias("losses"), F.count_if(F.expr("y = x")).alias("ties"), F.round(F.corr("x", "y"), 6).alias("pearson"))


@query("""SELECT s_suppkey, round(CASE WHEN hi > lo THEN (s_acctbal - lo) / (hi - lo) ELSE 0.5 END, 6) AS minmax, round(CASE WHEN sd > 0 THEN 1 / (1 + exp(-(s_acctbal - m) / sd)) ELSE 0.5 END, 6) AS logistic
    FROM (SELECT s_suppkey, s_acctbal, min(s_acctbal) OVER () AS lo, max(s_acctbal) OVER () AS hi, avg(s_acctbal) OVER () AS m, stddev_samp(s_acctbal) OVER () AS sd FROM supplier)""")
def normalized_scores(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    x = F.col("s_acctbal")
    stats = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"))
    got = rows.crossJoin(F.broadcast(stats))
    return got.select("s_suppkey", F.round(F.when(F.expr("hi > lo"), (x - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5), 6).alias("minmax"), F.round(F.when(F.expr("sd > 0"), 1 / (1 + F.exp(-(x - F.col("m")) / F.col("sd")))).otherwise(0.5), 6).alias("logistic"))


@query("""WITH f AS (SELECT doc_id, n_chars < 100 AS short, quality = 0 AS poor, toxic = 1 AS harmful FROM documents JOIN labels USING (doc_id))
    SELECT count(*) AS n, count_if(short) AS too_short, count_if(poor) AS low_quality, count_if(harmful) AS toxic, count_if(NOT short AND NOT poor AND NOT harmful) AS kept FROM f""")
def quality_floor(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    short, poor, harmful = F.col("n_chars") < 100, F.col("quality") == 0, F.col("toxic") == 1
    return rows.agg(F.count("*").alias("n"), F.count_if(short).alias("too_short"), F.count_if(poor).alias("low_quality"), F.count_if(harmful).alias("toxic"), F.count_if(~short & ~poor & ~harmful).alias("kept"))


@query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(10), ' '), '(?i)[^ \\t-\\r]+[ \\t-\\r]+et[ \\t-\\r]+al\\.?', '', 'g'), '[0-9]+', '', 'g'), '[ \\t-\\r]+', ' ', 'g'))) AS cleaned_md5 FROM documents""")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("cleaned_md5"))


@query("""WITH l AS (SELECT item_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])[ \\t-\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM benchmark)
    SELECT item_id, array_to_string([('[E' || i || '] ' || s[i]) FOR i IN range(1, len(s) + 1)], chr(10)) AS tagged FROM l""")
def evidence_tag(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.evidence_tagged(F.col("text")).alias("tagged"))


@query("SELECT count(*) AS n, count_if(text IS NULL OR lower(trim(text)) IN ('', 'nan', 'none', 'null', '<na>', 'no citations found')) AS missing, count_if(length(text) >= 100) AS long_enough FROM documents")
def null_tokens(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.count_if(T.is_missing(F.col("text"))).alias("missing"), F.count_if(F.length("text") >= 100).alias("long_enough"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""WITH g AS (SELECT source, row_number() OVER (ORDER BY md5('42|' || source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
    SELECT doc_id, source, CASE WHEN r <= greatest(1, floor(n * 0.15::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM documents JOIN g USING (source)""")
def group_split(spark, d):
    return S.group_split(table(spark, d, "documents").select("doc_id", "source"), "source", 0.15, "42").select("doc_id", "source", "split")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
    SELECT doc_id, CASE WHEN i BETWEEN 101 AND 200 THEN 'test' WHEN i <= 300 THEN 'train' END AS part FROM r WHERE i <= 300""")
def fixed_index_split(spark, d):
    got = table(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(301)
    i = F.row_number().over(Window.orderBy("doc_id")) - 1
    return got.withColumn("i", i).select("doc_id", F.when(F.col("i").between(101, 200), "test").otherwise("train").alias("part"))


@query("""WITH u AS (SELECT vec_id, label, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS v FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))
    SELECT a.vec_id, round(avg(list_dot_product(a.v, b.v)), 6) AS mean_sim FROM u a JOIN u b ON a.label <> b.label GROUP BY a.vec_id""")
def cross_group_mean_sim(spark, d):
    """The mean cosine to all vectors of other labels, from sums of vectors: no join of rows with rows."""
    e = table(spark, d, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    u = e.select("vec_id", "label", F.transform("e", lambda x: x / F.sqrt(T.dot(F.col("e"), F.col("e")))).alias("v"))
    by_label = u.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"))
    totals = by_label.groupBy("i").agg(F.sum("s").alias("t"))
    sums = by_label.join(totals, "i").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("t") - F.col("s")).alias("o")))), lambda x: x["o"]).alias("others"))
    sizes = u.groupBy("label").agg(F.count("*").alias("m"))
    n = u.agg(F.count("*").alias("n"))
    return u.join(sums, "label").join(sizes, "label").crossJoin(F.broadcast(n)).where("n > m").select("vec_id", F.round(T.dot(F.col("v"), F.col("others")) / (F.col("n") - F.col("m")), 6).alias("mean_sim"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(stddev_pop(value), 4) AS sd_pop, min(value) AS least, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q3, max(value) AS most FROM events GROUP BY event_type")
def role_diagnostics(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("sd"), F.round(F.stddev_pop(v), 4).alias("sd_pop"), F.min(v).alias("least"), *[F.round(F.percentile(v, F.lit(q)), 4).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))], F.max(v).alias("most"))


@query("SELECT conv_id, string_agg('[' || upper(role) || '] ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def chat_prompt(spark, d):
    line = F.concat(F.lit("["), F.upper("role"), F.lit("] "), F.col("text"))
    got = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("ls"))
    return got.select("conv_id", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("prompt"))


@query("""SELECT conv_id, text AS answer, turn // 4 AS critique_round FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn // 4 DESC, turn) = 1""")
def latest_revision(spark, d):
    """The first answer of the latest round of critique; the draft (round 0) where there is no revision."""
    rows = table(spark, d, "conversations").where("role = 'assistant'").withColumn("critique_round", F.expr("turn div 4"))
    return S.latest_revision(rows, ["conv_id"], "critique_round", "turn", "text").withColumnsRenamed({"text": "answer"})


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, i AS chunk, md5(array_to_string(w[i * 200 + 1:i * 200 + 200], ' ')) AS chunk_md5 FROM (SELECT doc_id, w, unnest(range(0, ((len(w) + 199) // 200)::BIGINT)) AS i FROM w)""")
def word_chunks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.word_chunks(F.col("text"), 200)).alias("chunk", "c"))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("c").alias("chunk_md5"))


@query("""SELECT page_id, CASE WHEN r = 1 THEN host ELSE host || '__dup' || r END AS chunk_key FROM (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS r
    FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages))""")
def dup_safe_keys(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"))
    return S.numbered_keys(rows, "host", "page_id").select("page_id", "chunk_key")


@query("SELECT doc_id, round(1 - quality * 0.5 - least(n_chars, 10000) / 20000.0::DOUBLE, 6) AS difficulty, row_number() OVER (ORDER BY round(1 - quality * 0.5 - least(n_chars, 10000) / 20000.0::DOUBLE, 6), doc_id) AS place FROM documents JOIN labels USING (doc_id)")
def curriculum_order(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.select("doc_id", F.round(1 - F.col("quality") * 0.5 - F.least("n_chars", F.lit(10000)) / 20000.0, 6).alias("difficulty"))
    return with_rank(rows, [F.col("difficulty"), F.col("doc_id")], "place")


@query("""SELECT doc_id, CASE WHEN length(text) <= 1000 THEN md5(text) ELSE md5(left(text, 700) || chr(10) || '...' || chr(10) || right(text, 300)) END AS shortened_md5, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_lines FROM documents""")
def truncate_head_tail(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(T.head_tail(t, 1000)).alias("shortened_md5"), T.line_count(t).alias("n_lines"))


@query("SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 120) AS filename FROM pages")
def safe_filenames(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_filename(F.col("url")).alias("filename"))


@query("""WITH g AS (SELECT user_id, max(value) - min(value) AS gap FROM events WHERE value IS NOT NULL GROUP BY user_id HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (ORDER BY gap DESC, user_id) AS place, count(*) OVER () AS n FROM g)
    SELECT user_id, round(gap, 6) AS gap, place, CASE WHEN place <= round_even(n * 0.7::DOUBLE, 0) THEN 'natural' ELSE 'synthetic' END AS part FROM r""")
def gap_split_70_30(spark, d):
    g = table(spark, d, "events").where("value IS NOT NULL").groupBy("user_id").agg((F.max("value") - F.min("value")).alias("gap"), F.count("*").alias("c")).where("c >= 2")
    n = g.agg(F.count("*").alias("n"))
    r = with_rank(g, [-F.col("gap"), F.col("user_id")], "place").crossJoin(F.broadcast(n))
    return r.select("user_id", F.round("gap", 6).alias("gap"), "place", F.when(F.col("place") <= F.bround(F.col("n") * 0.7), "natural").otherwise("synthetic").alias("part"))
