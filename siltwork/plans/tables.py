"""Queries of joins, sets, splits and orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltwork.functions import context as C
from siltwork.functions import text as T
from siltwork.operators import pairs as P
from siltwork.operators import tables as TB
from siltwork.plans.catalog import _ITEMS, conversation_pairs, query, table


@query("""WITH l AS (SELECT o_custkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
    SELECT c_custkey, coalesce(o_orderpriority, 'none') AS priority FROM customer LEFT JOIN l ON c_custkey = o_custkey""")
def last_wins_lookup(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderpriority").alias("priority"))
    return TB.lookup(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "priority", "o_orderkey", F.lit("none"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25)),
    f AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS n FROM e GROUP BY ALL)
    SELECT o_orderkey, coalesce(array_to_string(ids, ','), '') AS ids, coalesce(len(ids), 0) > 0 AS any_known FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem) LEFT JOIN (SELECT l_orderkey AS o_orderkey, list(l_partkey ORDER BY n, l_partkey) AS ids FROM f GROUP BY 1) USING (o_orderkey)""")
def known_ids_in_order(spark, d):
    """Of the parts of each order those that the other table knows, in their order."""
    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    side = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"))
    got = TB.known_in_order(lists, "o_orderkey", "ids", side, "id")
    return got.select("o_orderkey", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), (F.size("ids") > 0).alias("any_known"))


@query("""SELECT count(*) AS orders, count(*) FILTER (WHERE n > 0) AS matched, round(count(*) FILTER (WHERE n > 0) / count(*)::DOUBLE, 6) AS coverage FROM (SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS n FROM orders)""")
def matched_share(spark, d):
    """The share of rows with a match."""
    hits = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(1))
    got = table(spark, d, "orders").select("o_orderkey").join(hits, "o_orderkey", "left")
    return got.agg(F.count("*").alias("orders"), F.count("hit").alias("matched"), F.round(F.count("hit") / F.count("*"), 6).alias("coverage"))


@query("""WITH j AS (SELECT a.doc_id, a.n_chars, b.quality FROM documents a LEFT JOIN labels b USING (doc_id)) SELECT doc_id, n_chars, quality, quality IS NULL AS unmeasured FROM j""")
def result_merge(spark, d):
    """Rows with the results that came back for them; those without any have none."""
    got = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return got.withColumn("unmeasured", F.col("quality").isNull())


@query("""WITH a AS (SELECT conv_id, turn, text, length(text) AS score FROM conversations), b AS (SELECT conv_id, turn, CASE WHEN turn = 2 THEN upper(text) ELSE text END AS text, length(text) * 2 AS score FROM conversations WHERE turn % 3 <> 1)
    SELECT a.conv_id, a.turn, a.score, b.score AS score_2, b.conv_id IS NOT NULL AND a.text IS DISTINCT FROM b.text AS mismatch FROM a LEFT JOIN b USING (conv_id, turn)""")
def two_score_files(spark, d):
    """Two files of scores by a composite key, and whether they speak of the same text."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    one = rows.withColumn("score", F.length("text").cast("long"))
    other = rows.where("turn % 3 <> 1").select("conv_id", "turn", F.when(F.col("turn") == 2, F.upper("text")).otherwise(F.col("text")).alias("text"), (F.length("text") * 2).cast("long").alias("score"))
    return TB.merged_scores(one, other, ["conv_id", "turn"], "score", "text").select("conv_id", "turn", "score", "score_2", "mismatch")


@query("""SELECT item_id, doc_id, md5(text) AS source_md5 FROM (SELECT item_id, item_id AS doc_id FROM benchmark) LEFT JOIN documents USING (doc_id)""")
def source_lookup(spark, d):
    """The source text of each item's paper."""
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("source_md5"))
    return table(spark, d, "benchmark").select("item_id", F.col("item_id").alias("doc_id")).join(docs, "doc_id", "left").select("item_id", "doc_id", "source_md5")


@query("""SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, round(abs(a.o_totalprice - b.o_totalprice), 2) AS gap FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey""")
def group_self_pairs(spark, d):
    got = TB.self_pairs(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")
    return got.select("o_custkey", "a", "b", F.round(F.abs(F.col("o_totalprice_a") - F.col("o_totalprice_b")), 2).alias("gap"))


@query("""WITH g AS (SELECT conv_id, list(length(text)::BIGINT ORDER BY turn) FILTER (WHERE role = 'user') AS u, list(length(text)::BIGINT ORDER BY turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id)
    SELECT conv_id, i::INT AS pos, u[i + 1] AS asked, a[i + 1] AS answered FROM (SELECT *, unnest(range(0, greatest(coalesce(len(u), 0), coalesce(len(a), 0)))) AS i FROM g)""")
def zipped_lists(spark, d):
    """Lists of unequal length side by side by position."""
    each = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", F.length("text").cast("long").alias("n"))))), lambda x: x["n"])
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(each("user").alias("u"), each("assistant").alias("a"))
    return TB.zipped(lists, "conv_id", {"asked": "u", "answered": "a"})


@query("""WITH g AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), s AS (SELECT c_custkey AS user_id, c_acctbal AS score, 1 AS k FROM customer)
    SELECT user_id, event_id, k, round(value, 4) AS value, round(score, 2) AS score FROM g JOIN s USING (user_id, k)""")
def paired_by_rank(spark, d):
    """The k-th row of a group with the k-th of another table; what is left over on either side is dropped."""
    g = table(spark, d, "events").select("user_id", "event_id", "value", F.expr("row_number() OVER (PARTITION BY user_id ORDER BY event_id)").alias("k"))
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("score"), F.lit(1).alias("k"))
    return g.join(s, ["user_id", "k"]).select("user_id", "event_id", F.col("k").cast("long").alias("k"), F.round("value", 4).alias("value"), F.round("score", 2).alias("score"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents), b AS (SELECT quality, row_number() OVER (ORDER BY doc_id) AS r FROM labels QUALIFY r <= 100) SELECT doc_id, quality FROM a LEFT JOIN b USING (r)""")
def aligned_by_position(spark, d):
    """A column of an earlier run by position, of its first 100 rows."""
    return TB.aligned(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), [F.col("doc_id")], [F.col("doc_id")], ["quality"], 100).select("doc_id", "quality")


@query(f"WITH {_ITEMS}, y AS (SELECT conv_id, avg(j) FILTER (WHERE yes) AS m, count(*) FILTER (WHERE yes) AS n FROM verdicts GROUP BY conv_id) SELECT conv_id, n, round(coalesce(m, 0), 6) AS similarity FROM y")
def yes_pair_similarity(spark, d):
    """The mean similarity of a paper's yes pairs; 0 without any."""
    j = T.jaccard(T.tokens(F.col("gt_text"), 3), T.tokens(F.col("llm_text"), 3))
    pairs = P.local_verdict(conversation_pairs(spark, d)).withColumn("j", j)
    got = pairs.groupBy("conv_id").agg(F.count_if("yes").alias("n"), F.avg(F.when(F.col("yes"), F.col("j"))).alias("m"))
    return got.select("conv_id", "n", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("similarity"))


@query(f"""WITH {_ITEMS}, v AS (SELECT conv_id, avg(CASE WHEN j > 0.03 THEN 1.0::DOUBLE ELSE 0.5 END) AS m FROM verdicts WHERE yes OR gt_id = llm_id - 1 GROUP BY conv_id)
    SELECT conv_id, round(coalesce(m, 1), 6) AS verified FROM (SELECT DISTINCT conv_id FROM verdicts) LEFT JOIN v USING (conv_id)""")
def verified_matches(spark, d):
    """How far words bear out the matches of a judge: half a mark for one with hardly a word in common; 1 without matches."""
    j = T.jaccard(T.tokens(F.col("gt_text"), 3), T.tokens(F.col("llm_text"), 3))
    pairs = P.local_verdict(conversation_pairs(spark, d)).withColumn("j", j)
    claimed = F.col("yes") | (F.col("gt_id") == F.col("llm_id") - 1)
    got = pairs.groupBy("conv_id").agg(F.avg(F.when(claimed, F.when(F.col("j") > 0.03, 1.0).otherwise(0.5))).alias("m"))
    return got.select("conv_id", F.round(F.coalesce("m", F.lit(1.0)), 6).alias("verified"))


@query("""SELECT to_json({'n': count(*), 'mean_chars': round(avg(n_chars), 4), 'languages': count(DISTINCT lang)}) AS summary FROM documents""")
def corpus_summary(spark, d):
    """Averages of the whole corpus as one keyed record of JSON."""
    got = table(spark, d, "documents").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.countDistinct("lang").alias("languages"))
    return got.select(F.to_json(F.struct("n", "mean_chars", "languages")).alias("summary"))


@query("""WITH k AS (SELECT DISTINCT CASE WHEN s_suppkey % 4 = 0 THEN 'x' || s_suppkey ELSE s_suppkey::VARCHAR END AS k FROM supplier) SELECT k AS paper, row_number() OVER (ORDER BY try_cast(k AS BIGINT) IS NULL, coalesce(try_cast(k AS BIGINT), 0), k) AS place FROM k""")
def paper_order(spark, d):
    """Merged shards in the order of papers: numbers, then names."""
    key = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("x"), F.col("s_suppkey").cast("string"))).otherwise(F.col("s_suppkey").cast("string"))
    return TB.paper_order(table(spark, d, "supplier").select(key.alias("paper")).distinct(), "paper").select("paper", "place")


@query("""WITH r AS (SELECT unnest(list_filter([CASE WHEN n_chars < 200 THEN 'short:' || n_chars END, CASE WHEN source IS NULL THEN 'no source' END, CASE WHEN n_chars > 3000 THEN 'long:' || n_chars END], lambda x: x IS NOT NULL)) AS r FROM documents)
    SELECT split_part(r, ':', 1) AS reason, count(*) AS n FROM r GROUP BY 1""")
def failure_reasons(spark, d):
    n = F.col("n_chars")
    why = F.array_compact(F.array(F.when(n < 200, F.concat(F.lit("short:"), n.cast("string"))), F.when(F.col("source").isNull(), F.lit("no source")), F.when(n > 3000, F.concat(F.lit("long:"), n.cast("string")))))
    return TB.reason_counts(table(spark, d, "documents").select(why.alias("why")), "why")


@query("""SELECT conv_id, turn, role, md5(text) AS sample_md5 FROM conversations WHERE role = 'assistant' AND turn >= 1 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""")
def first_sample(spark, d):
    """The first sample of a role, from a turn on, of each rollout."""
    got = table(spark, d, "conversations").where("role = 'assistant' AND turn >= 1").groupBy("conv_id").agg(F.min_by(F.struct("turn", "role", "text"), "turn").alias("x"))
    return got.select("conv_id", "x.turn", "x.role", F.md5("x.text").alias("sample_md5"))


@query("""WITH n AS (SELECT source, doc_id, lower(left(coalesce(text, ''), 120)) AS k FROM documents), f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY doc_id) = 1 OR k = '')
    SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM f QUALIFY place <= 5""")
def ordered_dedupe(spark, d):
    """The first five documents of each source without repeated starts."""
    got = TB.ordered_distinct(table(spark, d, "documents").select("source", "doc_id", "text"), ["source"], F.col("text"), ["doc_id"], 5)
    return got.select("source", "doc_id", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, d):
    return TB.seeded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50, 42)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS place FROM documents")
def seeded_shuffle(spark, d):
    return TB.seeded_shuffle(table(spark, d, "documents").select("doc_id"), "doc_id", 42)


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN n > 20 AND r <= ceil(n * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r""")
def row_split(spark, d):
    return TB.row_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.1, 7)


@query("""SELECT lang, source, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY lang, source""")
def composite_dedup(spark, d):
    """The first row of each composite key, nulls alike."""
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query("""SELECT conv_id, a.turn AS chosen, b.turn AS rejected FROM conversations a JOIN conversations b USING (conv_id) WHERE a.role = 'assistant' AND b.role = 'assistant' AND a.turn < b.turn AND trim(coalesce(a.text, '')) <> '' AND trim(coalesce(b.text, '')) <> '' AND trim(a.text) <> trim(b.text)""")
def distinct_pairs(spark, d):
    """Pairs for training: both texts there, and not the same."""
    rows = table(spark, d, "conversations").where("role = 'assistant'").withColumn("t", F.trim(F.coalesce("text", F.lit(""))))
    got = TB.self_pairs(rows, ["conv_id"], "turn", "t").where("t_a <> '' AND t_b <> '' AND t_a <> t_b")
    return got.select("conv_id", F.col("a").alias("chosen"), F.col("b").alias("rejected"))


@query("""SELECT p_partkey, round(list_avg(v), 6) AS mean, round(list_stddev_samp(v), 6) AS sd FROM (SELECT p_partkey, [p_size / 50.0::DOUBLE, p_retailprice::DOUBLE / 1000, CASE WHEN p_size > 25 THEN 0.5::DOUBLE END] AS v FROM part)""")
def seed_columns(spark, d):
    """Mean and deviation of each row's seed columns, those that are there."""
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("a"), (F.col("p_retailprice").cast("double") / 1000).alias("b"), F.when(F.col("p_size") > 25, 0.5).alias("c"))
    got = TB.across_columns(rows, "p_partkey", {"a": "1", "b": "2", "c": "3"}, "v")
    return got.select("p_partkey", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("""SELECT lang, round(100 * avg(regexp_matches(lower(coalesce(text, '')), 'data|error')::INT), 4) AS data_pct, round(100 * avg(regexp_matches(lower(coalesce(text, '')), 'licen[sc]e')::INT), 4) AS licence_pct FROM documents GROUP BY lang""")
def category_shares(spark, d):
    """The percentage of rows that each pattern hits."""
    low = F.lower(F.coalesce("text", F.lit("")))
    pct = lambda p: F.round(100 * F.avg(low.rlike(p).cast("int")), 4)
    return table(spark, d, "documents").groupBy("lang").agg(pct("data|error").alias("data_pct"), pct("licen[sc]e").alias("licence_pct"))


@query("""WITH t AS (SELECT doc_id, trim(CASE WHEN doc_id % 17 = 0 THEN 'ERROR: ' || coalesce(text, '') ELSE coalesce(text, '') END) AS t FROM documents)
    SELECT doc_id, length(t) >= 50 AND NOT regexp_matches(t, '^(?:PENDING|ERROR|SKIPPED)') AS usable, starts_with(t, 'ERROR') AS failed FROM t""")
def usable_texts(spark, d):
    t = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("ERROR: "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", C.usable(t).alias("usable"), F.startswith(F.trim(t), F.lit("ERROR")).alias("failed"))


@query("""WITH g AS (SELECT l_orderkey, list({'k': l_linenumber, 's': CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount * 10 END} ORDER BY l_linenumber) AS items FROM lineitem GROUP BY 1), f AS (SELECT l_orderkey, list_filter(items, lambda x: coalesce(x.s, -1) >= 0.5) AS kept FROM g)
    SELECT l_orderkey, len(kept) AS n, array_to_string([x.k FOR x IN kept], ',') AS kept FROM f WHERE len(kept) > 2 AND len(kept) <> 3""")
def scored_items(spark, d):
    """Items of a list that reach a score (none counts -1), of lists with so many of them."""
    score = F.when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_discount") * 10)
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("k"), score.alias("s")))).alias("items"))
    kept = F.filter("items", lambda x: F.coalesce(x["s"], F.lit(-1.0)) >= 0.5)
    return g.withColumn("kept", kept).where((F.size("kept") > 2) & (F.size("kept") != 3)).select("l_orderkey", F.size("kept").cast("long").alias("n"), F.array_join(F.transform("kept", lambda x: x["k"].cast("string")), ",").alias("kept"))
