"""Queries of scans, slices, lookups, retrieval lists and rewards that no other module holds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltwork.functions import metrics as M
from siltwork.functions import parse as P
from siltwork.functions import rewards as R
from siltwork.functions import text as T
from siltwork.operators import match
from siltwork.operators import retrieve as RT
from siltwork.operators import rule_score as RS
from siltwork.operators.order import with_rank
from siltwork.plans.catalog import _ITEMS, conversation_pairs, query, spread, table
from siltwork.plans.parsing import _DENSE, _PAGE_BM25, _letters, _pages_hits
from siltwork.sources import files as S
from siltwork.sources.shared import fresh_path, materialize


@query("SELECT p_partkey, p_name, p_size AS kind_size, p_retailprice AS kind_price FROM part")
def audit_csv(spark, d):
    """Nested rows flattened, written as CSV and read back with inferred types."""
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.struct(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")).alias("kind"))
    at = fresh_path(spark, "audit")
    S.write_csv(S.flattened(rows), at)
    got = S.read_csv_inferred(spark, at)
    return got.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("kind_size").cast("long").alias("kind_size"), F.col("kind_price").cast("double").alias("kind_price"))


@query("SELECT conv_id, count(*) AS n, sum(turn)::BIGINT AS turns FROM conversations GROUP BY conv_id")
def nested_round_trip(spark, d):
    """Records of lists through Parquet."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("steps"))
    back = materialize(rows, "nested")
    return back.select("conv_id", F.size("steps").cast("long").alias("n"), F.aggregate("steps.turn", F.lit(0).cast("long"), lambda a, x: a + x).alias("turns"))


@query("SELECT count(*) AS vectors, min(len(embedding))::BIGINT AS dims, count(*) = (SELECT count(*) FROM embeddings) AS in_step FROM embeddings")
def vector_index(spark, d):
    """Vectors written with their ids, loaded, and their number held against that of the rows."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = materialize(rows, "vectors")
    got = index.agg(F.count("*").alias("vectors"), F.min(F.size("embedding")).cast("long").alias("dims"))
    return got.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).select("vectors", "dims", (F.col("vectors") == F.col("n")).alias("in_step"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
    SELECT doc_id, i, CASE WHEN i >= 20 AND i < 50 THEN 'slice' WHEN i >= n - 10 THEN 'tail' WHEN i < 5 THEN 'head' END AS part FROM r WHERE i >= 20 AND i < 50 OR i >= n - 10 OR i < 5""")
def row_slices(spark, d):
    """Rows by position: a slice, a head and a tail; the rest is dropped."""
    rows = table(spark, d, "documents").select("doc_id")
    r = with_rank(rows, [F.col("doc_id")], "r").crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).withColumn("i", F.col("r") - 1)
    part = F.when((F.col("i") >= 20) & (F.col("i") < 50), "slice").when(F.col("i") >= F.col("n") - 10, "tail").when(F.col("i") < 5, "head")
    return r.withColumn("part", part).where("part IS NOT NULL").select("doc_id", "i", "part")


@query("SELECT doc_id, lang, 'unknown' AS licence FROM documents")
def pruned_columns(spark, d):
    """Columns dropped if they are there, and one added with a default where it is missing."""
    rows = table(spark, d, "documents").drop("text", "source", "n_chars", "no_such_column")
    return T.ensured(rows, {"licence": F.lit("unknown"), "lang": F.lit("?")})


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 ELSE 2 END, turn) AS place FROM conversations""")
def worker_order(spark, d):
    """Results in the order of a list of workers, whatever order they came in."""
    order = spark.createDataFrame([("assistant", 0), ("user", 1)], "role string, ordinal int")
    got = table(spark, d, "conversations").select("conv_id", "turn", "role").join(F.broadcast(order), "role", "left").withColumn("ordinal", F.coalesce("ordinal", F.lit(2)))
    return got.select("conv_id", "turn", F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY ordinal, turn)").cast("long").alias("place"))


@query("""WITH c AS (SELECT event_type || '::' || (user_id % 10) AS k, event_id, try_cast(json_extract_string(props, '$.page') AS INT) AS page FROM events),
    l AS (SELECT k, max(event_id) AS e FROM c WHERE page IS NOT NULL GROUP BY k), b AS (SELECT k, count(*) FILTER (WHERE page IS NULL) AS bad FROM c GROUP BY k)
    SELECT b.k AS chunk_key, c.page, b.bad FROM b LEFT JOIN l ON b.k = l.k LEFT JOIN c ON c.k = b.k AND c.event_id = l.e""")
def chunk_load(spark, d):
    """Chunks by key, the last of a key counts; rows that don't parse are counted."""
    key = F.concat("event_type", F.lit("::"), (F.col("user_id") % 10).cast("string"))
    rows = table(spark, d, "events").select(key.alias("chunk_key"), "event_id", F.get_json_object("props", "$.page").try_cast("int").alias("page"))
    good = F.when(F.col("page").isNotNull(), F.col("event_id"))
    return rows.groupBy("chunk_key").agg(F.max_by("page", good).alias("page"), F.count_if(F.col("page").isNull()).alias("bad"))


@query(f"""{_PAGE_BM25}, sp AS (SELECT item_id, page_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, page_id) AS p FROM s QUALIFY p <= 20), de AS (SELECT item_id, page_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, page_id) AS p FROM ({_DENSE}) QUALIFY p <= 20),
    f AS (SELECT item_id, page_id, sum(0.5::DOUBLE / (60 + p)) AS score FROM (SELECT * FROM sp UNION ALL SELECT * FROM de) GROUP BY ALL)
    SELECT item_id, page_id, round(score, 9) AS score FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, page_id) <= 5""")
def ensemble_topk(spark, d):
    """A sparse and a dense list fused by their ranks."""
    dense = RT.dense_exact(table(spark, d, "pages").select("page_id", _letters("html").alias("v")), table(spark, d, "benchmark").select("item_id", _letters("text").alias("v")), key="page_id", vector="v", k=20, query="item_id")
    got = RT.rank_fusion([(_pages_hits(spark, d, 20), 0.5), (dense, 0.5)], query="item_id", key="page_id", k=1_000)
    place = F.expr("row_number() OVER (PARTITION BY item_id ORDER BY score DESC, page_id)")
    return got.withColumn("score", F.round("score", 9)).withColumn("place", place).where("place <= 5").select("item_id", "page_id", "score")


@query("""WITH h AS (SELECT l_orderkey, unnest([l_partkey, l_suppkey]) AS id FROM lineitem), u AS (SELECT DISTINCT l_orderkey, id FROM h) SELECT l_orderkey, count(*) AS hits, count(p_partkey) AS known, min(p_name) AS first_name FROM u LEFT JOIN part ON p_partkey = id GROUP BY l_orderkey""")
def hit_union(spark, d):
    """Hits of several columns united, each id once, with what is known about it."""
    hits = table(spark, d, "lineitem").select("l_orderkey", F.explode(F.array(F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long"))).alias("id")).distinct()
    met = hits.join(table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), "p_name"), "id", "left")
    return met.groupBy("l_orderkey").agg(F.count("*").alias("hits"), F.count("p_name").alias("known"), F.min("p_name").alias("first_name"))


@query("""SELECT doc_id, md5('Represent this sentence for searching relevant passages: ' || left(text, 2000)) AS query_md5 FROM documents WHERE text IS NOT NULL""")
def query_texts(spark, d):
    """Query texts with the prefix that an encoder asks for."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(F.concat(F.lit(RT.QUERY_PREFIX), F.substring("text", 1, 2000))).alias("query_md5"))


@query(f"""WITH {_ITEMS}, r AS (SELECT conv_id, avg(m) AS r FROM (SELECT conv_id, gt_id, max(j) AS m FROM sims GROUP BY ALL) GROUP BY 1), p AS (SELECT conv_id, avg(m) AS p FROM (SELECT conv_id, llm_id, max(j) AS m FROM sims GROUP BY ALL) GROUP BY 1)
    SELECT conv_id, round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END, 6) AS f1 FROM r JOIN p USING (conv_id)""")
def best_match_f1(spark, d):
    j = T.jaccard(T.tokens(F.col("gt_text"), 3), T.tokens(F.col("llm_text"), 3))
    return match.best_match_f1(conversation_pairs(spark, d), "conv_id", j).select("conv_id", F.round("f1", 6).alias("f1"))


@query("""WITH t AS (SELECT conv_id, turn, text, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t-\\r]+'), lambda x: x <> '')) AS w FROM conversations),
    p AS (SELECT a.conv_id, a.turn, CASE WHEN len(a.w) + len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE ELSE 0 END AS j FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND a.text IS DISTINCT FROM b.text)
    SELECT t.conv_id, t.turn, round(coalesce(max(p.j), 0), 6) AS redundancy FROM t LEFT JOIN p USING (conv_id, turn) GROUP BY ALL""")
def item_redundancy(spark, d):
    """The highest similarity of each item to any other of its group, equal ones aside."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", T.spaced_words(F.col("text")).alias("w"))
    other = rows.select("conv_id", F.col("turn").alias("o"), F.col("text").alias("other"), F.col("w").alias("v"))
    met = rows.join(other, "conv_id").where((F.col("turn") != F.col("o")) & ~F.col("text").eqNullSafe(F.col("other"))).groupBy("conv_id", "turn").agg(F.max(T.jaccard(F.col("w"), F.col("v"))).alias("m"))
    return rows.select("conv_id", "turn").join(met, ["conv_id", "turn"], "left").select("conv_id", "turn", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("redundancy"))


@query("""SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(value) > 0 AND stddev_pop(x) > 0 THEN round(corr(value, x), 6) END AS r FROM (SELECT user_id, value, (event_id % 7)::DOUBLE AS x FROM events WHERE value IS NOT NULL) GROUP BY user_id""")
def pearson_by_group(spark, d):
    """Pearson's r of each group; none for fewer than three points or no variance."""
    rows = table(spark, d, "events").where("value IS NOT NULL").withColumn("x", (F.col("event_id") % 7).cast("double"))
    enough = (F.count("*") >= 3) & (F.stddev_pop("value") > 0) & (F.stddev_pop("x") > 0)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.when(enough, F.round(F.corr("value", "x"), 6)).alias("r"))


_MARKED = lambda c, marks: "(" + " + ".join(f"contains(upper({c}), '{m}')::INT" for m in marks) + ")"


@query(f"""WITH l AS (SELECT doc_id, 'Selected_Workers: a, NUM_ROUNDS ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' guidance_for b' ELSE '' END AS planning, CASE WHEN doc_id % 3 = 0 THEN 'coverage_gaps none; FEEDBACK_FOR a' ELSE '' END AS feedback, doc_id % 9 AS workers, quality, toxic FROM labels),
    s AS (SELECT *, (quality + toxic) / 2.0::DOUBLE AS decision, {_MARKED('feedback', R.FEEDBACK_MARKS)} / 5.0::DOUBLE AS f, {_MARKED('planning', R.PLANNING_MARKS)} / 4.0::DOUBLE AS p, CASE WHEN workers BETWEEN 3 AND 5 THEN 1.0 WHEN workers <= 7 THEN 0.7 ELSE 0.5 END::DOUBLE AS e FROM l)
    SELECT doc_id, round(f, 6) AS feedback, round(p, 6) AS planning, round((2 * decision + f + p + 1.5::DOUBLE * quality + 0.5::DOUBLE * e) / 6, 6) AS leader FROM s""")
def leader_rewards(spark, d):
    """What a leader's plan, feedback and choice of workers are worth."""
    c = F.col
    plan = F.concat(F.lit("Selected_Workers: a, NUM_ROUNDS "), c("doc_id").cast("string"), F.when(c("doc_id") % 2 == 0, " guidance_for b").otherwise(""))
    said = F.when(c("doc_id") % 3 == 0, "coverage_gaps none; FEEDBACK_FOR a").otherwise("")
    f, p = R.marked_share(said, R.FEEDBACK_MARKS), R.marked_share(plan, R.PLANNING_MARKS)
    total = R.leader_reward(decision=(c("quality") + c("toxic")) / 2.0, feedback=f, planning=p, breadth=c("quality"), workers=c("doc_id") % 9, weights={"decision": 2.0, "feedback": 1.0, "breadth": 1.5})
    return table(spark, d, "labels").select("doc_id", F.round(f, 6).alias("feedback"), F.round(p, 6).alias("planning"), F.round(total, 6).alias("leader"))


@query("""WITH x AS (SELECT l_orderkey, l_partkey, max(l_tax) * 10 AS j, max(l_discount) * 10 AS g, max(l_quantity) / 50.0::DOUBLE AS f, max(l_linenumber) AS n FROM lineitem GROUP BY ALL), a AS (SELECT *, CASE WHEN n = 1 THEN (0.15::DOUBLE * g + 0.15::DOUBLE * f) / (0.15::DOUBLE + 0.15::DOUBLE) ELSE (0.7::DOUBLE * j + 0.15::DOUBLE * g + 0.15::DOUBLE * f) / (0.7::DOUBLE + 0.15::DOUBLE + 0.15::DOUBLE) END AS a FROM x)
    SELECT l_orderkey, l_partkey, round(a, 6) AS alignment, round((0.7::DOUBLE * a + 0.3::DOUBLE * f) / (0.7::DOUBLE + 0.3::DOUBLE), 6) AS blend FROM a""")
def worker_alignment(spark, d):
    """Judge, grounding and form of a worker, without the judge renormalised; blended with its steps."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg((F.max("l_tax") * 10).alias("j"), (F.max("l_discount") * 10).alias("g"), (F.max("l_quantity") / 50.0).alias("f"), F.max("l_linenumber").alias("n"))
    rows = rows.withColumn("j", F.when(F.col("n") == 1, None).otherwise(F.col("j")))
    got = RS.blended(RS.blended(rows, R.ALIGNMENT_WEIGHTS, "a"), {"a": 0.7, "f": 0.3}, "blend")
    return got.select("l_orderkey", "l_partkey", F.round("a", 6).alias("alignment"), F.round("blend", 6).alias("blend"))


@query()
def reference_similarity(spark, d):
    """Half the F1 of one-to-one matches, half ROUGE-L of each paper's answers and references (folds and an Arrow exchange:
    no SQL; their parts are tested)."""
    pairs = conversation_pairs(spark, d).withColumn("j", M.content_overlap(F.col("gt_text"), F.col("llm_text")))
    f1 = match.match_f1(pairs, ["conv_id"], "llm_id", "gt_id", F.col("j"), 0.05)
    said = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", F.coalesce("text", F.lit("")).alias("t"))))), lambda x: x["t"]), "\n")
    texts = table(spark, d, "conversations").groupBy("conv_id").agg(said("assistant").alias("a"), said("user").alias("u"))
    got = f1.join(texts.withColumn("r", M.rouge_l(F.col("a"), F.col("u"))), "conv_id")
    return got.select("conv_id", F.round(0.5 * F.col("f1") + 0.5 * F.col("r.f1"), 6).alias("similarity"))


@query("""WITH p AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT a.o_custkey, coalesce(p.n, a.n) AS items, p.n IS NULL AS fallback FROM a LEFT JOIN p USING (o_custkey)""")
def specialty_items(spark, d):
    """A specialty's items of each paper; of papers that have none, all."""
    rows = table(spark, d, "orders")
    all_, own = rows.groupBy("o_custkey").agg(F.count("*").alias("n")), rows.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("own"))
    return all_.join(own, "o_custkey", "left").select("o_custkey", F.coalesce("own", "n").alias("items"), F.col("own").isNull().alias("fallback"))


_BOLD = r"(?m)^[ \t]*(?:[0-9]+[.)]|[-*])?[ \t]*\*\*([^*\n]+?):?\*\*:?[ \t]*(.*)$"


@query(f"""WITH t AS (SELECT conv_id, turn, '1. **Scope:** ' || replace(coalesce(text, ''), chr(10), ' ') || chr(10) || 'no item' || chr(10) || '- **Data**: few' AS t FROM conversations)
    SELECT conv_id, turn, i - 1 AS item, c[i] AS category, b[i] AS body FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(t, '{_BOLD}', 1) AS c, regexp_extract_all(t, '{_BOLD}', 2) AS b FROM t))""")
def bold_items(spark, d):
    """Reports of numbered or bulleted bold headings and of bold keys."""
    said = F.concat(F.lit("1. **Scope:** "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("\nno item\n- **Data**: few"))
    got = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(P.bold_items(said)).alias("item", "x"))
    return got.select("conv_id", "turn", F.col("item").cast("long").alias("item"), "x.category", "x.body")


@query()
def entity_counts(spark, d):
    """Entities of each text (look-around has no SQL form; tests hold them against Python)."""
    return spread(table(spark, d, "documents"), "doc_id").select("doc_id", F.size(P.entities(F.col("text"))).alias("n_entities"))


@query("""SELECT item_id, 'Paper ' || item_id AS title, 'An abstract.' AS abstract, 1 AS n_sections FROM benchmark""")
def tei_records(spark, d):
    """Records out of TEI (one Arrow exchange), the abstract from its section where the header has none."""
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Paper '), F.col("item_id").cast("string"), F.lit("</title></titleStmt></fileDesc></teiHeader><text><body><div><head>Abstract</head><p>An  abstract.</p></div></body></text></TEI>"))
    got = table(spark, d, "benchmark").select("item_id", S.tei_record(xml).alias("r"))
    return got.select("item_id", "r.title", "r.abstract", F.size("r.sections").alias("n_sections"))
