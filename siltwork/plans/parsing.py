"""Queries of parsers and fused retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltwork.functions import metrics as M
from siltwork.functions import parse as P
from siltwork.operators import retrieve as R
from siltwork.plans.catalog import ORACLE_SQL, query, spread, table

_S = "[ \\t-\\r]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


@query(f"""WITH l AS (SELECT doc_id, unnest(list_filter([{_STRIP(f"regexp_replace(x, '^{_S}*[-*•0-9.]+{_S}*', '')")} FOR x IN regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r')], lambda x: length(x) > 10)) AS item FROM documents)
    SELECT doc_id, count(*) AS n, md5(string_agg(DISTINCT item, chr(10) ORDER BY item)) AS items_md5 FROM l GROUP BY doc_id""")
def reference_items(spark, d):
    items = P.reference_items(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", items.alias("i")).where(F.size("i") > 0)
    return rows.select("doc_id", F.size("i").cast("long").alias("n"), F.md5(F.array_join(F.array_sort(F.array_distinct("i")), "\n")).alias("items_md5"))


@query(f"""WITH l AS (SELECT item_id, {_STRIP("unnest(string_split(" + _STRIP("text") + ", chr(10)))")} AS gt_text, unnest(range(0, len(string_split({_STRIP("text")}, chr(10)))::BIGINT)) AS gt_id FROM benchmark)
    SELECT item_id, gt_id::INT AS gt_id, gt_text FROM l WHERE gt_text <> ''""")
def numbered_lines(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.inline(P.numbered_lines(F.col("text"))))


@query()
def report_items(spark, d):
    """The report grammar over all documents (no SQL; tests hold it against a loop over lines)."""
    items = P.report_items(F.col("text"))
    return spread(table(spark, d, "documents"), "doc_id").select("doc_id", items.alias("i")).select("doc_id", F.size("i").alias("n_items"), F.size(F.array_distinct(F.transform("i", lambda x: x["category"]))).alias("n_categories"), F.md5(F.to_json("i")).alias("items_md5"))


_TAGS = ", ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN '{tag}' END" for tag, p in P.WEAKNESSES.items())


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), g AS (SELECT doc_id, list_filter([{_TAGS}], lambda x: x IS NOT NULL) AS g FROM t)
    SELECT doc_id, CASE WHEN len(g) > 0 THEN array_to_string(g, ',') ELSE 'other' END AS tags FROM g""")
def weakness_tags(spark, d):
    return spread(table(spark, d, "documents"), "doc_id").select("doc_id", F.array_join(P.weakness_tags(F.col("text")), ",").alias("tags"))


_HITS = ["(" + " + ".join(f"contains(t, '{k}')::INT" for k in keys) + ")" for keys in P.SPECIALTIES.values()]
_LONG = " UNION ALL ".join(f"SELECT doc_id, {i} AS i, '{name}' AS name, {h} AS n FROM t" for i, (name, h) in enumerate(zip(P.SPECIALTIES, _HITS)))


@query(f"""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), s AS ({_LONG})
    SELECT doc_id, CASE WHEN n > 0 THEN name ELSE 'other' END AS specialty FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1""")
def specialties(spark, d):
    return spread(table(spark, d, "documents"), "doc_id").select("doc_id", P.specialty(F.col("text")).alias("specialty"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.page') AS INT) AS page FROM events""")
def json_cells(spark, d):
    """A field of JSON that stands fenced in an answer."""
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    return table(spark, d, "events").select("event_id", F.get_json_object(P.json_text(answer), "$.page").try_cast("int").alias("page"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 500 THEN text WHEN contains(left(text, 500), '.') AND 500 - instr(reverse(left(text, 500)), '.') + 1 > 400 THEN left(text, 500 - instr(reverse(left(text, 500)), '.') + 1) ELSE left(text, 500) END AS cut FROM documents""")
def sentence_cut(spark, d):
    return table(spark, d, "documents").select("doc_id", P.sentence_cut(F.col("text"), 500).alias("cut"))


def _pages_hits(spark, d, k):
    pages, items = table(spark, d, "pages"), table(spark, d, "benchmark")
    return R.bm25(pages, items, key="page_id", text="html", query="item_id", query_text="text", k=k).select("item_id", "page_id", "score", "place")


_PAGE_BM25 = ORACLE_SQL["bm25_topk"].replace("documents", "pages").replace("doc_id", "page_id").replace("lower(text)", "lower(html)", 2)
_PAGE_BM25 = _PAGE_BM25.replace("SELECT item_id, page_id, score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, page_id) <= 10", "")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_COUNTS = lambda c: "[" + ", ".join(f"(length({c}) - length(replace({c}, '{x}', '')))::DOUBLE" for x in _LETTERS) + "]"
_DENSE = f"""SELECT item_id, page_id, round(list_cosine_similarity(a, b), 6) AS score FROM (SELECT item_id, {_COUNTS('lower(text)')} AS a FROM benchmark) CROSS JOIN (SELECT page_id, {_COUNTS('lower(html)')} AS b FROM pages)
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(list_cosine_similarity(a, b), 6) DESC, page_id) <= 100"""


def _letters(c: str):
    """How often each letter of a-z stands in a text: the vectors of these tables, which hold no embeddings of texts."""
    low = F.lower(F.col(c))
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("double") for x in _LETTERS])


@query(f"""{_PAGE_BM25}, sp AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, page_id) <= 100), de AS ({_DENSE}),
    n AS (SELECT item_id, page_id, 0.5::DOUBLE * score / CASE WHEN max(score) OVER (PARTITION BY item_id) > 0 THEN max(score) OVER (PARTITION BY item_id) ELSE 1 END AS p FROM sp UNION ALL SELECT item_id, page_id, 0.5::DOUBLE * score FROM de),
    f AS (SELECT item_id, page_id, round(sum(p), 8) AS score FROM n GROUP BY ALL)
    SELECT item_id, page_id, score FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, page_id) <= 3""")
def hybrid_topk(spark, d):
    """The 100 best of all pages by BM25 and the 100 best by the cosine of letter counts, fused."""
    dense = R.dense_exact(table(spark, d, "pages").select("page_id", _letters("html").alias("v")), table(spark, d, "benchmark").select("item_id", _letters("text").alias("v")), key="page_id", vector="v", k=100, query="item_id")
    got = R.hybrid(dense, _pages_hits(spark, d, 100), query="item_id", key="page_id", k=1_000)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "page_id")
    return got.withColumn("score", F.round("score", 8)).withColumn("place", F.row_number().over(w)).where("place <= 3").select("item_id", "page_id", "score")


@query(f"""{_PAGE_BM25}, cand AS (SELECT item_id, page_id, score / CASE WHEN max(score) OVER (PARTITION BY item_id) > 0 THEN max(score) OVER (PARTITION BY item_id) ELSE 1 END AS score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, page_id) <= 200),
    w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS q FROM benchmark),
    f AS (SELECT item_id, page_id, round(score + 0.05::DOUBLE * len(list_intersect(w.q, regexp_split_to_array(lower(html), '[^a-z0-9]+'))) / sqrt(len(w.q)), 6) AS fused FROM cand JOIN w USING (item_id) JOIN pages USING (page_id))
    SELECT item_id, page_id, fused FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, page_id) <= 20""")
def reranked(spark, d):
    """The 200 best of all pages, their scores over the best one's, and of those the 20 best with word overlap."""
    hits = _pages_hits(spark, d, 200)
    best = F.max("score").over(Window.partitionBy("item_id"))
    near = hits.withColumn("score", F.col("score") / F.when(best > 0, best).otherwise(1.0)).join(table(spark, d, "benchmark").select("item_id", "text"), "item_id").join(table(spark, d, "pages").select("page_id", "html"), "page_id")
    overlap = M.query_overlap(F.col("text"), F.col("html"))
    got = R.rerank(near.withColumn("score", F.round(F.col("score") + 0.05 * overlap, 6)), "score", F.lit(0.0), "item_id", "page_id", 20)
    return got.select("item_id", "page_id", F.round("fused", 6).alias("fused"))
