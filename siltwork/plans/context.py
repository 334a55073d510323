"""Queries of cleaning, lists, truncation, sections and prompts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltwork.functions import context as C
from siltwork.functions import parse as P
from siltwork.functions import rewards as R
from siltwork.functions import text as T
from siltwork.operators import retrieve as RT
from siltwork.plans.catalog import query, spread, table
from siltwork.plans.parsing import _PAGE_BM25, _pages_hits
from siltwork.sources import files as S
from siltwork.sources.shared import fresh_path

_S = "[ \\t-\\r]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"
_TOPK = "QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, page_id)"


def _dumped(sql: str) -> str:
    for pattern, by in C.DUMP_NOISE:
        sql = "regexp_replace({}, '{}', '{}', 'g')".format(sql, pattern.replace("'", "''").replace(r"\s", _S), by)
    return _STRIP(sql)


@query(f"SELECT event_id, {_dumped('props')} AS prose FROM events WHERE props IS NOT NULL")
def plain_dumps(spark, d):
    return table(spark, d, "events").where("props IS NOT NULL").select("event_id", C.plain_dump(F.col("props")).alias("prose"))


@query("""SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS texts, to_json({'n': count(*), 'first': min(turn)}) AS record FROM conversations GROUP BY conv_id""")
def coerced_texts(spark, d):
    """Lists joined by a blank, records as JSON."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"), F.struct(F.count("*").alias("n"), F.min("turn").alias("first")).alias("r"))
    return g.select("conv_id", C.as_text(F.col("t"), "array").alias("texts"), C.as_text(F.col("r"), "struct").alias("record"))


_CUT = lambda p: f"list_filter([{_STRIP('x')} FOR x IN regexp_split_to_array(t, '{p}')], lambda x: length(x) > 10)"


@query(f"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN regexp_replace(coalesce(text, ''), '\\n', chr(10) || '1. ', 'g') WHEN 1 THEN regexp_replace(coalesce(text, ''), '\\n', chr(10) || '- ', 'g') ELSE coalesce(text, '') END AS t FROM documents),
    c AS (SELECT doc_id, {_CUT('(?:^|\\n)[ \\t]*[0-9]+[.)][ \\t]+')} AS a, {_CUT('(?:^|\\n)[ \\t]*[-*•][ \\t]+')} AS b, {_CUT('\\n[ \\t]*\\n')} AS c FROM t),
    i AS (SELECT doc_id, CASE WHEN len(a) > 1 THEN a WHEN len(b) > 1 THEN b ELSE c END AS i FROM c)
    SELECT doc_id, len(i) AS n, md5(array_to_string(i, chr(10))) AS items_md5 FROM i""")
def numbered_items(spark, d):
    """Numbered lists, else bulleted ones, else paragraphs."""
    t = F.coalesce("text", F.lit(""))
    marked = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace(t, "\n", "\n1. ")).when(F.col("doc_id") % 3 == 1, F.regexp_replace(t, "\n", "\n- ")).otherwise(t)
    rows = table(spark, d, "documents").select("doc_id", C.numbered_items(marked).alias("i"))
    return rows.select("doc_id", F.size("i").cast("long").alias("n"), F.md5(F.array_join("i", "\n")).alias("items_md5"))


@query("""SELECT conv_id, string_agg('- [Major] ' || trim(text), chr(10) ORDER BY turn) AS review FROM conversations WHERE role = 'assistant' AND trim(coalesce(text, '')) <> '' GROUP BY conv_id""")
def tagged_bullets(spark, d):
    g = table(spark, d, "conversations").where("role = 'assistant' AND trim(coalesce(text, '')) <> ''").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return g.select("conv_id", C.bullets(F.col("t"), "Major").alias("review"))


@query()
def continued_bullets(spark, d):
    """Bullets and the lines that continue them: a fold without SQL; tests hold it against a loop."""
    rows = table(spark, d, "documents").select("doc_id", C.continued_bullets(F.regexp_replace(F.coalesce("text", F.lit("")), r"\n(?=[A-M])", "\n- ")).alias("i"))
    return rows.select("doc_id", F.size("i").alias("n"), F.md5(F.array_join("i", "\n")).alias("items_md5"))


@query(f"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_S}+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, md5(CASE WHEN length(text) > 400 THEN left(text, 400) || ' ... [TRUNCATED]' ELSE text END) AS chars_md5, md5(CASE WHEN len(w) > 60 THEN array_to_string(w[1:60], ' ') || ' ... [TRUNCATED]' ELSE array_to_string(w, ' ') END) AS words_md5 FROM w""")
def head_cuts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(C.head(t, 400)).alias("chars_md5"), F.md5(C.head_words(t, 60)).alias("words_md5"))


@query("""WITH n AS (SELECT doc_id, text, length(coalesce(text, '')) AS n FROM documents), s AS (SELECT doc_id, text, unnest(CASE WHEN n = 0 THEN [] WHEN n <= 512 THEN [1] ELSE range(1, n - 50 + 1, 462) END) AS i FROM n)
    SELECT doc_id, i::INT AS start, md5(substring(text, i, 512)) AS piece_md5 FROM s""")
def overlapping_pieces(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(C.overlapping_pieces(F.col("text"))).alias("i", "piece"))
    return rows.select("doc_id", (F.col("i") * 462 + 1).cast("int").alias("start"), F.md5("piece").alias("piece_md5"))


def _papers(spark, d):
    """Conversations as papers: each turn a section headed by its role."""
    s = F.array_sort(F.collect_list(F.struct("turn", F.initcap("role").alias("heading"), F.coalesce("text", F.lit("")).alias("text"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(s, lambda x: F.struct(x["heading"].alias("heading"), x["text"].alias("text"))).alias("s"))


@query("""SELECT conv_id, md5(coalesce(first(text ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS first_md5, md5(coalesce(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS all_md5,
    md5('Title: Paper ' || conv_id || chr(10) || string_agg(upper(left(role, 1)) || substring(role, 2) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS document_md5 FROM conversations GROUP BY conv_id""")
def section_texts(spark, d):
    """The first section of a kind, all of a kind, and the whole paper as one document."""
    s = F.col("s")
    title = F.concat(F.lit("Paper "), F.col("conv_id").cast("string"))
    return _papers(spark, d).select("conv_id", F.md5(C.section(s, "assistant")).alias("first_md5"), F.md5(C.section(s, "assistant", True)).alias("all_md5"), F.md5(C.document_text(title, F.lit(""), s)).alias("document_md5"))


@query("""WITH t AS (SELECT * FROM (SELECT source, doc_id, text FROM documents WHERE text IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3),
    p AS (SELECT source, string_agg('Paper' || r || '_Title: ' || doc_id || chr(10) || 'Paper' || r || '_Abstract: ' || left(text, 50) || chr(10) || 'Paper' || r || '_Introduction: ', chr(10) || chr(10) ORDER BY r) AS b FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM t) GROUP BY source)
    SELECT source, CASE WHEN length(b) > 200 THEN left(b, 200) || ' ... [TRUNCATED]' ELSE b END AS block FROM p""")
def context_blocks(spark, d):
    first = F.expr("row_number() OVER (PARTITION BY source ORDER BY doc_id)")
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("source", "doc_id", "text").withColumn("r", first).where("r <= 3")
    entry = F.struct("r", F.col("doc_id").cast("string").alias("title"), F.substring("text", 1, 50).alias("abstract"), F.lit("").alias("introduction"))
    return rows.groupBy("source").agg(F.array_sort(F.collect_list(entry)).alias("e")).select("source", C.context_block(F.col("e"), 200).alias("block"))


@query("""WITH r AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), a AS (SELECT conv_id, turn AS ablated FROM r)
    SELECT conv_id, ablated, 'Paper ' || conv_id || ': ' || coalesce(string_agg(r.text, ' | ' ORDER BY r.turn) FILTER (WHERE r.turn <> ablated), '') || ' end' AS prompt FROM a JOIN r USING (conv_id) GROUP BY conv_id, ablated""")
def leave_one_out_prompts(spark, d):
    """A prompt template for each report left out."""
    g = table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("r"))
    rows = g.select("conv_id", "r", F.explode("r.turn").alias("ablated"))
    reports = F.array_join(F.transform(F.filter("r", lambda x: x["turn"] != F.col("ablated")), lambda x: x["text"]), " | ")
    return rows.select("conv_id", "ablated", C.template("Paper {paper}: {reports} end", paper=F.col("conv_id"), reports=reports).alias("prompt"))


@query("""SELECT conv_id, turn::INT AS gt_id, contains(upper(coalesce(text, '')), 'YES') AS yes FROM conversations""")
def prefixed_answers(spark, d):
    """Ids and verdicts out of fields that carry a prefix."""
    rows = table(spark, d, "conversations").select("conv_id", F.concat(F.lit("gt_id:"), F.col("turn").cast("string")).alias("f"), F.concat(F.lit("Pair 0: "), F.coalesce("text", F.lit(""))).alias("a"))
    return rows.select("conv_id", C.prefixed_field(F.col("f")).cast("int").alias("gt_id"), C.says_yes(F.col("a")).alias("yes"))


@query("""SELECT doc_id, n_chars % 2 AS flag, n_chars % 7 AS degree FROM documents WHERE n_chars IS NOT NULL""")
def novelty_flags(spark, d):
    said = F.concat(F.lit("Some words.\nBinaryNoveltyFlag: "), (F.col("n_chars") % 2).cast("string"), F.lit("\nDegreeNoveltyScore : "), (F.col("n_chars") % 7).cast("string"))
    return table(spark, d, "documents").where("n_chars IS NOT NULL").select("doc_id", P.novelty_flags(said).alias("x")).select("doc_id", F.col("x.flag").cast("long").alias("flag"), F.col("x.degree").cast("long").alias("degree"))


@query("""SELECT item_id, text AS inner_text FROM benchmark""")
def tagged_blocks(spark, d):
    """What a tagged block of an answer holds."""
    said = F.concat(F.lit("<think>none</think> <boxed_LIMITATIONS> "), F.col("text"), F.lit("\n</boxed_limitations> end"))
    return table(spark, d, "benchmark").select("item_id", P.boxed(said, "LIMITATIONS").alias("inner_text"))


@query("""SELECT conv_id, turn, '<|im_start|>system' || chr(10) || 'Be brief.' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || regexp_replace(coalesce(text, ''), '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations""")
def tagged_prompts(spark, d):
    said = F.concat(F.lit("[SYSTEM] Be brief. [USER]\n"), F.coalesce("text", F.lit("")))
    return table(spark, d, "conversations").select("conv_id", "turn", P.tagged_prompt_to_chat(said).alias("prompt"))


@query("""SELECT doc_id, text AS answer FROM documents WHERE text IS NOT NULL AND NOT contains(text, '<') AND trim(text) <> '' AND text = trim(text)""")
def answers_without_thoughts(spark, d):
    rows = table(spark, d, "documents").where("text IS NOT NULL AND NOT contains(text, '<') AND trim(text) <> '' AND text = trim(text)")
    return rows.select("doc_id", T.strip_think(F.concat(F.lit("<think>a\nb</think>"), F.col("text"))).alias("answer"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.page') AS INT) AS page FROM events""")
def repr_cells(spark, d):
    """Cells that Python printed, read as JSON (one Arrow exchange)."""
    cell = F.replace(F.col("props"), F.lit('"'), F.lit("'"))
    return table(spark, d, "events").select("event_id", F.get_json_object(P.pyrepr_to_json(cell), "$.page").try_cast("int").alias("page"))


@query("""SELECT doc_id, (1.0::DOUBLE * (doc_id % 2 = 0)::INT * 0.5 + least(1 / 4.0::DOUBLE, 1) * 0.5 * (doc_id % 2 = 0)::INT - 0.25 * (1 - (doc_id % 2 = 0)::INT)) AS raw FROM documents""")
def format_rewards(spark, d):
    """A <think> part always, a section with one tagged bullet in every second answer; before the reward is clamped."""
    said = F.concat(F.lit("<think>x</think>\n"), F.when(F.col("doc_id") % 2 == 0, F.lit("## Limitations\n- [Major] one\n## End\n")).otherwise(F.lit("none")))
    got = spread(table(spark, d, "documents"), "doc_id").select("doc_id", R.format_reward(said).alias("r"))
    return got.select("doc_id", (0.5 * F.col("r.section") + 0.5 * F.col("r.bullets") + F.col("r.penalty")).alias("raw"))


@query("""SELECT doc_id, quality, toxic FROM labels""")
def json_documents(spark, d):
    """Files of one JSON list each."""
    rows = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    at = fresh_path(spark, "json-documents")
    S.write_json_documents(rows, at)
    return S.read_json_documents(spark, at, rows.schema)


@query("""SELECT 'abstract' AS section, count(*) AS n FROM documents WHERE NOT (text IS NULL OR lower(trim(text)) IN ('', 'nan', 'none', 'null', '<na>', 'no citations found')) UNION ALL
    SELECT 'Intro', count(*) FROM documents WHERE lang = 'en' AND NOT (text IS NULL OR lower(trim(text)) IN ('', 'nan', 'none', 'null', '<na>', 'no citations found'))""")
def section_chunks(spark, d):
    """Abstracts and sections as chunks with metadata and keys that don't repeat."""
    s = F.when(F.col("lang") == "en", F.array(F.struct(F.lit("Intro").alias("heading"), F.col("text").alias("text"))))
    papers = table(spark, d, "documents").select("doc_id", F.col("text").alias("abstract"), s.alias("sections"))
    return RT.chunks(papers, "doc_id", "abstract", "sections").groupBy("section").agg(F.count("*").alias("n"))


@query(f"""{_PAGE_BM25}, cand AS (SELECT * FROM s {_TOPK} <= 100), u AS (SELECT page_id, regexp_replace(lower(url), '[^a-z]', '', 'g') AS sec FROM pages)
    SELECT item_id, page_id, score FROM cand JOIN u USING (page_id) WHERE contains(sec, 'html') OR contains(sec, 'b') {_TOPK} <= 3""")
def filtered_topk(spark, d):
    """The three best, of the 100 best of all pages, whose section name holds a keyword."""
    found = _pages_hits(spark, d, 100).join(table(spark, d, "pages").select("page_id", "url"), "page_id").where(RT.sections_matching("url", "html") | RT.sections_matching("url", "b"))
    place = F.expr("row_number() OVER (PARTITION BY item_id ORDER BY score DESC, page_id)")
    return found.withColumn("place", place).where("place <= 3").select("item_id", "page_id", "score")
