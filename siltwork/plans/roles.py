"""Queries of rewards by role, step scores, redundancy in groups, further report grammars and scans, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltwork.functions import metrics as M
from siltwork.functions import rewards as R
from siltwork.functions import roles as A
from siltwork.operators import pairs as P
from siltwork.operators import retrieve as RT
from siltwork.operators import rule_score as RS
from siltwork.operators import select as SEL
from siltwork.plans.catalog import ORACLE_SQL, conversation_pairs, query, spread, table
from siltwork.sources import files as S
from siltwork.sources.shared import fresh_path

_PARTS = {"f1": "l_discount * 10", "grounding": "l_tax * 10", "specificity": "l_quantity / 50.0", "severity": "l_discount * 5", "dedup": "l_tax * 5", "organization": "l_quantity / 100.0", "rouge": "l_tax * 3", "length_penalty": "l_discount * 2", "redundancy_penalty": "l_tax * 2"}


def _sql_sum(weights: dict[str, float], parts: dict[str, str]) -> str:
    return " + ".join(f"{w}::DOUBLE * ({parts[n]})" for n, w in weights.items())


def _sql_clamp(x: str) -> str:
    return f"greatest(0, least(1, {x}))"


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_tax, l_quantity % 4 AS matched, l_linenumber % 3 AS novel, l_linenumber % 7 AS n_pred, l_orderkey % 5 AS n_gt, {_sql_clamp(_sql_sum(A.WORKER_WEIGHTS, _PARTS))} AS worker, {_sql_clamp(_sql_sum(A.MASTER_WEIGHTS, _PARTS))} AS master FROM lineitem),
    p AS (SELECT *, (matched + 0.5::DOUBLE * novel) / greatest(n_pred, 1) AS p, matched / greatest(n_gt, 1)::DOUBLE AS r, master - worker AS delta FROM c)
    SELECT l_orderkey, l_linenumber, round(worker, 6) AS worker, round(master, 6) AS master,
    round(CASE WHEN n_pred = 0 THEN 0 ELSE (CASE WHEN n_gt = 0 THEN p WHEN p + r < 1e-9 THEN 0 ELSE 3.25::DOUBLE * p * r / (2.25::DOUBLE * p + r + 1e-9::DOUBLE) END) * (0.5::DOUBLE + 0.5::DOUBLE * l_tax * 10) END, 6) AS list_f1,
    round({_sql_clamp(f"0.4::DOUBLE * {_sql_clamp('0.5::DOUBLE + 2 * delta')} + 0.35::DOUBLE * l_tax * 10 + 0.25::DOUBLE * {_sql_clamp('delta / greatest(1 - worker, 0.05::DOUBLE)')}")}, 6) AS feedback FROM p""")
def teacher_composites(spark, d):
    """Composites of workers and masters, the F-beta of their items, and what feedback improved."""
    parts = {n: F.expr(e) for n, e in _PARTS.items()}
    rows = table(spark, d, "lineitem").withColumn("worker", A.composite(parts, A.WORKER_WEIGHTS)).withColumn("master", A.composite(parts, A.MASTER_WEIGHTS))
    c = F.col
    f1 = A.item_list_f1(c("l_quantity") % 4, c("l_linenumber") % 3, c("l_linenumber") % 7, c("l_orderkey") % 5, c("l_tax") * 10)
    told = A.feedback(c("worker"), c("master"), c("l_tax") * 10)
    return rows.select("l_orderkey", "l_linenumber", F.round("worker", 6).alias("worker"), F.round("master", 6).alias("master"), F.round(f1, 6).alias("list_f1"), F.round(told["composite"], 6).alias("feedback"))


@query("""WITH t AS (SELECT conv_id, turn, '### Alpha ' || coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN chr(10) || '- a b' || chr(10) || '- c d' || chr(10) || '* e f' ELSE '' END AS t FROM conversations),
    n AS (SELECT *, (contains(t, 'Alpha')::INT + contains(t, 'Beta')::INT + contains(t, 'Gamma')::INT) AS named, len(regexp_extract_all(t, '(?m)^\\s*[-*•]\\s+\\S')) AS bullets FROM t),
    s AS (SELECT *, named / 3.0::DOUBLE AS coverage, least(1, CASE WHEN contains(lower(t), 'master') THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN bullets >= 6 THEN 0.3::DOUBLE WHEN bullets >= 3 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN named >= 1.5 THEN 0.4::DOUBLE WHEN named > 0 THEN 0.2::DOUBLE ELSE 0 END) AS structure FROM n)
    SELECT conv_id, turn, round(coverage, 6) AS coverage, round(structure, 6) AS structure, round(0.55::DOUBLE * coverage + 0.45::DOUBLE * structure, 6) AS handoff FROM s""")
def leader_handoffs(spark, d):
    """A leader's summaries for the master: workers named, sections and bullets."""
    said = F.concat(F.lit("### Alpha "), F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, "\n- a b\n- c d\n* e f").otherwise(""))
    got = table(spark, d, "conversations").select("conv_id", "turn", A.handoff(said, F.array(*map(F.lit, ("Alpha", "Beta", "Gamma")))).alias("h"))
    return got.select("conv_id", "turn", F.round("h.coverage", 6).alias("coverage"), F.round("h.structure", 6).alias("structure"), F.round("h.composite", 6).alias("handoff"))


_PLAIN = ", ".join(f"'{w}'" for w in A.PLAIN_WORDS)


@query(f"""WITH i AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda w: length(w) > 3 AND w NOT IN ({_PLAIN})) AS ws FROM conversations WHERE role = 'assistant'),
    p AS (SELECT conv_id, lower(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS low FROM conversations WHERE role = 'user' GROUP BY 1),
    b AS (SELECT conv_id, avg((len(ws) = 0 OR len(list_filter(ws, lambda w: contains(low, w))) / greatest(len(ws), 1)::DOUBLE < 0.15)::INT) AS s FROM i JOIN p USING (conv_id) WHERE low <> '' GROUP BY 1)
    SELECT c.conv_id, round(coalesce(s, 0.5), 6) AS boilerplate FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b USING (conv_id)""")
def boilerplate_shares(spark, d):
    """How many answers of each conversation share hardly any word with its questions."""
    text = F.coalesce("text", F.lit(""))
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "assistant", text)).alias("items"), F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", text.alias("t"))))).alias("u"))
    paper = F.array_join(F.transform("u", lambda x: x["t"]), "\n")
    return lists.select("conv_id", F.round(A.boilerplate_share(F.col("items"), paper), 6).alias("boilerplate"))


_ROLE = "experimental_evaluation"
_sql_has = lambda c, p: f"regexp_matches({c}, '(?i){p}')::INT"
_sql_words = lambda c: f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda z: z <> ''))"


@query(f"""WITH s AS ({ORACLE_SQL["pair_similarity_tfidf"]}),
    g AS (SELECT conv_id, turn AS gt_id, {" + ".join(_sql_has("coalesce(text, '')", w) for w in A.ROLE_KEYWORDS[_ROLE])} > 0 AS own FROM conversations WHERE role = 'user'),
    o AS (SELECT conv_id, llm_id, avg((cosine > 0.25)::INT) AS overlap FROM s JOIN g USING (conv_id, gt_id) WHERE own GROUP BY ALL),
    a AS (SELECT conv_id, turn AS llm_id, coalesce(text, '') AS t FROM conversations WHERE role = 'assistant'),
    p AS (SELECT conv_id, llm_id, least(1, ({" + ".join(_sql_has("t", w) for w in A.ROLE_KEYWORDS[_ROLE])}) / 4.0::DOUBLE) AS category, least(1, ({" + ".join(_sql_has("t", w) for w in A.ROLE_SPECIFICS)}) / 3.0::DOUBLE) AS specificity,
        least(1, ({" + ".join(f"len(regexp_extract_all(t, '(?i){w}'))" for w in A.ROLE_EVIDENCE)}) * 0.15::DOUBLE) AS evidence, greatest(0, CASE WHEN {_sql_words("t")} < 30 THEN 0.2::DOUBLE WHEN {_sql_words("t")} < 80 THEN 0.5::DOUBLE ELSE least(1, {_sql_words("t")} / 200.0::DOUBLE) END - 0.1::DOUBLE * ({" + ".join(f"contains(lower(t), '{w}')::INT" for w in A.ROLE_GENERIC)})) AS quality FROM a)
    SELECT conv_id, llm_id, round(overlap, 6) AS overlap, round((2 * category + 1.5::DOUBLE * specificity + evidence + 1.5::DOUBLE * coalesce(overlap, 0.5::DOUBLE) + quality) / 7, 6) AS reward,
        round(((2 * category + 1.5::DOUBLE * specificity + evidence + 1.5::DOUBLE * coalesce(overlap, 0.5::DOUBLE) + quality) / 7 + CASE WHEN llm_id % 4 = 1 THEN quality ELSE 0 END) / CASE WHEN llm_id % 4 = 1 THEN 2 ELSE 1 END, 6) AS combined FROM p LEFT JOIN o USING (conv_id, llm_id)""")
def role_rewards(spark, d):
    """The reward of each answer as a worker's of one role, and combined with a second reward where there is one."""
    pairs = conversation_pairs(spark, d)
    cosine = P.tfidf_cosine(pairs, ["conv_id", "gt_id", "llm_id"], "gt_text", "llm_text")
    refs = table(spark, d, "conversations").where("role = 'user'").select("conv_id", F.col("turn").alias("gt_id"), A.role_relevant(F.col("text"), _ROLE).alias("own"))
    overlap = cosine.join(refs.where("own"), ["conv_id", "gt_id"]).groupBy("conv_id", "llm_id").agg(F.avg((F.round("cosine", 6) > 0.25).cast("double")).alias("overlap"))
    parts = A.role_parts(F.col("text"), _ROLE)
    said = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", F.col("turn").alias("llm_id"), *[c.alias(n) for n, c in parts.items()])
    got = said.join(overlap, ["conv_id", "llm_id"], "left").withColumn("r", A.role_reward({n: F.col(n) for n in parts}, F.col("overlap")))
    both = A.combined_reward(F.col("r"), F.when(F.col("llm_id") % 4 == 1, F.col("quality")), F.lit(None).cast("double"))
    return got.select("conv_id", "llm_id", F.round("overlap", 6).alias("overlap"), F.round("r", 6).alias("reward"), F.round(both, 6).alias("combined"))


_REVIEW_TEXT = "'Novelty Score: 3. Evidence: compared to ' || coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' Validation Score: 2 and scope limitation' ELSE '' END"


@query(f"""WITH t AS (SELECT d.doc_id, {_REVIEW_TEXT.replace("doc_id", "d.doc_id")} AS t, coalesce(text, '') AS x, source, coalesce(quality, 0)::DOUBLE AS g FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
    w AS (SELECT *, lower(t) AS low, least(1, {_sql_words("t")} / 200.0::DOUBLE) AS words, least(1, {_sql_words("x")} / 35.0::DOUBLE) AS few FROM t),
    s AS (SELECT doc_id,
        0.1::DOUBLE * 0.5 + 0.15::DOUBLE * 0.5 + 0.5::DOUBLE * g + 0.25::DOUBLE * ((0.4::DOUBLE * {_sql_has("x", A.CLAIM_NUMBER)} + 0.3::DOUBLE * {_sql_has("x", A.CLAIM_METHOD)} + 0.3::DOUBLE * {_sql_has("x", A.CLAIM_COMPARISON)}) + 1.0::DOUBLE) / 2 AS claims,
        0.2::DOUBLE * ({" + ".join(_sql_has("t", p) for p in A.NOVELTY_MARKS)}) / 3 + 0.3::DOUBLE * g + 0.25::DOUBLE * CASE WHEN source IS NULL THEN 0.5::DOUBLE WHEN length(source) > 5 AND contains(low, left(lower(source), 30)) THEN 1 / 3.0::DOUBLE ELSE 0 END + 0.25::DOUBLE * (0.3::DOUBLE * {_sql_has("t", A.NOVELTY_CONCRETE)} + 0.3::DOUBLE * {_sql_has("t", A.NOVELTY_COMPARED)} + 0.4::DOUBLE * words) AS novelty,
        0.2::DOUBLE * least(1, len(regexp_extract_all(t, '(?i){A.SCOPE_MARKS}')) / 3.0::DOUBLE) + 0.25::DOUBLE * g + 0.3::DOUBLE * ({" + ".join(f"contains(low, '{w}')::INT" for w in A.SCOPE_DIMENSIONS)}) / 4 + 0.25::DOUBLE * (0.3::DOUBLE * {_sql_has("t", "Evidence")} + 0.3::DOUBLE * {_sql_has("t", "limitation")} + 0.4::DOUBLE * words) AS scope, length(t) AS n,
        0.2::DOUBLE * (0.35::DOUBLE * {_sql_has("x", A.LIMITATION_CONCRETE)} + 0.15::DOUBLE * (coalesce(source, '') <> '')::INT + 0.4::DOUBLE * few) + 0.2::DOUBLE * g + 0.15::DOUBLE * 0.5 + 0.2::DOUBLE * g + 0.25::DOUBLE * 0.5 AS limitations FROM w),
    k AS (SELECT doc_id, claims, CASE WHEN n < 50 THEN 0 ELSE novelty END AS novelty, CASE WHEN n < 50 THEN 0 ELSE scope END AS scope, limitations FROM s)
    SELECT doc_id, round(claims, 6) AS claims, round(novelty, 6) AS novelty, round(scope, 6) AS scope, round(limitations, 6) AS limitations, round(0.15::DOUBLE * claims + 0.25::DOUBLE * novelty + 0.25::DOUBLE * scope + 0.35::DOUBLE * limitations, 6) AS review FROM k""")
def review_steps(spark, d):
    """Scores of the four steps of a claim-based review; similarities stand in columns."""
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("g"))
    rows = spread(table(spark, d, "documents"), "doc_id").select("doc_id", "text", "source").join(labels, "doc_id", "left").withColumn("g", F.coalesce("g", F.lit(0.0))).withColumn("t", F.expr(_REVIEW_TEXT))
    g, none, half = F.col("g"), F.lit(None).cast("string"), F.lit(0.5)
    claim = lambda text, section, quote: F.struct(text.alias("claim"), F.lit(section).alias("section"), F.lit("x").alias("type"), quote.alias("evidence_quote"))
    claims = F.array(claim(F.col("text"), "Abstract", none), claim(F.lit("12 % better than the model"), "Annex", F.lit("q")))
    sections = F.array(F.lit("Abstract"), F.lit("Method"), F.lit("Annex"))
    refs = F.when(F.col("source").isNotNull(), F.array("source"))
    items = F.array(F.struct(F.col("text").alias("limitation"), F.col("source").alias("category"), none.alias("severity")))
    steps = {"claims": A.claims_step(claims, sections, g), "novelty": A.novelty_step(F.col("t"), g, refs), "scope": A.scope_step(F.col("t"), g), "limitations": A.limitations_step(items, g, half, g, half)}
    got = rows.select("doc_id", *[c.alias(n) for n, c in steps.items()])
    return got.select("doc_id", *[F.round(n, 6).alias(n) for n in steps], F.round(A.review_score({n: F.col(n) for n in steps}), 6).alias("review"))


@query("""WITH e AS (SELECT vec_id, vec_id // 20 AS paper, vec_id % 4 = 0 AS item, embedding::DOUBLE[] AS e FROM embeddings),
    m AS (SELECT a.paper, a.vec_id, max(list_cosine_similarity(a.e, b.e)) AS m FROM e a JOIN e b ON a.paper = b.paper AND a.item AND NOT b.item GROUP BY ALL),
    n AS (SELECT paper, count(*) AS n FROM e WHERE item GROUP BY paper),
    o AS (SELECT a.paper, sum(list_cosine_similarity(a.e, b.e)) AS o FROM e a JOIN e b ON a.paper = b.paper AND a.item AND b.item AND a.vec_id <> b.vec_id GROUP BY ALL)
    SELECT n.paper, round(avg(m.m), 6) AS grounding, round(CASE WHEN n.n > 1 THEN 1 - any_value(o.o) / (n.n * n.n) ELSE 0.5 END, 6) AS non_redundancy FROM n JOIN m USING (paper) LEFT JOIN o USING (paper) GROUP BY n.paper, n.n""")
def chunk_grounding(spark, d):
    """The mean over items of their largest cosine to a paper's chunks, and how unlike the items are."""
    rows = table(spark, d, "embeddings").withColumn("paper", F.expr("vec_id div 20"))
    items = rows.where("vec_id % 4 = 0")
    near = RT.chunk_grounding(items, rows.where("vec_id % 4 <> 0"), "paper", "vec_id", "embedding").groupBy("paper").agg(F.avg("cosine").alias("g"))
    return near.join(RT.non_redundancy(items, "paper", "embedding"), "paper").select("paper", F.round("g", 6).alias("grounding"), F.round("non_redundancy", 6).alias("non_redundancy"))


@query("""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.label <> b.label)
    SELECT query_id, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) = 1""")
def cross_group_max_sim(spark, d):
    """The nearest vector of another label, of a stated query set against all rows."""
    rows = table(spark, d, "embeddings")
    return RT.dense_exact(rows, rows.where("vec_id % 20 = 0"), key="vec_id", vector="embedding", k=1, apart="label").select("query_id", "vec_id", "score")


_STOP = ", ".join(f"'{w}'" for w in M.STOP_WORDS)


@query(f"""WITH r AS (SELECT conv_id, turn, text FROM conversations), n AS (SELECT conv_id, count(*) AS n FROM r GROUP BY 1),
    tf AS (SELECT conv_id, turn, w, count(*) AS tf FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN_]+')) AS w FROM r) WHERE length(w) >= 2 AND w NOT IN ({_STOP}) GROUP BY ALL),
    df AS (SELECT conv_id, w, count(*) AS df FROM tf GROUP BY ALL), x AS (SELECT conv_id, turn, w, tf * (ln((1 + n) / (1.0::DOUBLE + df)) + 1) AS x FROM tf JOIN df USING (conv_id, w) JOIN n USING (conv_id)),
    u AS (SELECT conv_id, turn, w, x / sqrt(sum(x * x) OVER (PARTITION BY conv_id, turn)) AS x FROM x), m AS (SELECT a.conv_id, a.turn, b.turn AS o, sum(a.x * b.x) AS s FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.w = b.w AND a.turn <> b.turn GROUP BY ALL),
    h AS (SELECT conv_id, count(*) AS near FROM (SELECT conv_id, turn, max(s) AS m FROM m GROUP BY ALL) WHERE m > 0.6 GROUP BY 1),
    k AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t-\\r]+'), lambda z: z <> '')) AS ws FROM r),
    j AS (SELECT a.conv_id, avg((CASE WHEN len(a.ws) + len(b.ws) > 0 THEN len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))::DOUBLE ELSE 0 END > 0.5)::INT) AS alike FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY 1)
    SELECT n.conv_id, round(CASE WHEN n >= 3 AND n.conv_id IN (SELECT conv_id FROM df) THEN coalesce(near, 0) / n::DOUBLE WHEN n >= 2 THEN least(1, 3 * coalesce(alike, 0)) ELSE 0 END, 6) AS redundancy FROM n LEFT JOIN h USING (conv_id) LEFT JOIN j USING (conv_id)""")
def tfidf_redundancy(spark, d):
    """How many items of each group another one repeats, by TF-IDF of the group."""
    got = P.group_redundancy(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text")
    return got.select("conv_id", F.round("redundancy", 6).alias("redundancy"))


@query("""WITH l AS (SELECT conv_id, turn, i, ls[i] AS x FROM (SELECT conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT conv_id, turn, string_split('- none yet' || chr(10) || '- **Scope:**' || chr(10) || '  - ' || replace(coalesce(text, 'x'), chr(10), ' ') || chr(10) || 'no item' || chr(10) || '- **Data** few' || chr(10) || '- small', chr(10)) AS ls FROM conversations))),
    c AS (SELECT *, CASE WHEN regexp_matches(x, '^\\s*-\\s*\\*\\*.+?\\*\\*') THEN trim(regexp_extract(x, '^\\s*-\\s*\\*\\*(.+?)\\*\\*', 1), ' :') END AS c FROM l),
    k AS (SELECT *, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING), 'General') AS category FROM c)
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS llm_id, category, regexp_replace(regexp_extract(rtrim(x), '^\\s*-\\s+(.+)$', 1), '^\\s+|\\s+$', '', 'g') AS limitation FROM k WHERE c IS NULL AND regexp_matches(rtrim(x), '^\\s*-\\s+.') AND NOT regexp_matches(x, '^\\s*- \\*\\*')""")
def listed_items(spark, d):
    """Reports of bullets in which bold ones name categories."""
    said = F.concat(F.lit("- none yet\n- **Scope:**\n  - "), F.replace(F.coalesce("text", F.lit("x")), F.lit("\n"), F.lit(" ")), F.lit("\nno item\n- **Data** few\n- small"))
    got = table(spark, d, "conversations").select("conv_id", "turn", F.explode(A.listed_items(said)).alias("x"))
    return got.select("conv_id", "turn", F.col("x.llm_id").cast("long").alias("llm_id"), "x.category", "x.limitation")


@query()
def headed_items(spark, d):
    """Reports of headings, numbered items and bullets with titles (a fold without SQL; tests hold it against a loop)."""
    said = F.concat(F.lit("## Design\n1. **Scope**: "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("\n**Data:**\n* few: rows\n- plain"))
    got = table(spark, d, "conversations").select("conv_id", "turn", F.explode(A.headed_items(said)).alias("x"))
    return got.select("conv_id", "turn", F.col("x.llm_id").cast("long").alias("llm_id"), "x.category", "x.limitation")


@query("""SELECT event_id, user_id, event_type FROM events WHERE event_type IS NOT NULL""")
def keyed_by_path(spark, d):
    """JSON files of which the folder names a key."""
    rows, at = table(spark, d, "events").where("event_type IS NOT NULL").select("event_id", "user_id", "event_type"), fresh_path(spark, "keyed")
    rows.write.partitionBy("event_type").json(at)
    return S.keyed_by_file_name(spark, f"{at}/*", "event_id long, user_id long", r"event_type=([^/]*)/", "event_type", whole_path=True)


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '%PDF-' ELSE '' END || html AS c FROM pages WHERE html IS NOT NULL)
    SELECT page_id, CASE WHEN strlen(c) >= 1024 AND starts_with(c, '%PDF-') THEN 'ok' WHEN starts_with(c, '%PDF-') THEN 'too_small' ELSE 'not_pdf' END AS status FROM p""")
def pdf_checks(spark, d):
    """Whether bytes look like a whole PDF."""
    c = F.encode(F.concat(F.when(F.col("page_id") % 3 == 0, "%PDF-").otherwise(""), "html"), "UTF-8")
    rows = table(spark, d, "pages").where("html IS NOT NULL").select("page_id", c.alias("content")).withColumn("length", F.octet_length("content"))
    return rows.select("page_id", S.pdf_status(F.col("content"), F.col("length")).alias("status"))


@query("SELECT doc_id, quality FROM labels")
def first_readable_source(spark, d):
    """A history read from the second of two places, as the first isn't there."""
    at = fresh_path(spark, "state")
    S.write_json_lines(table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality")), at)
    schema = "doc_id long, quality long"
    return S.first_readable(spark, [(fresh_path(spark, "missing"), lambda p: S.read_csv(spark, p, schema)), (at, lambda p: S.read_json_lines(spark, p, schema))])


@query("""WITH u AS (SELECT vec_id, vec_id // 20 AS paper, vec_id % 2 = 0 AS said, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
    s AS (SELECT a.paper, a.vec_id AS x, b.vec_id AS y, list_dot_product(a.v, b.v) AS c FROM u a JOIN u b ON a.paper = b.paper AND a.said AND NOT b.said),
    p AS (SELECT paper, avg(m) AS p FROM (SELECT paper, x, max(c) AS m FROM s GROUP BY ALL) GROUP BY 1), r AS (SELECT paper, avg(m) AS r FROM (SELECT paper, y, max(c) AS m FROM s GROUP BY ALL) GROUP BY 1), k AS (SELECT DISTINCT paper FROM u)
    SELECT paper, round(coalesce(p, 0), 6) AS precision, round(coalesce(r, 0), 6) AS recall, round(coalesce(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END, 0), 6) AS f1 FROM k LEFT JOIN p USING (paper) LEFT JOIN r USING (paper)""")
def greedy_cosine_f1(spark, d):
    """Two lists of word vectors of each paper matched greedily by cosine."""
    e = F.col("embedding").cast("array<double>")
    v = F.transform(e, lambda x: x / F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, y: a + y * y)))
    rows = table(spark, d, "embeddings").select(F.expr("vec_id div 20").alias("paper"), (F.col("vec_id") % 2 == 0).alias("said"), v.alias("v"))
    lists = rows.groupBy("paper").agg(F.collect_list(F.when(F.col("said"), F.col("v"))).alias("a"), F.collect_list(F.when(~F.col("said"), F.col("v"))).alias("b"))
    got = lists.select("paper", M.greedy_cosine(F.col("a"), F.col("b")).alias("x"))
    return got.select("paper", *[F.round(f"x.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


def _toy_encoder(texts: list[str]) -> list[list[float]]:
    """Lengths and letters a; it refuses texts of an odd length, and batches that hold one."""
    if any(len(t) % 2 for t in texts):
        raise ValueError("odd length")
    return [[float(len(t)), float(t.count("a"))] for t in texts]


@query("""SELECT conv_id, turn, length(text)::DOUBLE AS size, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS a FROM conversations WHERE text IS NOT NULL AND length(text) % 2 = 0""")
def encoded_items(spark, d):
    """Texts through an encoder, one by one where a batch fails; items that it refuses are dropped."""
    got = RT.encoded(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", _toy_encoder).where("embedding IS NOT NULL")
    return got.select("conv_id", "turn", F.col("embedding")[0].alias("size"), F.col("embedding")[1].alias("a"))


@query("""WITH s AS (SELECT user_id, event_id AS arrival, event_id % 3 AS round, event_type, CASE event_id % 5 WHEN 0 THEN 'hop_search' WHEN 1 THEN 'hop_query' WHEN 2 THEN 'hop_draft' WHEN 3 THEN 'revised' ELSE 'final' END AS turn, event_type || '-' || event_id AS output FROM events),
    l AS (SELECT user_id, event_type, turn, arg_max(output, arrival) AS o FROM s WHERE turn LIKE 'hop%' GROUP BY ALL), r AS (SELECT user_id, event_type, output AS o FROM s WHERE turn = 'revised' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY round DESC, arrival) = 1),
    k AS (SELECT user_id, event_type, any_value(o) FILTER (WHERE turn = 'hop_search') AS a, any_value(o) FILTER (WHERE turn = 'hop_query') AS b, any_value(o) FILTER (WHERE turn = 'hop_draft') AS c FROM l GROUP BY ALL)
    SELECT k.user_id, k.event_type, coalesce(a, '') AS search, coalesce(b, '') AS retrieve, coalesce(r.o, c, '') AS synthesize FROM k LEFT JOIN r ON k.user_id IS NOT DISTINCT FROM r.user_id AND k.event_type IS NOT DISTINCT FROM r.event_type""")
def worker_outputs(spark, d):
    """What each worker of a rollout searched, retrieved and finally said."""
    c = F.col
    kind = F.element_at(F.array(*map(F.lit, ("hop_search", "hop_query", "hop_draft", "revised", "final"))), (c("event_id") % 5 + 1).cast("int"))
    rows = table(spark, d, "events").select("user_id", "event_type", c("event_id").alias("arrival"), (c("event_id") % 3).alias("round"), kind.alias("turn"), F.concat("event_type", F.lit("-"), c("event_id").cast("string")).alias("output"))
    return SEL.worker_outputs(rows, ["user_id", "event_type"], "turn", "round", "arrival", "output")


@query()
def stepwise_selection(spark, d):
    """Answers scored by their steps and by their likeness to the references, the best of each paper for fine-tuning and best
    and worst as a pair (step scores and ROUGE have no SQL; tests hold the parts)."""
    pairs = conversation_pairs(spark, d)
    step = R.worker_reward(R.search_reward(c := F.col("llm_text")), R.retrieve_reward(c, F.col("gt_text")), R.synthesis_reward(c, F.col("gt_text")))
    scored = pairs.groupBy("conv_id", "llm_id").agg(F.max("llm_text").alias("llm_text"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("gt_id", "gt_text"))), lambda x: x["gt_text"])).alias("gt_text")).where("trim(llm_text) <> ''")
    scored = scored.withColumn("steps", step).withColumn("similarity", M.rouge_l(F.col("llm_text"), F.col("gt_text"), stemmed=True)["f1"])
    scored = RS.blended(scored, {"steps": 0.5, "similarity": 0.5}, "score").withColumn("score", F.round("score", 4))
    best = SEL.top_k(scored, ["conv_id"], "score", "llm_id", 1).where("score >= 0.05").select("conv_id", F.col("llm_id").alias("best"), "score")
    return best.join(SEL.best_worst(scored, ["conv_id"], "score", "llm_id", 0.05).select("conv_id", "chosen", "rejected", F.round("score_gap", 4).alias("score_gap")), "conv_id", "left")
