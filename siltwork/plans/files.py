"""Queries through sources, sinks and streams, with the SQL of what they must return."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltwork.plans.catalog import query, table
from siltwork.sources import files as S
from siltwork.sources.shared import fresh_path
from siltwork.streaming import jobs as J


@query("SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents")
def csv_round_trip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    at = fresh_path(spark, "csv")
    S.write_csv(docs, at)
    return S.read_csv(spark, at, docs.schema).select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_lines_round_trip(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    at = fresh_path(spark, "jsonl")
    S.write_json_lines(rows, at)
    return S.read_json_lines(spark, at, rows.schema)


@query("""SELECT doc_id, quality, toxic, CASE WHEN quality = 1 THEN NULL ELSE 'legacy' END AS origin FROM labels""")
def shard_backfill(spark, d):
    """Shards of one quality, and older rows for the ids that no shard has."""
    rows = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    at = fresh_path(spark, "shards")
    S.write_shards(rows.where("quality = 1"), at, "toxic")
    shards = S.load_shards(spark, at, rows.schema)
    return S.backfill(shards, [rows.withColumn("origin", F.lit("legacy"))], "doc_id").select("doc_id", "quality", "toxic", "origin")


@query("SELECT p_partkey, p_name, p_brand AS kind_brand, p_size AS kind_size FROM part")
def flattened_audit(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("kind"))
    return S.flattened(rows)


@query("""WITH r AS (SELECT doc_id, source, text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source END AS source, text FROM documents))
    SELECT doc_id, coalesce(nullif(trim(source), ''), 'row_' || i) AS record_id FROM r WHERE trim(coalesce(text, '')) <> ''""")
def record_ids(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("source"), "text")
    return S.with_record_ids(rows, "source", "text", [F.col("doc_id")]).select("doc_id", "record_id")


@query("SELECT conv_id, turn, length(text) AS n FROM conversations WHERE text IS NOT NULL")
def cached_call(spark, d):
    """A call on each text: one run fills the cache with user texts, the next computes only what is missing."""
    rows = table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "role", "text")
    at = fresh_path(spark, "cache")
    measure = lambda asked: asked.withColumn("n", F.length("text").cast("long"))
    S.cached_calls(rows.where("role = 'user'"), at, ["text"], measure, ["n"])
    return S.cached_calls(rows, at, ["text"], measure, ["n"]).select("conv_id", "turn", "n")


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL""")
def stream_hourly(spark, d):
    """Counts an hour and type, through a stream whose updates replace one another. All rows count, in whatever order
    batches bring them, so there is no watermark; the state is a row an hour and type."""
    rows = J.event_time(J.stream_parquet(spark, f"{d}/events.parquet").select("ts", "event_type", "value"), "ts", None)
    got = J.windowed(rows, "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")])
    out = fresh_path(spark, "hourly")
    J.run_available(got, out, fresh_path(spark, "hourly-checkpoint"), "update")
    back = J.latest(spark, out, ["event_type", "start"])
    return back.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, g""")
def user_sessions(spark, d):
    rows = table(spark, d, "events").where("ts IS NOT NULL").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    got = J.sessions(rows, "ts", "6 hours", ["user_id"], [F.count("*").alias("n")])
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id, user_id, value FROM events WHERE ts IS NOT NULL")
def stream_once(spark, d):
    """Each event once, though the stream brings all of them twice."""
    rows = J.event_time(J.stream_parquet(spark, f"{d}/events.parquet").select("event_id", "user_id", "value", "ts"), "ts", "3650 days")
    out = fresh_path(spark, "once")
    J.run_available(J.once(rows.withColumn("__copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("__copy"), ["event_id"]), out, fresh_path(spark, "once-checkpoint"))
    return spark.read.parquet(out).select("event_id", "user_id", "value")


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'no_text' ELSE 'ok' END AS status FROM documents")
def resumed_work(spark, d):
    """Work that a first run did for labelled documents only, and a second one completes."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    done = fresh_path(spark, "done")
    work = lambda rows: rows.select("doc_id", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no_text").otherwise("ok").alias("status"))
    J.resume(docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi"), "doc_id", done, work)
    return J.resume(docs, "doc_id", done, work)
