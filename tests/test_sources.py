"""Sources, sinks and streams on small hard inputs."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltwork.sources import files as S
from siltwork.streaming import jobs as J

HARD = [(1, 'a "quoted", cell\nwith a line'), (2, ""), (3, None), (4, "\\"), (5, "ünï ☃")]


def test_csv_keeps_every_cell(spark, tmp_path):
    df = spark.createDataFrame(HARD, "i int, t string")
    S.write_csv(df, str(tmp_path / "c"))
    assert sorted(S.read_csv(spark, str(tmp_path / "c"), df.schema).collect()) == sorted(df.collect())


def test_json_lines_skip_what_is_broken(spark, tmp_path):
    (tmp_path / "rollout_7.jsonl").write_text('{"i": 1, "t": "x"}\n\n{"i": 2, "t":\n{"i": 3}\n')
    got = S.read_json_lines(spark, str(tmp_path), "i int, t string").collect()
    assert sorted((r.i, r.t) for r in got) == [(1, "x"), (3, None)]
    named = S.keyed_by_file_name(spark, str(tmp_path), "i int", r"rollout_(\d+)", "paper").where("i IS NOT NULL")
    assert {r.paper for r in named.collect()} == {"7"}


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"i": 1}, {"i": 2}], indent=1))
    assert S.read_json_documents(spark, str(tmp_path), "i int").count() == 2


def test_json_documents_share_no_file(spark, tmp_path):
    """Many lists from many tasks, ids that are null or below 0, repeated rows, and no rows at all."""
    from siltwork.plans import context

    rows = [(i, i % 2, 0) for i in range(-40, 400)] + [(None, 1, None), (None, None, None), (7, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality long, toxic long")
    labels.repartition(9).write.parquet(f"{tmp_path}/labels.parquet")
    wide = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {key: spark.conf.get(key) for key in wide}
    try:
        for key, value in wide.items():
            spark.conf.set(key, value)
        got = context.json_documents(spark, str(tmp_path)).collect()
        S.write_json_documents(labels, str(tmp_path / "j"), rows=3)
        again = S.read_json_documents(spark, str(tmp_path / "j"), labels.schema).collect()
        S.write_json_documents(labels.limit(0), str(tmp_path / "none"))
        assert S.read_json_documents(spark, str(tmp_path / "none"), labels.schema).count() == 0
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sorted(map(repr, got)) == sorted(map(repr, again)) == sorted(map(repr, labels.collect()))


def test_shards_replace_only_their_keys(spark, tmp_path):
    at = str(tmp_path / "s")
    schema = StructType.fromDDL("k int, v string")
    S.write_shards(spark.createDataFrame([(1, "a"), (2, "b")], schema), at, "k")
    S.write_shards(spark.createDataFrame([(2, "c")], schema), at, "k")
    (tmp_path / "s" / "k=1" / "killed.json").write_text('{"v": "cut')
    assert sorted((r.k, r.v) for r in S.load_shards(spark, at, schema).collect()) == [(1, "a"), (2, "c")]


def test_record_ids(spark):
    rows = spark.createDataFrame([(0, " x ", "t"), (1, "", "t"), (2, None, " "), (3, None, "t")], "o int, id string, t string")
    got = S.with_record_ids(rows, "id", "t", [F.col("o")]).orderBy("o").collect()
    assert [r.record_id for r in got] == ["x", "row_1", "row_3"]


def test_pdf_status(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-" + b"x" * 2000, "b.pdf": b"%PDF-1", "c.pdf": b"<html>" * 400}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.status for r in S.pdf_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "ok", "b.pdf": "too_small", "c.pdf": "not_pdf"}


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A  Paper</title></titleStmt>
<sourceDesc><biblStruct><analytic><author><persName><forename>A</forename> <surname>B</surname></persName></author></analytic></biblStruct></sourceDesc></fileDesc></teiHeader>
<text><body><div><head>Abstract</head><p>Short.</p></div><div><head>Method</head><p>One.</p><p>Two.</p></div></body>
<back><listBibl><biblStruct><analytic><title>Ref</title></analytic><monogr><imprint><date when="2020-01"/></imprint></monogr><idno type="DOI">10.1/x</idno></biblStruct></listBibl></back></text></TEI>"""


def test_tei(spark):
    rows = spark.createDataFrame([(1, TEI), (2, "<broken"), (3, None), (4, "<!DOCTYPE x><TEI/>"), (5, "<TEI/>")], "i int, x string")
    got = {r.i: r.t for r in rows.select("i", S.tei_record(F.col("x")).alias("t")).collect()}
    assert got[1].title == "A Paper" and got[1].authors == ["A B"] and got[1].abstract == "Short."
    assert [(s.heading, s.paragraphs) for s in got[1].sections] == [("Abstract", ["Short."]), ("Method", ["One.", "Two."])]
    assert [tuple(r) for r in got[1].references] == [("Ref", "2020", "10.1/x")]
    assert got[2].title is got[3].title is got[4].title is None and got[5].title == "" and got[5].sections == []


def test_cache_computes_only_what_is_missing(spark, tmp_path):
    at, seen = str(tmp_path / "c"), []

    def work(asked):
        seen.append(asked.count())
        return asked.withColumn("n", F.length("t"))

    rows = spark.createDataFrame(HARD + [(6, "")], "i int, t string")
    S.cached_calls(rows.where("i < 3"), at, ["t"], work, ["n"]).collect()
    got = S.cached_calls(rows, at, ["t"], work, ["n"])
    assert seen == [2, 3] and {r.i: r.n for r in got.collect()}[6] == 0 and got.count() == 6


def test_stream_resumes(spark, tmp_path):
    src, out, cp = [str(tmp_path / n) for n in ("src", "out", "cp")]
    rows = lambda n: spark.range(n).select("id", (F.col("id") % 2).alias("k"), F.lit("2024-01-01 00:30:00").cast("timestamp").alias("ts"))
    rows(10).write.parquet(src)
    for total in (10, 14):
        got = J.windowed(J.event_time(J.stream_parquet(spark, src), "ts", "1 day"), "ts", "1 hour", ["k"], [F.count("*").alias("n")])
        J.run_available(got, out, cp, "update")
        assert J.latest(spark, out, ["k", "start"]).agg(F.sum("n")).first()[0] == total
        rows(4).write.mode("append").parquet(src)


def test_resume_does_only_the_rest(spark, tmp_path):
    done, seen = str(tmp_path / "d"), []

    def work(todo):
        seen.append(todo.count())
        return todo.select("id")

    for n in (3, 5, 5):
        assert J.resume(spark.range(n), "id", done, work).count() == n
    assert seen == [3, 2, 0]


@pytest.mark.parametrize("parts", [("a", None), ("a", "")])
def test_keys_tell_null_from_empty(spark, parts):
    key = spark.range(1).select(S.call_key(*[F.lit(p).cast("string") for p in parts]).alias("k")).first().k
    assert len(key) == 24 and (key == spark.range(1).select(S.call_key(F.lit("a"), F.lit("")).alias("k")).first().k) == (parts[1] == "")


def test_hourly_counts_rows_of_any_batch(spark, tmp_path, monkeypatch):
    """Files in batches of one, the latest times first: rows far behind those seen still count."""
    import datetime
    import functools
    import os

    from siltwork.plans import files

    start = datetime.datetime(2024, 3, 1)
    rows = [(start + datetime.timedelta(days=d, minutes=20 * k), "ab"[k % 2], float(k)) for d in (20, 9, 0, 15, 9) for k in range(7)]
    known = set()
    for i in range(5):
        part = spark.createDataFrame(rows[7 * i : 7 * i + 7], "ts timestamp_ntz, event_type string, value double").coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/events.parquet")
        new = set(os.listdir(f"{tmp_path}/events.parquet")) - known
        known |= new
        for name in new:  # a stream takes older files first
            os.utime(f"{tmp_path}/events.parquet/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    monkeypatch.setattr(files.J, "stream_parquet", functools.partial(J.stream_parquet, files_a_batch=1))
    got = {(r.event_type, r.start): (r.n, r.total) for r in files.stream_hourly(spark, str(tmp_path)).collect()}
    want = {}
    for ts, kind, value in rows:
        n, total = want.get((kind, ts.replace(minute=0)), (0, 0.0))
        want[kind, ts.replace(minute=0)] = (n + 1, total + value)
    assert got == want
