"""Scans and sinks: CSV, JSON documents, JSON lines, shards by key, file names as keys, PDF checks, TEI, cached calls."""

from __future__ import annotations

from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from siltwork.operators.order import with_rank
from siltwork.sources.shared import exists

CSV = {"header": True, "multiLine": True, "quote": "\"", "escape": "\"", "nullValue": "\\N", "emptyValue": "", "lineSep": "\n"}
CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header; cells may hold quotes and line breaks. \\N is null. The schema is given: a scan to infer it
    would read everything twice."""
    return spark.read.options(**CSV).schema(schema).csv(path)


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with types inferred, at the price of a second scan."""
    return spark.read.options(**CSV).option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**{k: v for k, v in CSV.items() if k not in ("multiLine", "emptyValue")}).option("escapeQuotes", True).csv(path)


def write_json_documents(df: DataFrame, path: str, rows: int = 50_000) -> None:
    """Files that each hold one JSON list, of so many rows of a task at most. A reader takes one document of a file, so no
    two lists may share one."""
    at = F.monotonically_increasing_id()
    dealt = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.shiftright(at, 33).alias("task"), F.floor(at.bitwiseAND((1 << 33) - 1) / rows).alias("block"))
    lists = dealt.groupBy("task", "block").agg(F.to_json(F.collect_list("row")).alias("value")).select("value")
    lists.write.option("maxRecordsPerFile", 1).option("lineSep", " ").text(path)


def read_json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that each hold one JSON document or a list of objects."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """An object a line; blank and corrupt lines are left out."""
    return spark.read.option("mode", "DROPMALFORMED").schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """Nulls are written as such, so that all rows have all fields."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def keyed_by_file_name(spark: SparkSession, path: str, schema: StructType | str, pattern: str, name: str, whole_path: bool = False) -> DataFrame:
    """JSON files with a key taken from the file's name, or its whole path, by the first group of a pattern; others have an
    empty key."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn(name, F.regexp_extract(F.col("_metadata.file_path" if whole_path else "_metadata.file_name"), pattern, 1))


def first_readable(spark: SparkSession, places: list[tuple[str, Callable[[str], DataFrame]]]) -> DataFrame:
    """The first of several (path, reader) of which the path exists."""
    for path, read in places:
        if exists(spark, path):
            return read(path)
    raise FileNotFoundError(", ".join(path for path, _ in places))


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as columns joined by _, arrays and maps as JSON: the form of an audit CSV."""

    def leaves(schema: StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema.fields:
            here = (*path, f.name)
            c = F.col(".".join(f"`{p}`" for p in here))
            if isinstance(f.dataType, StructType):
                out += leaves(f.dataType, here)
            else:
                out.append((F.to_json(c) if f.dataType.typeName() in ("array", "map") else c).alias("_".join(here)))
        return out

    return df.select(*leaves(df.schema, ()))


def write_shards(df: DataFrame, path: str, key: str) -> None:
    """A folder of JSON lines for each key; only the folders of keys in df are replaced, each when its job commits."""
    df.repartition(F.col(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).partitionBy(key).json(path)


def load_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of all shards; corrupt lines are left out."""
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    rows = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(wide).json(path)
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def backfill(shards: DataFrame, legacy: list[DataFrame], key: str) -> DataFrame:
    """Shards, and rows of older files for keys that no shard has; fields that one lacks are null."""
    out = shards
    known = shards.select(key).distinct()
    for rows in legacy:
        out = out.unionByName(rows.join(known, key, "left_anti"), allowMissingColumns=True)
    return out


def with_record_ids(rows: DataFrame, id_column: str | None, text: str, order: list[Column], name: str = "record_id") -> DataFrame:
    """Rows with a text that isn't blank, and an id: the stripped cell, or row_<position from 0> where it is empty."""
    placed = with_rank(rows, order, "__place")
    made = F.concat(F.lit("row_"), (F.col("__place") - 1).cast("string"))
    own = F.nullif(F.trim(F.col(id_column).cast("string")), F.lit("")) if id_column else F.lit(None).cast("string")
    return placed.withColumn(name, F.coalesce(own, made)).where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").drop("__place")


def valid_pdf(content: Column, length: Column, least: int = 1024) -> Column:
    """Whether a file's bytes look like a whole PDF."""
    return (length >= least) & (F.substring(content, 1, 5) == F.lit(b"%PDF-"))


def pdf_status(content: Column, length: Column) -> Column:
    """ok, too_small or not_pdf."""
    magic = F.substring(content, 1, 5) == F.lit(b"%PDF-")
    return F.when(valid_pdf(content, length), "ok").when(magic, "too_small").otherwise("not_pdf")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with a status."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", pdf_status(F.col("content"), F.col("length")).alias("status"))


_STRINGS = ArrayType(StringType())
TEI_SCHEMA = StructType(
    [
        StructField("title", StringType()),
        StructField("authors", _STRINGS),
        StructField("abstract", StringType()),
        StructField("sections", ArrayType(StructType([StructField("heading", StringType()), StructField("paragraphs", _STRINGS)]))),
        StructField("references", ArrayType(StructType([StructField(n, StringType()) for n in ("title", "year", "doi")]))),
    ]
)


def parse_tei(xml: str | None) -> dict | None:
    """A paper's record from its TEI; null for no text, broken XML or a document type (entities aren't expanded)."""
    if not xml or "<!DOCTYPE" in xml:
        return None
    try:
        root = ElementTree.fromstring(xml.encode())
    except ElementTree.ParseError:
        return None
    words = lambda e: " ".join("".join(e.itertext()).split()) if e is not None else ""
    divs = []
    for div in root.iterfind(".//{*}text/{*}body/{*}div"):
        paragraphs = [p for p in map(words, div.iterfind("{*}p")) if p]
        divs.append({"heading": words(div.find("{*}head")), "paragraphs": paragraphs})
    abstract = words(root.find(".//{*}profileDesc/{*}abstract"))
    if not abstract:
        abstract = next((" ".join(s["paragraphs"]) for s in divs if s["heading"].lower() == "abstract"), "")
    references = []
    for b in root.iterfind(".//{*}listBibl/{*}biblStruct"):
        date = b.find(".//{*}date")
        doi = next((words(i) for i in b.iterfind(".//{*}idno") if i.get("type", "").upper() == "DOI"), None)
        references.append({"title": words(b.find(".//{*}title")), "year": (date.get("when", "")[:4] or None) if date is not None else None, "doi": doi})
    authors = [words(p) for p in root.iterfind(".//{*}sourceDesc//{*}author/{*}persName")]
    return {"title": words(root.find(".//{*}titleStmt/{*}title")), "authors": authors, "abstract": abstract, "sections": divs, "references": references}


@F.pandas_udf(TEI_SCHEMA)
def _tei(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_tei(x) or dict.fromkeys(TEI_SCHEMA.names) for x in xml], columns=TEI_SCHEMA.names)


def tei_record(xml: Column) -> Column:
    return _tei(xml)


def call_key(*parts: Column) -> Column:
    """24 hex digits of SHA-256 over the inputs of a call; null inputs differ from empty ones."""
    return F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, 24)


def cached_calls(rows: DataFrame, cache: str, inputs: list[str], compute: Callable[[DataFrame], DataFrame], outputs: list[str]) -> DataFrame:
    """rows with the outputs of a costly call. Each distinct input that the cache (a Parquet folder) lacks is computed
    once and appended; compute gets key and inputs and adds the outputs."""
    spark = rows.sparkSession
    keyed = rows.withColumn("__key", call_key(*[F.col(c) for c in inputs]))
    asked = keyed.select("__key", *inputs).dropDuplicates(["__key"])
    if exists(spark, cache):
        asked = asked.join(spark.read.parquet(cache).select("__key"), "__key", "left_anti")
    compute(asked).select("__key", *outputs).write.mode("append").parquet(cache)
    # a writer that ran at the same time may have added a key twice
    known = spark.read.parquet(cache).dropDuplicates(["__key"])
    return keyed.join(known, "__key", "left").drop("__key")
