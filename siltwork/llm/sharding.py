"""Sharding by a two-pass external shuffle.

Pass 1 scatters rows uniformly into memory-sized buckets by a seeded hash. Pass 2 puts each bucket into one order that
doesn't depend on how rows arrived, shuffles it by Fisher-Yates with a generator seeded by the bucket, and writes it.
The buckets, one after the other, are one uniformly shuffled sequence; shards are equal runs of it, so by the law
``rows`` their row counts are at most one apart, whatever keys, sources or copies are frequent.

Row counts of buckets are taken before pass 1, from keys and check sums alone, so pass 2 knows the shard and slot of each
row and writes each shard into a folder of its own: reading a shard reads nothing else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_on_exit, fresh_path, give_back

#: A bucket's rows are in memory at once.
BUCKET_BYTES = 32 << 20
SEED = 42


def _bytes(docs: DataFrame) -> Column:
    """About the bytes of a row: of its texts and binaries, of nested columns as JSON, and 8 of any other."""
    total = F.lit(16).cast("long")
    for f in docs.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        size = F.octet_length(c) if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(c))) if kind in ("array", "map", "struct") else F.lit(8)
        total = total + F.coalesce(size, F.lit(0))
    return total


def shuffle_buckets(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shards: int = 1, buckets: int | None = None, seed: int = SEED) -> DataFrame:
    """docs with size, text_crc32, shard and slot: each partition a shuffled bucket, a run of the whole shuffled sequence."""
    docs = docs.drop(*[c for c in docs.columns if c in ("size", "text_crc32", "shard", "slot", "bucket")])
    t = F.col(text)
    sized = docs.withColumn("size", (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long")).withColumn("text_crc32", F.crc32(F.coalesce(t, F.lit("")).cast("binary")))
    if buckets is None:
        total = docs.select(F.sum(_bytes(docs))).first()[0] or 0
        buckets = max(1, -(-total // BUCKET_BYTES), docs.sparkSession.sparkContext.defaultParallelism)
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64(F.col(key), "text_crc32", F.lit(seed)), F.lit(buckets)).cast("int"))
    # One number for each bucket; their count follows the bytes, a bucket's memory doesn't.
    counts = np.zeros(buckets, dtype=np.int64)
    for r in dealt.groupBy("bucket").count().collect():
        counts[r["bucket"]] = r["count"]
    rows = int(counts.sum())
    first = docs.sparkSession.sparkContext.broadcast(np.cumsum(counts) - counts)

    def fisher_yates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        # A task may hold several buckets; the order by hash key is the same wherever a row arrived.
        table = pa.Table.from_batches(held)
        order = pa.compute.sort_indices(table, sort_keys=[("bucket", "ascending"), (key, "ascending"), ("text_crc32", "ascending"), ("size", "ascending")])
        numbers = table["bucket"].combine_chunks().take(order).to_numpy()
        table = table.drop_columns("bucket")
        edges = np.flatnonzero(np.diff(numbers, prepend=-1, append=-1))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            mine = order.slice(low, high - low).to_numpy().copy()
            rng = np.random.default_rng([seed, zlib.crc32(b"bucket"), int(numbers[low])])
            for i, j in zip(range(len(mine) - 1, 0, -1), (rng.random(len(mine) - 1) * np.arange(len(mine), 1, -1)).astype(np.int64), strict=True):
                mine[i], mine[j] = mine[j], mine[i]
            place = first.value[numbers[low]] + np.arange(len(mine))
            shard = place * shards // rows
            slot = place - (shard * rows + shards - 1) // shards
            for start in range(0, len(mine), 2_000):
                span = slice(start, start + 2_000)
                part = table.take(pa.array(mine[span])).append_column("shard", pa.array(shard[span], pa.int32())).append_column("slot", pa.array(slot[span], pa.int64()))
                yield from part.combine_chunks().to_batches()
        del table, held
        give_back()

    return dealt.repartitionById(buckets, "bucket").mapInArrow(fisher_yates, dealt.drop("bucket").schema.add("shard", "integer").add("slot", "long"))


def write_shards(docs: DataFrame, path: str | None = None, *, shards: int = 40, text: str = "text", key: str = "doc_id", buckets: int | None = None, seed: int = SEED) -> DataFrame:
    """Write docs, shuffled, as Parquet under path, a folder shard=s for each shard, and return what was written, with size,
    text_crc32, shard and slot.

    Shard s is read back as ``result.where(shard = s).orderBy(slot)``; a file holds a run of its shard's slots, in order.
    Null texts have 16 bytes and the check sum of an empty text. Null keys and repeated rows are rows like others, each
    with a slot of its own. An empty table gives none. Columns of docs named like those added, or bucket, give way to
    them. Rows equal in key and text share a bucket.
    """
    spark = docs.sparkSession
    own = path is None
    path = path or fresh_path(spark, "shards")
    shuffled = shuffle_buckets(docs, text=text, key=key, shards=shards, buckets=buckets, seed=seed)
    # Two buckets meet at most in a shard's border: the sort that the writer needs is of rows in order.
    shuffled.sortWithinPartitions("shard", "slot").write.mode("overwrite").option("compression", "lz4").partitionBy("shard").parquet(path)
    if own:
        drop_on_exit(spark, path)
    return spark.read.schema(shuffled.schema).parquet(path)
