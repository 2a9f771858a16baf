"""Sharding by a two-pass external shuffle.

Pass 1 scatters rows uniformly over buckets of about ``BUCKET_BYTES`` by a seeded hash of the id and of the
row's place in its input partition, so copies and repeated ids spread as well. Each bucket fits in memory, is
put in random order by a seeded Fisher-Yates shuffle and written. Pass 2 numbers the rows across buckets from
the bucket counts and deals position p to shard p mod n, slot p div n: shard counts are at most one apart.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.llm.staging import staged

SHARDS = 24
BUCKET_BYTES = 32 << 20
BROADCAST_BUCKETS = 1 << 20
SEED = 20240607
LAW = "rows"


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A random order of n things: position i swaps with a position from i to n - 1."""
    order = np.arange(n)
    if n > 1:
        other = np.random.Generator(np.random.PCG64(seed)).integers(np.arange(n - 1), n)
        for i, j in enumerate(other.tolist()):
            order[i], order[j] = order[j], order[i]
    return order


def buckets(docs: DataFrame, bucket_bytes: int, seed: int) -> tuple[DataFrame, int]:
    """All columns, ``size`` (UTF-8 bytes of the text and 8 more) and the bucket."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    count = max(1, -(-(docs.agg(F.sum(size)).first()[0] or 0) // bucket_bytes))

    def place(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            row = pa.array(np.arange(at, at + b.num_rows) + (part << 40))
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, row], names=[*b.schema.names, "place_"])

    placed = docs.mapInArrow(place, docs.limit(0).withColumn("place_", F.lit(0).cast("long")).schema)
    key = F.xxhash64(F.lit(seed), "doc_id", "place_")
    return placed.withColumn("size_", size).withColumn("bucket_", F.pmod(key, F.lit(count)).cast("long")), count


def shuffled(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> tuple[DataFrame, int]:
    """Pass 1, written: the columns of ``docs``, ``size_``, ``bucket_`` and ``at_``, the row's place in its bucket;
    and the number of buckets."""
    scattered, count = buckets(docs, bucket_bytes, seed)

    def shuffle(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket_")[0].as_py()
        # Rows come in the order in which blocks were fetched; the seed decides only once that is undone.
        t = t.sort_by("place_").drop_columns(["place_"])
        return t.take(pa.array(fisher_yates(t.num_rows, zlib.crc32(f"{seed}:{bucket}".encode())))).append_column("at_", pa.array(np.arange(t.num_rows)))

    schema = scattered.limit(0).drop("place_").withColumn("at_", F.lit(0).cast("long")).schema
    return staged(scattered.groupBy("bucket_").applyInArrow(shuffle, schema), "shards"), count


def shards(docs: DataFrame, count: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """The columns of ``docs`` with ``size``, ``shard`` and ``slot`` (gapless from 0 in each shard). Null texts have
    size 8; repeated rows are dealt each; columns of ``docs`` named like the results are replaced."""
    docs = docs.drop("size", "shard", "slot")
    rows, buckets_ = shuffled(docs, bucket_bytes, seed)
    per = rows.groupBy("bucket_").agg(F.count("*").alias("n"))
    # One row per bucket of BUCKET_BYTES: a small table.
    before = per.select(F.col("bucket_").alias("b_"), (F.sum("n").over(Window.orderBy("bucket_")) - F.col("n")).alias("before_"))
    # Two longs a bucket: broadcast, so that texts are not shuffled again, unless there are very many.
    before = F.broadcast(before) if buckets_ <= BROADCAST_BUCKETS else before
    p = F.col("before_") + F.col("at_")
    return rows.join(before, F.col("bucket_") == F.col("b_")).select(*docs.columns, F.col("size_").alias("size"), F.pmod(p, F.lit(count)).cast("int").alias("shard"), F.floor(p / count).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, slot_rows: int = 1 << 20) -> None:
    """Parquet, one folder per shard, in slot order within files of at most ``slot_rows`` rows."""
    block = F.floor(F.col("slot") / slot_rows)
    sharded.repartition(F.col("shard"), block).sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", slot_rows).partitionBy("shard").parquet(path)
