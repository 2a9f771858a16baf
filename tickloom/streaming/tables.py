"""Stateless and built-in stateful streams over ticks and bars.

Event time is a zoned timestamp column ``ts`` (naive times are read as UTC). Late rows are
accepted up to the watermark; beyond it they are dropped and counted by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tickloom.operators.sets import dedup_keep_last


def write_in_order(df: DataFrame, path: str, order, rows: int) -> None:
    """Parquet files of at most ``rows`` rows each in ``order``, which is also the order in which a stream reads them:
    a file source goes by modification time, and files written in parallel are stamped as they end."""
    df.withColumn("_at", order).repartitionByRange("_at").sortWithinPartitions("_at").drop("_at").write.option("maxRecordsPerFile", rows).parquet(path)
    spark = df.sparkSession
    hdfs = spark._jvm.org.apache.hadoop.fs
    folder = hdfs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().endswith(".parquet"))
    last = max((f.getModificationTime() for f in fs.listStatus(folder)), default=0)
    for i, name in enumerate(files):
        fs.setTimes(hdfs.Path(folder, name), last - len(files) + i, -1)


def close_input(df: DataFrame, path: str, time: str, after: str) -> None:
    """One more file with one row that is empty but for ``time``, ``after`` the newest row: it moves the watermark past
    every window that is still open, so that these are written. Its own window never closes."""
    end = df.agg((F.max(time) + F.expr(f"INTERVAL {after}")).alias(time)).where(F.col(time).isNotNull())
    end.select(*[F.col(time) if c == time else F.lit(None).cast(t.dataType).alias(c) for c, t in ((f.name, f) for f in df.schema)]).coalesce(1).write.mode("append").parquet(path)


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder or glob as a stream."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


@contextmanager
def _one_store_a_core(spark: SparkSession) -> Iterator[None]:
    """A stream that starts here keeps its state in no more partitions than there are cores. Each is a task, a commit
    and a message to the driver in every micro-batch, rows or not, so their number must not grow with the input as
    that of the batches does. The stream takes the setting when it starts; the session then has its own again."""
    key = "spark.sql.shuffle.partitions"
    own = spark.conf.get(key)
    spark.conf.set(key, str(min(int(own), max(spark.sparkContext.defaultParallelism, 1))))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def drain(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Run a stream over all that is available, to its end."""
    with _one_store_a_core(spark):
        q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Drain everything available into files. File sinks commit exactly once per batch."""
    drain(df.sparkSession, df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode))


def run_upsert(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Drain into a versioned table: each batch's rows land under its own ``batch`` partition,
    which a retry overwrites, so a restart neither loses nor doubles rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    drain(df.sparkSession, df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode))


def latest(spark: SparkSession, path: str, keys) -> DataFrame:
    """Current state of a versioned table: the last batch's row per key."""
    df = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return dedup_keep_last(df, list(keys), ["batch"]).drop("batch")


def minute_bars(ticks: DataFrame, minutes: int = 1, delay: str = "2 minutes", slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) OHLC bars of a tick stream, opened and closed by arrival number."""
    order = F.col("seq")
    w = F.window("ts", f"{minutes} minutes", slide) if slide else F.window("ts", f"{minutes} minutes")
    return ticks.withWatermark("ts", delay).groupBy("symbol", w.alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("volume").alias("volume"), F.sum("bidvolume").alias("bidvolume"), F.sum("askvolume").alias("askvolume"), F.count(F.lit(1)).alias("n_ticks"),
    ).select("symbol", F.col("w.start").alias("dt"), F.col("w.end").alias("dt_end"), "open", "high", "low", "close", "volume", "bidvolume", "askvolume", "n_ticks")


def session_activity(ticks: DataFrame, gap: str = "30 minutes", delay: str = "2 minutes") -> DataFrame:
    """Activity sessions: bursts of ticks closed by a pause."""
    return ticks.withWatermark("ts", delay).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_ticks"), F.sum("volume").alias("volume"), F.max("price").alias("high"), F.min("price").alias("low"),
    ).select("symbol", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_ticks", "volume", "high", "low")


def signals_dedup(signals: DataFrame, keys, delay: str = "10 minutes") -> DataFrame:
    """Each signal key once within the watermark."""
    return signals.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def static_enrich(stream: DataFrame, static: DataFrame, keys) -> DataFrame:
    """New rows with day-level facts of a static table (stream-static left join)."""
    return stream.join(static, list(keys), "left")


def replay(spark: SparkSession, path: str, schema, build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_trigger: int = 1) -> None:
    """Feed stored files through the live path, a few files per batch, in file order."""
    run_upsert(build(read_stream(spark, path, schema, files_per_trigger)), out, checkpoint)
