"""Tick tables in a relational database. Connection options always come from the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_ticks(spark: SparkSession, options: dict, table: str, symbol: str, start_ts: int, end_ts: int, slices: int = 32) -> DataFrame:
    """Parallel JDBC read of one symbol and time range, one slice of the range per task.
    The predicates run inside the database."""
    step = max((end_ts - start_ts + slices) // slices, 1)
    safe = symbol.replace("'", "''")
    preds, lo = [], start_ts
    while lo <= end_ts:
        hi = min(lo + step - 1, end_ts)
        preds.append(f"symbol = '{safe}' AND timestamp BETWEEN {lo} AND {hi}")
        lo = hi + 1
    props = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], table, predicates=preds, properties=props)


def fetch_range(ticks: DataFrame, symbol: str, start_ts: int, end_ts: int, ts: str = "timestamp") -> DataFrame:
    """Closed range."""
    return ticks.filter((F.col("symbol") == symbol) & F.col(ts).between(start_ts, end_ts))


def fetch_since(ticks: DataFrame, symbol: str, last_ts: int, ts: str = "timestamp") -> DataFrame:
    """Open at the left: strictly after the last seen time."""
    return ticks.filter((F.col("symbol") == symbol) & (F.col(ts) > last_ts))


def time_bounds(ticks: DataFrame, ts: str = "timestamp") -> DataFrame:
    return ticks.groupBy("symbol").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
