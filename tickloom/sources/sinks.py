"""Sinks. Spark's commit protocol makes each write all-or-nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions import calendar as cal
from tickloom.operators.sets import dedup_keep_last


def canonical_bars(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    """The ordered output columns of a bar file: one row per time, derived session columns."""
    df = dedup_keep_last(bars, [*keys, "dt"], ["dt"]) if keys is not None else bars
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in bars.columns else F.lit(0.0)
    return df.select(
        *keys,
        F.date_format("dt", "MM/dd/yyyy").alias("Date"), F.date_format("dt", "HH:mm:ss").alias("Time"),
        F.col("open").cast("double").alias("Open"), F.col("high").cast("double").alias("High"),
        F.col("low").cast("double").alias("Low"), F.col("close").cast("double").alias("Close"),
        zero("volume").alias("Volume"), zero("bidvolume").alias("BidVolume"), zero("askvolume").alias("AskVolume"),
        cal.overnight_flag("dt").alias("ovn"), cal.trading_day("dt").alias("trading_day"),
        zero("nearby_gamma_score").alias("nearby_gamma_score"),
    )


def write_bars(bars: DataFrame, path: str) -> None:
    bars.write.mode("overwrite").option("header", True).csv(path)


def write_snapshots(chain: DataFrame, root: str, date: str = "trade_date", writers_per_date: int = 4) -> None:
    """Snapshots into ``date=`` partitions; only the dates present are replaced. Rows meet by
    date and a few strike buckets, so files stay few and one busy date is not one writer."""
    out = chain.withColumn("date", F.col(date)).repartition(F.col("date"), F.pmod(F.xxhash64("strike"), F.lit(writers_per_date)))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(root))


def signal_payload(signals: DataFrame, id_columns, columns) -> DataFrame:
    """Signals as JSON text: NaN as null, 16-character sha1 id over the identifying columns."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
             for c, t in signals.dtypes if c in columns]
    sid = F.substring(F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in id_columns])), 1, 16)
    return signals.select(sid.alias("signal_id"), *[F.col(c) for c in id_columns],
                          F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("payload"))


def write_jsonl(signals: DataFrame, path: str) -> None:
    signals.write.mode("append").json(path)
