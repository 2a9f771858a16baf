"""File sources: bar CSVs with varying headers, second bars, snapshots, external series.

Every reader is one distributed scan over a path or glob. Names are normalised, values are
cast with ``try_*`` so a bad cell becomes null instead of failing the job, and duplicates
are settled by file position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.functions import calendar as cal
from tickloom.operators.sets import dedup_keep_last

NUMERIC = ("open", "high", "low", "close", "volume", "bidvolume", "askvolume")


def _raw_csv(spark: SparkSession, path) -> DataFrame:
    """All columns as text, names stripped of spaces and byte-order marks, lower-cased;
    unnamed columns (trailing commas) dropped; file position kept in ``_at``."""
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                  F.monotonically_increasing_id().alias("i"))
    clean = {c: c.strip().lstrip("﻿").strip().lower() for c in df.columns}
    named = [c for c in df.columns if clean[c] and not clean[c].startswith("_c")]
    return df.select(*[F.col(f"`{c}`").alias(clean[c]) for c in named], at.alias("_at"))


def _parse_ts(text: Column, formats) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


DATE_TIME_FORMATS = ("MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss.S",
                     "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def _with_dt(df: DataFrame) -> DataFrame:
    if "dt" in df.columns:
        text = F.col("dt")
    elif "datetime" in df.columns:
        text = F.col("datetime")
    elif {"date", "time"} <= set(df.columns):
        text = F.concat_ws(" ", F.trim("date"), F.trim("time"))
    else:
        raise ValueError("bars need date and time, dt or datetime columns")
    return df.withColumn("dt", _parse_ts(text, DATE_TIME_FORMATS))


def read_bars_csv(spark: SparkSession, path, keys=("symbol",)) -> DataFrame:
    """Bars with numeric coercion; absent numeric columns read 0; last row per time wins."""
    df = _with_dt(_raw_csv(spark, path))
    cols = [F.expr(f"try_cast(`{c}` AS double)").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in NUMERIC]
    gamma = F.coalesce(F.expr("try_cast(nearby_gamma_score AS double)"), F.lit(0.0)) if "nearby_gamma_score" in df.columns else F.lit(0.0)
    present = [k for k in keys if k in df.columns]
    out = df.filter(F.col("dt").isNotNull()).select(*present, "dt", *cols, gamma.alias("nearby_gamma_score"), "_at")
    return dedup_keep_last(out, [*present, "dt"], ["_at"]).drop("_at")


# Column names of each vendor layout, as text.
SCHEMAS = {
    "combined": {"date": "date", "time": "time", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume"},
    "mnt_standard": {"date": "date", "time": "time", "open": "open", "high": "high", "low": "low", "last": "close", "volume": "volume"},
}


def read_schema(spark: SparkSession, path, schema: str, symbol: str, tz: str | None = None) -> DataFrame:
    """One vendor layout as (symbol, dt, OHLCV). With ``tz`` the wall-clock times that a DST
    jump skips or repeats are dropped, and ``dt`` becomes UTC."""
    raw = _raw_csv(spark, path)
    names = SCHEMAS[schema]
    raw = raw.select(*[F.col(f"`{c}`").alias(names[c]) for c in names if c in raw.columns], "_at")
    df = _with_dt(raw)
    if tz:
        df = df.filter(~cal.nonexistent_local("dt", tz) & ~cal.ambiguous_local("dt", tz)).withColumn("dt", F.convert_timezone(F.lit(tz), F.lit("UTC"), F.col("dt")))
    vals = [F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in ("open", "high", "low", "close", "volume")]
    out = df.filter(F.col("dt").isNotNull()).select(F.lit(symbol).alias("symbol"), "dt", *vals, "_at")
    return dedup_keep_last(out, ["symbol", "dt"], ["_at"]).drop("_at")


def read_many(spark: SparkSession, parts) -> DataFrame:
    """Union of (path, schema, symbol, tz) sources."""
    out = None
    for path, schema, symbol, tz in parts:
        df = read_schema(spark, path, schema, symbol, tz)
        out = df if out is None else out.unionByName(df)
    return out


def read_historical(spark: SparkSession, path) -> DataFrame:
    """Vendor history: ``YYYY/MM/DD`` dates, fractional seconds, ``Last`` as the close."""
    df = _raw_csv(spark, path).withColumnsRenamed({"last": "close"})
    text = F.concat_ws(" ", F.trim("date"), F.trim("time"))
    ts = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy/M/d HH:mm:ss.SSSSSS")), F.try_to_timestamp(text, F.lit("yyyy/M/d HH:mm:ss.S")),
                    F.try_to_timestamp(text, F.lit("yyyy/M/d HH:mm:ss")))
    keep = [c for c in ("symbol",) if c in df.columns]
    vals = [F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in NUMERIC if c in df.columns]
    return df.withColumn("dt", ts.cast("timestamp_ntz")).filter(F.col("dt").isNotNull()).select(*keep, "dt", *vals)


SECOND_BAR_NAMES = {"barendingtime": "dt", "series.open": "open", "series.high": "high", "series.low": "low",
                    "series.close": "close", "series.volume": "volume"}


def read_second_bars(spark: SparkSession, pattern) -> DataFrame:
    """Quarterly second-bar files: rows without full OHLC dropped, volume at least zero."""
    df = _raw_csv(spark, pattern)
    df = df.select(*[F.col(f"`{c}`").alias(SECOND_BAR_NAMES.get(c, c)) for c in df.columns])
    vals = [F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in NUMERIC if c in df.columns]
    keep = [c for c in ("symbol",) if c in df.columns]
    df = df.select(*keep, _parse_ts(F.col("dt"), DATE_TIME_FORMATS).alias("dt"), *vals)
    return df.dropna(subset=["dt", "open", "high", "low", "close"]).withColumn(
        "volume", F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(0.0)))


def read_feature_parquet(spark: SparkSession, pattern) -> DataFrame:
    """Cached feature parts as one table."""
    return spark.read.parquet(pattern) if isinstance(pattern, str) else spark.read.parquet(*pattern)


def read_external_series(spark: SparkSession, path, series: str | None = None) -> DataFrame:
    """(series, date, close): date header DATE or date, value from close, value or the first
    other column; rows without a number dropped."""
    raw = _raw_csv(spark, path)
    names = [c for c in raw.columns if c not in ("_at", "series")]
    date = next(c for c in names if c in ("date", "observation_date", "dt"))
    value = next((c for c in names if c in ("close", "value", "adj close")), next(c for c in names if c != date))
    tag = F.lit(series) if series else F.col("series")
    out = raw.select(tag.alias("series"), F.to_date(_parse_ts(F.trim(date), ("yyyy-MM-dd", "MM/dd/yyyy"))).alias("date"),
                     F.expr(f"try_cast(`{value}` AS double)").alias("close"))
    return out.dropna(subset=["date", "close"])


def read_snapshots(spark: SparkSession, root: str, start=None, end=None, business_days: bool = True) -> DataFrame:
    """Chain snapshots under ``date=`` partitions; the date filter prunes partitions."""
    df = spark.read.option("basePath", root).parquet(root)
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    return df.filter(F.weekday("date") < 5) if business_days else df


def list_snapshot_dates(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", root).parquet(root).select("date").distinct()


def read_day_range(df: DataFrame, ts: str, first_day: str, last_day: str) -> DataFrame:
    """Half-open day range on an event time; parquet row groups outside are skipped."""
    lo = F.lit(first_day).cast("timestamp_ntz")
    hi = F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp_ntz")
    return df.filter((F.col(ts) >= lo) & (F.col(ts) < hi))


def combine_parquets(spark: SparkSession, paths) -> DataFrame:
    """Same-schema parquet parts matched by column name."""
    out = None
    for p in paths:
        df = spark.read.parquet(p)
        out = df if out is None else out.unionByName(df)
    return out
