"""Set operations, de-duplication, top-k and deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.windows import by, whole


def dedup_keep_last(df: DataFrame, keys, order) -> DataFrame:
    """Last row per key. ``max_by`` over the packed row combines on the map side, so many
    copies of one key never travel to one task."""
    cols = df.columns
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select(*[F.col("_r")[c].alias(c) for c in cols])


def union_prefer_right(history: DataFrame, recent: DataFrame, keys=("symbol",), ts: str = "dt") -> DataFrame:
    """History before the first recent row of each series, followed by the recent rows."""
    first = recent.groupBy(*keys).agg(F.min(ts).alias("_first"))
    kept = history.join(first, list(keys), "left").filter(F.col("_first").isNull() | (F.col(ts) < F.col("_first"))).drop("_first")
    return kept.unionByName(recent)


def upsert(existing: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Replace every existing row whose key occurs in the new rows."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def last_n_days(bars: DataFrame, n: int, keys=("symbol",), day: str = "trading_day", before: Column | None = None) -> DataFrame:
    """Rows of the last ``n`` trading days (optionally strictly before a day)."""
    src = bars if before is None else bars.filter(F.col(day) < before)
    days = src.select(*keys, day).distinct()
    rank = F.row_number().over(by(keys, F.col(day).desc()))
    keep = days.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")
    return src.join(keep, [*keys, day], "left_semi")


def first_of_episode(df: DataFrame, keys, index: str, max_gap: int = 1) -> DataFrame:
    """First row of each run of rows whose index gap stays within ``max_gap``."""
    prev = F.lag(index).over(by(keys, index))
    return df.withColumn("_prev", prev).filter(F.col("_prev").isNull() | (F.col(index) - F.col("_prev") > max_gap)).drop("_prev")


def hash_order(*cols) -> Column:
    """A reproducible random order: first eight hex digits of an md5, as an integer."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")


def unit_hash(*cols) -> Column:
    """A reproducible draw in [0, 1)."""
    return hash_order(*cols) / F.lit(4294967296.0)


def stratified_sample(df: DataFrame, keys, quota: int, id_cols) -> DataFrame:
    """Up to ``quota`` rows per stratum in hash order. ``row_number() <= quota`` lets Spark
    keep only the best ``quota`` rows per stratum in each task before the shuffle."""
    h = hash_order(*[F.col(c).cast("string") for c in id_cols])
    rank = F.row_number().over(by(keys, ["_h", *id_cols]))
    return df.withColumn("_h", h).withColumn("_r", rank).filter(F.col("_r") <= quota).drop("_h", "_r")


def negative_subsample(df: DataFrame, keys, positive: Column, eligible: Column, ratio: int, id_cols) -> DataFrame:
    """All positives and, per group, ``ratio`` times as many eligible negatives in hash order."""
    h = hash_order(*[F.col(c).cast("string") for c in id_cols])
    marked = df.withColumns({"_pos": positive.cast("int"), "_h": h}).filter((F.col("_pos") == 1) | eligible)
    n_pos = F.sum("_pos").over(whole(keys))
    rank = F.row_number().over(by((*keys, "_pos"), ["_h", *id_cols]))
    return marked.withColumns({"_np": n_pos, "_r": rank}).filter(
        (F.col("_pos") == 1) | (F.col("_r") <= ratio * F.col("_np"))).drop("_pos", "_h", "_np", "_r")


def top_k(df: DataFrame, k: int, order, keys=()) -> DataFrame:
    """The k first rows by ``order``, over all rows or per group."""
    if not keys:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_r", F.row_number().over(by(keys, order))).filter(F.col("_r") <= k).drop("_r")


def calls_puts_to_long(wide: DataFrame, keys) -> DataFrame:
    """One wide row (c_iv, c_oi, p_iv, p_oi) to a row per option class that has a quote."""
    stack = F.expr("stack(2, 'C', c_iv, c_oi, 'P', p_iv, p_oi) AS (instrument_class, iv, open_interest)")
    return wide.select(*keys, stack).filter(F.col("iv").isNotNull())


def pivot_statistics(rows: DataFrame, keys, names, largest=frozenset(), name: str = "stat", value: str = "value", at: str = "at") -> DataFrame:
    """Statistic rows to columns in one aggregation: the largest value for names in
    ``largest``, the latest by ``at`` (then by value) for the others."""
    def pick(n):
        hit = F.col(name) == n
        v = F.when(hit, F.col(value))
        if n in largest:
            return F.max(v).alias(n)
        return F.max_by(v, F.when(hit, F.struct(F.col(at), F.col(value)))).alias(n)
    return rows.groupBy(*keys).agg(*[pick(n) for n in names])
