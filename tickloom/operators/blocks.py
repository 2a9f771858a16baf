"""Windows over a whole series, cut into equal blocks.

A window partitioned by symbol alone puts a symbol's full history in one task. Here rows
get an exact position in two steps (row number inside a time bucket, plus the count of all
earlier buckets), positions are cut into blocks of a fixed size, and each block borrows the
rows its frames reach back to from the block before it. Every task then holds at most
``block_rows + halo`` rows, whatever share of the table a symbol owns, and any
``ROWS n PRECEDING`` frame or ``lag`` with n <= halo is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tickloom.functions.windows import by


def join_keys(df: DataFrame, other: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which a null key meets a null key, so no row is lost."""
    other = other.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(other, same, how).drop(*[f"_k_{k}" for k in keys])


def with_position(df: DataFrame, keys, bucket: str, order, out: str = "_pos") -> DataFrame:
    """0-based position of each row in its series. ``bucket`` must not decrease along ``order``."""
    keys = list(keys)
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    # one row per series and bucket: small, bounded by the calendar
    before = F.coalesce(F.sum("_n").over(by(keys, bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, bucket, before.alias("_start"))
    rn = F.row_number().over(by((*keys, bucket), order)) - 1
    return join_keys(df.withColumn("_rn", rn), starts, [*keys, bucket]).withColumn(out, F.col("_rn") + F.col("_start")).drop("_rn", "_start")


def over_blocks(
    df: DataFrame, keys, bucket: str, order, halo: int, columns: Callable[[WindowSpec], list[dict[str, Column]]],
    block_rows: int = 65536, ahead: int = 0,
) -> DataFrame:
    """Evaluate window columns block by block.

    ``columns(w)`` returns layers of column dicts (a later layer may read an earlier one);
    the frames of all layers together must not reach further back than ``halo`` rows nor
    further forward than ``ahead`` rows.
    """
    keys = list(keys)
    size = max(block_rows, halo + 1, ahead + 1)
    placed = with_position(df, keys, bucket, order).withColumn("_block", F.floor(F.col("_pos") / size))
    at = F.col("_pos") % size
    shifts = [F.array(F.lit(0))]
    if halo:
        shifts.append(F.when(at >= size - halo, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    if ahead:
        shifts.append(F.when((at < ahead) & (F.col("_block") > 0), F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))
    spread = placed.withColumn("_copy", F.explode(F.concat(*shifts))).withColumn("_block", F.col("_block") + F.col("_copy"))
    w = by((*keys, "_block"), "_pos")
    for layer in columns(w):
        spread = spread.withColumns(layer)
    return spread.filter(F.col("_copy") == 0).drop("_copy", "_block", "_pos")


def carry_forward(df: DataFrame, keys, bucket: str, order, value: str, out: str) -> DataFrame:
    """Last non-null ``value`` at or before each row of the whole series.

    Inside a bucket a running window carries it; across buckets only the last value of each
    bucket travels, one row per series and bucket.
    """
    keys = list(keys)
    order = [order] if isinstance(order, str) else list(order)
    w = by((*keys, bucket), order)
    df = df.withColumn(out, F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = df.groupBy(*keys, bucket).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    inherited = F.last("_end", ignorenulls=True).over(by(keys, bucket).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*keys, bucket, inherited.alias("_inherited"))
    return join_keys(df, ends, [*keys, bucket], "left").withColumn(out, F.coalesce(out, "_inherited")).drop("_inherited")


def over_series(df: DataFrame, columns, halo: int, keys=("symbol",), day: str = "trading_day", order="dt",
                reset_daily: bool = False, block_rows: int = 65536, ahead: int = 0) -> DataFrame:
    """Rolling columns over the whole series, or restarted every trading day."""
    if not reset_daily:
        return over_blocks(df, keys, day, order, halo, columns, block_rows, ahead)
    w = by((*keys, day), order)
    df = df.withColumn("_pos", F.row_number().over(w) - 1)
    for layer in columns(w):
        df = df.withColumns(layer)
    return df.drop("_pos")
