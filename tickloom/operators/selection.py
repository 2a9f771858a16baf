"""Choosing among candidate events.

A greedy rule looks at its own earlier choices, so a day's candidates are folded in order
inside one array (`aggregate` in the JVM). A day's candidates are bounded by its bars times
the sides and levels that can fire on a bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.windows import DAY_KEYS, by, whole


def _fold_days(df: DataFrame, keys, item: Column, item_type: str, accept) -> DataFrame:
    """Sort each group's items, keep those ``accept(chosen, item)`` takes, explode them."""
    days = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    empty = F.array().cast(f"array<{item_type}>")
    chosen = F.aggregate("_items", empty, lambda acc, e: F.when(accept(acc, e), F.array_append(acc, e)).otherwise(acc))
    return days.select(*keys, F.explode(chosen).alias("e"))


def greedy_cooldown(events: DataFrame, cooldown: int, keys=(*DAY_KEYS, "side"), start: str = "bar_no", end: str = "exit_bar") -> DataFrame:
    """Events taken in order, each only once the last taken one has ended plus ``cooldown``."""
    item = F.struct(F.col(start).cast("int").alias("s"), F.col(end).cast("int").alias("x"))
    free = lambda acc, e: (F.size(acc) == 0) | (e["s"] >= F.coalesce(F.try_element_at(acc, F.lit(-1))["x"], F.lit(0)) + cooldown)
    picked = _fold_days(events, keys, item, "struct<s:int,x:int>", free)
    return events.join(picked.select(*keys, F.col("e.s").alias(start), F.col("e.x").alias(end)), [*keys, start, end], "left_semi")


def first_k_with_gap(events: DataFrame, score: str, floor: float, gap: int, k: int, keys=DAY_KEYS, minute: str = "minute", id_col: str = "dt") -> DataFrame:
    """Per day, in time order: at most ``k`` events at or above the floor, ``gap`` apart."""
    ok = events.filter(F.col(score) >= floor)
    item = F.struct(F.col(id_col).alias("d"), F.col(minute).cast("int").alias("m"))
    dt_type = dict(events.dtypes)[id_col]
    take = lambda acc, e: (F.size(acc) < k) & ((F.size(acc) == 0) | (e["m"] - F.coalesce(F.try_element_at(acc, F.lit(-1))["m"], F.lit(0)) >= gap))
    picked = _fold_days(ok, keys, item, f"struct<d:{dt_type},m:int>", take)
    return ok.join(picked.select(*keys, F.col("e.d").alias(id_col)), [*keys, id_col], "left_semi")


def slot_cap(events: DataFrame, cooldown: int, per_side: int, slots: int, keys=DAY_KEYS, minute: str = "bar_no") -> DataFrame:
    """Accept in order under a cooldown between accepts, a cap per (level, side) and a number
    of slots per day. Needs level and direction."""
    item = F.struct(F.col(minute).cast("int").alias("m"), F.col("level").alias("l"), F.col("direction").cast("int").alias("d"))
    def take(acc, e):
        same = F.size(F.filter(acc, lambda c: (c["l"] == e["l"]) & (c["d"] == e["d"])))
        rested = (F.size(acc) == 0) | (e["m"] - F.coalesce(F.try_element_at(acc, F.lit(-1))["m"], F.lit(0)) >= cooldown)
        return (F.size(acc) < slots) & rested & (same < per_side)
    picked = _fold_days(events, keys, item, "struct<m:int,l:string,d:int>", take)
    return picked.select(*keys, F.col("e.m").alias(minute), F.col("e.l").alias("level"), F.col("e.d").alias("direction"))


def walk_forward_folds(days: DataFrame, n_folds: int, min_train: int, keys=("symbol",), day: str = "day") -> DataFrame:
    """(fold, role, day): expanding training days before each test block; the last fold takes
    the remainder. Days is one row per series and day."""
    n = F.count(F.lit(1)).over(whole(keys))
    df = days.withColumns({"_i": F.row_number().over(by(keys, day)) - 1, "_n": n})
    per = F.floor((F.col("_n") - min_train) / n_folds)
    df = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    train_end = min_train + F.col("fold") * per
    test_end = F.when(F.col("fold") == n_folds - 1, F.col("_n")).otherwise(train_end + per)
    role = F.when(F.col("_i") < train_end, "train").when(F.col("_i") < test_end, "test")
    return df.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_i", "_n")
