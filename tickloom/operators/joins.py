"""Joins a market time series needs beyond plain equality.

No side carries a broadcast hint: Catalyst and AQE broadcast a side only when its measured
size is under the session's threshold, and shuffle it (splitting skewed keys) otherwise.

None of them is a cartesian product: every range or as-of predicate is carried by an
equi-join key (series and time bucket) or by a union and a carried value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions import calendar as cal
from tickloom.functions.windows import by, running, whole
from tickloom.operators.blocks import join_keys


def join_daily(bars: DataFrame, daily: DataFrame, keys=("symbol", "trading_day"), fill: dict | None = None) -> DataFrame:
    """Attach one row per (symbol, day) to every bar of the day."""
    out = bars.join(daily, list(keys), "left")
    return out.fillna(fill) if fill else out


def join_minute_features(bars: DataFrame, feats: DataFrame, columns, keys=("symbol", "dt")) -> DataFrame:
    """Left join with a ``<column>_is_missing`` flag per joined column."""
    out = bars.join(feats.select(*keys, *columns), list(keys), "left")
    return out.withColumns({f"{c}_is_missing": F.col(c).isNull().cast("int") for c in columns})


def coverage(df: DataFrame, columns, by_keys=()) -> DataFrame:
    """Rows, matched rows and matched share per column, as long rows."""
    aggs = [F.count(F.lit(1)).alias("n_rows")] + [F.count(c).alias(c) for c in columns]
    wide = df.groupBy(*by_keys).agg(*aggs)
    return wide.unpivot([*by_keys, "n_rows"], list(columns), "feature", "n_matched").withColumn(
        "coverage", F.col("n_matched") / F.col("n_rows"))


def join_left_dedup_right(left: DataFrame, right: DataFrame, keys, order) -> DataFrame:
    """Left join that cannot multiply rows: the right side keeps its first row per key."""
    w = by(keys, order)
    right = right.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return left.join(right, list(keys), "left")


def asof(
    left: DataFrame, right: DataFrame, keys, left_ts: str, right_ts: str, values, bucket: Column | None = None,
    strict: bool = False,
) -> DataFrame:
    """Last right row at or before each left row, per key.

    Only the distinct left times take part, and the left rows meet their result in an equi-join, so no left
    row passes through a window. Times and right rows are unioned and the last right row is carried along time
    inside a (key, bucket); what a bucket inherits is the last right row of all earlier buckets, a table with
    one row per key and bucket. Buckets are months, right for daily rows; pass a day or hour truncation for
    ticks. ``strict`` asks for right rows before, not at, the left time. Of right rows at one time the largest
    by ``values`` counts.
    """
    keys = list(keys)
    bucket = bucket or (lambda ts: F.date_trunc("month", ts))
    packed = F.struct(F.col(right_ts).alias("_rts"), *[F.col(v) for v in values])
    side_l, side_r = (0, 1) if strict else (1, 0)
    times = left.select(*keys, F.col(left_ts).alias("_t")).distinct().withColumn("_side", F.lit(side_l))
    known = right.select(*keys, F.col(right_ts).alias("_t"), F.lit(side_r).alias("_side"), packed.alias("_val"))
    both = times.unionByName(known, allowMissingColumns=True).withColumn("_bucket", bucket("_t"))
    w = by((*keys, "_bucket"), ["_t", "_side", "_val"])
    both = both.withColumn("_seen", F.last("_val", ignorenulls=True).over(running(w)))
    ends = known.withColumn("_bucket", bucket("_t")).groupBy(*keys, "_bucket").agg(F.max("_val").alias("_end"))
    empty = times.select(*keys, bucket("_t").alias("_bucket")).distinct()
    ends = inherited(empty, ends, keys)
    hit = F.coalesce("_seen", "_inherited")
    found = join_keys(both.filter(F.col("_side") == side_l), ends, [*keys, "_bucket"], "left")
    found = found.select(*keys, F.col("_t").alias(left_ts), hit["_rts"].alias(f"matched_{right_ts}"), *[hit[v].alias(v) for v in values])
    return join_keys(left, found, [*keys, left_ts], "left")


def inherited(buckets: DataFrame, ends: DataFrame, keys) -> DataFrame:
    """``_inherited`` for each of ``buckets``: the last ``_end`` of an earlier bucket of the key."""
    rows = join_keys(buckets.unionByName(ends.select(*keys, "_bucket")).distinct(), ends, [*keys, "_bucket"], "left")
    before = by(keys, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*keys, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_inherited"))


def asof_business_days(left: DataFrame, right: DataFrame, keys, left_day: str, right_day: str, values, max_days: int = 3) -> DataFrame:
    """As-of match kept only when at most ``max_days`` weekdays lie between."""
    out = asof(left, right, keys, left_day, right_day, values)
    m = f"matched_{right_day}"
    ok = cal.business_days_between(m, left_day) <= max_days
    return out.withColumns({c: F.when(ok, F.col(c)) for c in (m, *values)})


def dyadic_nodes(first: Column, end: Column, levels: int) -> Column:
    """Aligned nodes (level, at) that tile the leaves [first, end): node ``at`` of a level covers the leaves
    [at * 2^level, (at + 1) * 2^level). At most two nodes a level; on the last level all that are left."""
    none = F.array().cast("array<struct<level:int,at:bigint>>")
    node = lambda k, x: F.struct(F.lit(k).alias("level"), x.alias("at"))
    found = []
    for k in range(levels):
        # Leaves covered so far end at multiples of 2^k: lo rounds up, hi rounds down.
        lo = F.shiftright(first + ((1 << k) - 1), k)
        hi = F.shiftright(end, k)
        some = lo < hi
        if k == levels - 1:
            found.append(F.when(some, F.transform(F.sequence(lo, hi - 1), lambda x: node(levels - 1, x))).otherwise(none))
            break
        odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
        found.append(F.when(some & odd(lo), F.array(node(k, lo))).otherwise(none))
        found.append(F.when(some & odd(hi), F.array(node(k, hi - 1))).otherwise(none))
    return F.concat(*found)


def interval_aggregate(
    intervals: DataFrame, rows: DataFrame, keys, start: str, end: str, ts: str, parts: dict, final, interval_id, by=(),
    leaf: int = 1_000_000, levels: int = 16,
) -> DataFrame:
    """Aggregate the rows inside each closed interval.

    Time is cut into leaves of ``leaf`` microseconds, and those into a binary tree of ``levels``. Rows are summed once per
    node (and ``by`` columns, whose few values make a histogram); an interval adds up at most two nodes a level, and
    looks at raw rows only in the two leaves that it covers in part. Work is linear in rows plus intervals times
    levels, whatever the length of intervals and however many overlap.

    ``parts``: {name: (aggregate over rows, aggregate that merges it)}; ``final`` are aggregates over the merged parts
    of an interval, one row per ``by``. Intervals without rows have nulls.

    The joins are merges: an interval becomes some thirty nodes by an ``explode`` that Catalyst counts as one row, so a
    small file of intervals would be broadcast, and pass the driver, as its nodes."""
    keys, by, interval_id = list(keys), list(by), list(interval_id)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    floor = lambda x: F.expr(f"(({x}) - pmod({x}, {leaf}L)) div {leaf}L")
    merged = [merge(n).alias(n) for n, (_, merge) in parts.items()]
    placed = rows.withColumn("_us", micros(ts)).withColumn("_leaf", floor("_us"))
    leaves = placed.groupBy(*keys, *by, "_leaf").agg(*[make.alias(n) for n, (make, _) in parts.items()])
    up = F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.struct(k.alias("level"), F.expr("_leaf").alias("leaf")))).alias("_up")
    nodes = leaves.select(*keys, *by, *parts, up).select(*keys, *by, *parts, F.col("_up.level").alias("_level"), F.expr("shiftright(_up.leaf, _up.level)").alias("_at")).groupBy(*keys, *by, "_level", "_at").agg(*merged)
    spans = intervals.select(*keys, *interval_id, micros(start).alias("_s"), micros(end).alias("_e")).where("_s <= _e")
    spans = spans.withColumns({"_first": -floor("-_s"), "_end": floor("(_e + 1)")})
    wanted = spans.select(*keys, *interval_id, F.explode(dyadic_nodes(F.col("_first"), F.col("_end"), levels)).alias("_n")).select(*keys, *interval_id, F.col("_n.level").alias("_level"), F.col("_n.at").alias("_at"))
    inner = wanted.hint("merge").join(nodes, [*keys, "_level", "_at"]).select(*interval_id, *by, *parts)
    # Leaves of the two ends that are not covered whole.
    edges = F.filter(F.array_distinct(F.array(floor("_s"), floor("_e"))), lambda x: (x < F.col("_first")) | (x >= F.col("_end")))
    edge = spans.withColumn("_leaf", F.explode(edges)).hint("merge").join(placed.select(*keys, "_leaf", *[c for c in placed.columns if c not in (*keys, "_leaf")]), [*keys, "_leaf"]).where("_us BETWEEN _s AND _e")
    edge = edge.groupBy(*interval_id, *by).agg(*[make.alias(n) for n, (make, _) in parts.items()])
    both = inner.unionByName(edge).groupBy(*interval_id, *by).agg(*merged)
    return intervals.join(both.groupBy(*interval_id).agg(*final), interval_id, "left")


def anti_join_missing_dates(wanted: DataFrame, cached: DataFrame, keys=("symbol", "day"), warmup: int = 0) -> DataFrame:
    """Dates the cache lacks, after the first ``warmup`` dates of each series."""
    rn = F.row_number().over(by(keys[:-1], keys[-1]))
    return wanted.withColumn("_rn", rn).filter(F.col("_rn") > warmup).drop("_rn").join(cached, list(keys), "left_anti")


def backfill_pending(preds: DataFrame, actuals: DataFrame, keys, column: str = "actual", pending: int = -1) -> DataFrame:
    """Fill rows still marked pending once their outcome is known."""
    known = actuals.select(*keys, F.col(column).alias("_known"))
    out = preds.join(known, list(keys), "left")
    fixed = F.when((F.col(column) == pending) & F.col("_known").isNotNull(), F.col("_known")).otherwise(F.col(column))
    return out.withColumn(column, fixed).drop("_known")
