"""Bars from ticks, and coarser bars from bars.

Ticks reach a bar through one hash aggregation with map-side partials (`min_by`, `max_by`,
`sum`), so a symbol that owns most of the ticks never meets in one task. What leaves is
bounded by the calendar: at most one row per symbol and bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tickloom.functions import calendar as cal
from tickloom.functions.windows import DAY_KEYS, by, last_rows, running, whole
from tickloom.operators.blocks import over_blocks


def bucket_start(ts: str, minutes: int):
    """Start of the wall-clock bucket holding ``ts``."""
    return F.window(F.col(ts), f"{minutes} minutes")["start"]


def build_bars(ticks: DataFrame, minutes: int = 1, keys=("symbol",), ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Non-empty OHLC bars with volume, bid and ask sums, mean price and tick count.

    ``seq`` is the feed's arrival number and alone decides open and close: a plain number
    keeps the aggregation a hash aggregation, while ordering by a struct of time and number
    would make Spark sort all raw ticks first.
    """
    order = F.col(seq)
    return (
        ticks.groupBy(*keys, bucket_start(ts, minutes).alias("dt"))
        .agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"),
            F.sum("bidvolume").alias("bidvolume"), F.sum("askvolume").alias("askvolume"),
            F.avg("price").alias("price"), F.count(F.lit(1)).alias("n_ticks"),
        )
    )


def fill_empty_bars(bars: DataFrame, minutes: int = 1, keys=("symbol",)) -> DataFrame:
    """Add the empty buckets between consecutive bars: prices carry the last close row
    forward, sums are zero. The mean price is carried forward too, never backward.

    Each bar spawns the gap up to its successor, found in blocks of the series that see one row ahead.
    """
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    placed = bars.withColumn("_on", F.to_date("dt"))
    nxt = over_blocks(placed, keys, "_on", "dt", 0, lambda w: [{"_next": F.lead("dt").over(w)}], ahead=1).drop("_on")
    slots = F.when(
        F.col("_next").isNull() | (F.col("_next") <= F.col("dt") + step), F.array("dt")
    ).otherwise(F.sequence(F.col("dt"), F.col("_next") - step, step))
    out = nxt.withColumn("_slot", F.explode(slots)).withColumn("filled", (F.col("_slot") != F.col("dt")).cast("int"))
    zero = {c: F.when(F.col("filled") == 1, F.lit(0).cast(t)).otherwise(F.col(c)).alias(c)
            for c, t in bars.dtypes if c in ("volume", "bidvolume", "askvolume", "n_ticks")}
    keep = [F.col("_slot").alias("dt") if c == "dt" else zero.get(c, F.col(c)) for c in bars.columns]
    return out.select(*keep, "filled")


def with_session(bars: DataFrame, roll_hour: int = 15, keys=("symbol",)) -> DataFrame:
    """Trading day, minute of day, overnight flag and the bar's number inside its day."""
    out = bars.withColumns({
        "trading_day": cal.trading_day("dt", roll_hour),
        "minute": cal.minute_of_day("dt"),
        "ovn": cal.overnight_flag("dt"),
    })
    return out.withColumn("bar_no", F.row_number().over(by((*keys, "trading_day"))))


def resample(bars: DataFrame, minutes: int, keys=("symbol", "trading_day")) -> DataFrame:
    """Coarser bars inside each trading day; empty buckets do not appear."""
    return (
        bars.groupBy(*keys, bucket_start("dt", minutes).alias("bucket"))
        .agg(
            F.min_by("open", "dt").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "dt").alias("close"), F.sum("volume").alias("volume"),
            F.sum("bidvolume").alias("bidvolume"), F.sum("askvolume").alias("askvolume"),
        )
        .withColumnRenamed("bucket", "dt")
    )


def daily_from_trades(rows: DataFrame, keys=("symbol", "day")) -> DataFrame:
    """Daily OHLCV straight from trades (price, volume, seq)."""
    return rows.groupBy(*keys).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume"),
    )


def daily_bars(bars: DataFrame, keys=("symbol", "trading_day"), prefix: str = "", extra_mean: str | None = None) -> DataFrame:
    """Daily OHLCV of intraday bars, keyed by trading day (never by the first bar's date)."""
    aggs = [
        F.min_by("open", "dt").alias(f"{prefix}open"), F.max("high").alias(f"{prefix}high"),
        F.min("low").alias(f"{prefix}low"), F.max_by("close", "dt").alias(f"{prefix}close"),
        F.sum("volume").alias(f"{prefix}volume"),
    ]
    if extra_mean:
        aggs.append(F.avg(extra_mean).alias(f"{prefix}{extra_mean}"))
    return bars.groupBy(*keys).agg(*aggs)


def daily_bars_rth(bars: DataFrame, start: int = 390, end: int = 779, prefix: str = "rth_") -> DataFrame:
    return daily_bars(bars.filter(F.col("minute").between(start, end)), prefix=prefix)


def iso_week_key(day):
    d = cal.col(day)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d), F.lit("_"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def weekly_bars(days: DataFrame, keys=("symbol",), day: str = "day") -> DataFrame:
    """ISO-week bars; the key of a week is its last trading day."""
    return days.groupBy(*keys, iso_week_key(day).alias("year_week")).agg(
        F.max(day).alias(day), F.min_by("open", day).alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", day).alias("close"), F.sum("volume").alias("volume"),
    )


def require_unique_weeks(weeks: DataFrame, keys=("symbol",)) -> DataFrame:
    """Fails the job when a (key, year_week) occurs twice; otherwise passes rows through."""
    n = F.count(F.lit(1)).over(whole((*keys, "year_week")))
    checked = weeks.withColumn("_n", n)
    bad = F.raise_error(F.concat(F.lit("weekly rows must be unique by year_week: "), F.col("year_week")))
    return checked.filter(F.when(F.col("_n") > 1, bad.cast("boolean")).otherwise(True)).drop("_n")


def weekly_close_context(days: DataFrame, keys=("symbol",), day: str = "day", fast: int = 20, slow: int = 50) -> DataFrame:
    """Each day with its last completed Friday-ending week's close and moving averages.

    Weeks end on Friday. A day sees the week ending on or before it, so Monday to Thursday
    carry the previous week: the week key is an equi-join key, no as-of search is needed.
    """
    friday = F.date_add(cal.col(day), F.pmod(4 - F.weekday(day), F.lit(7)))
    weeks = (
        days.groupBy(*keys, friday.alias("week_end")).agg(F.max_by("close", day).alias("weekly_close"))
    )
    w = by(keys, "week_end")
    full = lambda n: F.when(F.count("weekly_close").over(last_rows(w, n)) >= n, F.avg("weekly_close").over(last_rows(w, n)))
    weeks = weeks.withColumns({"weekly_sma_fast": full(fast), "weekly_sma_slow": full(slow)})
    # a week's values hold until the next week that has any row
    weeks = weeks.withColumn("next_week", F.lead("week_end").over(w))
    seen = days.withColumn("_last_friday", F.date_sub(cal.col(day), F.pmod(F.weekday(day) + 3, F.lit(7))))
    cover = weeks.withColumn("_week", F.explode(F.sequence(
        F.col("week_end"),
        F.greatest(F.col("week_end"), F.coalesce(F.date_sub("next_week", 7), F.col("week_end"))),
        F.expr("INTERVAL 7 DAYS"))))
    return seen.join(
        cover.select(*keys, F.col("_week").alias("_last_friday"), "weekly_close", "weekly_sma_fast", "weekly_sma_slow"),
        [*keys, "_last_friday"], "left",
    ).drop("_last_friday")


def renumber_sessions(bars: DataFrame, min_bars: int = 30, roll_hour: int = 15, keys=("symbol",)) -> DataFrame:
    """Sessions by the previous-date rule; stubs below ``min_bars`` dropped, the rest
    numbered 0, 1, … without holes."""
    session = cal.trading_day("dt", roll_hour, "previous")
    df = bars.withColumn("session", session)
    sizes = df.groupBy(*keys, "session").agg(F.count(F.lit(1)).alias("n_bars")).filter(F.col("n_bars") >= min_bars)
    numbered = sizes.withColumn("session_no", F.row_number().over(by(keys, "session")) - 1)
    return df.join(numbered, [*keys, "session"])


def normalize_orderflow(df: DataFrame) -> DataFrame:
    """Legacy ``buys`` and ``sells`` become ask and bid volume where those are absent."""
    for old, new in (("buys", "askvolume"), ("sells", "bidvolume")):
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def validate_bars(bars: DataFrame, max_gap_minutes: int, keys=("symbol",), day: str = "trading_day") -> DataFrame:
    """Counts of rule violations per series.

    Gaps inside a day come from a per-day `lag`; gaps between days from the table of daily
    first and last times, so no window spans a whole series of bars.
    """
    minutes = lambda a, b: (cal.wall_seconds(b) - cal.wall_seconds(a)) / 60
    inside = bars.withColumn("_gap", minutes(F.lag("dt").over(by((*keys, day))), F.col("dt")))
    null_ohlc = F.greatest(*[F.col(c).isNull().cast("int") for c in ("open", "high", "low", "close")])
    daily = inside.groupBy(*keys, day).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("dt").alias("nd"), F.sum(null_ohlc).alias("nn"),
        F.sum((F.col("high") < F.col("low")).cast("int")).alias("ni"),
        F.sum((F.col("_gap") > max_gap_minutes).cast("int")).alias("ng"), F.max("_gap").alias("mg"),
        F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"),
    )
    between = minutes(F.lag("last_dt").over(by(keys, day)), F.col("first_dt"))
    daily = daily.withColumn("_between", between)
    return daily.groupBy(*keys).agg(
        F.sum("n").alias("n_bars"), F.sum(F.col("n") - F.col("nd")).alias("n_duplicate"), F.sum("nn").alias("n_null"),
        F.sum("ni").alias("n_inverted"),
        F.sum(F.coalesce("ng", F.lit(0)) + F.coalesce((F.col("_between") > max_gap_minutes).cast("int"), F.lit(0))).alias("n_gaps"),
        F.max(F.greatest("mg", "_between")).alias("max_gap_minutes"),
    )


def upsample_to_ticks(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    """Four pseudo ticks per bar: open, high, low, close at 0, 15, 30 and 45 seconds."""
    points = F.array(*[F.struct(F.lit(15 * i).alias("s"), F.col(c).alias("price")) for i, c in enumerate(("open", "high", "low", "close"))])
    return bars.select(*keys, "dt", (F.col("volume") / 4).alias("volume"), F.explode(points).alias("_p")).select(
        *keys, (F.col("dt") + F.make_dt_interval(secs=F.col("_p.s"))).alias("ts"), F.col("_p.price").alias("price"), "volume")


def merge_incremental(existing: DataFrame, ticks: DataFrame, new_ticks: DataFrame, minutes: int = 1, keys=("symbol",)) -> DataFrame:
    """Rebuild every bucket the new ticks touch from all its ticks; keep the others."""
    touched = new_ticks.select(*keys, bucket_start("ts", minutes).alias("dt")).distinct()
    marked = ticks.withColumn("dt", bucket_start("ts", minutes)).join(touched, [*keys, "dt"], "left_semi").drop("dt")
    rebuilt = build_bars(marked, minutes, keys)
    return existing.join(touched, [*keys, "dt"], "left_anti").unionByName(rebuilt)


def checkpoint_rows(bars: DataFrame, every: int = 30, keys=DAY_KEYS) -> DataFrame:
    """One row per checkpoint (each ``every`` bars and the last bar): what was known so far,
    next to what the full day became."""
    r = running(by(keys))
    d = whole(keys)
    out = bars.withColumns({
        "cp_high": F.max("high").over(r), "cp_low": F.min("low").over(r), "cp_volume": F.sum("volume").over(r),
        "day_high": F.max("high").over(d), "day_low": F.min("low").over(d), "day_close": F.max_by("close", "dt").over(d),
        "_n": F.max("bar_no").over(d),
    }).filter((F.col("bar_no") % every == 0) | (F.col("bar_no") == F.col("_n"))).drop("_n")
    rng = F.col("cp_high") - F.col("cp_low")
    return out.withColumns({
        "cp_close": F.col("close"), "cp_range": rng, "remaining_up": F.col("day_high") - F.col("cp_high"),
        "cp_position": F.when(rng > 0, (F.col("close") - F.col("cp_low")) / rng).otherwise(0.5),
    })


def align_to_primary(primary: DataFrame, other: DataFrame, on: str, columns, limit: int = 2, keys=("symbol",), match=()) -> DataFrame:
    """Other series on the primary's dates, carried at most ``limit`` rows, common rows only; ``match`` are the keys
    that both sides have."""
    w = by(keys, on).rowsBetween(-limit, 0)
    out = primary.join(other, [*match, on], "left")
    out = out.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    return out.dropna(subset=list(columns))


def join_targets(features: DataFrame, targets: DataFrame, keys, target_columns) -> DataFrame:
    """Features with targets on common keys: rows without a target go, empty features read 0."""
    out = features.join(targets, list(keys)).dropna(subset=list(target_columns))
    fill = [c for c, t in features.dtypes if c not in keys and t in ("double", "float", "int", "bigint")]
    return out.fillna(0, subset=fill)


def forward_window(bars: DataFrame, ahead: int, keys=DAY_KEYS) -> DataFrame:
    """Each bar with aggregates of its next ``ahead`` bars of the day and the first of them
    to exceed its high. The frame is the pairing: no rows are multiplied."""
    w = by(keys).rowsBetween(1, ahead)
    first = F.expr("array_position(transform(_next, h -> h > high), true)")
    return bars.withColumns({
        "n_ahead": F.count("dt").over(w), "max_ahead": F.max("high").over(w), "min_ahead": F.min("low").over(w),
        "_next": F.collect_list("high").over(w),
    }).withColumn("first_above", F.nullif(first, F.lit(0))).drop("_next")
