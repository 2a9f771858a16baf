"""Intraday running and rolling features of bars.

Windows restart each (symbol, trading_day), which the calendar bounds. Features the
definition lets run across days go through ``blocks.over_series``. Inactive levels are null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.windows import DAY_KEYS, by, clip, diff, last_rows, rolling, running, safe_div, whole
from tickloom.operators.blocks import carry_forward, join_keys, over_series, with_position

def ohlc4() -> Column:
    return (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4


def in_minutes(lo: int, hi: int) -> Column:
    """Closed minute-of-day range."""
    return F.col("minute").between(lo, hi)


# --- levels -------------------------------------------------------------------------------

def vwap_running(bars: DataFrame, keys=DAY_KEYS) -> DataFrame:
    """Running VWAP, its running root-mean-square deviation (floored) and the close's z."""
    r = running(by(keys))
    df = bars.withColumn("vwap", safe_div(F.sum(ohlc4() * F.col("volume")).over(r), F.sum("volume").over(r)))
    dev = F.sqrt(F.sum(F.pow(ohlc4() - F.col("vwap"), 2)).over(r) / F.count(F.lit(1)).over(r))
    df = df.withColumn("vwap_std", F.greatest(dev, F.lit(1e-6)))
    return df.withColumn("vwap_z", (F.col("close") - F.col("vwap")) / F.col("vwap_std"))


def vwap_sigma_bands(bars: DataFrame, mults=(1.0, 1.5, 2.0), min_bars: int = 10, keys=DAY_KEYS) -> DataFrame:
    """VWAP plus and minus multiples of the expanding deviation of ohlc4 from it."""
    df = bars if "vwap" in bars.columns else vwap_running(bars, keys)
    r = running(by(keys))
    df = df.withColumn("_dev", ohlc4() - F.col("vwap"))
    df = df.withColumn("vwap_sigma", F.when(F.count("_dev").over(r) >= min_bars, F.stddev_samp("_dev").over(r))).drop("_dev")
    tag = lambda m: str(m).replace(".0", "").replace(".", "")
    return df.withColumns({f"vwap_{d}_{tag(m)}s": F.col("vwap") + s * m * F.col("vwap_sigma") for m in mults for d, s in (("up", 1), ("dn", -1))})


def zscore_rolling(bars: DataFrame, n: int = 20, keys=DAY_KEYS) -> DataFrame:
    w = by(keys)
    sd = F.coalesce(rolling(F.stddev_samp, "close", w, n), F.lit(0.000001))
    return bars.withColumn("close_z20", safe_div(F.col("close") - rolling(F.avg, "close", w, n), sd))


def volume_z(bars: DataFrame, n: int = 20, keys=DAY_KEYS) -> DataFrame:
    f = last_rows(by(keys), n)
    return bars.withColumn("vol_z", (F.col("volume") - F.avg("volume").over(f)) / (F.stddev_samp("volume").over(f) + 1e-6))


def ofi_z(bars: DataFrame, n: int = 60, keys=DAY_KEYS) -> DataFrame:
    """Order-flow imbalance against its rolling mean; flat flow and warm-up read 0."""
    w = by(keys)
    ofi = F.coalesce(safe_div(F.col("askvolume") - F.col("bidvolume"), F.col("askvolume") + F.col("bidvolume")), F.lit(0.0))
    df = bars.withColumn("ofi", ofi)
    sd = F.nullif(rolling(F.stddev_samp, "ofi", w, n), F.lit(0.0))
    return df.withColumn("ofi_z", F.coalesce((F.col("ofi") - rolling(F.avg, "ofi", w, n)) / (sd + 1e-6), F.lit(0.0)))


def overnight_running_levels(bars: DataFrame, keys=DAY_KEYS) -> DataFrame:
    r = running(by(keys))
    on = F.col("ovn") == 1
    return bars.withColumns({"ovn_hi": F.max(F.when(on, F.col("high"))).over(r), "ovn_lo": F.min(F.when(on, F.col("low"))).over(r)})


def masked_range(bars: DataFrame, hi: str, lo: str, window: tuple[int, int], active: tuple[int, int], keys=DAY_KEYS) -> DataFrame:
    """High and low of one minute window, visible only in the active minutes."""
    d = whole(keys)
    inside, on = in_minutes(*window), in_minutes(*active)
    return bars.withColumns({hi: F.when(on, F.max(F.when(inside, F.col("high"))).over(d)),
                             lo: F.when(on, F.min(F.when(inside, F.col("low"))).over(d))})


def initial_balance_levels(bars: DataFrame, keys=DAY_KEYS) -> DataFrame:
    """High and low of 06:30-07:30, visible 07:30-12:59."""
    return masked_range(bars, "ib_hi", "ib_lo", (390, 450), (450, 779), keys)


def rth_running_levels(bars: DataFrame, keys=DAY_KEYS) -> DataFrame:
    """Running extremes from 06:30, visible from 07:00 to 12:59."""
    r = running(by(keys))
    inside, on = in_minutes(390, 779), in_minutes(420, 779)
    return bars.withColumns({"rth_hi": F.when(on, F.max(F.when(inside, F.col("high"))).over(r)),
                             "rth_lo": F.when(on, F.min(F.when(inside, F.col("low"))).over(r))})


def daily_shifted(bars: DataFrame, aggs: dict, keys=("symbol",), day: str = "trading_day", where=None) -> DataFrame:
    """One row per day holding the aggregates of the day before."""
    src = bars if where is None else bars.filter(where)
    daily = src.groupBy(*keys, day).agg(*[c.alias(n) for n, c in aggs.items()])
    w = by(keys, day)
    return daily.select(*keys, day, *[F.lag(n).over(w).alias(n) for n in aggs])


def prev_day_levels(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    prev = daily_shifted(bars, {"prev_high": F.max("high"), "prev_low": F.min("low")}, keys)
    return bars.join(prev, [*keys, "trading_day"], "left").withColumn("prev_mid", (F.col("prev_high") + F.col("prev_low")) / 2)


def prior_rth_open_close(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    prev = daily_shifted(bars, {"prior_rth_open": F.min_by("open", "dt"), "prior_rth_close": F.max_by("close", "dt")}, keys,
                         where=in_minutes(390, 779))
    return bars.join(prev, [*keys, "trading_day"], "left")


def opening_range_levels(bars: DataFrame, minutes=(5, 15), keys=DAY_KEYS) -> DataFrame:
    """Opening-range high, low and mid, visible once the range is complete."""
    for m in minutes:
        bars = masked_range(bars, f"or{m}_hi", f"or{m}_lo", (390, 389 + m), (390 + m, 1439), keys)
        bars = bars.withColumn(f"or{m}_mid", (F.col(f"or{m}_hi") + F.col(f"or{m}_lo")) / 2)
    return bars


def ib_extensions(bars: DataFrame, keys=DAY_KEYS) -> DataFrame:
    df = bars if "ib_hi" in bars.columns else initial_balance_levels(bars, keys)
    rng = F.col("ib_hi") - F.col("ib_lo")
    ok = (F.col("minute") >= 450) & (rng > 0)
    cols = {"ib_mid": F.when(ok, (F.col("ib_hi") + F.col("ib_lo")) / 2)}
    for tag, k in (("025", 0.25), ("050", 0.5), ("100", 1.0)):
        cols[f"ib_hi_ext_{tag}"] = F.when(ok, F.col("ib_hi") + k * rng)
        cols[f"ib_lo_ext_{tag}"] = F.when(ok, F.col("ib_lo") - k * rng)
    return df.withColumns(cols)


def price_levels(bars: DataFrame) -> DataFrame:
    """Every level and level z-score in one pass over the day windows."""
    df = prev_day_levels(bars)
    for step in (vwap_running, overnight_running_levels, initial_balance_levels, rth_running_levels, zscore_rolling, volume_z, ofi_z):
        df = step(df)
    sd = F.col("vwap_std")
    return df.withColumns({
        "ovn_lo_z": (F.col("close") - F.col("ovn_lo")) / sd, "ovn_hi_z": (F.col("ovn_hi") - F.col("close")) / sd,
        "ib_lo_z": (F.col("close") - F.col("ib_lo")) / sd, "ib_hi_z": (F.col("ib_hi") - F.col("close")) / sd,
    })


# --- session context ------------------------------------------------------------------------

def session_position(bars: DataFrame, atr: DataFrame | None = None, keys=DAY_KEYS) -> DataFrame:
    """Gap, overnight range and open location, first-15-minute position, day progress,
    distance from open and VWAP, trend strength. ``atr`` holds (symbol, trading_day, atr)."""
    df = vwap_running(bars, keys)
    prev = daily_shifted(bars, {"_pc": F.max_by("close", "dt")}, keys[:-1])
    df = df.join(prev, list(keys), "left")
    df = df.join(atr, list(keys), "left") if atr is not None else df.withColumn("atr", F.lit(None).cast("double"))
    w, d = by(keys), whole(keys)
    r = running(w)
    rth, ovn, or15 = F.col("minute") >= 390, F.col("minute") < 390, in_minutes(390, 404)
    # positional regular hours: from the first bar at or after the open minute onward
    df = df.withColumns({
        "_open0": F.first("open").over(r), "_started": F.max(rth.cast("int")).over(r) == 1,
        "_ro": F.min_by(F.when(rth, F.col("open")), F.when(rth, F.col("dt"))).over(d),
        "_oh": F.max(F.when(ovn, F.col("high"))).over(d), "_ol": F.min(F.when(ovn, F.col("low"))).over(d),
        "_ohr": F.max(F.when(ovn, F.col("high"))).over(r), "_olr": F.min(F.when(ovn, F.col("low"))).over(r),
        "_h15": F.max(F.when(or15, F.col("high"))).over(d), "_l15": F.min(F.when(or15, F.col("low"))).over(d),
        "_c15": F.max_by(F.when(or15, F.col("close")), F.when(or15, F.col("dt"))).over(d),
    })
    df = df.withColumns({
        "_rh": F.max(F.when(F.col("_started"), F.col("high"))).over(r), "_rl": F.min(F.when(F.col("_started"), F.col("low"))).over(r),
    })
    on, zero = F.col("_started"), F.lit(0.0)
    rr = F.greatest(F.col("_rh") - F.col("_rl"), F.lit(0.25))
    ovr = F.greatest(F.col("_oh") - F.col("_ol"), F.lit(0.25))
    gap = F.col("_open0") - F.col("_pc")
    dist = F.col("close") - F.col("_ro")
    active15 = (F.col("minute") >= 405) & F.col("_h15").isNotNull() & F.col("_ro").isNotNull()
    out = df.withColumns({
        "gap_from_prev_close_pts": F.coalesce(gap, zero),
        "gap_from_prev_close_atr": F.coalesce(F.when(F.first("atr").over(r) > 0, gap / F.first("atr").over(r)), zero),
        "overnight_range_pts": F.when(on & F.col("_oh").isNotNull(), F.col("_oh") - F.col("_ol")).otherwise(
            F.coalesce(F.when(F.col("minute") < 390, F.col("_ohr") - F.col("_olr")), zero)),
        "overnight_open_loc": F.when(on, F.coalesce((F.col("_ro") - F.col("_ol")) / ovr, F.lit(0.5))).otherwise(zero),
        "or15_range_pts": F.when(active15, F.col("_h15") - F.col("_l15")).otherwise(zero),
        "or15_close_pos": F.when(active15, (F.col("_c15") - F.col("_l15")) / F.greatest(F.col("_h15") - F.col("_l15"), F.lit(0.25))).otherwise(zero),
        "day_progress_norm": F.when(rth, F.least((F.col("minute") - 390) / 390.0, F.lit(1.0))).otherwise(zero),
        "dist_from_rth_open_pts": F.when(on, dist).otherwise(zero),
        "dist_from_rth_open_in_rth_range": F.when(on, dist / rr).otherwise(zero),
        "dist_from_vwap_pts": F.when(on, F.coalesce(F.col("close") - F.col("vwap"), zero)).otherwise(zero),
        "session_trend_strength": F.when(on, F.abs(dist) / rr).otherwise(zero),
    })
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def opening_drive_regime(bars: DataFrame, min_net: float = 8.0, min_frac: float = 0.55, high_pos: float = 0.7, low_pos: float = 0.3,
                         open_minute: int = 390, end_minute: int = 420, keys=DAY_KEYS) -> DataFrame:
    """Direction of the opening drive, visible from ``end_minute``."""
    inside = in_minutes(open_minute, end_minute - 1)
    pick = lambda f, c: f(F.when(inside, F.col(c)), F.when(inside, F.col("dt")))
    day = bars.groupBy(*keys).agg(
        pick(F.min_by, "open").alias("_o"), pick(F.max_by, "close").alias("_c"),
        F.max(F.when(inside, F.col("high"))).alias("_h"), F.min(F.when(inside, F.col("low"))).alias("_l"))
    net, rng = F.col("_c") - F.col("_o"), F.greatest(F.col("_h") - F.col("_l"), F.lit(0.25))
    frac, pos = F.abs(net) / rng, (F.col("_c") - F.col("_l")) / rng
    strong = (F.abs(net) >= min_net) & (frac >= min_frac)
    day = day.select(*keys, net.alias("_net"), frac.alias("_frac"),
                     F.when(strong & (net > 0) & (pos >= high_pos), 1).when(strong & (net < 0) & (pos <= low_pos), -1).otherwise(0).alias("_dir"))
    on = (F.col("minute") >= end_minute) & F.col("_net").isNotNull()
    zero = F.lit(0.0)
    return bars.join(day, list(keys), "left").withColumns({
        "opening_drive_regime_dir": F.when(on, F.col("_dir")).otherwise(0), "opening_drive_net_pts": F.when(on, F.col("_net")).otherwise(zero),
        "opening_drive_frac": F.when(on, F.col("_frac")).otherwise(zero)}).drop("_net", "_frac", "_dir")


def gap_filled(bars: DataFrame, min_gap: float = 0.5, keys=DAY_KEYS) -> DataFrame:
    """1 once the session has traded back to the prior close."""
    prev = daily_shifted(bars, {"_pc": F.max_by("close", "dt")}, keys[:-1])
    r = running(by(keys))
    df = bars.join(prev, list(keys), "left").withColumns({"_o": F.first("open").over(r), "_lo": F.min("low").over(r), "_hi": F.max("high").over(r)})
    gap = F.col("_o") - F.col("_pc")
    hit = F.when(gap > 0, F.col("_lo") <= F.col("_pc")).otherwise(F.col("_hi") >= F.col("_pc"))
    filled = F.when(F.col("_pc").isNull() | (F.abs(gap) < min_gap), 0).otherwise(hit.cast("int"))
    return df.withColumn("gap_filled", filled).drop("_pc", "_o", "_lo", "_hi")


def bollinger_columns(w, price: str = "close", n: int = 20, k: float = 2.0, prefix: str = "bb_") -> list[dict]:
    """Layers: bands, then %B, width and band distances in band widths."""
    f = last_rows(w, n)
    c, p = F.col(price), prefix
    band = F.col(f"{p}upper") - F.col(f"{p}lower")
    return [
        {f"{p}sma": F.avg(price).over(f), f"{p}std": F.stddev_samp(price).over(f)},
        {f"{p}upper": F.col(f"{p}sma") + k * F.col(f"{p}std"), f"{p}lower": F.col(f"{p}sma") - k * F.col(f"{p}std")},
        {f"{p}pct_b": F.coalesce(safe_div(c - F.col(f"{p}lower"), band), F.lit(0.5)),
         f"{p}width": F.coalesce(safe_div(band, F.col(f"{p}sma")), F.lit(0.0)),
         f"{p}upper_dist": F.coalesce(safe_div(F.col(f"{p}upper") - c, band), F.lit(0.0)),
         f"{p}lower_dist": F.coalesce(safe_div(c - F.col(f"{p}lower"), band), F.lit(0.0))},
    ]


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, width_window: int = 60, **where) -> DataFrame:
    def columns(w):
        f = last_rows(w, width_window)
        z = safe_div(F.col("bb_width") - F.avg("bb_width").over(f), F.stddev_samp("bb_width").over(f))
        return [*bollinger_columns(w, n=n, k=k), {"bb_width_z": F.coalesce(z, F.lit(0.0))}]
    return over_series(bars, columns, n + width_window, **where)


def range_exhaustion(bars: DataFrame, atr: DataFrame, keys=DAY_KEYS) -> DataFrame:
    """Running range against the prior day's ATR and range. ``atr``: (symbol, trading_day,
    atr) already shifted to the day that may use it."""
    prior = daily_shifted(bars, {"_pr": F.max("high") - F.min("low")}, keys[:-1])
    r = running(by(keys))
    df = bars.join(prior, list(keys), "left").join(atr, list(keys), "left")
    df = df.withColumns({"running_range": F.max("high").over(r) - F.min("low").over(r), "_c0": F.first("close").over(r)})
    rng, a, pr = F.col("running_range"), F.nullif(F.col("atr"), F.lit(0.0)), F.nullif(F.col("_pr"), F.lit(0.0))
    return df.withColumns({
        "range_pct_of_atr": F.coalesce(rng / a, F.lit(0.0)), "range_pct_of_prior_range": F.coalesce(rng / pr, F.lit(0.0)),
        "distance_from_open_atr": F.coalesce(F.abs(F.col("close") - F.col("_c0")) / a, F.lit(0.0)),
        "remaining_atr_pct": F.coalesce(F.greatest(a - rng, F.lit(0.0)) / a, F.lit(1.0)),
    }).drop("_pr", "_c0")


def range_percentile_prior(bars: DataFrame, n: int = 20, keys=DAY_KEYS) -> DataFrame:
    """Share of the last ``n`` completed positive day ranges at or under the running range."""
    daily = bars.groupBy(*keys).agg((F.max("high") - F.min("low")).alias("_rng"))
    series = by(keys[:-1], keys[-1])
    # Positive days are numbered and keep the last n ranges; a day reads those of the last one before it.
    ranges = daily.filter("_rng > 0").select(*keys[:-1], F.row_number().over(series).alias("_k"), F.collect_list("_rng").over(last_rows(series, n)).alias("_hist"))
    before = F.count(F.when(F.col("_rng") > 0, 1)).over(series.rowsBetween(Window.unboundedPreceding, -1))
    daily = join_keys(daily.withColumn("_k", before), ranges, [*keys[:-1], "_k"], "left").select(*keys, F.coalesce("_hist", F.array().cast("array<double>")).alias("_hist"))
    r = running(by(keys))
    df = bars.withColumn("running_range", F.max("high").over(r) - F.min("low").over(r)).join(daily, list(keys), "left")
    share = F.size(F.filter("_hist", lambda x: x <= F.col("running_range"))) / F.nullif(F.size("_hist"), F.lit(0))
    return df.withColumn("session_range_percentile", F.when(F.size("_hist") > 0, share).otherwise(0.5)).drop("_hist")


def session_range_rank(daily: DataFrame, n: int = 20, keys=("symbol",), day: str = "day") -> DataFrame:
    """Share of the last ``n`` day ranges (this one included) at or under this one."""
    f = last_rows(by(keys, day), n)
    df = daily.withColumn("day_range", F.col("high") - F.col("low")).withColumn("_h", F.collect_list("day_range").over(f))
    return df.withColumn("session_range_rank", F.size(F.filter("_h", lambda x: x <= F.col("day_range"))) / F.size("_h")).drop("_h")


def bars_since_extreme(bars: DataFrame, keys=DAY_KEYS) -> DataFrame:
    """Bars since the running high or low was last touched."""
    w = by(keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    new = F.max("high").over(before).isNull() | (F.col("high") >= F.max("high").over(before)) | (F.col("low") <= F.min("low").over(before))
    df = bars.withColumn("_new", new)
    last_new = F.last(F.when(F.col("_new"), F.col("bar_no")), ignorenulls=True).over(running(w))
    return df.withColumn("bars_since_session_extreme", F.col("bar_no") - last_new).drop("_new")


def approach_velocity(bars: DataFrame, atr: str | None = None, **where) -> DataFrame:
    """Ten-bar velocity and the change of five-bar velocity per ATR, over the whole series."""
    a = F.greatest(F.coalesce(F.col(atr), F.lit(0.0)), F.lit(0.01)) if atr else F.lit(1.0)
    def columns(w):
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        v10, v5 = zero(diff("close", w, 10)) / 10 / a, zero(diff("close", w, 5)) / 5 / a
        p5 = zero(F.lag("close", 5).over(w) - F.lag("close", 10).over(w)) / 5 / a
        return [{"approach_velocity_10bar": clip(v10, -3, 3), "approach_deceleration": clip(v5 - p5, -3, 3)}]
    return over_series(bars, columns, 10, **where)


def directional_context(df: DataFrame, daily_b="daily_bb_pct_b", daily_rsi="daily_rsi_14", weekly_b="weekly_bb_pct_b") -> DataFrame:
    b, rsi, wb = F.col(daily_b), F.col(daily_rsi), F.col(weekly_b)
    return df.withColumns({
        "bb_side_alignment": F.when(b < 0.1, 1).when(b > 0.9, -1).otherwise(0),
        "trend_exhaustion_score": clip((rsi - 50) / 50 * (b * 2 - 1), -1, 1),
        "weekly_trend_alignment": F.when((wb < 0.2) & (b < 0.2), 1).when((wb > 0.8) & (b > 0.8), -1).otherwise(0),
    })


# --- candles and flow -------------------------------------------------------------------------

def bar_range() -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.lit(0.01))


def wick() -> Column:
    """Rejection wick: below the open on an up bar, above the open on a down bar."""
    return F.greatest(F.when(F.col("close") >= F.col("open"), F.col("open") - F.col("low")).otherwise(F.col("high") - F.col("open")), F.lit(0.0))


def candle_shape(level: Column | None = None) -> dict[str, Column]:
    body = F.greatest(F.abs(F.col("close") - F.col("open")), F.lit(0.01))
    level = level if level is not None else (F.col("high") + F.col("low")) / 2
    pen = F.when(F.col("close") >= F.col("open"), F.greatest(level - F.col("low"), F.lit(0.0))).otherwise(F.greatest(F.col("high") - level, F.lit(0.0)))
    return {
        "wick_to_body_ratio": wick() / body, "rejection_wick_pct": wick() / bar_range(),
        "close_position": (F.col("close") - F.col("low")) / bar_range(), "bar_momentum": (F.col("close") - F.col("open")) / bar_range(),
        "rejection_penetration": pen / F.greatest(level * 0.001, F.lit(0.01)),
    }


def candle_quality(bars: DataFrame, n: int = 20, level: Column | None = None, **where) -> DataFrame:
    def columns(w):
        f = last_rows(w, n)
        sd = F.coalesce(F.nullif(F.stddev_samp("_r").over(f), F.lit(0.0)), F.lit(0.01))
        return [{"_r": bar_range(), **candle_shape(level)}, {"bar_range_z": (F.col("_r") - F.avg("_r").over(f)) / sd}]
    return over_series(bars, columns, n, **where).drop("_r")


def bars_since_open(bars: DataFrame, keys=DAY_KEYS) -> DataFrame:
    """0-based ordinal of a regular-hours bar in its day; 0 overnight."""
    n = F.sum(F.when(F.col("ovn") == 0, 1).otherwise(0)).over(running(by(keys)))
    return bars.withColumn("bars_since_rth_open", F.when(F.col("ovn") == 0, n - 1).otherwise(0))


def touched(level, pct: float = 0.001) -> Column:
    level = F.col(level) if isinstance(level, str) else level
    t = F.abs(level) * pct
    return F.col("low").between(level - t, level + t) | F.col("high").between(level - t, level + t)


def level_touch_count(bars: DataFrame, level: str, n: int = 50, pct: float = 0.001, **where) -> DataFrame:
    hit = F.coalesce(touched(level, pct), F.lit(False)).cast("int")
    return over_series(bars, lambda w: [{"_t": hit}, {"level_touch_count": F.sum("_t").over(last_rows(w, n))}], n, **where).drop("_t")


def rejection_counts(bars: DataFrame, threshold: float = 0.5, **where) -> DataFrame:
    def columns(w):
        s = candle_shape()
        f3, f5 = last_rows(w, 3), last_rows(w, 5)
        prev = F.coalesce(F.lag("bar_momentum").over(w), F.lit(0.0))
        return [
            {"wick_to_body_ratio": s["wick_to_body_ratio"], "bar_momentum": s["bar_momentum"]},
            {"_rej": (F.col("wick_to_body_ratio") > threshold).cast("int"), "_w3": F.avg("wick_to_body_ratio").over(f3),
             "max_wick_ratio_3bar": F.max("wick_to_body_ratio").over(f3),
             "bar_momentum_reversal": (F.col("bar_momentum") * prev < 0).cast("int")},
            {"rejection_bar_count_3": F.sum("_rej").over(f3), "rejection_bar_count_5": F.sum("_rej").over(f5),
             "rejection_momentum": clip(F.col("_w3") - F.coalesce(F.lag("_w3", 3).over(w), F.lit(0.0)), -3, 3)},
        ]
    return over_series(bars, columns, 8, **where).drop("_rej", "_w3")


def rolling_slope_norm(bars: DataFrame, columns_in: dict, n: int = 10, **where) -> DataFrame:
    """Least-squares slope of the previous ``n`` values over their mean, clipped to 3.
    ``columns_in`` maps output names to source columns."""
    def columns(w):
        f = last_rows(w, n, skip_current=True)
        out = {}
        for name, c in columns_in.items():
            y = F.col(c) if isinstance(c, str) else c
            out[f"_y_{name}"] = y.cast("double")
        second = {}
        for name in columns_in:
            y = F.col(f"_y_{name}")
            mean = F.avg(y).over(f)
            slope = F.regr_slope(y, F.col("_pos").cast("double")).over(f)
            ok = (F.count(y).over(f) >= n) & (mean != 0)
            second[name] = clip(F.when(ok, slope / F.greatest(F.abs(mean), F.lit(1e-6))).otherwise(0.0), -3, 3)
        return [out, second]
    df = over_series(bars, columns, n, **where)
    return df.drop(*[c for c in df.columns if c.startswith("_y_")])


def consecutive_same_dir(bars: DataFrame, keys=("symbol",), day: str = "trading_day", block_rows: int = 65536) -> DataFrame:
    """Length of the current run of same-signed close changes over the whole series.

    A run has no length limit, so the position of its last break is carried forward."""
    placed = with_position(bars, keys, day, "dt", out="pos")
    def columns(w):
        sign = F.signum(diff("close", w))
        return [{"_sg": F.coalesce(sign, F.lit(0.0))},
                {"_break": F.when((F.col("_sg") == 0) | (F.coalesce(F.lag("_sg").over(w), F.lit(0.0)) != F.col("_sg")), F.col("pos"))}]
    df = over_series(placed, columns, 2, keys=keys, day=day, block_rows=block_rows)
    df = carry_forward(df, keys, day, "dt", "_break", "_last")
    return df.withColumn("consecutive_same_dir", F.col("pos") - F.col("_last")).drop("_sg", "_break", "_last", "pos")


def delta_proxy() -> Column:
    return ((F.col("close") - F.col("low")) / bar_range() - 0.5) * F.col("volume")


def cum_delta_z(bars: DataFrame, use_bidask: bool = True, fast: int = 10, slow: int = 50, **where) -> DataFrame:
    delta = F.coalesce(F.col("bidvolume"), F.lit(0.0)) - F.coalesce(F.col("askvolume"), F.lit(0.0)) if use_bidask else delta_proxy()
    def columns(w):
        f = last_rows(w, slow)
        sd = F.coalesce(F.nullif(F.stddev_samp("_cd").over(f), F.lit(0.0)), F.lit(1.0))
        return [{"_d": delta}, {"_cd": F.sum("_d").over(last_rows(w, fast))},
                {"approach_cum_delta_z": clip(F.coalesce((F.col("_cd") - F.avg("_cd").over(f)) / sd, F.lit(0.0)), -5, 5)}]
    return over_series(bars, columns, fast + slow, **where).drop("_d", "_cd")


def temporal_interactions(bars: DataFrame, levels=(), keys=("symbol",), day: str = "trading_day", tod_mode: str = "global",
                          vol_lookback: int = 20, block_rows: int = 65536) -> DataFrame:
    """Wick, volume, delta, time-of-day and level interactions in three fused layers.

    ``tod_mode`` "global" scales the range by the whole series' mean and deviation (not
    causal); "running" uses the trading days before.
    """
    df = bars_since_open(bars, (*keys, day))
    df = df.withColumn("_cavg", F.avg("volume").over(running(by((*keys, day)))))
    def columns(w):
        one = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1.0))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        f3, f5, f10, f14, f50, fv = (last_rows(w, n) for n in (3, 5, 10, 14, 50, vol_lookback))
        v = F.col("volume")
        flip = (F.col("_delta") * zero(F.lag("_delta").over(w)) < 0).cast("double")
        vz = (v - F.avg("volume").over(fv)) / one(F.stddev_samp("volume").over(fv))
        z50 = lambda c: (F.col(c) - F.avg(c).over(f50)) / one(F.stddev_samp(c).over(f50))
        d3p = zero(F.lag("_d3").over(w))
        return [
            {"_wb": candle_shape()["wick_to_body_ratio"], "_delta": delta_proxy(), "_br": bar_range(),
             **{f"_t{i}": F.coalesce(touched(l), F.lit(False)).cast("int") for i, l in enumerate(levels)}},
            {"_flip": flip, "_vz": vz, "_into": F.coalesce(F.avg("volume").over(w.rowsBetween(-3, -1)), v),
             "_cd": F.sum("_delta").over(f10), "_pt": zero(diff("close", w, 10)), "_d3": F.sum("_delta").over(f3),
             "_atr": F.avg("_br").over(f14),
             "mae_estimate": F.max("_br").over(f5) / F.nullif(F.col("close"), F.lit(0.0)) * 100,
             "level_test_sequence": sum((F.sum(f"_t{i}").over(f10) for i in range(len(levels))), F.lit(0))},
            {"wick_delta_interaction": F.col("_wb") * F.col("_flip"), "wick_volume_interaction": F.col("_wb") * clip("_vz", -3, 3),
             "vol_exhaustion_ratio": clip(v / F.greatest(F.col("_into"), F.lit(1.0)), 0, 5),
             "delta_exhaustion": clip(z50("_cd") - z50("_pt") * F.signum("_cd"), -5, 5),
             "delta_momentum_3bar": clip((F.col("_d3") - d3p) / F.greatest(F.abs(d3p), F.lit(1.0)), -5, 5),
             "delta_reversal_signal": F.col("_flip"),
             "session_vol_ratio": clip(v / F.greatest(F.col("_cavg"), F.lit(1.0)), 0, 5)},
        ]
    # The layers reach back: volume z-score, or 49 rows of a mean over sums of 10 and differences of 10 rows.
    df = over_series(df, columns, max(vol_lookback - 1, 49 + 10), keys=keys, day=day, block_rows=block_rows)
    stats = df.groupBy(*keys, day).agg(F.count("_atr").alias("n"), F.sum("_atr").alias("s"), F.sum(F.pow("_atr", 2)).alias("q"))
    if tod_mode == "global":
        frame = by(keys, day).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    else:
        frame = by(keys, day).rowsBetween(Window.unboundedPreceding, -1)
    n, s, q = (F.sum(c).over(frame) for c in ("n", "s", "q"))
    stats = stats.select(*keys, day, (s / n).alias("_m"), F.sqrt(F.greatest(q / n - F.pow(s / n, 2), F.lit(0.0))).alias("_sd"))
    df = join_keys(df, stats, [*keys, day], "left")
    atr_z = (F.col("_atr") - F.col("_m")) / (F.col("_sd") + 1e-6)
    near = [F.abs(F.col("close") - F.col(l)) / F.nullif(F.col("close"), F.lit(0.0)) for l in levels]
    near = F.least(*near) * 10000 if len(near) > 1 else (near[0] * 10000 if near else F.lit(0.0))
    df = df.withColumns({"tod_volatility_interaction": F.col("bars_since_rth_open") / 390 * F.coalesce(clip(atr_z, -3, 3), F.lit(0.0)),
                         "bars_to_nearest_level": near})
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def level_stability(bars: DataFrame, hi: str = "rth_hi", lo: str = "rth_lo", n: int = 30, keys=DAY_KEYS) -> DataFrame:
    """Age of each running level, its updates in ``n`` bars and the joint firmness. Invalid
    bars (a level missing) read 0 for age and do not count as updates."""
    w = by(keys)
    r = running(w)
    df = bars.withColumn("_ok", F.col(hi).isNotNull() & F.col(lo).isNotNull())
    for c in (hi, lo):
        # previous valid value, across invalid bars, for the age; adjacent bars for updates
        prev_valid = F.last(F.when(F.col("_ok"), F.col(c)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        moved = F.abs(F.col(c) - F.lag(c).over(w)) > 1e-9
        both = F.col("_ok") & F.lag("_ok").over(w)
        df = df.withColumns({f"_set_{c}": F.when(F.col("_ok") & (prev_valid.isNull() | (F.abs(F.col(c) - prev_valid) > 1e-9)), F.col("bar_no")),
                             f"_chg_{c}": F.coalesce((both & moved).cast("int"), F.lit(0))})
    df = df.withColumn("_any", F.max(F.col("_ok").cast("int")).over(whole(keys)) == 1)
    out = {}
    for c in (hi, lo):
        age = F.col("bar_no") - F.last(f"_set_{c}", ignorenulls=True).over(r)
        out[f"{c}_age_bars"] = F.when(F.col("_ok"), F.coalesce(age, F.lit(0))).otherwise(0)
        out[f"{c}_updates_{n}"] = F.sum(f"_chg_{c}").over(last_rows(w, n))
    df = df.withColumns(out)
    firm = 1.0 / (1.0 + F.col(f"{hi}_updates_{n}") + F.col(f"{lo}_updates_{n}"))
    df = df.withColumn("rth_level_firmness", F.when(F.col("_any"), firm).otherwise(0.0))
    return df.drop(*[c for c in df.columns if c.startswith("_")])


# --- sequences ----------------------------------------------------------------------------------

def sequence_features(bars: DataFrame, n: int = 20, min_bars: int = 5, keys=DAY_KEYS) -> DataFrame:
    """Slopes of close, volume and cumulative delta over the previous ``n`` bars of the day."""
    w = by(keys)
    f = last_rows(w, n, skip_current=True)
    df = bars.withColumn("_cd", F.sum(F.col("bidvolume") - F.col("askvolume")).over(running(w)))
    x = F.col("bar_no").cast("double")
    ok = F.count("close").over(f) >= min_bars
    pick = lambda c: F.coalesce(F.when(ok, c), F.lit(0.0))
    return df.withColumns({
        "seq_price_trend": pick(F.regr_slope(F.col("close"), x).over(f) / (F.first("close").over(f) + 1e-6)),
        "seq_volume_trend": pick(F.regr_slope(F.col("volume"), x).over(f) / (F.avg("volume").over(f) + 1e-6)),
        "seq_delta_final": pick(F.sum(F.col("bidvolume") - F.col("askvolume")).over(f)),
        "seq_delta_trend": pick(F.regr_slope(F.col("_cd"), x).over(f)),
    }).drop("_cd")


def vap_concentration(bars: DataFrame, n: int = 20, bins: int = 10, min_bars: int = 5, **where) -> DataFrame:
    """1 - normalised entropy of the previous ``n`` bars' volume in ``bins`` price bins
    around the current close. The window is an array of ``n`` structs, folded in the JVM."""
    def columns(w):
        f = last_rows(w, n, skip_current=True)
        return [{"_win": F.collect_list(F.struct("close", "volume")).over(f), "_hi": F.max("close").over(f), "_lo": F.min("close").over(f)}]
    df = over_series(bars, columns, n, **where)
    span = F.when(F.col("_hi") - F.col("_lo") < 0.01, 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    df = df.withColumns({"_e0": F.col("close") - span / 2, "_bw": span / bins})
    idx = lambda e: F.greatest(F.least(F.ceil((e["close"] - F.col("_e0")) / F.col("_bw")) - 1, F.lit(bins - 1)), F.lit(0))
    vol = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.aggregate(
        "_win", F.lit(0.0), lambda acc, e: acc + F.when(idx(e) == b, e["volume"]).otherwise(0.0)))
    df = df.withColumn("_v", vol).withColumn("_tot", F.aggregate("_v", F.lit(0.0), lambda a, x: a + x))
    share = lambda x: F.least(F.greatest(x / F.col("_tot"), F.lit(1e-10)), F.lit(1.0))
    ent = F.aggregate("_v", F.lit(0.0), lambda a, x: a - share(x) * F.ln(share(x)))
    ok = (F.size("_win") >= n) & (F.col("_tot") > 0) & (F.col("bar_no") > min_bars)
    df = df.withColumn("seq_vap_concentration", F.when(ok, 1.0 - ent / math.log(bins)).otherwise(0.0))
    return df.drop("_win", "_hi", "_lo", "_e0", "_bw", "_v", "_tot")


def sequence_windows(bars: DataFrame, n: int = 20, min_bars: int = 5, keys=DAY_KEYS) -> DataFrame:
    """Arrays of the previous ``n`` bars of the day, left padded with zeros: prices as
    returns from the window's first value, volume as population z."""
    f = last_rows(by(keys), n, skip_current=True)
    df = bars.withColumn("_win", F.collect_list(F.struct("open", "high", "low", "close", "volume")).over(f))
    df = df.withColumn("seq_len", F.when(F.size("_win") >= min_bars, F.size("_win")).otherwise(0))
    pad = lambda a: F.when(F.col("seq_len") > 0, F.concat(F.array_repeat(F.lit(0.0), n - F.size("_win")), a)).otherwise(F.array_repeat(F.lit(0.0), n))
    def returns(c):
        base = F.col("_win")[0][c]
        return F.transform("_win", lambda e: F.when(base == 0, 0.0).otherwise((e[c] - base) / base))
    cols = {f"seq_{c}": pad(returns(c)) for c in ("open", "high", "low", "close")}
    df = df.withColumn("_vm", F.aggregate("_win", F.lit(0.0), lambda a, e: a + e["volume"]) / F.nullif(F.size("_win"), F.lit(0)))
    df = df.withColumn("_vs", F.sqrt(F.aggregate("_win", F.lit(0.0), lambda a, e: a + F.pow(e["volume"] - F.col("_vm"), 2)) / F.nullif(F.size("_win"), F.lit(0))))
    cols["seq_volume"] = pad(F.transform("_win", lambda e: F.when(F.col("_vs") < 1e-6, 0.0).otherwise((e["volume"] - F.col("_vm")) / F.col("_vs"))))
    return df.withColumns(cols).drop("_win", "_vm", "_vs")


def level_sequence_channels(bars: DataFrame, level: str, n: int = 60, keys=DAY_KEYS) -> DataFrame:
    """Six channels of the last ``n`` bars around a level, as an array of structs: close
    and range per mille of the level, volume z, scaled signed volume, close position and
    scaled cumulative signed volume (population deviations, zeros when flat)."""
    f = last_rows(by(keys), n)
    signed = F.signum(F.col("close") - F.col("open")) * F.col("volume")
    df = bars.withColumn("_td", signed)
    df = df.withColumn("_win", F.collect_list(F.struct("high", "low", "close", "volume", F.col("_td").alias("td"))).over(f))
    cum = F.transform("_win", lambda e, i: F.aggregate(F.slice("_win", F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x["td"]))
    df = df.withColumn("_cum", cum)
    sd = lambda c: F.stddev_pop(c).over(f)
    cmean = F.aggregate("_cum", F.lit(0.0), lambda a, x: a + x) / F.size("_cum")
    df = df.withColumns({"_vm": F.avg("volume").over(f), "_vs": sd("volume"), "_ts": sd("_td"), "_cm": cmean})
    df = df.withColumn("_cs", F.sqrt(F.aggregate("_cum", F.lit(0.0), lambda a, x: a + F.pow(x - F.col("_cm"), 2)) / F.size("_cum")))
    lv = F.col(level)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    chan = F.transform("_win", lambda e, i: F.struct(
        ratio((e["close"] - lv) * 1000, lv).alias("close"), ratio(e["volume"] - F.col("_vm"), F.col("_vs")).alias("volume_z"),
        ratio(e["td"], F.col("_ts")).alias("signed_volume"), ratio((e["high"] - e["low"]) * 1000, lv).alias("range"),
        F.when(e["high"] > e["low"], (e["close"] - e["low"]) / (e["high"] - e["low"])).otherwise(0.5).alias("close_position"),
        ratio(F.col("_cum")[i], F.col("_cs")).alias("cum_delta")))
    return df.withColumn("channels", chan).drop("_td", "_win", "_cum", "_vm", "_vs", "_ts", "_cm", "_cs")


def rejection_strength(level: Column, direction: Column) -> Column:
    """0.4 wick ratio + 0.3 close location + 0.2 wick share + 0.1 penetration."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body = F.greatest(F.abs(c - o), F.lit(0.01))
    bull = direction > 0
    wk = F.greatest(F.when(bull, F.least(o, c) - l).otherwise(h - F.greatest(o, c)), F.lit(0.0))
    pen = F.greatest(F.when(bull, level - l).otherwise(h - level), F.lit(0.0))
    close_pos = F.when(bull, c - l).otherwise(h - c) / bar_range()
    return (0.4 * F.least(wk / body, F.lit(3.0)) / 3.0 + 0.3 * close_pos + 0.2 * wk / bar_range()
            + 0.1 * F.least(pen / (level * 0.002), F.lit(2.0)))
