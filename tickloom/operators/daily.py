"""Daily and multi-instrument features.

One row per symbol and day: a symbol's history is bounded by the calendar (about 250 rows
a year), so windows partitioned by symbol stay small however many ticks stand behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.ema import with_ema
from tickloom.functions.windows import by, clip, diff, last_rows, pct_change, rolling, running, safe_div, whole
from tickloom.operators import scans
from tickloom.operators.blocks import join_keys, over_blocks, with_position

KEYS = ("symbol",)


def w_day(keys=KEYS, day="day"):
    return by(keys, day)


def true_range(w) -> Column:
    pc = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def ema_adjusted(daily: DataFrame, column: str, span: float, out: str, min_periods: int = 1, keys=KEYS, day="day") -> DataFrame:
    return with_ema(daily, {out: (column, span, min_periods)}, keys, day)


def rsi(daily: DataFrame, span: int = 14, price: str | Column = "close", out: str | None = None, keys=KEYS, day="day") -> DataFrame:
    """Exponential RSI: a missing change counts as no change; 50 until ``span`` rows or
    when nothing fell."""
    out = out or f"rsi_{span}"
    w = w_day(keys, day)
    df = daily.withColumn("_px", F.col(price) if isinstance(price, str) else price)
    d = diff("_px", w)
    df = df.withColumns({"_g": F.when(d > 0, d).otherwise(0.0), "_l": F.when(d < 0, -d).otherwise(0.0)})
    df = with_ema(df, {"_ag": ("_g", span, span), "_al": ("_l", span, span)}, keys, day)
    return df.withColumn(out, F.coalesce(100 - 100 / (1 + safe_div("_ag", "_al")), F.lit(50.0))).drop("_px", "_g", "_l", "_ag", "_al")


def atr(daily: DataFrame, span: int = 14, simple: bool = False, keys=KEYS, day="day") -> DataFrame:
    """Average true range; the bare true range until ``span`` rows. ``simple`` uses a plain
    rolling mean."""
    out = f"atr_{span}"
    w = w_day(keys, day)
    df = daily.withColumn("_tr", true_range(w))
    if simple:
        return df.withColumn(out, rolling(F.avg, "_tr", w, span, 1)).drop("_tr")
    return with_ema(df, {"_e": ("_tr", span, span)}, keys, day).withColumn(out, F.coalesce("_e", "_tr")).drop("_e", "_tr")


def fill0(df: DataFrame, columns) -> DataFrame:
    return df.fillna(0.0, subset=list(columns))


def sma_slope(name: str, n: int, w, lag: int = 5) -> Column:
    """Change of a moving-average column over ``lag`` rows."""
    return pct_change(name, w, lag)


def returns_momentum(daily: DataFrame, keys=KEYS, day="day") -> DataFrame:
    w = w_day(keys, day)
    df = daily.withColumns({f"return_{n}d": pct_change("close", w, n) for n in (1, 5, 20, 60)})
    return rsi(rsi(fill0(df, [f"return_{n}d" for n in (1, 5, 20, 60)]), 5, keys=keys, day=day), 14, keys=keys, day=day)


def with_smas(daily: DataFrame, windows=(20, 50, 100, 200), keys=KEYS, day="day") -> DataFrame:
    w = w_day(keys, day)
    return daily.withColumns({f"sma{n}": F.avg("close").over(last_rows(w, n)) for n in windows})


def sma_z_slope_alignment(daily: DataFrame, windows=(20, 50, 100, 200), keys=KEYS, day="day") -> DataFrame:
    """z of the close against each average, five-row slopes, and the alignment score."""
    w = w_day(keys, day)
    df = with_smas(daily, windows, keys, day)
    cols = {}
    for n in windows:
        cols[f"close_vs_sma{n}_z"] = F.coalesce(safe_div(F.col("close") - F.col(f"sma{n}"), F.stddev_samp("close").over(last_rows(w, n))), F.lit(0.0))
        cols[f"sma{n}_slope_5d"] = F.coalesce(pct_change(f"sma{n}", w, 5), F.lit(0.0))
    pairs = list(zip(windows, windows[1:]))
    up = sum(((F.col(f"sma{a}") > F.col(f"sma{b}")).cast("int") for a, b in pairs), F.lit(0))
    cols["ma_alignment"] = up / len(pairs) * 2 - 1
    return df.withColumns(cols)


def ma_cross_age(daily: DataFrame, fast: int, slow: int, out: str, keys=KEYS, day="day") -> DataFrame:
    """Days since the averages crossed, signed by the side; 0 before the first cross."""
    w = w_day(keys, day)
    df = with_smas(daily, (fast, slow), keys, day)
    df = df.withColumns({"_up": (F.col(f"sma{fast}") > F.col(f"sma{slow}")).cast("int"), "_rn": F.row_number().over(w)})
    df = df.withColumn("_x", F.when(F.col("_up") != F.lag("_up").over(w), F.col("_rn")))
    since = F.col("_rn") - F.last("_x", ignorenulls=True).over(running(w)) + 1
    return df.withColumn(out, F.coalesce(since * (2 * F.col("_up") - 1), F.lit(0))).drop("_up", "_rn", "_x")


def volatility_block(daily: DataFrame, keys=KEYS, day="day") -> DataFrame:
    """ATR ratios, realised volatility, its own volatility, squared-return means, ATR rank."""
    w = w_day(keys, day)
    df = daily.withColumns({"_tr": true_range(w), "log_ret": F.ln(safe_div("close", F.lag("close").over(w)))})
    df = df.withColumn("_sq", F.pow("log_ret", 2))
    df = with_ema(df, {"_a5": ("_tr", 5, 5), "_a14": ("_tr", 14, 14), "_a20": ("_tr", 20, 20), "_s5": ("_sq", 5, 1), "_s20": ("_sq", 20, 1)}, keys, day)
    df = df.withColumns({f"atr_{n}": F.coalesce(f"_a{n}", "_tr") for n in (5, 14, 20)})
    year = 252 ** 0.5
    df = df.withColumns({"rvol_10d": rolling(F.stddev_samp, "log_ret", w, 10) * year, "rvol_20d": rolling(F.stddev_samp, "log_ret", w, 20) * year,
                         "rvol_21d": rolling(F.stddev_samp, "log_ret", w, 21) * year})
    f = last_rows(w, 252)
    lo, hi = F.min("atr_14").over(f), F.max("atr_14").over(f)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = {
        "atr_ratio_5_20": zero(safe_div("atr_5", "atr_20")), "vol_of_vol": zero(rolling(F.stddev_samp, "rvol_10d", w, 20)),
        "atr_pct_14": zero(safe_div("atr_14", "close")),
        "atr_pctile_252d": zero(F.when(F.count("atr_14").over(f) >= 60, safe_div(F.col("atr_14") - lo, hi - lo))),
        "atr_momentum_5d": zero(pct_change("atr_14", w, 5)), "atr_momentum_10d": zero(pct_change("atr_14", w, 10)),
        "sq_ret_lag1": zero(F.lag("_sq").over(w)), "sq_ret_ewm5": zero(F.lag("_s5").over(w)), "sq_ret_ewm20": zero(F.lag("_s20").over(w)),
    }
    df = df.withColumns(out)
    return fill0(df, ["rvol_10d", "rvol_20d", "rvol_21d"]).drop("_tr", "_sq", "_a5", "_a14", "_a20", "_s5", "_s20")


def bar_shape_daily(daily: DataFrame, keys=KEYS, day="day") -> DataFrame:
    w = w_day(keys, day)
    rng = F.col("high") - F.col("low")
    pc = F.lag("close").over(w)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return daily.withColumns({
        "range_pct": safe_div(rng, "close"), "close_position": zero(safe_div(F.col("close") - F.col("low"), rng)),
        "upper_wick_ratio": zero(safe_div(F.col("high") - F.greatest("close", "open"), rng)),
        "lower_wick_ratio": zero(safe_div(F.least("close", "open") - F.col("low"), rng)), "gap_pct": zero(safe_div(F.col("open") - pc, pc)),
        "body_range_ratio": zero(safe_div(F.abs(F.col("close") - F.col("open")), rng)),
    })


def run_length(flag: str, w) -> list[dict]:
    """Layers giving the length of the current run of 1s in ``flag`` as ``flag_run``."""
    return [{f"_{flag}_rn": F.row_number().over(w)},
            {f"_{flag}_zero": F.last(F.when(F.col(flag) == 0, F.col(f"_{flag}_rn")), ignorenulls=True).over(running(w))},
            {f"{flag}_run": F.col(f"_{flag}_rn") - F.coalesce(F.col(f"_{flag}_zero"), F.lit(0))}]


def consec_days(daily: DataFrame, keys=KEYS, day="day") -> DataFrame:
    """Lengths of the current runs of up days and of down days."""
    w = w_day(keys, day)
    d = F.coalesce(diff("close", w), F.lit(0.0))
    df = daily.withColumns({"_upd": (d > 0).cast("int"), "_dnd": (d < 0).cast("int")})
    for f in ("_upd", "_dnd"):
        for layer in run_length(f, w):
            df = df.withColumns(layer)
    df = df.withColumns({"consec_up": F.col("_upd_run"), "consec_down": F.col("_dnd_run")})
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def drawdown(daily: DataFrame, windows=(20, 60), keys=KEYS, day="day") -> DataFrame:
    w = w_day(keys, day)
    hi = lambda n: F.max("close").over(last_rows(w, n))
    return daily.withColumns({f"drawdown_{n}d": (F.col("close") - hi(n)) / hi(n) for n in windows})


def capture_block(daily: DataFrame, keys=KEYS, day="day") -> DataFrame:
    """Recovery ratio, up capture and down-volatility ratio over 20 rows."""
    w = w_day(keys, day)
    f = last_rows(w, 20)
    df = daily.withColumn("_r", F.coalesce(pct_change("close", w), F.lit(0.0)))
    df = df.withColumns({"_p": F.when(F.col("_r") > 0, F.col("_r")).otherwise(0.0), "_q": F.when(F.col("_r") < 0, -F.col("_r")).otherwise(0.0),
                         "_neg": F.when(F.col("_r") < 0, F.col("_r"))})
    lo, hi = F.min("close").over(f), F.max("close").over(f)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = df.withColumns({
        "recovery_ratio": zero(safe_div(F.col("close") - lo, hi - lo)),
        "up_capture_ratio_20d": zero(safe_div(rolling(F.sum, "_p", w, 20, 5), rolling(F.sum, "_q", w, 20, 5))),
        "down_vol_ratio": zero(safe_div(rolling(F.stddev_samp, "_neg", w, 20, 5), rolling(F.stddev_samp, "_r", w, 20, 5))),
    })
    return out.drop("_r", "_p", "_q", "_neg")


def bollinger_daily(daily: DataFrame, n: int = 20, k: float = 2.0, keys=KEYS, day="day") -> DataFrame:
    w = w_day(keys, day)
    f = last_rows(w, n)
    df = daily.withColumns({"_m": F.avg("close").over(f), "_sd": F.stddev_samp("close").over(f)})
    band = 2 * k * F.col("_sd")
    df = df.withColumns({"bb_pct_b": safe_div(F.col("close") - (F.col("_m") - k * F.col("_sd")), band), "bb_width": safe_div(band, F.col("_m"))})
    z = safe_div(F.col("bb_width") - rolling(F.avg, "bb_width", w, 60, 10), rolling(F.stddev_samp, "bb_width", w, 60, 10))
    return fill0(df.withColumn("bb_width_z", z), ["bb_pct_b", "bb_width", "bb_width_z"]).drop("_m", "_sd")


def trend_exhaustion(daily: DataFrame, keys=KEYS, day="day") -> DataFrame:
    """RSI distance from 50 times clipped %B distance from the middle."""
    df = rsi(bollinger_daily(daily, keys=keys, day=day), 14, keys=keys, day=day)
    return df.withColumn("trend_exhaustion", (F.col("rsi_14") - 50) / 50 * (clip("bb_pct_b", 0, 1) * 2 - 1))


def price_extension(daily: DataFrame, keys=KEYS, day="day") -> DataFrame:
    """Distance from averages in ATR, and the 20-row return against the mean ATR."""
    w = w_day(keys, day)
    df = atr(with_smas(daily, (20, 50), keys, day), 14, keys=keys, day=day)
    a20 = F.avg("atr_14").over(last_rows(w, 20))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.withColumns({
        "price_extension_20d": zero(safe_div(F.col("close") - F.col("sma20"), "atr_14")), "price_extension_50d": zero(safe_div(F.col("close") - F.col("sma50"), "atr_14")),
        "return_vs_range_20d": zero(safe_div(zero(pct_change("close", w, 20)), safe_div(a20, "close"))),
    })


def range_features_mtf(daily: DataFrame, windows=(5, 20, 63), keys=KEYS, day="day") -> DataFrame:
    """Position, width, breakout of the previous window and compression against the mean
    width of three windows."""
    w = w_day(keys, day)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    df = daily
    for n in windows:
        df = df.withColumns({f"_h{n}": rolling(F.max, "close", w, n), f"_l{n}": rolling(F.min, "close", w, n)})
        df = df.withColumn(f"_w{n}", safe_div(F.col(f"_h{n}") - F.col(f"_l{n}"), "close"))
        df = df.withColumns({
            f"range_pos_{n}": zero(safe_div(F.col("close") - F.col(f"_l{n}"), F.col(f"_h{n}") - F.col(f"_l{n}"))), f"range_width_{n}": zero(F.col(f"_w{n}")),
            f"range_breakout_{n}": F.when(F.col("close") < F.lag(f"_l{n}").over(w), -1.0).when(F.col("close") > F.lag(f"_h{n}").over(w), 1.0).otherwise(0.0),
            f"range_compression_{n}": zero(safe_div(f"_w{n}", rolling(F.avg, f"_w{n}", w, 3 * n, n))),
        })
    return df.drop(*[f"_{p}{n}" for n in windows for p in "hlw"])


def range_autoregressive(daily: DataFrame, keys=KEYS, day="day") -> DataFrame:
    """Lags, means and exponential means of the day range, its asymmetry and ATR ratio, all
    as known before the day."""
    w = w_day(keys, day)
    pc = F.lag("close").over(w)
    df = atr(daily, 14, keys=keys, day=day)
    df = df.withColumns({"_rp": safe_div(F.col("high") - F.col("low"), "close"), "_hm": safe_div(F.col("high") - pc, pc), "_lm": safe_div(pc - F.col("low"), pc),
                         "_up": F.coalesce((F.col("close") > pc).cast("double"), F.lit(0.0)),
                         "_ra": safe_div(F.col("high") - F.col("low"), F.col("atr_14"))})
    df = df.withColumn("_as", F.col("_hm") - F.col("_lm"))
    df = with_ema(df, {"_e5": ("_rp", 5, 1), "_e20": ("_rp", 20, 1)}, keys, day)
    before = lambda fn, c, n: F.when(F.count(c).over(last_rows(w, n, True)) >= n, fn(c).over(last_rows(w, n, True)))
    cols = {f"range_pct_lag{k}": F.lag("_rp", k).over(w) for k in (1, 2, 3, 5)}
    cols |= {f"range_pct_ma{n}": before(F.avg, "_rp", n) for n in (5, 20, 60)}
    cols |= {"range_pct_ewm5": F.lag("_e5").over(w), "range_pct_ewm20": F.lag("_e20").over(w),
             "high_move_pct_lag1": F.lag("_hm").over(w), "low_move_pct_lag1": F.lag("_lm").over(w),
             "high_move_pct_ma5": before(F.avg, "_hm", 5), "low_move_pct_ma5": before(F.avg, "_lm", 5),
             "hi_lo_asymmetry_lag1": F.lag("_as").over(w), "hi_lo_asymmetry_ma5": before(F.avg, "_as", 5),
             "range_atr_ratio_lag1": F.lag("_ra").over(w), "range_atr_ratio_ma5": before(F.avg, "_ra", 5),
             "up_days_5d": before(F.sum, "_up", 5), "up_days_10d": before(F.sum, "_up", 10)}
    df = fill0(df.withColumns(cols), cols)
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def causal_shift(daily: DataFrame, columns, keys=KEYS, day="day", fill: float | None = 0.0) -> DataFrame:
    """Every named column as of the row before."""
    w = w_day(keys, day)
    df = daily.withColumns({c: F.lag(c).over(w) for c in columns})
    return df if fill is None else df.fillna(fill, subset=list(columns))


def vp_evolution(daily: DataFrame, keys=KEYS, day="day") -> DataFrame:
    """Five-row changes and rolling means of profile-shape columns (vp_*)."""
    w = w_day(keys, day)
    poc = F.col("low") + F.col("vp_poc_rel") * (F.col("high") - F.col("low"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return daily.withColumns({
        "vp_poc_vs_close": zero(safe_div(F.col("close") - poc, F.col("high") - F.col("low"))),
        "vp_poc_shift_5d": zero(diff("vp_poc_rel", w, 5)), "vp_va_width_trend_5d": zero(diff("vp_va_width_rel", w, 5)),
        "vp_entropy_change_5d": zero(diff("vp_entropy", w, 5)), "vp_va_width_10d_avg": F.avg("vp_va_width_rel").over(last_rows(w, 10)),
        "vp_n_peaks_5d_avg": F.avg("vp_n_peaks").over(last_rows(w, 5)),
    })


def macro_context(daily: DataFrame, others: DataFrame | None = None, keys=KEYS, day="day") -> DataFrame:
    """Trend state, drawdown bucket, ATR rank (1 = quietest), trend strength, squeeze,
    distance from the year's extremes, and breadth of other series (series, day, close)."""
    w = w_day(keys, day)
    df = atr(with_smas(daily, (20, 50, 200), keys, day), 14, keys=keys, day=day)
    df = df.withColumns({"_lr": F.ln(safe_div("close", F.lag("close").over(w))), "_top": F.max("close").over(running(w)),
                         "_rng": F.col("high") - F.col("low"), "_hist": F.collect_list("atr_14").over(last_rows(w, 252))})
    dd = (F.col("close") - F.col("_top")) / F.col("_top")
    f = last_rows(w, 252)
    hi, lo = rolling(F.max, "close", w, 252, 50), rolling(F.min, "close", w, 252, 50)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rank = F.size(F.filter("_hist", lambda x: x >= F.col("atr_14"))) / F.size("_hist")
    out = df.withColumns({
        "ma_20_vs_50": F.when(F.col("sma20") > F.col("sma50"), 1).otherwise(-1), "ma_50_vs_200": F.when(F.col("sma50") > F.col("sma200"), 1).otherwise(-1),
        "drawdown_regime": F.when(dd <= -0.15, 2).when(dd <= -0.05, 1).otherwise(0),
        "vol_regime_pctile": F.when(F.size("_hist") >= 50, rank).otherwise(0.0),
        "trend_strength_20d": zero(safe_div(pct_change("close", w, 20), rolling(F.stddev_samp, "_lr", w, 20) * 252 ** 0.5)),
        "range_squeeze": zero(safe_div(F.avg("_rng").over(last_rows(w, 5)), F.avg("_rng").over(last_rows(w, 20)))),
        "dist_52w_high": zero(safe_div(F.col("close") - hi, hi - lo)), "dist_52w_low": zero(safe_div(F.col("close") - lo, hi - lo)),
    }).drop("_lr", "_top", "_rng", "_hist")
    if others is None:
        return out.withColumn("breadth_proxy", F.lit(0.5))
    wo = by(("series",), day)
    breadth = others.withColumn("_r", pct_change("close", wo, 20)).groupBy(day).agg(F.avg(F.coalesce((F.col("_r") > 0).cast("double"), F.lit(0.0))).alias("breadth_proxy"))
    return out.join(breadth, day, "left").fillna(0.0, subset=["breadth_proxy"])


# --- two series ---------------------------------------------------------------------------------

def pair_returns(primary: DataFrame, other: DataFrame, day="day", on=()) -> DataFrame:
    """Aligned pair: other's close joined on the day as ``oclose``, one-row returns x and y."""
    on = [*on, day]
    j = primary.join(other.select(*on, F.col("close").alias("oclose")), on)
    w = w_day(day=day)
    return j.withColumns({"x": pct_change("close", w), "y": pct_change("oclose", w)})


def pair_rolling(fn, a: str, b: str, w, n: int, mp: int) -> Column:
    """Two-column aggregate over rows where both are present."""
    f = last_rows(w, n)
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.when(F.count(x).over(f) >= mp, fn(x, y, f))


def corr_over(x: Column, y: Column, f) -> Column:
    """Correlation over a frame; null when a side is constant (F.corr would divide by zero)."""
    return safe_div(F.covar_samp(x, y).over(f), F.stddev_samp(x).over(f) * F.stddev_samp(y).over(f))


def covar_over(x: Column, y: Column, f) -> Column:
    return F.covar_samp(x, y).over(f)


def rolling_corr_beta(primary: DataFrame, other: DataFrame, windows=(10, 20, 60), day="day", on=()) -> DataFrame:
    """Rolling correlations, their shift and z, beta and its change, relative strength and
    the correlation with the other side's previous return."""
    w = w_day(day=day)
    df = pair_returns(primary, other, day, on)
    df = df.withColumn("_y1", F.lag("y").over(w))
    df = df.withColumns({f"corr_{n}d": pair_rolling(corr_over, "x", "y", w, n, n // 2) for n in windows})
    short, long = f"corr_{windows[0]}d", f"corr_{windows[-1]}d"
    df = df.withColumn("beta_20d", safe_div(pair_rolling(covar_over, "x", "y", w, 20, 10), rolling(F.var_samp, "y", w, 20, 10)))
    return df.withColumns({
        "corr_shift": F.col(short) - F.col(long),
        "corr_z": safe_div(F.col(short) - rolling(F.avg, short, w, 60, 10), rolling(F.stddev_samp, short, w, 60, 10)),
        "relstr_5d": pct_change("close", w, 5) - pct_change("oclose", w, 5), "relstr_20d": pct_change("close", w, 20) - pct_change("oclose", w, 20),
        "beta_change": diff("beta_20d", w, 5), "leadlag": pair_rolling(corr_over, "x", "_y1", w, 20, 10),
    }).drop("_y1")


def corr_regime(pairs: DataFrame, null_safe: bool = False, day="day") -> DataFrame:
    """Sign flips, momentum, positive share and age of the 20-row correlation of x and y.

    By default a missing sign counts as changed, as NaN comparisons would make it; with
    ``null_safe`` two missing signs are equal."""
    w = w_day(day=day)
    df = pairs.withColumn("corr20", pair_rolling(corr_over, "x", "y", w, 20, 10))
    df = df.withColumns({"_s": F.signum("corr20"), "_rn": F.row_number().over(w)})
    ps = F.lag("_s").over(w)
    same = F.col("_s").eqNullSafe(ps) if null_safe else F.coalesce(F.col("_s") == ps, F.lit(False))
    # the age restarts at 1 on a sign change to non-zero, at 0 while a sign is missing
    gap = F.col("_s").isNull() | ps.isNull()
    df = df.withColumns({
        "_chg": (~same).cast("int"), "_pos": F.coalesce((F.col("corr20") > 0).cast("double"), F.lit(0.0)),
        "_reset": F.when(gap, F.col("_rn")).when((F.col("_s") != ps) & (F.col("_s") != 0), F.col("_rn") - 1),
    })
    return df.withColumns({
        "sign_flip_10d": F.max("_chg").over(last_rows(w, 10)), "momentum_10d": diff("corr20", w, 10),
        "pos_pct_60d": rolling(F.avg, "_pos", w, 60, 10), "regime_age": F.col("_rn") - F.last("_reset", ignorenulls=True).over(running(w)),
    }).drop("_s", "_rn", "_chg", "_pos", "_reset")


def vix_block(primary: DataFrame, vix: DataFrame, vix3m: DataFrame, day="day") -> DataFrame:
    """Volatility-index level, rank, regime, spikes, spread to realised volatility and term
    structure. ``vix`` and ``vix3m`` are already as-of joined: (symbol, day, value)."""
    w = w_day(day=day)
    df = primary.join(vix.select("symbol", day, F.col("value").alias("vix_close")), ["symbol", day], "left") \
        .join(vix3m.select("symbol", day, F.col("value").alias("v3")), ["symbol", day], "left")
    df = df.withColumns({"x": pct_change("close", w), "y": pct_change("vix_close", w), "_h": F.collect_list("vix_close").over(last_rows(w, 252)),
                         "vix_term_structure": safe_div("vix_close", "v3")})
    v = F.col("vix_close")
    sma = rolling(F.avg, "vix_close", w, 20, 5)
    c20, c60 = pair_rolling(corr_over, "x", "y", w, 20, 10), pair_rolling(corr_over, "x", "y", w, 60, 20)
    ts = "vix_term_structure"
    return df.withColumns({
        "vix_percentile_252d": F.when(F.size("_h") >= 60, F.size(F.filter("_h", lambda e: e <= F.col("vix_close"))) / F.size("_h")),
        "vix_vs_sma20": safe_div(v - sma, sma), "vix_change_1d": F.col("y"), "vix_change_5d": pct_change("vix_close", w, 5),
        "vix_regime": F.when(v >= 30, 3).when(v >= 20, 2).when(v >= 15, 1).otherwise(0),
        "vix_spike": F.coalesce((F.abs("y") > 2 * rolling(F.stddev_samp, "y", w, 60, 20)).cast("int"), F.lit(0)),
        "vix_rv_spread": v - rolling(F.stddev_samp, "x", w, 20, 10) * 252 ** 0.5 * 100,
        "vix_es_corr_20d": c20, "vix_es_corr_shift": c20 - c60, "vix_term_spread": F.col("v3") - v,
        "vix_term_z": safe_div(F.col(ts) - rolling(F.avg, ts, w, 60, 10), rolling(F.stddev_samp, ts, w, 60, 10)),
        "vix_term_regime": F.coalesce((rolling(F.avg, ts, w, 20, 5) > 1).cast("int"), F.lit(0)), "vix3m_slope_5d": pct_change("v3", w, 5),
    }).drop("_h")


def dxy_block(primary: DataFrame, dxy: DataFrame, day="day") -> DataFrame:
    """Currency-index returns, trend and correlation with the primary series."""
    w = w_day(day=day)
    df = primary.join(dxy.select("symbol", day, F.col("value").alias("d")), ["symbol", day], "left")
    df = df.withColumns({"x": pct_change("close", w), "y": pct_change("d", w)})
    df = df.withColumns({"dxy_es_corr_20d": pair_rolling(corr_over, "x", "y", w, 20, 10), "dxy_es_corr_60d": pair_rolling(corr_over, "x", "y", w, 60, 20)})
    c, sma = "dxy_es_corr_20d", rolling(F.avg, "d", w, 50, 20)
    return df.withColumns({
        "dxy_return_5d": pct_change("d", w, 5), "dxy_return_20d": pct_change("d", w, 20), "dxy_vs_sma50": safe_div(F.col("d") - sma, sma),
        "dxy_trend": F.signum(pct_change("d", w, 20)), "dxy_es_corr_shift": F.col(c) - F.col("dxy_es_corr_60d"),
        "dxy_es_corr_z": safe_div(F.col(c) - rolling(F.avg, c, w, 60, 10), rolling(F.stddev_samp, c, w, 60, 10)),
    })


def leading_block(df: DataFrame, day="day") -> DataFrame:
    """Yield-curve slope, skew index and credit stress from as-of joined columns
    tnx, irx, skew, hyg, lqd next to close."""
    w = w_day(day=day)
    z = lambda c: safe_div(F.col(c) - rolling(F.avg, c, w, 60, 20), rolling(F.stddev_samp, c, w, 60, 20))
    df = df.withColumns({"yield_curve_slope": F.col("tnx") - F.col("irx"), "credit_stress": pct_change("hyg", w, 20) - pct_change("close", w, 20),
                         "hy_ig_spread": pct_change("hyg", w, 20) - pct_change("lqd", w, 20)})
    return df.withColumns({
        "yield_curve_slope_20d_chg": diff("yield_curve_slope", w, 20), "yield_curve_z": z("yield_curve_slope"), "skew_z": z("skew"),
        "skew_change_5d": diff("skew", w, 5), "credit_stress_z": z("credit_stress"), "credit_momentum": diff("credit_stress", w, 5),
    })


# --- change detection --------------------------------------------------------------------------

def cusum(daily: DataFrame, column: str, drift: float = 0.5, lookback: int = 60, reset: float = 5.0, keys=KEYS, day="day", block_rows: int = scans.BLOCK) -> DataFrame:
    """Two-sided CUSUM of rolling z-scores that restarts after exceeding ``reset``: z-scores by
    windows over blocks, the sums by a scan over blocks (``scans.resetting_sums``). A row without
    z (the first one, or no spread) shows 0 and leaves the sums as they are."""
    half = lookback // 2

    def z_of(w):
        sd = rolling(F.stddev_samp, column, w, lookback, half)
        z = F.when(sd >= 1e-10, (F.col(column) - rolling(F.avg, column, w, lookback, half)) / sd)
        return [{"z": F.when(F.col("_pos") > 0, z), "_at": F.col("_pos")}]

    src = daily.select(*keys, day, F.col(column).cast("double"), F.year(day).alias("_year"))
    df = over_blocks(src, keys, "_year", day, lookback, z_of).select(*keys, day, "_at", "z")
    out = scans.resetting_sums(df, keys, "_at", "z", drift, reset, block_rows)
    out = out.select(*keys, day, "z", F.col("up").alias("cusum_pos"), F.col("down").alias("cusum_neg"))
    return out.withColumn("cusum_score", F.greatest("cusum_pos", "cusum_neg") / reset)


def cusum_columns(daily: DataFrame, keys=KEYS, day="day") -> DataFrame:
    """``cusum`` of the daily return, beside the other columns."""
    r = daily.withColumn("_r", F.coalesce(pct_change("close", w_day(keys, day)), F.lit(0.0)))
    return join_keys(daily, cusum(r, "_r", keys=keys, day=day).drop("z"), [*keys, day])


def ewma_z(daily: DataFrame, column: str, span: int = 20, baseline: int = 252, keys=KEYS, day="day") -> DataFrame:
    w = w_day(keys, day)
    df = with_ema(daily, {"ewma_value": (column, span, span // 2)}, keys, day)
    mean, sd = (rolling(fn, "ewma_value", w, baseline, baseline // 2) for fn in (F.avg, F.stddev_samp))
    return df.withColumn("ewma_z", F.coalesce(safe_div(F.col("ewma_value") - mean, sd), F.lit(0.0)))


def change_score(daily: DataFrame, returns: str, anomaly: str, keys=KEYS, day="day") -> DataFrame:
    """The larger of the return CUSUM and the scaled anomaly EWMA z, in [0, 1]."""
    w = w_day(keys, day)
    c = cusum(daily, returns, keys=keys, day=day).drop("z")
    df = ewma_z(daily, anomaly, keys=keys, day=day).join(c, [*keys, day])
    norm = (clip("ewma_z", -3, 3) / 3.0 + 1) / 2
    return df.withColumns({
        "return_cusum_direction": F.when(F.col("cusum_pos") >= F.col("cusum_neg"), 1).otherwise(-1),
        "anomaly_acceleration": F.coalesce(diff("ewma_value", w, 5), F.lit(0.0)),
        "combined_change_score": clip(F.greatest(F.col("cusum_score"), norm), 0, 1),
    })


# Risk buckets start above these scores.
RISK_THRESHOLDS = (0.25, 0.50, 0.75)


def regime_risk(df: DataFrame, breakouts, positions, anomaly: str, change: str, weights=(0.25, 0.40, 0.35), thresholds=RISK_THRESHOLDS) -> DataFrame:
    """Weighted range stress, anomaly and change scores, and a 0-3 bucket."""
    n, total = len(breakouts), sum(weights)
    frac = sum((F.abs(F.col(c)) for c in breakouts), F.lit(0.0)) / n
    far = sum((F.abs(F.col(c) - 0.5) for c in positions), F.lit(0.0)) / len(positions)
    df = df.withColumn("range_stress", clip((frac + far) / 2, 0, 1))
    a, c = (F.coalesce(clip(x, 0, 1), F.lit(0.0)) for x in (anomaly, change))
    wr, wa, wc = (x / total for x in weights)
    df = df.withColumn("risk_score", clip(wr * F.col("range_stress") + wa * a + wc * c, 0, 1))
    return df.withColumn("risk_regime", sum(((F.col("risk_score") > t).cast("int") for t in thresholds), F.lit(0)))


def robust_anomaly_score(daily: DataFrame, features, train_rows: int, keys=KEYS, day="day") -> DataFrame:
    """Mean absolute robust z over the features, scaled by the training window's own range,
    with its percentile among the training scores. Fitted on the first ``train_rows`` rows."""
    w = w_day(keys, day)
    df = daily.fillna(0.0, subset=list(features)).withColumn("_train", (F.row_number().over(w) <= train_rows).cast("int"))
    q = lambda c, p: F.percentile(F.when(F.col("_train") == 1, F.col(c)), p)
    stats = df.groupBy(*keys).agg(*[q(c, 0.5).alias(f"_m_{c}") for c in features], *[(q(c, 0.75) - q(c, 0.25)).alias(f"_i_{c}") for c in features])
    df = df.join(stats, list(keys))
    raw = sum((F.coalesce(safe_div(F.abs(F.col(c) - F.col(f"_m_{c}")), f"_i_{c}"), F.lit(0.0)) for c in features), F.lit(0.0)) / len(features)
    df = df.withColumn("_raw", raw)
    d = whole(keys)
    tr = F.when(F.col("_train") == 1, F.col("_raw"))
    lo, hi = F.min(tr).over(d), F.max(tr).over(d)
    df = df.withColumn("anomaly_score", F.coalesce(clip(safe_div(F.col("_raw") - lo, hi - lo), 0, 1), F.lit(0.0)))
    o = by(keys, "anomaly_score")
    below = F.coalesce(F.sum("_train").over(o.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0))
    n = F.sum("_train").over(d)
    same = F.sum("_train").over(whole((*keys, "anomaly_score")))
    pct = (below - same + below + (same > 0).cast("int")) / 2 / n
    df = df.withColumn("anomaly_percentile", pct)
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def walk_forward_anomaly(daily: DataFrame, features, n_folds: int, min_train: int, contamination: float = 0.05, k: int = 4096, steps: int = 1024, keys=KEYS, day="day") -> DataFrame:
    """Anomaly scores of every test row, fitted on the rows before its fold only.

    Folds are those of ``selection.walk_forward_folds``. The rows between two fold borders are
    sketched once per feature (KLL, ``k``); sketches are merged along the folds, so each fold has
    the medians and quartile spreads of its own past without reading that past again. The raw score
    is the mean of |x - median| / spread. Its range, its limit and its distribution over a fold's
    training rows are one more aggregation, partial before any shuffle.

    anomaly_score: raw scaled by the training range, in [0, 1]; anomaly_label: above the training
    quantile 1 - contamination; anomaly_percentile: share of training rows at or below the row, cut
    down to multiples of 1 / ``steps``.
    Quantiles are exact up to ``k`` training rows per series and within 2.3 / k^0.97 of the rank
    beyond. Missing features count as 0; a feature without spread adds nothing; series with no more
    than ``min_train`` rows have no test rows.
    """
    keys, features = list(keys), list(features)
    src = daily.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}).withColumn("_year", F.year(day))
    placed = with_position(src, keys, "_year", day, "_i").drop("_year")
    sizes = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    per = F.floor((F.col("_n") - min_train) / n_folds)
    # part 0 is the first training window, part f + 1 the test rows of fold f
    block = F.when(per > 0, F.least(F.floor((F.col("_i") - min_train) / F.nullif(per, F.lit(0))), F.lit(n_folds - 1))).otherwise(n_folds - 1)
    placed = join_keys(placed, sizes, keys).withColumn("_part", F.when(F.col("_i") < min_train, 0).otherwise(block + 1).cast("int")).drop("_n")

    folds_after = F.explode(F.sequence("_part", F.lit(n_folds - 1))).alias("fold")
    parts = placed.filter(F.col("_part") < n_folds).groupBy(*keys, "_part").agg(*[F.kll_sketch_agg_double(c, k).alias(c) for c in features])
    past = parts.select(*keys, *features, folds_after).groupBy(*keys, "fold").agg(*[F.kll_merge_agg_double(c, k).alias(c) for c in features])
    q = lambda c, p: F.kll_sketch_get_quantile_double(c, F.lit(p))
    centres = F.array(*[F.struct(q(c, 0.5).alias("middle"), (q(c, 0.75) - q(c, 0.25)).alias("spread")) for c in features])
    fits = past.select(*keys, F.struct("fold", centres.alias("at")).alias("_f")).groupBy(*keys).agg(F.collect_list("_f").alias("_fits"))
    fitted = join_keys(placed, fits, keys)

    def raw(at):
        return sum((F.coalesce(safe_div(F.abs(F.col(c) - at[i]["middle"]), at[i]["spread"]), F.lit(0.0)) for i, c in enumerate(features)), F.lit(0.0)) / len(features)

    trained = fitted.select(*keys, "_part", *features, F.explode("_fits").alias("_f")).filter(F.col("_part") <= F.col("_f.fold"))
    trained = trained.select(*keys, F.col("_f.fold").alias("fold"), raw(F.col("_f.at")).alias("_raw"))
    ranges = trained.groupBy(*keys, "fold").agg(F.min("_raw").alias("_low"), F.max("_raw").alias("_high"), F.kll_sketch_agg_double("_raw", k).alias("_scores"))
    grid = F.array(*[F.lit((j + 1) / steps) for j in range(steps)])
    ranges = ranges.select(*keys, "fold", "_low", "_high", q("_scores", 1 - contamination).alias("_limit"), F.kll_sketch_get_quantile_double("_scores", grid).alias("_grid"))
    own = F.get(F.filter("_fits", lambda f: f["fold"] == F.col("_part") - 1), F.lit(0))["at"]
    tested = fitted.filter(F.col("_part") > 0).withColumns({"fold": F.col("_part") - 1, "_at": own})
    tested = tested.withColumn("_raw", raw(F.col("_at"))).drop("_fits", "_at", "_part", "_i")
    out = join_keys(tested, ranges, [*keys, "fold"])
    return out.withColumns({
        "anomaly_score": F.coalesce(clip(safe_div(F.col("_raw") - F.col("_low"), F.col("_high") - F.col("_low")), 0, 1), F.lit(0.0)),
        "anomaly_label": (F.col("_raw") > F.col("_limit")).cast("int"),
        "anomaly_percentile": F.size(F.filter("_grid", lambda g: g <= F.col("_raw"))) / steps,
    }).drop("_raw", "_low", "_high", "_limit", "_grid")
