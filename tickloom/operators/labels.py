"""Labels from what happens next. All of them read future rows, so they are batch only.

The future of a bar is a bounded frame (``ROWS 1..n FOLLOWING``) or the rest of its day,
held as an array on the row. First touches are array functions over it: no self join, no
pairs, and one shuffle per series block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.windows import DAY_KEYS, by, last_rows, safe_div, whole
from tickloom.operators import scans
from tickloom.operators.blocks import over_series

PATH = ("high", "low", "close")


def with_path(bars: DataFrame, ahead: int, out: str = "path", include_current: bool = False, **where) -> DataFrame:
    """Array of (high, low, close) of the next ``ahead`` bars."""
    first = 0 if include_current else 1
    last = ahead - 1 if include_current else ahead
    return over_series(bars, lambda w: [{out: F.collect_list(F.struct(*PATH)).over(w.rowsBetween(first, last))}], 0, ahead=ahead, **where)


def day_paths(bars: DataFrame, keys=DAY_KEYS) -> DataFrame:
    """One row per day with its bars in order; a day's bars are bounded by the clock."""
    rows = F.sort_array(F.collect_list(F.struct("bar_no", *PATH)))
    return bars.groupBy(*keys).agg(rows.alias("day_path"))


def first_touch(path: Column | str, test) -> Column:
    """1-based index of the first element that passes, null when none does."""
    return F.nullif(F.array_position(F.transform(path, test), F.lit(True)), F.lit(0))


def barrier_columns(df: DataFrame, path: str = "path", tie: str = "stop", timeout: str = "zero", keep_tie: bool = False) -> DataFrame:
    """First touch of ``stop`` or ``target`` along ``path`` for ``direction`` and
    ``entry_price``. ``tie`` names the winner inside one bar; ``timeout`` pays 0 ("zero") or
    the last close of the path ("close"); ``keep_tie`` reports lost ties as stop_tie."""
    d, stop, target, px = (F.col(c) for c in ("direction", "stop", "target", "entry_price"))
    df = df.withColumns({
        "_s": first_touch(path, lambda e: F.when(d > 0, e["low"] <= stop).otherwise(e["high"] >= stop)),
        "_t": first_touch(path, lambda e: F.when(d > 0, e["high"] >= target).otherwise(e["low"] <= target)),
    })
    n = F.size(path)
    s, t = F.coalesce("_s", n + 1), F.coalesce("_t", n + 1)
    stop_wins = (s <= t) if tie == "stop" else (s < t)
    none = (s > n) & (t > n)
    kind = F.when(none, "timeout").when(stop_wins, F.when((s == t) & F.lit(keep_tie), "stop_tie").otherwise("stop")).otherwise("target")
    df = df.withColumns({"exit_type": kind, "exit_bars": F.when(none, n).otherwise(F.least(s, t))})
    last_close = F.try_element_at(path, F.lit(-1))["close"]
    end = px if timeout == "zero" else F.coalesce(last_close, px)
    exit_px = F.when(F.col("exit_type") == "timeout", end).when(F.col("exit_type") == "target", target).otherwise(stop)
    walked = F.slice(path, F.lit(1), F.greatest("exit_bars", F.lit(0)))
    best = F.aggregate(walked, F.lit(0.0), lambda a, e: F.greatest(a, F.when(d > 0, e["high"] - px).otherwise(px - e["low"])))
    worst = F.aggregate(walked, F.lit(0.0), lambda a, e: F.greatest(a, F.when(d > 0, px - e["low"]).otherwise(e["high"] - px)))
    df = df.withColumns({"exit_price": exit_px, "mfe": best, "mae": worst})
    return df.withColumn("pnl", (F.col("exit_price") - px) * d).drop("_s", "_t")


def barrier_outcome(entries: DataFrame, bars: DataFrame, start_offset: int = 1, tie: str = "stop", timeout: str = "zero",
                    horizon: int | None = None, keep_tie: bool = False, last_minute: int | None = None, roll_hour: int = 15, keys=DAY_KEYS) -> DataFrame:
    """Barrier exits of entries (symbol, trading_day, bar_no, entry_price, direction, stop,
    target) inside their day, or up to ``last_minute`` of a session that starts at
    ``roll_hour``. ``start_offset`` 0 lets the entry bar itself exit the trade; ``horizon``
    bounds the number of bars."""
    since_roll = lambda m: F.pmod(m - F.lit(60 * roll_hour), F.lit(1440))
    src = bars if last_minute is None else bars.filter(since_roll(F.col("minute")) <= since_roll(F.lit(last_minute)))
    none = F.array().cast("array<struct<bar_no:int,high:double,low:double,close:double>>")
    if horizon is not None:
        # A bounded look ahead travels with the entry's bar; the whole day is only needed without one.
        ahead = by(keys, "bar_no").rowsBetween(start_offset, start_offset + horizon - 1)
        paths = src.select(*keys, "bar_no", F.collect_list(F.struct("bar_no", *PATH)).over(ahead).alias("path"))
        df = entries.join(paths, [*keys, "bar_no"], "left").withColumn("path", F.coalesce("path", none))
        return barrier_columns(df, "path", tie, timeout, keep_tie).drop("path")
    df = entries.join(day_paths(src, keys), list(keys), "left")
    path = F.filter(F.coalesce("day_path", none), lambda e: e["bar_no"] >= F.col("bar_no") + start_offset)
    return barrier_columns(df.withColumn("path", path).drop("day_path"), "path", tie, timeout, keep_tie).drop("path")


def reversal_breakout(df: DataFrame, reversal: float = 6.0, breakout: float = 4.0, forward: int = 45, alpha: float = 0.3, drop_ambiguous: bool = False,
                      tolerance: int = 2, min_day_bars: int = 20, per_day: bool = True, block_rows: int = 65536, keys=DAY_KEYS) -> DataFrame:
    """Outcome of near-level bars (side not 0): did price move ``reversal`` away from the
    close before ``breakout`` through the level? ``per_day`` stops at the session's end and
    skips short days. Needs close, level_price, side."""
    if per_day:
        df = df.withColumn("_n", F.count(F.lit(1)).over(whole(keys)))
    df = with_path(df, forward, reset_daily=per_day, block_rows=block_rows)
    near = df.filter(F.col("side") != 0)
    c, lv, up = F.col("close"), F.col("level_price"), F.col("side") > 0
    hit = lambda rev, is_up: first_touch("path", lambda e: (
        F.when(is_up, e["high"] >= c + reversal).otherwise(e["low"] <= c - reversal) if rev
        else F.when(is_up, e["low"] <= lv - breakout).otherwise(e["high"] >= lv + breakout)))
    never = F.lit(9999)
    near = near.withColumns({"_r": F.coalesce(hit(True, up), never), "_b": F.coalesce(hit(False, up), never),
                             "_or": F.coalesce(hit(True, ~up), never), "_ob": F.coalesce(hit(False, ~up), never)})
    call = lambda r, b: F.when(F.col(r) < F.col(b), "reversal").when(F.col(b) < F.col(r), "breakout").otherwise("inconclusive")
    near = near.withColumns({"outcome": call("_r", "_b"), "_o": call("_or", "_ob"), "bars_to_event": F.least("_r", "_b")})
    if drop_ambiguous:
        clash = (F.col("_o") != "inconclusive") & (F.col("_o") != F.col("outcome")) & (F.least("_or", "_ob") <= F.col("bars_to_event") + tolerance)
        near = near.withColumn("outcome", F.when(clash, "inconclusive").otherwise(F.col("outcome")))
    if per_day:
        near = near.filter(F.col("_n") >= min_day_bars)
    undecided = F.col("outcome") == "inconclusive"
    p = F.when(undecided, 0.15).when(F.col("outcome") == "reversal", F.exp(-alpha * F.col("bars_to_event"))).otherwise(0.0)
    near = near.withColumns({"p_reversal": p, "bars_to_event": F.when(undecided, 0).otherwise(F.col("bars_to_event"))})
    return near.drop("path", "_r", "_b", "_or", "_ob", "_o", "_n")


def major_move(df: DataFrame, forward: int = 60, reversal: float = 6.0, breakout: float = 4.0, ratio: float = 1.4, breakout_ratio: float = 1.2, terminal: float = 0.2,
               vol: str | None = None, reversal_vol: float = 0.10, breakout_vol: float = 0.08, drop_near: bool = False, margin: float = 0.0, ratio_buffer: float = 0.0,
               block_rows: int = 65536) -> DataFrame:
    """Outcome by excursion quality, whatever came first: 1 reversal, 0 breakout, 2 neither."""
    def columns(w):
        f = w.rowsBetween(1, forward)
        return [{"_h": F.max("high").over(f), "_l": F.min("low").over(f), "_e": F.last("close").over(f)}]
    df = over_series(df, columns, 0, ahead=forward, block_rows=block_rows).filter(F.col("side") != 0)
    up, c, lv, eps = F.col("side") > 0, F.col("close"), F.col("level_price"), 1e-6
    scale = lambda base, k: F.greatest(F.lit(float(base)), F.when(F.col(vol) > 0, k * F.col(vol))) if vol else F.lit(float(base))
    df = df.withColumns({
        "aligned_mfe": F.when(up, F.col("_h") - c).otherwise(c - F.col("_l")), "terminal_disp": F.when(up, F.col("_e") - c).otherwise(c - F.col("_e")),
        "adverse": F.greatest(F.when(up, c - F.col("_l")).otherwise(F.col("_h") - c), F.when(up, lv - F.col("_l")).otherwise(F.col("_h") - lv)),
        "_rt": scale(reversal, reversal_vol), "_bt": scale(breakout, breakout_vol),
    })
    a, b, t, rt, bt = (F.col(x) for x in ("aligned_mfe", "adverse", "terminal_disp", "_rt", "_bt"))
    ra, rb = (a + eps) / F.nullif(b + eps, F.lit(0.0)), (b + eps) / F.nullif(a + eps, F.lit(0.0))
    pos = (a >= rt) & (ra >= ratio) & (t >= terminal * rt)
    neg = (b >= bt) & (rb >= breakout_ratio) & (t <= -terminal * bt)
    label = F.when(pos & ~neg, 1).when(neg & ~pos, 0).otherwise(2)
    if drop_near:
        close_pos = ((a - rt) / F.greatest(rt, F.lit(eps)) <= margin) | (ra - ratio <= ratio_buffer) | (t / F.greatest(rt, F.lit(eps)) - terminal <= margin)
        close_neg = ((b - bt) / F.greatest(bt, F.lit(eps)) <= margin) | (rb - breakout_ratio <= ratio_buffer) | (-t / F.greatest(bt, F.lit(eps)) - terminal <= margin)
        label = F.when((label == 1) & close_pos, 2).when((label == 0) & close_neg, 2).otherwise(label)
    return df.withColumn("outcome", F.coalesce(label, F.lit(2))).drop("_h", "_l", "_e", "_rt", "_bt")


def realized_mfe(df: DataFrame, forward: int = 45, unit: float = 4.0, block_rows: int = 65536) -> DataFrame:
    """Largest favourable move of the next bars for the row's side."""
    def columns(w):
        f = w.rowsBetween(1, forward)
        up = F.max("high").over(f) - F.col("close")
        dn = F.col("close") - F.min("low").over(f)
        return [{"mfe_pts": F.when(F.col("side") > 0, up).when(F.col("side") < 0, dn)}]
    return over_series(df, columns, 0, ahead=forward, block_rows=block_rows).withColumn("mfe_r", F.col("mfe_pts") / unit)


def reversals(bars: DataFrame, price: str = "close", window: int = 20, min_slope: float = 1e-4, min_move: float = 0.002, validate: int = 15,
              bounce: float = 0.5, keys=DAY_KEYS) -> DataFrame:
    """Bars where the rolling slope changes sign and the move that follows holds.

    ``price`` "close" judges the move on closes; "range" judges it on highs and lows. Adds
    reversal (1, -1, 0), magnitude, duration and prior_trend to every bar of long-enough days.
    """
    w, d = by(keys), whole(keys)
    slope = F.when(F.count("close").over(last_rows(w, window)) >= window, F.regr_slope(F.col("close"), F.col("bar_no").cast("double")).over(last_rows(w, window)))
    f = w.rowsBetween(0, validate - 1)
    hi, lo = ("close", "close") if price == "close" else ("high", "low")
    df = bars.withColumns({"_slope": slope, "_n": F.count(F.lit(1)).over(d), "_hi": F.collect_list(hi).over(f), "_lo": F.collect_list(lo).over(f)})
    df = df.withColumn("_prev", F.lag("_slope").over(w))
    turn_up = (F.col("_prev") < -min_slope) & (F.col("_slope") > min_slope)
    turn_dn = (F.col("_prev") > min_slope) & (F.col("_slope") < -min_slope)
    able = (F.col("_n") >= window + validate) & (F.col("bar_no") < F.col("_n")) & (F.size("_hi") >= 3)
    df = df.withColumn("_dir", F.when(able & turn_up, 1).when(able & turn_dn, -1).otherwise(0))
    c, up = F.col("close"), F.col("_dir") > 0
    best = F.when(up, F.array_max("_hi")).otherwise(F.array_min("_lo"))
    at = F.when(up, F.array_position("_hi", F.array_max("_hi"))).otherwise(F.array_position("_lo", F.array_min("_lo")))
    df = df.withColumns({"_best": best, "_at": at})
    after = lambda c: F.slice(c, F.col("_at").cast("int"), F.size(c))
    back = F.when(up, F.col("_best") - F.array_min(after("_lo"))).otherwise(F.array_max(after("_hi")) - F.col("_best")) / F.nullif(c, F.lit(0.0))
    move = F.when(up, F.col("_best") - c).otherwise(c - F.col("_best")) / F.nullif(c, F.lit(0.0))
    ok = (F.col("_dir") != 0) & (move >= min_move) & (back <= bounce * min_move)
    zero = F.lit(0.0)
    df = df.withColumns({
        "reversal": F.when(ok, F.col("_dir")).otherwise(0), "magnitude": F.when(ok, move).otherwise(zero),
        "duration": F.when(ok, F.col("_at") - 1).otherwise(0), "prior_trend": F.when(ok, F.col("_prev")).otherwise(zero),
        "extreme": F.when(ok, F.col("_best")),
    })
    return df.drop("_slope", "_n", "_hi", "_lo", "_prev", "_dir", "_best", "_at")


def viable_zones(bars: DataFrame, stop: float = 0.0015, min_rr: float = 1.5, lookback: int = 10, keys=DAY_KEYS, levels=None, proximity: float | None = None,
                 alpha: float = 0.5, **rules) -> DataFrame:
    """Bars up to ``lookback`` before a reversal whose entry would have survived the stop and
    earned ``min_rr``; walking back ends at the first stopped-out bar, and a later reversal
    overwrites an earlier one. With ``levels`` only reversals near the day's median of a
    level count, and the zone carries that level and a probability decaying with distance."""
    df = reversals(bars, price="range", keys=keys, **rules)
    w = by(keys)
    df = df.withColumn("_back", F.collect_list(F.struct("bar_no", "high", "low", "close")).over(last_rows(w, lookback + 1)))
    rev = df.filter((F.col("reversal") != 0) & (F.col("magnitude") / stop >= min_rr))
    extra = []
    if levels:
        first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("bar_no")))
        med = bars.groupBy(*keys).agg(*[F.when(first(c) != 0, F.median(c)).alias(f"_m_{c}") for c in levels])
        rev = rev.join(med, list(keys))
        opts = F.array(*[F.struct(F.abs(F.col("close") - F.col(f"_m_{c}")).alias("dist"), F.lit(i).alias("ord"), F.lit(c).alias("name")) for i, c in enumerate(levels)])
        rev = rev.withColumn("_lv", F.array_min(F.filter(opts, lambda e: e["dist"].isNotNull()))).filter(F.col("_lv.dist") <= proximity)
        extra = [F.col("_lv.name").alias("nearest_level"), F.col("_lv.dist").alias("level_distance")]
    n = F.size("_back")
    up, zero = F.col("reversal") > 0, F.lit(0.0)

    def step(k):
        entry = F.element_at("_back", n - k)
        span = F.slice("_back", n - k, k + 1)
        worst = F.when(up, F.array_min(F.transform(span, lambda e: e["low"]))).otherwise(F.array_max(F.transform(span, lambda e: e["high"])))
        mae = F.greatest(F.when(up, entry["close"] - worst).otherwise(worst - entry["close"]) / F.nullif(entry["close"], F.lit(0.0)), zero)
        reward = F.when(up, F.col("extreme") - entry["close"]).otherwise(entry["close"] - F.col("extreme")) / F.nullif(entry["close"], F.lit(0.0))
        return F.struct(k.alias("k"), entry["bar_no"].alias("bar_no"), mae.alias("mae"), reward.alias("reward"))

    rev = rev.withColumn("_steps", F.transform(F.sequence(F.lit(0), n - 1), step))
    stopped = F.array_position(F.transform("_steps", lambda s: s["mae"] > stop), F.lit(True))
    alive = F.when(stopped == 0, F.col("_steps")).otherwise(F.slice("_steps", F.lit(1), F.greatest(stopped.cast("int") - 1, F.lit(0))))
    rev = rev.withColumn("_e", F.explode(F.filter(alive, lambda s: s["reward"] / stop >= min_rr)))
    zone = F.struct(F.col("reversal").alias("zone_label"), F.col("_e.mae").alias("max_adverse_excursion"), F.col("_e.reward").alias("potential_reward"), F.col("_e.k").alias("bars_to_reversal"),
                    (F.col("_e.reward") / stop).alias("reward_risk_ratio"), F.col("magnitude").alias("reversal_magnitude"), F.exp(-alpha * F.col("_e.k")).alias("zone_probability"), *extra)
    best = rev.groupBy(*keys, F.col("_e.bar_no").alias("zone_bar")).agg(F.max_by(zone, "bar_no").alias("z"))
    return best.select(*keys, F.col("zone_bar").alias("bar_no"), "z.*")


def zone_distribution(zones: DataFrame) -> DataFrame:
    return zones.groupBy("bars_to_reversal").agg(
        F.count(F.lit(1)).alias("n"), F.avg("max_adverse_excursion").alias("avg_mae"), F.avg("potential_reward").alias("avg_reward"), F.avg("reward_risk_ratio").alias("avg_rr"),
        F.avg((F.col("zone_label") == 1).cast("int")).alias("pct_bull"), F.avg((F.col("zone_label") == -1).cast("int")).alias("pct_bear"))


# --- daily labels ---------------------------------------------------------------------------------

def forward_range_targets(daily: DataFrame, horizon: int, keys=("symbol",), day="day") -> DataFrame:
    """High and low moves from the previous close over ``horizon`` days from this one."""
    w = by(keys, day)
    f = w.rowsBetween(0, horizon - 1)
    pc = F.lag("close").over(w)
    hi, lo = safe_div(F.max("high").over(f) - pc, pc), safe_div(pc - F.min("low").over(f), pc)
    return daily.withColumns({"range_high_pct": hi, "range_low_pct": lo, "width_pct": hi + lo, "center_pct": (hi - lo) / 2})


def predicted_range_attach(bars: DataFrame, ranges: DataFrame, keys=DAY_KEYS) -> DataFrame:
    """Predicted low and high of the day on its bars, the width and the close's position."""
    df = bars.join(ranges, list(keys), "left")
    width = F.col("pred_high") - F.col("pred_low")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.withColumns({"pred_width": zero(width), "pred_pos": zero(safe_div(F.col("close") - F.col("pred_low"), width)), "pred_high": zero(F.col("pred_high")), "pred_low": zero(F.col("pred_low"))})


def first_of_week(ranges: DataFrame, keys=("symbol",), day: str = "trading_day") -> DataFrame:
    """The range predicted on a week's first row, for every day of that week that has one."""
    week = F.to_date(F.date_trunc("week", day))
    first = F.min_by(F.struct("pred_high", "pred_low"), day)
    return ranges.groupBy(*keys, week.alias("week")).agg(first.alias("_r")).select(*keys, "week", "_r.pred_high", "_r.pred_low")


def predicted_ranges_attach(bars: DataFrame, daily: DataFrame, weekly: DataFrame | None = None, rth: DataFrame | None = None, keys=("symbol",), day: str = "trading_day") -> DataFrame:
    """Predicted ranges of several horizons on the bars, each given as (keys, day, pred_high, pred_low).

    Adds pred_range_high, _low, _width, _pos with the suffix daily; width and position with the
    suffix weekly, from the prediction of the week's first row (``first_of_week``); and
    pred_rth_high, _low, _width. A bar without a prediction has zeros. The position in a range
    without width is 0 for the day and 0.5 for the week.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def attach(df, ranges, on):
        return df.join(ranges.select(*on, F.col("pred_high").alias("_high"), F.col("pred_low").alias("_low")), on, "left")

    high, low = F.col("_high"), F.col("_low")
    width, keys = high - low, list(keys)
    df = attach(bars, daily, [*keys, day])
    df = df.withColumns({"pred_range_high_daily": zero(high), "pred_range_low_daily": zero(low), "pred_range_width_daily": zero(width), "pred_range_pos_daily": zero(safe_div(F.col("close") - low, width))}).drop("_high", "_low")
    if weekly is not None:
        df = attach(df.withColumn("week", F.to_date(F.date_trunc("week", day))), first_of_week(weekly, keys, day), [*keys, "week"])
        pos = F.when(width > 0, (F.col("close") - low) / width).when(width.isNotNull(), 0.5)
        df = df.withColumns({"pred_range_width_weekly": zero(width), "pred_range_pos_weekly": zero(pos)}).drop("_high", "_low", "week")
    if rth is not None:
        df = attach(df, rth, [*keys, day])
        df = df.withColumns({"pred_rth_high": zero(high), "pred_rth_low": zero(low), "pred_rth_width": zero(width)}).drop("_high", "_low")
    return df


def swing_points(daily: DataFrame, lookback: int = 10, keys=("symbol",), day="day") -> DataFrame:
    """Highs and lows that are the extreme of ``lookback`` rows on both sides."""
    w = by(keys, day)
    f = w.rowsBetween(-lookback, lookback)
    full = F.count(F.lit(1)).over(f) == 2 * lookback + 1
    return daily.withColumns({"swing_high": (full & (F.col("high") == F.max("high").over(f))).cast("int"), "swing_low": (full & (F.col("low") == F.min("low").over(f))).cast("int")})


def macro_regime(daily: DataFrame, lookback: int = 10, keys=("symbol",), day="day") -> DataFrame:
    """2 for higher lows without lower highs, 0 for the opposite, else 1."""
    w = by(keys, day)
    df = swing_points(daily, lookback, keys, day)
    # the swing before the last one: carry each swing's predecessor along the series
    for c, src in (("high", "swing_high"), ("low", "swing_low")):
        at = F.when(F.col(src) == 1, F.col(c))
        df = df.withColumn(f"_p_{c}", F.when(F.col(src) == 1, F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
        r = w.rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({f"_c_{c}": F.last(at, ignorenulls=True).over(r), f"_n_{c}": F.sum(src).over(r)})
        df = df.withColumn(f"_p_{c}", F.last(f"_p_{c}", ignorenulls=True).over(r))
    enough = (F.col("_n_high") >= 2) & (F.col("_n_low") >= 2)
    higher_lows, lower_highs = F.col("_c_low") > F.col("_p_low"), F.col("_c_high") < F.col("_p_high")
    reg = F.when(enough & higher_lows & ~lower_highs, 2).when(enough & lower_highs & ~higher_lows, 0).otherwise(1)
    return df.withColumn("macro_regime", reg).drop(*[f"_{p}_{c}" for p in "pcn" for c in ("high", "low")])


def micro_regime(daily: DataFrame, threshold: float = 0.003, keys=("symbol",), day="day") -> DataFrame:
    """Next day's return as 2 up, 0 down, 1 between, -1 unknown."""
    nxt = safe_div(F.lead("close").over(by(keys, day)), "close") - 1
    return daily.withColumn("micro_regime", F.when(nxt.isNull(), -1).when(nxt > threshold, 2).when(nxt < -threshold, 0).otherwise(1))


def zigzag(daily: DataFrame, threshold: float = 0.05, keys=("symbol",), day="day", block_rows: int = scans.BLOCK) -> DataFrame:
    """Turning points where price has reversed by ``threshold``: kind peak or trough. After the
    first turn the walk resumes right behind it with the confirming row as its extreme. Runs as a
    scan over blocks (``scans.turning_points``)."""
    return scans.turning_points(daily, keys, F.year(day), day, "close", threshold, block_rows)


def pct_regime(daily: DataFrame, detect: float = 0.05, bull: float = 0.10, bear: float = 0.07, keys=("symbol",), day="day") -> DataFrame:
    """Days of zigzag segments above the bull or bear size: 2, 0, else 1. A turning day
    belongs to both segments and keeps the later strong one; the tail after the last turn is
    judged by the last close."""
    w = by(keys, "turn_no")
    turns = zigzag(daily, detect, keys, day)
    last = daily.groupBy(*keys).agg(F.max(day).alias("_ed"), F.max_by("close", day).alias("_ec"))
    turns = turns.withColumn("_n", F.count(F.lit(1)).over(whole(keys))).filter(F.col("_n") >= 2)
    seg = turns.withColumns({"_nd": F.lead(day).over(w), "_nc": F.lead("close").over(w)}).join(last, list(keys))
    tail = F.col("_nd").isNull()
    move = (F.coalesce("_nc", "_ec") - F.col("close")) / F.nullif(F.col("close"), F.lit(0.0))
    call = F.when((F.col("kind") == "trough") & (move > bull), 2).when((F.col("kind") == "peak") & (F.abs(move) > bear), 0).when(tail, 1)
    seg = seg.select(*keys, F.col(day).alias("_from"), F.coalesce("_nd", "_ed").alias("_to"), "turn_no", call.alias("_call")).filter(F.col("_call").isNotNull() & (F.col("_from") <= F.col("_to")))
    # a segment claims the days it covers, as (turn_no, call), through one row per day
    days = seg.select(*keys, F.explode(F.sequence("_from", "_to")).alias(day), F.struct("turn_no", "_call").alias("_s"))
    claimed = days.groupBy(*keys, day).agg(F.max("_s").alias("_s"))
    return daily.join(claimed, [*keys, day], "left").withColumn("pct_regime", F.coalesce(F.col("_s._call"), F.lit(1))).drop("_s")
