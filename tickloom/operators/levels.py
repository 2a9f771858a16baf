"""How price interacts with reference levels.

Level columns are wide and null while inactive. Ranking levels builds a small array of
structs per row, so nothing is exploded or shuffled; state along a level is a window over
(symbol, trading_day, level).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.windows import DAY_KEYS, by, clip, last_rows, running
from tickloom.operators.blocks import over_series

# Default level columns, in tie-breaking order, and their type strengths.
LEVELS = ("vwap", "ovn_lo", "ovn_hi", "rth_lo", "rth_hi", "prev_high", "prev_low")
STRENGTH = {"vwap": 3, "ovn_lo": 2, "ovn_hi": 2, "rth_lo": 2, "rth_hi": 2, "prev_high": 1, "prev_low": 1}

# Name prefixes of level families.
GROUPS = (("vwap", "vwap"), ("ovn_", "overnight"), ("rth_", "rth"), ("prev_", "prior_day"), ("prior_rth", "prior_rth"), ("ib_", "initial_balance"), ("or", "opening_range"))


def level_group(name: Column) -> Column:
    out = None
    for prefix, group in GROUPS:
        out = F.when(name.startswith(prefix), group) if out is None else out.when(name.startswith(prefix), group)
    return out.otherwise("other")


def level_array(levels, price: Column) -> Column:
    """Array of (dist, ord, name, price) of the active levels."""
    entries = [F.struct(F.abs(price - F.col(c)).alias("dist"), F.lit(i).alias("ord"), F.lit(c).alias("name"), F.col(c).alias("price")) for i, c in enumerate(levels)]
    return F.filter(F.array(*entries), lambda e: e["dist"].isNotNull())


def nearest_level(df: DataFrame, levels=LEVELS, proximity: float | None = 5.0) -> DataFrame:
    """Nearest level within ``proximity`` of the close; the first listed wins a tie."""
    best = F.array_min(level_array(levels, F.col("close")))
    df = df.withColumn("_best", best)
    if proximity is not None:
        df = df.withColumn("_best", F.when(F.col("_best.dist") <= proximity, F.col("_best")))
    return df.withColumns({"nearest_level": F.col("_best.name"), "level_price": F.col("_best.price"), "level_distance": F.col("_best.dist")}).drop("_best")


def level_side(df: DataFrame) -> DataFrame:
    """+1 at or above the nearest level, -1 below, 0 away from any."""
    side = F.when(F.col("level_price").isNull(), 0).when(F.col("close") >= F.col("level_price"), 1).otherwise(-1)
    return df.withColumn("side", side)


def level_side_hysteresis(df: DataFrame, hysteresis: float, flip_confirm: float | None = None, keys=DAY_KEYS) -> DataFrame:
    """Sticky side per day and level: it changes only once the close is ``flip_confirm``
    beyond the level, so the side is that of the last bar that far away, else of the first."""
    confirm = max(flip_confirm if flip_confirm is not None else hysteresis, hysteresis)
    if hysteresis <= 0:
        return level_side(df)
    w = by((*keys, "nearest_level"))
    dist = F.col("close") - F.col("level_price")
    setter = F.when(dist >= confirm, 1).when(dist <= -confirm, -1).when(F.row_number().over(w) == 1, F.when(dist >= 0, 1).otherwise(-1))
    df = df.withColumn("_set", F.when(F.col("level_price").isNotNull(), setter))
    return df.withColumn("side", F.coalesce(F.last("_set", ignorenulls=True).over(running(w)), F.lit(0))).drop("_set")


def level_confluence(df: DataFrame, levels=LEVELS, strength: dict = STRENGTH) -> DataFrame:
    """Distance to the nearest level per mille, other levels around it and its strength."""
    df = df.withColumn("_lv", level_array(levels, F.col("close"))).withColumn("_ref", F.array_min("_lv"))
    away = F.transform(F.filter("_lv", lambda e: e["ord"] != F.col("_ref.ord")), lambda e: F.abs(e["price"] - F.col("_ref.price")))
    df = df.withColumn("_away", F.when(F.col("_ref").isNotNull(), away).otherwise(F.array().cast("array<double>")))
    kind = F.coalesce(*[F.when(F.col("_ref.name") == k, F.lit(v)) for k, v in strength.items()], F.when(F.col("_ref").isNotNull(), F.lit(1)), F.lit(0))
    return df.withColumns({
        "level_distance_norm": F.col("_ref.dist") / F.greatest(F.col("close"), F.lit(1.0)) * 1000,
        "n_levels_within_3pt": F.size(F.filter("_away", lambda d: d <= 3.0)), "n_levels_within_5pt": F.size(F.filter("_away", lambda d: d <= 5.0)),
        "level_cluster_score": F.aggregate("_away", F.lit(0.0), lambda a, d: a + F.exp(-d / 2.0)), "level_type_strength": kind,
    }).drop("_lv", "_ref", "_away")


NEVER = 9999


def episode_state(df: DataFrame, density_bars: int = 30, keys=DAY_KEYS) -> DataFrame:
    """Touch, flip, reclaim and run features of near-level bars (side not 0).

    Touch features look at earlier bars only; a flip of side is known at its bar's close and
    closes the run before it.
    """
    near = df.filter((F.col("side") != 0) & F.col("nearest_level").isNotNull())
    wl, ws = by((*keys, "nearest_level"), "bar_no"), by((*keys, "nearest_level", "side"), "bar_no")
    prior = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    recent = lambda w: w.rangeBetween(-density_bars, -1)
    since = lambda w: F.coalesce(F.col("bar_no") - F.lag("bar_no").over(w), F.lit(NEVER))
    near = near.withColumns({
        "_pen": F.coalesce(F.abs(F.col("close") - F.col("level_price")), F.lit(0.0)),
        "_flip": F.coalesce((F.lag("side").over(wl) != F.col("side")).cast("int"), F.lit(0)),
        "level_side_touch_count_day": F.count("dt").over(prior(ws)), "bars_since_last_level_side_touch": since(ws),
        "level_side_touch_density_30": F.count("dt").over(recent(ws)),
        "level_touch_count_any_side_day": F.count("dt").over(prior(wl)), "bars_since_last_level_touch_any_side": since(wl),
        "level_touch_density_any_30": F.count("dt").over(recent(wl)),
    })
    near = near.withColumn("level_side_flip_count_day", F.sum("_flip").over(running(wl)))
    wr = by((*keys, "nearest_level", "level_side_flip_count_day"), "bar_no")
    near = near.withColumns({"_start": F.min("bar_no").over(running(wr)), "current_run_max_penetration_pts": F.max("_pen").over(running(wr))})
    hit = F.col("_flip") == 1
    near = near.withColumns({
        "current_run_bars": F.col("bar_no") - F.col("_start"), "is_reclaim_bar": F.col("_flip"),
        "_dwell": F.when(hit, F.col("bar_no") - F.lag("_start").over(wl)), "_rpen": F.when(hit, F.lag("current_run_max_penetration_pts").over(wl)),
        "_at": F.when(hit, F.col("bar_no")),
    })
    last = lambda c: F.last(c, ignorenulls=True).over(running(ws))
    near = near.withColumns({
        "level_reclaim_count_day": F.sum("_flip").over(running(ws)), "bars_since_last_reclaim": F.coalesce(F.col("bar_no") - last("_at"), F.lit(NEVER)),
        "last_reclaim_dwell_bars": F.coalesce(last("_dwell"), F.lit(0)), "last_reclaim_penetration_pts": F.coalesce(last("_rpen"), F.lit(0.0)),
    })
    return near.drop("_pen", "_flip", "_start", "_dwell", "_rpen", "_at")


def direction_stability(df: DataFrame, keys=DAY_KEYS) -> DataFrame:
    """Run length, flips and crosses in ten touches, stability and the share of the last
    five touches that moved with the side, along each (day, level)."""
    near = df.filter((F.col("side") != 0) & F.col("nearest_level").isNotNull())
    w = by((*keys, "nearest_level"), "bar_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sign = F.signum(F.col("close") - F.col("level_price"))
    near = near.withColumns({"_j": F.row_number().over(w), "_sg": F.when(sign != 0, sign),
                             "_flip": F.coalesce((F.lag("side").over(w) != F.col("side")).cast("int"), F.lit(0)),
                             "_good": ((F.col("close") - F.lag("close").over(w)) * F.col("side") > 0).cast("int")})
    near = near.withColumns({
        "_cross": F.coalesce((F.col("_sg") != F.last("_sg", ignorenulls=True).over(before)).cast("int"), F.lit(0)),
        "_last": F.last(F.when(F.col("_flip") == 1, F.col("_j")), ignorenulls=True).over(running(w)), "_good": F.coalesce("_good", F.lit(0)),
    })
    near = near.withColumns({
        "same_level_side_run_bars": F.col("_j") - F.coalesce("_last", F.lit(1)) + 1,
        "bars_since_same_level_side_flip": F.coalesce(F.col("_j") - F.col("_last"), F.col("_j")),
        "same_level_side_flip_count_10": F.sum("_flip").over(last_rows(w, 10)), "same_level_cross_count_10": F.sum("_cross").over(last_rows(w, 10)),
        "aligned_return_frac_5": F.avg("_good").over(last_rows(w, 5)),
    })
    near = near.withColumn("same_level_side_stability_10", 1.0 / (1.0 + F.col("same_level_side_flip_count_10") + F.col("same_level_cross_count_10")))
    return near.drop("_j", "_sg", "_flip", "_good", "_cross", "_last")


def level_encoding(df: DataFrame, levels=LEVELS, pct_b: str | None = None, **where) -> DataFrame:
    """One column per level name, support flag, its product with %B, and the approach
    direction from the five-bar change (+1 away from or through upward, -1 downward)."""
    df = df.withColumns({f"is_{c}": F.coalesce((F.col("nearest_level") == c).cast("int"), F.lit(0)) for c in levels})
    df = df.withColumn("level_is_support", (F.col("side") == 1).cast("int"))
    if pct_b:
        df = df.withColumn("level_side_bb_interaction", F.col("level_is_support") * F.col(pct_b))
    def columns(w):
        chg = F.col("close") - F.lag("close", 5).over(w)
        above = F.col("close") >= F.col("level_price")
        d = F.when(above, F.when(chg < 0, -1).otherwise(1)).otherwise(F.when(chg > 0, 1).otherwise(-1))
        return [{"approach_dir_vs_level": F.when(F.col("level_price").isNotNull() & chg.isNotNull(), d).otherwise(0)}]
    return over_series(df, columns, 5, **where)


def trailing_level_rate(labeled: DataFrame, days: DataFrame, levels=LEVELS, windows=(20, 50), keys=("symbol",), day: str = "trading_day") -> DataFrame:
    """Share of reversals among decided touches of a level over the last days, known before
    the day. ``labeled`` has nearest_level and outcome (1 reversal, 0 breakout); ``days`` is
    the trading calendar per symbol."""
    stats = labeled.filter(F.col("outcome").isin(0, 1)).groupBy(*keys, day, "nearest_level").agg(F.sum("outcome").alias("n_rev"), F.count("outcome").alias("n_total"))
    grid = days.select(*keys, day, F.explode(F.array(*[F.lit(x) for x in levels])).alias("nearest_level"))
    dense = grid.join(stats, [*keys, day, "nearest_level"], "left").fillna(0, subset=["n_rev", "n_total"])
    w = by((*keys, "nearest_level"), day)
    cols = {}
    for n in windows:
        f = last_rows(w, n)
        cols[f"_r{n}"] = F.sum("n_rev").over(f) / F.greatest(F.sum("n_total").over(f), F.lit(1))
    dense = dense.withColumns(cols)
    return dense.withColumns({f"rev_rate_{n}d": F.lag(f"_r{n}").over(w) for n in windows}).drop(*cols)


# --- triggers --------------------------------------------------------------------------------

def stack_levels(df: DataFrame, levels, keep) -> DataFrame:
    """Long rows (…, level, level_price) of the active levels."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in levels)
    return df.select(*keep, F.expr(f"stack({len(levels)}, {pairs}) AS (level, level_price)")).filter(F.col("level_price").isNotNull())


def breakout_triggers(df: DataFrame, levels=LEVELS, rth_only: bool = True, **where) -> DataFrame:
    """Closes that reach or cross a level from the other side of the previous close, which
    may lie in the previous session. An exact touch from a touching close fires both ways."""
    df = over_series(df, lambda w: [{"prev_close": F.lag("close").over(w)}], 1, **where)
    if rth_only:
        df = df.filter(F.col("ovn") == 0)
    long = stack_levels(df, levels, ["symbol", "trading_day", "dt", "bar_no", "close", "prev_close"])
    up = (F.col("prev_close") <= F.col("level_price")) & (F.col("close") >= F.col("level_price"))
    dn = (F.col("prev_close") >= F.col("level_price")) & (F.col("close") <= F.col("level_price"))
    sides = F.concat(F.when(up, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), F.when(dn, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))
    return long.withColumn("direction", F.explode(sides))


def reversion_triggers(df: DataFrame, levels=LEVELS, rth_only: bool = True) -> DataFrame:
    """Bars that open beyond a level, trade to it and close back: +1 held from above."""
    if rth_only:
        df = df.filter(F.col("ovn") == 0)
    long = stack_levels(df, levels, ["symbol", "trading_day", "dt", "bar_no", "open", "high", "low", "close"])
    lv = F.col("level_price")
    d = F.when((F.col("open") > lv) & (F.col("low") <= lv) & (F.col("close") > lv), 1).when((F.col("open") < lv) & (F.col("high") >= lv) & (F.col("close") < lv), -1)
    return long.withColumn("direction", d).filter(F.col("direction").isNotNull())


def retest_entries(triggers: DataFrame, bars: DataFrame, lookahead: int, threshold_pct: float, stop_buffer_pct: float, max_risk: float, rr: float,
                   **where) -> DataFrame:
    """First of the next bars to close back at the level, with stop and target. The bar's
    own forward array is joined to the trigger, so a trigger never multiplies."""
    path = F.struct("dt", "trading_day", "bar_no", "close")
    ahead = over_series(bars, lambda w: [{"_path": F.collect_list(path).over(w.rowsBetween(1, lookahead))}], 0, ahead=lookahead, **where)
    t = triggers.join(ahead.select("symbol", "dt", "_path"), ["symbol", "dt"])
    risk = F.least(stop_buffer_pct * F.col("level_price"), F.lit(float(max_risk)))
    thr = F.least(threshold_pct * F.col("level_price"), risk * 0.5)
    hits = F.filter("_path", lambda e: F.abs(e["close"] - F.col("level_price")) <= F.col("_thr"))
    t = t.withColumns({"risk": risk, "_thr": thr}).withColumn("_hit", F.try_element_at(hits, F.lit(1))).filter(F.col("_hit").isNotNull())
    d, px = F.col("direction"), F.col("_hit.close")
    return t.withColumns({"entry_ts": F.col("_hit.dt"), "entry_day": F.col("_hit.trading_day"), "entry_bar": F.col("_hit.bar_no"), "entry_price": px,
                          "stop": px - d * F.col("risk"), "target": px + d * rr * F.col("risk")}).drop("_path", "_thr", "_hit")


def touch_signals(htf: DataFrame, levels=LEVELS, **where) -> DataFrame:
    """Breakout and reversion triggers of coarse bars, one per (symbol, level, direction,
    time); a reversion wins over a breakout of the same key."""
    b = breakout_triggers(htf, levels, **where).select("symbol", "level", "direction", "dt", "level_price", F.lit("breakout").alias("kind"))
    r = reversion_triggers(htf, levels).select("symbol", "level", "direction", "dt", "level_price", F.lit("reversion").alias("kind"))
    return b.unionByName(r).groupBy("symbol", "level", "direction", "dt").agg(F.max("kind").alias("kind"), F.max("level_price").alias("level_price"))


def candidates_to_bars(sources: dict[str, DataFrame], bars: DataFrame, quality: str = "quality") -> DataFrame:
    """Candidates of several sources matched to bars by time and ranked per bar by quality."""
    out = None
    for name, df in sources.items():
        df = df.select("symbol", "dt", "direction", quality, F.lit(name).alias("source"))
        out = df if out is None else out.unionByName(df)
    j = out.join(bars.select("symbol", "trading_day", "dt", "bar_no", "close"), ["symbol", "dt"])
    return j.withColumn("rank", F.row_number().over(by(("symbol", "dt"), [F.col(quality).desc(), "source", "direction"])))


def trend_pullback_filter(df: DataFrame, min_trend: float, max_pullback: float, min_volume_z: float) -> DataFrame:
    """Bars in a trend (session trend strength) that have pulled back to VWAP on volume."""
    trend = F.col("session_trend_strength") * F.signum(F.col("dist_from_rth_open_pts"))
    pull = F.abs(F.col("close") - F.col("vwap")) / F.greatest(F.col("vwap"), F.lit(1e-6))
    return df.withColumns({"trend_proxy": trend, "pullback": pull}).filter(
        (F.abs("trend_proxy") >= min_trend) & (F.col("pullback") <= max_pullback) & (F.col("vol_z") >= min_volume_z))


def day_gate(df: DataFrame, features: dict[str, float], decision_minute: int, specs: dict[str, int], keys=DAY_KEYS) -> DataFrame:
    """Per day: maxima of features up to a decision minute against thresholds; a spec names
    how many must pass. Specs are a literal table of a few rows."""
    d = df.filter(F.col("minute") <= decision_minute).groupBy(*keys).agg(*[F.max(c).alias(c) for c in features])
    passed = sum((F.coalesce(F.col(c) >= v, F.lit(False)).cast("int") for c, v in features.items()), F.lit(0))
    spec = F.explode(F.array(*[F.struct(F.lit(n).alias("spec"), F.lit(k).alias("need")) for n, k in specs.items()]))
    return d.withColumn("n_passed", passed).withColumn("_s", spec).select(*keys, *features, "n_passed", F.col("_s.spec").alias("spec"),
                                                                          (F.col("n_passed") >= F.col("_s.need")).cast("int").alias("active"))
