"""Intraday window queries. SQL uses plain windows over the whole series; the plans cut the
same series into blocks of ``B`` rows; tests cut them smaller, so that several blocks exist there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.windows import by
from tickloom.operators import bars, daily, intraday as it
from tickloom.plans.adapters import BAR, DAY, with_
from tickloom.plans.catalog import query
from tickloom.plans.sqlkit import ema_sql, rsi_sql

B = 65536
W_DAY = "w AS (PARTITION BY symbol, trading_day ORDER BY dt ROWS UNBOUNDED PRECEDING)"
DAYP = "d AS (PARTITION BY symbol, trading_day)"
O4 = "((open + high + low + close) / 4)"

VWAP = f"""
vw0 AS (SELECT *, {O4} AS tp, sum({O4} * volume) OVER w / sum(volume) OVER w AS vwap FROM bar WINDOW {W_DAY}),
vw AS (SELECT *, greatest(sqrt(sum((tp - vwap) * (tp - vwap)) OVER w / count(*) OVER w), 1e-6) AS vwap_std FROM vw0 WINDOW {W_DAY})"""


@query("vwap_running", "symbol dt:t vwap:f vwap_std:f vwap_z:f4", with_(BAR, VWAP) + "SELECT symbol, dt, vwap, vwap_std, CASE WHEN bar_no > 1 THEN (close - vwap) / vwap_std END AS vwap_z FROM vw")
def _(t):
    return it.vwap_running(t.bar()).withColumn("vwap_z", F.when(F.col("bar_no") > 1, F.col("vwap_z")))


@query("vwap_sigma_bands", "symbol dt:t vwap_up_1s:f vwap_dn_1s:f vwap_up_15s:f vwap_dn_15s:f vwap_up_2s:f vwap_dn_2s:f", with_(BAR, VWAP) + f"""
, s AS (SELECT symbol, dt, vwap, CASE WHEN count(*) OVER w >= 10 THEN stddev_samp(tp - vwap) OVER w END AS sg FROM vw WINDOW {W_DAY})
SELECT symbol, dt, vwap + sg AS vwap_up_1s, vwap - sg AS vwap_dn_1s, vwap + 1.5 * sg AS vwap_up_15s, vwap - 1.5 * sg AS vwap_dn_15s,
  vwap + 2 * sg AS vwap_up_2s, vwap - 2 * sg AS vwap_dn_2s FROM s""")
def _(t):
    return it.vwap_sigma_bands(t.bar())


@query("zscore_rolling", "symbol dt:t close_z20:f", with_(BAR) + """
SELECT symbol, dt, CASE WHEN count(*) OVER f >= 20 THEN (close - avg(close) OVER f) / stddev_samp(close) OVER f END AS close_z20
FROM bar WINDOW f AS (PARTITION BY symbol, trading_day ORDER BY dt ROWS 19 PRECEDING)""")
def _(t):
    return it.zscore_rolling(t.bar())


@query("volume_z", "symbol dt:t vol_z:f", with_(BAR) + """
SELECT symbol, dt, (volume - avg(volume) OVER f) / (stddev_samp(volume) OVER f + 1e-6) AS vol_z
FROM bar WINDOW f AS (PARTITION BY symbol, trading_day ORDER BY dt ROWS 19 PRECEDING)""")
def _(t):
    return it.volume_z(t.bar())


@query("ofi_z", "symbol dt:t ofi:f ofi_z:f", with_(BAR) + """
, o AS (SELECT *, coalesce((askvolume - bidvolume) / nullif(askvolume + bidvolume, 0), 0) AS ofi FROM bar)
SELECT symbol, dt, ofi, coalesce(CASE WHEN count(*) OVER f >= 20 THEN (ofi - avg(ofi) OVER f) / (nullif(stddev_samp(ofi) OVER f, 0) + 1e-6) END, 0) AS ofi_z
FROM o WINDOW f AS (PARTITION BY symbol, trading_day ORDER BY dt ROWS 19 PRECEDING)""")
def _(t):
    return it.ofi_z(t.bar(), 20)


LEVELS = f"""
lv AS (SELECT *, max(CASE WHEN ovn = 1 THEN high END) OVER w AS ovn_hi, min(CASE WHEN ovn = 1 THEN low END) OVER w AS ovn_lo,
  CASE WHEN minute BETWEEN 450 AND 779 THEN max(high) FILTER (minute BETWEEN 390 AND 450) OVER d END AS ib_hi,
  CASE WHEN minute BETWEEN 450 AND 779 THEN min(low) FILTER (minute BETWEEN 390 AND 450) OVER d END AS ib_lo,
  CASE WHEN minute BETWEEN 420 AND 779 THEN max(high) FILTER (minute BETWEEN 390 AND 779) OVER w END AS rth_hi,
  CASE WHEN minute BETWEEN 420 AND 779 THEN min(low) FILTER (minute BETWEEN 390 AND 779) OVER w END AS rth_lo FROM vw WINDOW {W_DAY}, {DAYP})"""


@query("overnight_running_levels", "symbol dt:t ovn_hi:f ovn_lo:f ovn_hi_z:f4 ovn_lo_z:f4", with_(BAR, VWAP, LEVELS) + """
SELECT symbol, dt, ovn_hi, ovn_lo, CASE WHEN bar_no > 1 THEN (ovn_hi - close) / vwap_std END AS ovn_hi_z,
  CASE WHEN bar_no > 1 THEN (close - ovn_lo) / vwap_std END AS ovn_lo_z FROM lv""")
def _(t):
    df = it.price_levels(t.bar())
    return df.withColumns({c: F.when(F.col("bar_no") > 1, F.col(c)) for c in ("ovn_hi_z", "ovn_lo_z")})


@query("initial_balance_levels", "symbol dt:t ib_hi:f ib_lo:f ib_hi_z:f ib_lo_z:f", with_(BAR, VWAP, LEVELS) + """
SELECT symbol, dt, ib_hi, ib_lo, (ib_hi - close) / vwap_std AS ib_hi_z, (close - ib_lo) / vwap_std AS ib_lo_z FROM lv""")
def _(t):
    return it.price_levels(t.bar())


@query("rth_running_levels", "symbol dt:t rth_hi:f rth_lo:f", with_(BAR, VWAP, LEVELS) + "SELECT symbol, dt, rth_hi, rth_lo FROM lv")
def _(t):
    return it.rth_running_levels(t.bar())


PREV = """
pd AS (SELECT symbol, trading_day, max(high) AS dh, min(low) AS dl, arg_max(close, dt) AS dc, arg_min(open, dt) AS dop FROM bar GROUP BY 1, 2),
prev AS (SELECT symbol, trading_day, lag(dh) OVER w AS prev_high, lag(dl) OVER w AS prev_low, lag(dc) OVER w AS pc FROM pd WINDOW w AS (PARTITION BY symbol ORDER BY trading_day))"""


@query("prev_day_levels", "symbol dt:t prev_high:f prev_low:f prev_mid:f", with_(BAR, PREV) + """
SELECT symbol, dt, prev_high, prev_low, (prev_high + prev_low) / 2 AS prev_mid FROM bar JOIN prev USING (symbol, trading_day)""")
def _(t):
    return it.prev_day_levels(t.bar())


@query("prior_rth_open_close", "symbol dt:t prior_rth_open:f prior_rth_close:f", with_(BAR) + """
, r AS (SELECT symbol, trading_day, arg_min(open, dt) AS o, arg_max(close, dt) AS c FROM bar WHERE minute BETWEEN 390 AND 779 GROUP BY 1, 2),
p AS (SELECT symbol, trading_day, lag(o) OVER w AS prior_rth_open, lag(c) OVER w AS prior_rth_close FROM r WINDOW w AS (PARTITION BY symbol ORDER BY trading_day))
SELECT symbol, dt, prior_rth_open, prior_rth_close FROM bar LEFT JOIN p USING (symbol, trading_day)""")
def _(t):
    return it.prior_rth_open_close(t.bar())


@query("opening_range_levels", "symbol dt:t or15_hi:f or15_lo:f or15_mid:f or30_hi:f or30_lo:f or30_mid:f", with_(BAR) + f"""
, o AS (SELECT symbol, dt, minute, max(high) FILTER (minute BETWEEN 390 AND 404) OVER d AS a, min(low) FILTER (minute BETWEEN 390 AND 404) OVER d AS b,
  max(high) FILTER (minute BETWEEN 390 AND 419) OVER d AS e, min(low) FILTER (minute BETWEEN 390 AND 419) OVER d AS f FROM bar WINDOW {DAYP})
SELECT symbol, dt, CASE WHEN minute >= 405 THEN a END AS or15_hi, CASE WHEN minute >= 405 THEN b END AS or15_lo, CASE WHEN minute >= 405 THEN (a + b) / 2 END AS or15_mid,
  CASE WHEN minute >= 420 THEN e END AS or30_hi, CASE WHEN minute >= 420 THEN f END AS or30_lo, CASE WHEN minute >= 420 THEN (e + f) / 2 END AS or30_mid FROM o""")
def _(t):
    return it.opening_range_levels(t.bar(), (15, 30))


@query("ib_extensions", "symbol dt:t ib_mid:f ib_hi_ext_025:f ib_hi_ext_050:f ib_hi_ext_100:f ib_lo_ext_025:f ib_lo_ext_050:f ib_lo_ext_100:f",
       with_(BAR, VWAP, LEVELS) + """
, x AS (SELECT symbol, dt, ib_hi, ib_lo, CASE WHEN minute >= 450 AND ib_hi > ib_lo THEN ib_hi - ib_lo END AS r FROM lv)
SELECT symbol, dt, CASE WHEN r IS NOT NULL THEN (ib_hi + ib_lo) / 2 END AS ib_mid, ib_hi + .25 * r AS ib_hi_ext_025, ib_hi + .5 * r AS ib_hi_ext_050,
  ib_hi + r AS ib_hi_ext_100, ib_lo - .25 * r AS ib_lo_ext_025, ib_lo - .5 * r AS ib_lo_ext_050, ib_lo - r AS ib_lo_ext_100 FROM x""")
def _(t):
    return it.ib_extensions(t.bar())


ATR = """
tr AS (SELECT symbol, trading_day AS day, dh - dl AS rng, greatest(dh - dl, abs(dh - lag(dc) OVER w), abs(dl - lag(dc) OVER w)) AS x FROM pd WINDOW w AS (PARTITION BY symbol ORDER BY trading_day)),
""" + ema_sql("atr0", "tr", "x", 5, 5) + """,
atr AS (SELECT symbol, day AS trading_day, lag(coalesce(ema, x)) OVER (PARTITION BY symbol ORDER BY day) AS atr FROM atr0)"""


def prior_atr(t, span=5):
    """ATR of the day before, per (symbol, trading_day)."""
    d = bars.daily_bars(t.bar()).withColumnRenamed("trading_day", "day")
    a = daily.atr(d, span)
    return a.select("symbol", F.col("day").alias("trading_day"), F.lag(f"atr_{span}").over(by(("symbol",), "day")).alias("atr"))


@query("session_position", "symbol dt:t gap_from_prev_close_pts:f gap_from_prev_close_atr:f overnight_range_pts:f overnight_open_loc:f or15_range_pts:f or15_close_pos:f "
       "day_progress_norm:f dist_from_rth_open_pts:f dist_from_rth_open_in_rth_range:f dist_from_vwap_pts:f session_trend_strength:f",
       with_(BAR, VWAP, PREV, ATR) + f"""
, b AS (SELECT v.*, p.pc, a.atr, first_value(open) OVER w AS o0, max((minute >= 390)::INT) OVER w AS on_, max(high) FILTER (minute < 390) OVER d AS oh,
  min(low) FILTER (minute < 390) OVER d AS ol, max(high) FILTER (minute < 390) OVER w AS ohr, min(low) FILTER (minute < 390) OVER w AS olr,
  max(high) FILTER (minute BETWEEN 390 AND 404) OVER d AS h15, min(low) FILTER (minute BETWEEN 390 AND 404) OVER d AS l15
  FROM vw v JOIN prev p USING (symbol, trading_day) LEFT JOIN atr a USING (symbol, trading_day) WINDOW {W_DAY}, {DAYP}),
g AS (SELECT symbol, trading_day, arg_min(open, dt) FILTER (minute >= 390) AS ro, arg_max(close, dt) FILTER (minute BETWEEN 390 AND 404) AS c15 FROM bar GROUP BY 1, 2),
c AS (SELECT b.*, g.ro, g.c15, max(high) FILTER (on_ = 1) OVER w AS rh, min(low) FILTER (on_ = 1) OVER w AS rl FROM b JOIN g USING (symbol, trading_day) WINDOW {W_DAY})
SELECT symbol, dt, coalesce(o0 - pc, 0) AS gap_from_prev_close_pts, coalesce(CASE WHEN atr > 0 THEN (o0 - pc) / atr END, 0) AS gap_from_prev_close_atr,
  CASE WHEN on_ = 1 AND oh IS NOT NULL THEN oh - ol ELSE coalesce(CASE WHEN minute < 390 THEN ohr - olr END, 0) END AS overnight_range_pts,
  CASE WHEN on_ = 1 THEN coalesce((ro - ol) / greatest(oh - ol, 0.25), 0.5) ELSE 0 END AS overnight_open_loc,
  CASE WHEN minute >= 405 AND h15 IS NOT NULL THEN h15 - l15 ELSE 0 END AS or15_range_pts,
  CASE WHEN minute >= 405 AND h15 IS NOT NULL THEN (c15 - l15) / greatest(h15 - l15, 0.25) ELSE 0 END AS or15_close_pos,
  CASE WHEN minute >= 390 THEN least((minute - 390) / 390.0::DOUBLE, 1) ELSE 0 END AS day_progress_norm,
  CASE WHEN on_ = 1 THEN close - ro ELSE 0 END AS dist_from_rth_open_pts, CASE WHEN on_ = 1 THEN (close - ro) / greatest(rh - rl, .25) ELSE 0 END AS dist_from_rth_open_in_rth_range,
  CASE WHEN on_ = 1 THEN close - vwap ELSE 0 END AS dist_from_vwap_pts, CASE WHEN on_ = 1 THEN abs(close - ro) / greatest(rh - rl, .25) ELSE 0 END AS session_trend_strength FROM c""")
def _(t):
    return it.session_position(t.bar(), prior_atr(t))


@query("opening_drive_regime", "symbol dt:t opening_drive_regime_dir:i opening_drive_net_pts:f opening_drive_frac:f", with_(BAR) + """
, d AS (SELECT symbol, trading_day, arg_max(close, dt) - arg_min(open, dt) AS net, greatest(max(high) - min(low), .25) AS rng, arg_max(close, dt) - min(low) AS up
  FROM bar WHERE minute BETWEEN 390 AND 419 GROUP BY 1, 2)
SELECT symbol, dt, CASE WHEN minute >= 420 AND abs(net) >= 8 AND abs(net) / rng >= .55 THEN CASE WHEN net > 0 AND up / rng >= .7 THEN 1 WHEN net < 0 AND up / rng <= .3 THEN -1 ELSE 0 END ELSE 0 END AS opening_drive_regime_dir,
  CASE WHEN minute >= 420 AND net IS NOT NULL THEN net ELSE 0 END AS opening_drive_net_pts, CASE WHEN minute >= 420 AND net IS NOT NULL THEN abs(net) / rng ELSE 0 END AS opening_drive_frac
FROM bar LEFT JOIN d USING (symbol, trading_day)""")
def _(t):
    return it.opening_drive_regime(t.bar())


@query("gap_filled", "symbol dt:t gap_filled:i", with_(BAR, PREV) + f"""
, b AS (SELECT bar.*, pc, first_value(open) OVER w AS o0, min(low) OVER w AS lo, max(high) OVER w AS hi FROM bar JOIN prev USING (symbol, trading_day) WINDOW {W_DAY})
SELECT symbol, dt, CASE WHEN pc IS NULL OR abs(o0 - pc) < 0.5 THEN 0 WHEN o0 > pc THEN (lo <= pc)::INT ELSE (hi >= pc)::INT END AS gap_filled FROM b""")
def _(t):
    return it.gap_filled(t.bar())


@query("bollinger", "symbol dt:t bb_pct_b:f bb_width:f bb_upper_dist:f bb_lower_dist:f bb_width_z:f", with_(BAR) + """
, s AS (SELECT symbol, dt, close, avg(close) OVER f AS m, stddev_samp(close) OVER f AS sd FROM bar WINDOW f AS (PARTITION BY symbol ORDER BY dt ROWS 19 PRECEDING)),
b AS (SELECT *, coalesce((close - (m - 2 * sd)) / nullif(4 * sd, 0), .5) AS bb_pct_b, coalesce(((m + 2 * sd) - (m - 2 * sd)) / nullif(m, 0), 0) AS bb_width,
  coalesce((m + 2 * sd - close) / nullif(4 * sd, 0), 0) AS bb_upper_dist, coalesce((close - (m - 2 * sd)) / nullif(4 * sd, 0), 0) AS bb_lower_dist FROM s)
SELECT symbol, dt, bb_pct_b, bb_width, bb_upper_dist, bb_lower_dist, coalesce((bb_width - avg(bb_width) OVER g) / nullif(stddev_samp(bb_width) OVER g, 0), 0) AS bb_width_z
FROM b WINDOW g AS (PARTITION BY symbol ORDER BY dt ROWS 59 PRECEDING)""")
def _(t):
    return it.bollinger(t.bar(), block_rows=B)


RUNR = f"rr AS (SELECT *, max(high) OVER w - min(low) OVER w AS running_range, first_value(close) OVER w AS c0 FROM bar WINDOW {W_DAY})"


@query("range_exhaustion", "symbol dt:t range_pct_of_atr:f range_pct_of_prior_range:f distance_from_open_atr:f remaining_atr_pct:f", with_(BAR, PREV, ATR, RUNR) + """
SELECT symbol, dt, coalesce(running_range / nullif(atr, 0), 0) AS range_pct_of_atr, coalesce(running_range / nullif(prev_high - prev_low, 0), 0) AS range_pct_of_prior_range,
  coalesce(abs(close - c0) / nullif(atr, 0), 0) AS distance_from_open_atr, coalesce(greatest(nullif(atr, 0) - running_range, CASE WHEN atr <> 0 THEN 0 END) / nullif(atr, 0), 1) AS remaining_atr_pct
FROM rr JOIN prev USING (symbol, trading_day) LEFT JOIN atr USING (symbol, trading_day)""")
def _(t):
    return it.range_exhaustion(t.bar(), prior_atr(t))


@query("range_percentile_prior20", "symbol dt:t running_range:f session_range_percentile:f", with_(BAR, RUNR) + """
, d AS (SELECT symbol, trading_day, max(high) - min(low) AS rng FROM bar GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trading_day) AS rn FROM d WHERE rng > 0),
h AS (SELECT d.symbol, d.trading_day, (SELECT list(x.rng) FROM (SELECT p.rng FROM p WHERE p.symbol = d.symbol AND p.trading_day < d.trading_day ORDER BY p.trading_day DESC LIMIT 20) x) AS hist FROM d)
SELECT symbol, dt, running_range, CASE WHEN len(hist) > 0 THEN len(list_filter(hist, lambda x: x <= running_range)) / len(hist) ELSE .5 END AS session_range_percentile
FROM rr JOIN h USING (symbol, trading_day)""")
def _(t):
    return it.range_percentile_prior(t.bar())


@query("session_range_rank", "symbol day:d day_range:f session_range_rank:f", with_(DAY) + """
, r AS (SELECT symbol, day, high - low AS day_range, row_number() OVER (PARTITION BY symbol ORDER BY day) AS rn FROM day)
SELECT a.symbol, a.day, a.day_range, avg((b.day_range <= a.day_range)::INT) AS session_range_rank FROM r a JOIN r b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 19 AND a.rn GROUP BY 1, 2, 3""")
def _(t):
    return it.session_range_rank(t.day())


@query("bars_since_extreme", "symbol dt:t bars_since_session_extreme:i", with_(BAR) + """
, p AS (SELECT *, max(high) OVER b AS ph, min(low) OVER b AS pl FROM bar WINDOW b AS (PARTITION BY symbol, trading_day ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT symbol, dt, bar_no - max(CASE WHEN ph IS NULL OR high >= ph OR low <= pl THEN bar_no END) OVER (PARTITION BY symbol, trading_day ORDER BY dt ROWS UNBOUNDED PRECEDING) AS bars_since_session_extreme FROM p""")
def _(t):
    return it.bars_since_extreme(t.bar())


@query("approach_velocity", "symbol dt:t approach_velocity_10bar:f approach_deceleration:f", with_(BAR) + """
, l AS (SELECT symbol, dt, close, lag(close, 5) OVER w AS c5, lag(close, 10) OVER w AS c10 FROM bar WINDOW w AS (PARTITION BY symbol ORDER BY dt))
SELECT symbol, dt, greatest(least(coalesce(close - c10, 0) / 10, 3), -3) AS approach_velocity_10bar,
  greatest(least(coalesce(close - c5, 0) / 5 - coalesce(c5 - c10, 0) / 5, 3), -3) AS approach_deceleration FROM l""")
def _(t):
    return it.approach_velocity(t.bar(), block_rows=B)


@query("candle_quality", "symbol dt:t wick_to_body_ratio:f rejection_wick_pct:f close_position:f bar_momentum:f bar_range_z:f rejection_penetration:f", with_(BAR, VWAP) + """
, c AS (SELECT *, greatest(high - low, .01) AS r, greatest(abs(close - open), .01) AS body, greatest(CASE WHEN close >= open THEN open - low ELSE high - open END, 0) AS wick FROM vw)
SELECT symbol, dt, wick / body AS wick_to_body_ratio, wick / r AS rejection_wick_pct, (close - low) / r AS close_position, (close - open) / r AS bar_momentum,
  (r - avg(r) OVER f) / coalesce(nullif(stddev_samp(r) OVER f, 0), .01) AS bar_range_z,
  CASE WHEN close >= open THEN greatest(vwap - low, 0) ELSE greatest(high - vwap, 0) END / greatest(vwap * .001, .01) AS rejection_penetration
FROM c WINDOW f AS (PARTITION BY symbol ORDER BY dt ROWS 19 PRECEDING)""")
def _(t):
    return it.candle_quality(it.vwap_running(t.bar()), level=F.col("vwap"), block_rows=B)


@query("bars_since_open", "symbol dt:t bars_since_rth_open:i", with_(BAR) + f"""
SELECT symbol, dt, CASE WHEN ovn = 0 THEN sum((ovn = 0)::INT) OVER w - 1 ELSE 0 END AS bars_since_rth_open FROM bar WINDOW {W_DAY}""")
def _(t):
    return it.bars_since_open(t.bar())


@query("level_touch_count", "symbol dt:t level_touch_count:i", with_(BAR, VWAP) + """
, c AS (SELECT symbol, dt, (low BETWEEN vwap * .95 AND vwap * 1.05 OR high BETWEEN vwap * .95 AND vwap * 1.05)::INT AS hit FROM (SELECT symbol, dt, low, high, vwap FROM vw))
SELECT symbol, dt, sum(hit) OVER (PARTITION BY symbol ORDER BY dt ROWS 49 PRECEDING) AS level_touch_count FROM c""")
def _(t):
    return it.level_touch_count(it.vwap_running(t.bar()), "vwap", 50, 0.05, block_rows=B)


WB = "wb AS (SELECT *, greatest(high - low, .01) AS r, greatest(CASE WHEN close >= open THEN open - low ELSE high - open END, 0) / greatest(abs(close - open), .01) AS wb, (close - open) / greatest(high - low, .01) AS mom FROM bar)"


@query("rejection_counts", "symbol dt:t rejection_bar_count_3:i rejection_bar_count_5:i max_wick_ratio_3bar:f bar_momentum_reversal:i rejection_momentum:f", with_(BAR, WB) + """
, a AS (SELECT symbol, dt, mom, lag(mom) OVER w AS pm, sum((wb > .5)::INT) OVER f3 AS rejection_bar_count_3, sum((wb > .5)::INT) OVER f5 AS rejection_bar_count_5, max(wb) OVER f3 AS max_wick_ratio_3bar, avg(wb) OVER f3 AS w3
 FROM wb WINDOW w AS (PARTITION BY symbol ORDER BY dt), f3 AS (PARTITION BY symbol ORDER BY dt ROWS 2 PRECEDING), f5 AS (PARTITION BY symbol ORDER BY dt ROWS 4 PRECEDING))
SELECT *, (mom * coalesce(pm, 0) < 0)::INT AS bar_momentum_reversal, greatest(least(w3 - coalesce(lag(w3, 3) OVER (PARTITION BY symbol ORDER BY dt), 0), 3), -3) AS rejection_momentum FROM a""")
def _(t):
    return it.rejection_counts(t.bar(), block_rows=B)


@query("rolling_slope_norm", "symbol dt:t vol_trend_into_level:f bar_size_trend_into_level:f", with_(BAR) + """
, x AS (SELECT symbol, dt, volume AS v, greatest(high - low, .01) AS r, row_number() OVER (PARTITION BY symbol ORDER BY dt)::DOUBLE AS rn FROM bar),
y AS (SELECT *, count(*) OVER f AS n, regr_slope(v, rn) OVER f AS sv, avg(v) OVER f AS mv, regr_slope(r, rn) OVER f AS sr, avg(r) OVER f AS mr FROM x
 WINDOW f AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT symbol, dt, CASE WHEN n >= 10 THEN greatest(least(sv / greatest(abs(mv), 1e-6), 3), -3) ELSE 0 END AS vol_trend_into_level,
 CASE WHEN n >= 10 THEN greatest(least(sr / greatest(abs(mr), 1e-6), 3), -3) ELSE 0 END AS bar_size_trend_into_level FROM y""")
def _(t):
    return it.rolling_slope_norm(t.bar(), {"vol_trend_into_level": "volume", "bar_size_trend_into_level": it.bar_range()}, block_rows=B)


@query("consecutive_same_dir", "symbol dt:t consecutive_same_dir:i", with_(BAR) + """
, s AS (SELECT symbol, dt, coalesce(sign(close - lag(close) OVER w), 0) AS sg, row_number() OVER w AS rn FROM bar WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
b AS (SELECT *, CASE WHEN sg = 0 OR sg <> coalesce(lag(sg) OVER (PARTITION BY symbol ORDER BY dt), 0) THEN rn END AS brk FROM s)
SELECT symbol, dt, rn - max(brk) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) AS consecutive_same_dir FROM b""")
def _(t):
    return it.consecutive_same_dir(t.bar(), block_rows=B)


@query("cum_delta_z", "symbol dt:t approach_cum_delta_z:f z_day:f", with_(BAR) + """
, c AS (SELECT symbol, dt, trading_day, sum(bidvolume - askvolume) OVER f AS a, sum(bidvolume - askvolume) OVER g AS b FROM bar
 WINDOW f AS (PARTITION BY symbol ORDER BY dt ROWS 9 PRECEDING), g AS (PARTITION BY symbol, trading_day ORDER BY dt ROWS 9 PRECEDING))
SELECT symbol, dt, greatest(least(coalesce((a - avg(a) OVER f) / coalesce(nullif(stddev_samp(a) OVER f, 0), 1), 0), 5), -5) AS approach_cum_delta_z,
 greatest(least(coalesce((b - avg(b) OVER g) / coalesce(nullif(stddev_samp(b) OVER g, 0), 1), 0), 5), -5) AS z_day
FROM c WINDOW f AS (PARTITION BY symbol ORDER BY dt ROWS 49 PRECEDING), g AS (PARTITION BY symbol, trading_day ORDER BY dt ROWS 49 PRECEDING)""")
def _(t):
    df = it.cum_delta_z(t.bar(), reset_daily=True).withColumnRenamed("approach_cum_delta_z", "z_day")
    return it.cum_delta_z(df, block_rows=B)


@query("temporal_interactions", "symbol dt:t wick_delta_interaction:f wick_volume_interaction:f vol_exhaustion_ratio:f delta_exhaustion:f delta_momentum_3bar:f delta_reversal_signal:f "
       "session_vol_ratio:f mae_estimate:f level_test_sequence:i bars_to_nearest_level:f tod_volatility_interaction:f", with_(BAR, VWAP) + """
, w0 AS (SELECT *, greatest(high - low, .01) AS r, greatest(CASE WHEN close >= open THEN open - low ELSE high - open END, 0) / greatest(abs(close - open), .01) AS wb,
  ((close - low) / greatest(high - low, .01) - .5) * volume AS delta, (low BETWEEN vwap * .999 AND vwap * 1.001 OR high BETWEEN vwap * .999 AND vwap * 1.001)::INT AS hit,
  avg(volume) OVER (PARTITION BY symbol, trading_day ORDER BY dt ROWS UNBOUNDED PRECEDING) AS cavg,
  CASE WHEN ovn = 0 THEN sum((ovn = 0)::INT) OVER (PARTITION BY symbol, trading_day ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 ELSE 0 END AS bso FROM vw),
w1 AS (SELECT *, (delta * coalesce(lag(delta) OVER w, 0) < 0)::INT::DOUBLE AS flip, (volume - avg(volume) OVER f20) / coalesce(nullif(stddev_samp(volume) OVER f20, 0), 1) AS vz,
  coalesce(avg(volume) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), volume) AS into_, sum(delta) OVER f10 AS cd, coalesce(close - lag(close, 10) OVER w, 0) AS pt,
  sum(delta) OVER f3 AS d3, avg(r) OVER (PARTITION BY symbol ORDER BY dt ROWS 13 PRECEDING) AS atr, max(r) OVER (PARTITION BY symbol ORDER BY dt ROWS 4 PRECEDING) / nullif(close, 0) * 100 AS mae_estimate,
  sum(hit) OVER f10 AS level_test_sequence FROM w0 WINDOW w AS (PARTITION BY symbol ORDER BY dt), f20 AS (PARTITION BY symbol ORDER BY dt ROWS 19 PRECEDING),
  f10 AS (PARTITION BY symbol ORDER BY dt ROWS 9 PRECEDING), f3 AS (PARTITION BY symbol ORDER BY dt ROWS 2 PRECEDING)),
w2 AS (SELECT *, (cd - avg(cd) OVER f50) / coalesce(nullif(stddev_samp(cd) OVER f50, 0), 1) AS zc, (pt - avg(pt) OVER f50) / coalesce(nullif(stddev_samp(pt) OVER f50, 0), 1) AS zp,
  coalesce(lag(d3) OVER (PARTITION BY symbol ORDER BY dt), 0) AS d3p, (atr - avg(atr) OVER (PARTITION BY symbol)) / (stddev_pop(atr) OVER (PARTITION BY symbol) + 1e-6) AS az
  FROM w1 WINDOW f50 AS (PARTITION BY symbol ORDER BY dt ROWS 49 PRECEDING))
SELECT symbol, dt, wb * flip AS wick_delta_interaction, wb * greatest(least(vz, 3), -3) AS wick_volume_interaction, greatest(least(volume / greatest(into_, 1), 5), 0) AS vol_exhaustion_ratio,
  greatest(least(zc - zp * sign(cd), 5), -5) AS delta_exhaustion, greatest(least((d3 - d3p) / greatest(abs(d3p), 1), 5), -5) AS delta_momentum_3bar, flip AS delta_reversal_signal,
  greatest(least(volume / greatest(cavg, 1), 5), 0) AS session_vol_ratio, mae_estimate, level_test_sequence, abs(close - vwap) / nullif(close, 0) * 10000 AS bars_to_nearest_level,
  bso / 390::DOUBLE * greatest(least(az, 3), -3) AS tod_volatility_interaction FROM w2""")
def _(t):
    return it.temporal_interactions(it.vwap_running(t.bar()), ["vwap"], block_rows=B)


@query("level_stability", "symbol dt:t rth_hi_age_bars:i rth_lo_age_bars:i rth_hi_updates_30:i rth_lo_updates_30:i rth_level_firmness:f", with_(BAR, VWAP, LEVELS) + f"""
, a AS (SELECT symbol, trading_day, dt, bar_no, rth_hi IS NOT NULL AS ok, rth_hi, rth_lo, lag(rth_hi) OVER w AS ph, lag(rth_lo) OVER w AS pl,
  last_value(rth_hi IGNORE NULLS) OVER b AS vh, last_value(rth_lo IGNORE NULLS) OVER b AS vl FROM lv WINDOW w AS (PARTITION BY symbol, trading_day ORDER BY dt),
  b AS (PARTITION BY symbol, trading_day ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CASE WHEN ok AND (vh IS NULL OR abs(rth_hi - vh) > 1e-9) THEN bar_no END AS sh, CASE WHEN ok AND (vl IS NULL OR abs(rth_lo - vl) > 1e-9) THEN bar_no END AS sl,
  coalesce((abs(rth_hi - ph) > 1e-9)::INT, 0) AS uh, coalesce((abs(rth_lo - pl) > 1e-9)::INT, 0) AS ul FROM a),
e AS (SELECT *, CASE WHEN ok THEN bar_no - max(sh) OVER w ELSE 0 END AS rth_hi_age_bars, CASE WHEN ok THEN bar_no - max(sl) OVER w ELSE 0 END AS rth_lo_age_bars, sum(uh) OVER f AS rth_hi_updates_30,
  sum(ul) OVER f AS rth_lo_updates_30, bool_or(ok) OVER (PARTITION BY symbol, trading_day) AS any_ FROM c WINDOW {W_DAY}, f AS (PARTITION BY symbol, trading_day ORDER BY dt ROWS 29 PRECEDING))
SELECT symbol, dt, rth_hi_age_bars, rth_lo_age_bars, rth_hi_updates_30, rth_lo_updates_30, CASE WHEN any_ THEN 1.0::DOUBLE / (1 + rth_hi_updates_30 + rth_lo_updates_30) ELSE 0 END AS rth_level_firmness FROM e""")
def _(t):
    return it.level_stability(it.rth_running_levels(t.bar()))


@query("sequence_features", "symbol dt:t seq_price_trend:f seq_volume_trend:f seq_delta_final:f seq_delta_trend:f", with_(BAR) + """
, c AS (SELECT *, sum(bidvolume - askvolume) OVER (PARTITION BY symbol, trading_day ORDER BY dt ROWS UNBOUNDED PRECEDING) AS cd FROM bar),
s AS (SELECT symbol, dt, count(*) OVER f AS n, regr_slope(close, bar_no::DOUBLE) OVER f / (first_value(close) OVER f + 1e-6) AS a, regr_slope(volume, bar_no::DOUBLE) OVER f / (avg(volume) OVER f + 1e-6) AS b,
 sum(bidvolume - askvolume) OVER f AS e, regr_slope(cd, bar_no::DOUBLE) OVER f AS g FROM c WINDOW f AS (PARTITION BY symbol, trading_day ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, dt, CASE WHEN n >= 5 THEN a ELSE 0 END AS seq_price_trend, CASE WHEN n >= 5 THEN b ELSE 0 END AS seq_volume_trend, CASE WHEN n >= 5 THEN e ELSE 0 END AS seq_delta_final,
 CASE WHEN n >= 5 THEN g ELSE 0 END AS seq_delta_trend FROM s""")
def _(t):
    return it.sequence_features(t.bar())


@query("sequence_vap_concentration", "symbol dt:t seq_vap_concentration:f", with_(BAR) + """
, x AS (SELECT symbol, dt, close, volume, bar_no, row_number() OVER w AS rn, max(close) OVER f AS hi, min(close) OVER f AS lo, count(*) OVER f AS n FROM bar
  WINDOW w AS (PARTITION BY symbol ORDER BY dt), f AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, CASE WHEN hi - lo < .01 THEN 1.0::DOUBLE ELSE hi - lo END AS span FROM x),
z AS (SELECT y.symbol, y.dt, greatest(least(ceil((p.close - (y.close - y.span / 2)) / (y.span / 10)) - 1, 9), 0) AS b, sum(p.volume) AS v FROM y JOIN y p ON p.symbol = y.symbol AND p.rn BETWEEN y.rn - 20 AND y.rn - 1
  WHERE y.n >= 20 AND y.bar_no > 5 GROUP BY 1, 2, 3),
t AS (SELECT *, v / sum(v) OVER (PARTITION BY symbol, dt) AS s FROM z),
e AS (SELECT symbol, dt, -sum(greatest(s, 1e-10) * ln(greatest(s, 1e-10))) - (10 - count(*)) * 1e-10 * ln(1e-10) AS ent FROM t GROUP BY 1, 2)
SELECT symbol, dt, coalesce(1 - ent / ln(10::DOUBLE), 0) AS seq_vap_concentration FROM y LEFT JOIN e USING (symbol, dt)""")
def _(t):
    return it.vap_concentration(t.bar(), block_rows=B)


@query("sequence_windows", "symbol dt:t seq_len:i n_slots:i pad:i first_close:f last_close:f sum_close:f last_volume:f", with_(BAR) + """
, s AS (SELECT symbol, dt, count(*) OVER f AS n, first_value(close) OVER f AS c0, last_value(close) OVER f AS cl, sum(close) OVER f AS cs, avg(volume) OVER f AS vm, stddev_pop(volume) OVER f AS vs, last_value(volume) OVER f AS vl
 FROM bar WINDOW f AS (PARTITION BY symbol, trading_day ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, dt, CASE WHEN n >= 5 THEN n ELSE 0 END AS seq_len, 20 AS n_slots, CASE WHEN n >= 5 THEN 20 - n ELSE 20 END AS pad, 0 AS first_close, CASE WHEN n >= 5 THEN coalesce((cl - c0) / nullif(c0, 0), 0) ELSE 0 END AS last_close,
 CASE WHEN n >= 5 THEN coalesce((cs - n * c0) / nullif(c0, 0), 0) ELSE 0 END AS sum_close, CASE WHEN n >= 5 AND vs >= 1e-6 THEN (vl - vm) / vs ELSE 0 END AS last_volume FROM s""")
def _(t):
    df = it.sequence_windows(t.bar())
    return df.withColumns({"n_slots": F.size("seq_close"), "pad": 20 - F.col("seq_len"), "first_close": F.element_at("seq_close", F.lit(1)), "last_close": F.element_at("seq_close", F.lit(-1)),
                           "sum_close": F.aggregate("seq_close", F.lit(0.0), lambda a, x: a + x), "last_volume": F.element_at("seq_volume", F.lit(-1))})


@query("level_sequence_channels", "symbol dt:t step:i c_close:f c_volume_z:f c_signed:f c_range:f c_pos:f c_cum:f", with_(BAR, VWAP) + """
, x AS (SELECT *, sign(close - open) * volume AS td FROM vw),
p AS (SELECT a.symbol, a.dt, a.vwap AS lv, b.bar_no, b.high, b.low, b.close, b.volume, b.td, row_number() OVER q AS step, sum(b.td) OVER (q ROWS UNBOUNDED PRECEDING) AS cum
 FROM x a JOIN x b ON a.symbol = b.symbol AND a.trading_day = b.trading_day AND b.bar_no BETWEEN a.bar_no - 5 AND a.bar_no WINDOW q AS (PARTITION BY a.symbol, a.dt ORDER BY b.bar_no))
SELECT symbol, dt, step, (close - lv) / lv * 1000 AS c_close, coalesce((volume - avg(volume) OVER g) / nullif(stddev_pop(volume) OVER g, 0), 0) AS c_volume_z, coalesce(td / nullif(stddev_pop(td) OVER g, 0), 0) AS c_signed,
 (high - low) / lv * 1000 AS c_range, CASE WHEN high > low THEN (close - low) / (high - low) ELSE .5 END AS c_pos, coalesce(cum / nullif(stddev_pop(cum) OVER g, 0), 0) AS c_cum FROM p WINDOW g AS (PARTITION BY symbol, dt)""")
def _(t):
    df = it.level_sequence_channels(it.vwap_running(t.bar()), "vwap", 6)
    return df.select("symbol", "dt", F.posexplode("channels").alias("i", "c")).select(
        "symbol", "dt", (F.col("i") + 1).alias("step"), F.col("c.close").alias("c_close"), F.col("c.volume_z").alias("c_volume_z"), F.col("c.signed_volume").alias("c_signed"),
        F.col("c.range").alias("c_range"), F.col("c.close_position").alias("c_pos"), F.col("c.cum_delta").alias("c_cum"))


@query("rejection_strength", "symbol dt:t strength:f", with_(BAR, VWAP) + """
SELECT symbol, dt, .4 * least(greatest(CASE WHEN close >= vwap THEN least(open, close) - low ELSE high - greatest(open, close) END, 0) / greatest(abs(close - open), .01), 3) / 3
 + .3 * CASE WHEN close >= vwap THEN close - low ELSE high - close END / greatest(high - low, .01)
 + .2 * greatest(CASE WHEN close >= vwap THEN least(open, close) - low ELSE high - greatest(open, close) END, 0) / greatest(high - low, .01)
 + .1 * least(greatest(CASE WHEN close >= vwap THEN vwap - low ELSE high - vwap END, 0) / (vwap * .002), 2) AS strength FROM vw""")
def _(t):
    return it.vwap_running(t.bar()).withColumn("strength", it.rejection_strength(F.col("vwap"), F.when(F.col("close") >= F.col("vwap"), 1).otherwise(-1)))


WK = """
wb AS (SELECT symbol, isoyear(day) * 100 + week(day) AS yw, max(day) AS ld, arg_max(close, day) AS close FROM day GROUP BY 1, 2),
wbb AS (SELECT symbol, yw, lag(pb) OVER (PARTITION BY symbol ORDER BY ld) AS wpb FROM (SELECT symbol, yw, ld, coalesce((close - (avg(close) OVER f - 2 * stddev_samp(close) OVER f)) / nullif(4 * stddev_samp(close) OVER f, 0), .5) AS pb FROM wb WINDOW f AS (PARTITION BY symbol ORDER BY ld ROWS 19 PRECEDING)))"""


@query("directional_context", "symbol day:d bb_side_alignment:i trend_exhaustion_score:f weekly_trend_alignment:i", with_(DAY, rsi_sql("r1", "day", "close", 14), WK) + """
, b AS (SELECT symbol, day, rsi, coalesce((close - (avg(close) OVER f - 2 * stddev_samp(close) OVER f)) / nullif(4 * stddev_samp(close) OVER f, 0), .5) AS pb FROM r1 WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING)),
s AS (SELECT symbol, day, coalesce(lag(rsi) OVER w, 0) AS r, coalesce(lag(pb) OVER w, 0) AS b FROM b WINDOW w AS (PARTITION BY symbol ORDER BY day)),
j AS (SELECT s.*, coalesce(wpb, 0) AS wpb FROM s LEFT JOIN wbb ON wbb.symbol = s.symbol AND wbb.yw = isoyear(s.day) * 100 + week(s.day))
SELECT symbol, day, CASE WHEN b < .1 THEN 1 WHEN b > .9 THEN -1 ELSE 0 END AS bb_side_alignment, greatest(least((r - 50) / 50 * (b * 2 - 1), 1), -1) AS trend_exhaustion_score, CASE WHEN wpb < .2 AND b < .2 THEN 1 WHEN wpb > .8 AND b > .8 THEN -1 ELSE 0 END AS weekly_trend_alignment FROM j""")
def _(t):
    w = by(("symbol",), "day")
    d = daily.rsi(t.day(), 14)
    for layer in it.bollinger_columns(w):
        d = d.withColumns(layer)
    d = daily.causal_shift(d.withColumnsRenamed({"bb_pct_b": "daily_bb_pct_b", "rsi_14": "daily_rsi_14"}), ["daily_bb_pct_b", "daily_rsi_14"]).withColumn("year_week", bars.iso_week_key("day"))
    wk = bars.require_unique_weeks(bars.weekly_bars(t.day()))
    for layer in it.bollinger_columns(w):
        wk = wk.withColumns(layer)
    wk = daily.causal_shift(wk.withColumnRenamed("bb_pct_b", "weekly_bb_pct_b"), ["weekly_bb_pct_b"])
    j = d.join(wk.select("symbol", "year_week", "weekly_bb_pct_b"), ["symbol", "year_week"], "left").fillna(0.0, subset=["weekly_bb_pct_b"])
    return it.directional_context(j)
