"""Daily and multi-instrument queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.windows import by, pct_change
from tickloom.operators import daily as dl, folds, joins, selection as sl
from tickloom.plans.adapters import DAY, DAY2, with_, with_series
from tickloom.plans.catalog import query
from tickloom.plans.sqlkit import P, TR, YEAR, atr_sql, ema_sql, lag, pair, pct, roll, rsi_sql, z0

S = "symbol day:d "


@query("ema_adjusted", S + "ema14:f ema100:f", with_(DAY, ema_sql("e1", "day", "close", 14, 1), ema_sql("e2", "day", "close", 100, 10)) + """
SELECT symbol, day, e1.ema AS ema14, e2.ema AS ema100 FROM e1 JOIN e2 USING (symbol, day)""")
def _(t):
    return dl.ema_adjusted(dl.ema_adjusted(t.day(), "close", 14, "ema14"), "close", 100, "ema100", 10)


@query("rsi", S + "rsi_14:f rsi_5:f", with_(DAY, rsi_sql("r1", "day", "close", 14), rsi_sql("r2", "day", "close", 5)) + """
SELECT symbol, day, r1.rsi AS rsi_14, r2.rsi AS rsi_5 FROM r1 JOIN r2 USING (symbol, day)""")
def _(t):
    return dl.rsi(dl.rsi(t.day(), 14), 5)


@query("atr", S + "atr_14:f atr_20:f", with_(DAY, atr_sql("a1", "day", 14)) + f"""
, s AS (SELECT symbol, day, {TR} AS tr FROM day) SELECT symbol, day, atr AS atr_14, {roll('avg', 'tr', 20, 1)} AS atr_20 FROM a1 JOIN s USING (symbol, day)""")
def _(t):
    return dl.atr(dl.atr(t.day(), 14), 20, simple=True)


@query("returns_momentum", S + "return_1d:f return_5d:f return_20d:f return_60d:f rsi_5:f rsi_14:f",
       with_(DAY, rsi_sql("r1", "day", "close", 14), rsi_sql("r2", "day", "close", 5)) + f"""
SELECT symbol, day, {z0(pct('r1.close', 1))} AS return_1d, {z0(pct('r1.close', 5))} AS return_5d, {z0(pct('r1.close', 20))} AS return_20d, {z0(pct('r1.close', 60))} AS return_60d,
 r2.rsi AS rsi_5, r1.rsi AS rsi_14 FROM r1 JOIN r2 USING (symbol, day)""")
def _(t):
    return dl.returns_momentum(t.day())


SMA = "sm AS (SELECT *, " + ", ".join(f"avg(close) OVER ({P} ROWS {n - 1} PRECEDING) AS sma{n}, stddev_samp(close) OVER ({P} ROWS {n - 1} PRECEDING) AS sd{n}" for n in (20, 50, 100, 200)) + " FROM day)"


@query("sma_z_slope_alignment", S + "close_vs_sma20_z:f close_vs_sma50_z:f close_vs_sma100_z:f close_vs_sma200_z:f sma20_slope_5d:f sma200_slope_5d:f ma_alignment:f",
       with_(DAY, SMA) + "SELECT symbol, day, " + ", ".join(f"coalesce((close - sma{n}) / nullif(sd{n}, 0), 0) AS close_vs_sma{n}_z" for n in (20, 50, 100, 200)) + f""",
 {z0(pct('sma20', 5))} AS sma20_slope_5d, {z0(pct('sma200', 5))} AS sma200_slope_5d,
 ((sma20 > sma50)::INT + (sma50 > sma100)::INT + (sma100 > sma200)::INT) / 3::DOUBLE * 2 - 1 AS ma_alignment FROM sm""")
def _(t):
    return dl.sma_z_slope_alignment(t.day())


@query("ma_cross_age", S + "ma_20_50_cross:i", with_(DAY, SMA) + f"""
, c AS (SELECT symbol, day, (sma20 > sma50)::INT AS up, row_number() OVER ({P}) AS rn FROM sm),
x AS (SELECT *, CASE WHEN up <> {lag('up')} THEN rn END AS brk FROM c)
SELECT symbol, day, coalesce((rn - max(brk) OVER ({P} ROWS UNBOUNDED PRECEDING) + 1) * (2 * up - 1), 0) AS ma_20_50_cross FROM x""")
def _(t):
    return dl.ma_cross_age(t.day(), 20, 50, "ma_20_50_cross")


@query("volatility_block", S + "atr_5:f atr_14:f atr_ratio_5_20:f rvol_10d:f rvol_20d:f vol_of_vol:f atr_pctile_252d:f atr_momentum_5d:f sq_ret_lag1:f sq_ret_ewm5:f sq_ret_ewm20:f",
       with_(DAY, atr_sql("a5", "day", 5), atr_sql("a14", "day", 14), atr_sql("a20", "day", 20),
             f"lr AS (SELECT symbol, day, ln(close / {lag('close')}) AS lr, ln(close / {lag('close')}) * ln(close / {lag('close')}) AS sq FROM day)",
             ema_sql("q5", "lr", "sq", 5, 1), ema_sql("q20", "lr", "sq", 20, 1)) + f"""
, j AS (SELECT symbol, day, a5.atr AS atr_5, a14.atr AS atr_14, a20.atr AS atr_20, lr.lr, lr.sq, q5.ema AS s5, q20.ema AS s20 FROM a5 JOIN a14 USING (symbol, day) JOIN a20 USING (symbol, day)
  JOIN lr USING (symbol, day) JOIN q5 USING (symbol, day) JOIN q20 USING (symbol, day)),
k AS (SELECT *, {roll('stddev_samp', 'lr', 10)} * {YEAR} AS rv10, {roll('stddev_samp', 'lr', 20)} * {YEAR} AS rv20 FROM j)
SELECT symbol, day, atr_5, atr_14, coalesce(atr_5 / nullif(atr_20, 0), 0) AS atr_ratio_5_20, {z0('rv10')} AS rvol_10d, {z0('rv20')} AS rvol_20d, {z0(roll('stddev_samp', 'rv10', 20))} AS vol_of_vol,
 {z0(f"(atr_14 - ({roll('min', 'atr_14', 252, 60)})) / nullif(({roll('max', 'atr_14', 252, 60)}) - ({roll('min', 'atr_14', 252, 60)}), 0)")} AS atr_pctile_252d, {z0(pct('atr_14', 5))} AS atr_momentum_5d,
 {z0(lag('sq'))} AS sq_ret_lag1, {z0(lag('s5'))} AS sq_ret_ewm5, {z0(lag('s20'))} AS sq_ret_ewm20 FROM k""")
def _(t):
    return dl.volatility_block(t.day())


@query("bar_shape_daily", S + "range_pct:f close_position:f upper_wick_ratio:f lower_wick_ratio:f gap_pct:f body_range_ratio:f", with_(DAY) + f"""
SELECT symbol, day, (high - low) / close AS range_pct, {z0('(close - low) / nullif(high - low, 0)')} AS close_position, {z0('(high - greatest(close, open)) / nullif(high - low, 0)')} AS upper_wick_ratio,
 {z0('(least(close, open) - low) / nullif(high - low, 0)')} AS lower_wick_ratio, {z0(f"(open - {lag('close')}) / {lag('close')}")} AS gap_pct, {z0('abs(close - open) / nullif(high - low, 0)')} AS body_range_ratio FROM day""")
def _(t):
    return dl.bar_shape_daily(t.day())


@query("consec_days", S + "consec_up:i consec_down:i", with_(DAY) + f"""
, u AS (SELECT symbol, day, row_number() OVER ({P}) AS rn, coalesce((close > {lag('close')})::INT, 0) AS up, coalesce((close < {lag('close')})::INT, 0) AS dn FROM day)
SELECT symbol, day, rn - coalesce(max(CASE WHEN up = 0 THEN rn END) OVER ({P} ROWS UNBOUNDED PRECEDING), 0) AS consec_up,
 rn - coalesce(max(CASE WHEN dn = 0 THEN rn END) OVER ({P} ROWS UNBOUNDED PRECEDING), 0) AS consec_down FROM u""")
def _(t):
    return dl.consec_days(t.day())


@query("drawdown", S + "drawdown_20d:f drawdown_60d:f", with_(DAY) + f"""
SELECT symbol, day, close / max(close) OVER ({P} ROWS 19 PRECEDING) - 1 AS drawdown_20d, close / max(close) OVER ({P} ROWS 59 PRECEDING) - 1 AS drawdown_60d FROM day""")
def _(t):
    return dl.drawdown(t.day())


RET = f"rt AS (SELECT *, {z0(pct('close'))} AS r FROM day)"


@query("recovery_ratio", S + "recovery_ratio:f", with_(DAY) + f"""
SELECT symbol, day, {z0(f"(close - {roll('min', 'close', 20, 1)}) / nullif({roll('max', 'close', 20, 1)} - {roll('min', 'close', 20, 1)}, 0)")} AS recovery_ratio FROM day""")
def _(t):
    return dl.capture_block(t.day())


@query("up_capture", S + "up_capture_ratio_20d:f", with_(DAY, RET) + f"""
, q AS (SELECT symbol, day, CASE WHEN r > 0 THEN r ELSE 0 END AS p, CASE WHEN r < 0 THEN -r ELSE 0 END AS n FROM rt)
SELECT symbol, day, {z0(f"({roll('sum', 'p', 20, 5)}) / nullif({roll('sum', 'n', 20, 5)}, 0)")} AS up_capture_ratio_20d FROM q""")
def _(t):
    return dl.capture_block(t.day())


@query("down_vol_ratio", S + "down_vol_ratio:f", with_(DAY, RET) + f"""
, q AS (SELECT symbol, day, r, CASE WHEN r < 0 THEN r END AS n FROM rt)
SELECT symbol, day, {z0(f"({roll('stddev_samp', 'n', 20, 5)}) / nullif({roll('stddev_samp', 'r', 20, 5)}, 0)")} AS down_vol_ratio FROM q""")
def _(t):
    return dl.capture_block(t.day())


@query("trend_exhaustion", S + "bb_pct_b:f bb_width:f bb_width_z:f trend_exhaustion:f", with_(DAY, rsi_sql("r1", "day", "close", 14)) + f"""
, b AS (SELECT symbol, day, close, rsi, {roll('avg', 'close', 20, 1)} AS m, {roll('stddev_samp', 'close', 20, 1)} AS sd FROM r1),
c AS (SELECT symbol, day, rsi, (close - (m - 2 * sd)) / nullif(4 * sd, 0) AS pb, 4 * sd / nullif(m, 0) AS bw FROM b)
SELECT symbol, day, {z0('pb')} AS bb_pct_b, {z0('bw')} AS bb_width, {z0(f"(bw - ({roll('avg', 'bw', 60, 10)})) / nullif({roll('stddev_samp', 'bw', 60, 10)}, 0)")} AS bb_width_z,
 (rsi - 50) / 50 * (greatest(least({z0('pb')}, 1), 0) * 2 - 1) AS trend_exhaustion FROM c""")
def _(t):
    return dl.trend_exhaustion(t.day())


@query("price_extension", S + "price_extension_20d:f price_extension_50d:f return_vs_range_20d:f", with_(DAY, SMA, atr_sql("a14", "sm", 14)) + f"""
SELECT symbol, day, {z0('(close - sma20) / nullif(atr, 0)')} AS price_extension_20d, {z0('(close - sma50) / nullif(atr, 0)')} AS price_extension_50d,
 {z0(f"{z0(pct('close', 20))} / nullif(({roll('avg', 'atr', 20, 1)}) / close, 0)")} AS return_vs_range_20d FROM a14""")
def _(t):
    return dl.price_extension(t.day())


def _range_sql(n):
    return f"rg{n} AS (SELECT symbol, day, close, {roll('max', 'close', n)} AS h, {roll('min', 'close', n)} AS l, (({roll('max', 'close', n)}) - ({roll('min', 'close', n)})) / close AS w FROM day)"


def _range_cols(n):
    return (f"SELECT symbol, day, {z0('(close - l) / nullif(h - l, 0)')} AS range_pos_{n}, {z0('w')} AS range_width_{n}, CASE WHEN close < {lag('l')} THEN -1 WHEN close > {lag('h')} THEN 1 ELSE 0 END AS range_breakout_{n}, "
            f"{z0(f'w / nullif({roll('avg', 'w', 3 * n, n)}, 0)')} AS range_compression_{n} FROM rg{n}")


@query("range_features_mtf", S + " ".join(f"range_pos_{n}:f range_width_{n}:f range_breakout_{n}:i range_compression_{n}:f" for n in (5, 20, 63)),
       with_(DAY, *[_range_sql(n) for n in (5, 20, 63)]) + f"SELECT * FROM ({_range_cols(5)}) JOIN ({_range_cols(20)}) USING (symbol, day) JOIN ({_range_cols(63)}) USING (symbol, day)")
def _(t):
    return dl.range_features_mtf(t.day())


def before(fn, x, n):
    over = f"OVER ({P} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return z0(f"CASE WHEN count({x}) {over} >= {n} THEN {fn}({x}) {over} END")


@query("range_autoregressive", S + "range_pct_lag1:f range_pct_lag5:f range_pct_ma5:f range_pct_ma20:f range_pct_ewm5:f range_pct_ewm20:f high_move_pct_lag1:f low_move_pct_ma5:f "
       "hi_lo_asymmetry_lag1:f hi_lo_asymmetry_ma5:f range_atr_ratio_lag1:f range_atr_ratio_ma5:f up_days_5d:i up_days_10d:i",
       with_(DAY, atr_sql("a14", "day", 14), f"ra AS (SELECT symbol, day, (high - low) / close AS rp, (high - {lag('close')}) / {lag('close')} AS hm, ({lag('close')} - low) / {lag('close')} AS lm, "
             f"coalesce((close > {lag('close')})::INT, 0) AS up, (high - low) / nullif(atr, 0) AS rr FROM a14)", ema_sql("e5", "ra", "rp", 5, 1), ema_sql("e20", "ra", "rp", 20, 1)) + f"""
, j AS (SELECT ra.*, ra.hm - ra.lm AS asy, e5.ema AS m5, e20.ema AS m20 FROM ra JOIN e5 USING (symbol, day) JOIN e20 USING (symbol, day))
SELECT symbol, day, {z0(lag('rp'))} AS range_pct_lag1, {z0(lag('rp', 5))} AS range_pct_lag5, {before('avg', 'rp', 5)} AS range_pct_ma5, {before('avg', 'rp', 20)} AS range_pct_ma20, {z0(lag('m5'))} AS range_pct_ewm5,
 {z0(lag('m20'))} AS range_pct_ewm20, {z0(lag('hm'))} AS high_move_pct_lag1, {before('avg', 'lm', 5)} AS low_move_pct_ma5, {z0(lag('asy'))} AS hi_lo_asymmetry_lag1, {before('avg', 'asy', 5)} AS hi_lo_asymmetry_ma5,
 {z0(lag('rr'))} AS range_atr_ratio_lag1, {before('avg', 'rr', 5)} AS range_atr_ratio_ma5, {before('sum', 'up', 5)} AS up_days_5d, {before('sum', 'up', 10)} AS up_days_10d FROM j""")
def _(t):
    return dl.range_autoregressive(t.day())


@query("causal_shift", S + "close:f volume:f high:f", with_(DAY) + f"SELECT symbol, day, {z0(lag('close'))} AS close, {z0(lag('volume'))} AS volume, high FROM day")
def _(t):
    return dl.causal_shift(t.day(), ["close", "volume"])


@query("macro_context", S + "ma_20_vs_50:i ma_50_vs_200:i drawdown_regime:i vol_regime_pctile:f trend_strength_20d:f range_squeeze:f dist_52w_high:f dist_52w_low:f breadth_proxy:f",
       with_(DAY, DAY2, SMA, atr_sql("a14", "sm", 14)) + f"""
, m AS (SELECT *, row_number() OVER ({P}) AS rn, max(close) OVER ({P} ROWS UNBOUNDED PRECEDING) AS top, ln(close / {lag('close')}) AS lr, high - low AS rng FROM a14),
rk AS (SELECT a.symbol, a.day, CASE WHEN count(*) >= 50 THEN avg((b.atr >= a.atr)::INT) ELSE 0 END AS pr FROM m a JOIN m b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 251 AND a.rn GROUP BY 1, 2),
o AS (SELECT symbol, day, coalesce((close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY day) - 1 > 0)::INT, 0) AS up FROM day2), br AS (SELECT day, avg(up) AS b FROM o GROUP BY 1)
SELECT m.symbol, m.day, CASE WHEN sma20 > sma50 THEN 1 ELSE -1 END AS ma_20_vs_50, CASE WHEN sma50 > sma200 THEN 1 ELSE -1 END AS ma_50_vs_200,
 CASE WHEN (close - top) / top <= -.15 THEN 2 WHEN (close - top) / top <= -.05 THEN 1 ELSE 0 END AS drawdown_regime, pr AS vol_regime_pctile,
 {z0(f"{pct('close', 20, 'PARTITION BY m.symbol ORDER BY m.day')} / nullif(({roll('stddev_samp', 'lr', 20, None, 'PARTITION BY m.symbol ORDER BY m.day')}) * {YEAR}, 0)")} AS trend_strength_20d,
 {z0('avg(rng) OVER (PARTITION BY m.symbol ORDER BY m.day ROWS 4 PRECEDING) / nullif(avg(rng) OVER (PARTITION BY m.symbol ORDER BY m.day ROWS 19 PRECEDING), 0)')} AS range_squeeze,
 CASE WHEN m.rn >= 50 THEN {z0('(close - max(close) OVER y) / nullif(max(close) OVER y - min(close) OVER y, 0)')} ELSE 0 END AS dist_52w_high,
 CASE WHEN m.rn >= 50 THEN {z0('(close - min(close) OVER y) / nullif(max(close) OVER y - min(close) OVER y, 0)')} ELSE 0 END AS dist_52w_low, coalesce(b, 0) AS breadth_proxy
FROM m JOIN rk USING (symbol, day) LEFT JOIN br USING (day) WINDOW y AS (PARTITION BY m.symbol ORDER BY m.day ROWS 251 PRECEDING)""")
def _(t):
    return dl.macro_context(t.day(), t.day2().withColumnRenamed("symbol", "series"))


PAIR = f"""
ot AS (SELECT symbol AS series, day, close AS oclose FROM day2),
pr0 AS (SELECT day.symbol || ' ' || series AS symbol, day.day, close, oclose FROM day JOIN ot ON ot.day = day.day),
pr AS (SELECT *, {pct('close')} AS x, {pct('oclose')} AS y FROM pr0)"""


def pairs(t):
    """Every symbol beside every other series, under one name for the pair."""
    left = with_series(t.day()).withColumn("symbol", F.concat_ws(" ", "symbol", "series"))
    return left, t.day2().withColumnRenamed("symbol", "series")


@query("rolling_corr_beta", S + "corr_10d:f corr_20d:f corr_60d:f corr_shift:f corr_z:f beta_20d:f beta_change:f relstr_5d:f relstr_20d:f leadlag:f", with_(DAY, DAY2, PAIR) + f"""
, c AS (SELECT *, {lag('y')} AS y1, {pair('corr', 'x', 'y', 10, 5)} AS corr_10d, {pair('corr', 'x', 'y', 20, 10)} AS corr_20d, {pair('corr', 'x', 'y', 60, 30)} AS corr_60d,
 ({pair('covar_samp', 'x', 'y', 20, 10)}) / nullif({roll('var_samp', 'y', 20, 10)}, 0) AS beta_20d FROM pr)
SELECT *, corr_10d - corr_60d AS corr_shift, (corr_10d - ({roll('avg', 'corr_10d', 60, 10)})) / nullif({roll('stddev_samp', 'corr_10d', 60, 10)}, 0) AS corr_z, beta_20d - {lag('beta_20d', 5)} AS beta_change,
 {pct('close', 5)} - {pct('oclose', 5)} AS relstr_5d, {pct('close', 20)} - {pct('oclose', 20)} AS relstr_20d, {pair('corr', 'x', 'y1', 20, 10)} AS leadlag FROM c""")
def _(t):
    return dl.rolling_corr_beta(*pairs(t), on=["series"])


@query("corr_regime", S + "corr20:f sign_flip_10d:i momentum_10d:f pos_pct_60d:f regime_age:i", with_(DAY, DAY2, PAIR) + f"""
, c AS (SELECT symbol, day, row_number() OVER ({P}) AS rn, {pair('corr', 'x', 'y', 20, 10)} AS corr20 FROM pr),
s AS (SELECT *, sign(corr20) AS sg, sign({lag('corr20')}) AS ps FROM c),
r AS (SELECT *, coalesce(sg <> ps, true)::INT AS chg, coalesce((corr20 > 0)::INT, 0) AS pos, CASE WHEN sg IS NULL OR ps IS NULL THEN rn WHEN sg <> ps AND sg <> 0 THEN rn - 1 END AS rs FROM s)
SELECT symbol, day, corr20, max(chg) OVER ({P} ROWS 9 PRECEDING) AS sign_flip_10d, corr20 - {lag('corr20', 10)} AS momentum_10d, {roll('avg', 'pos', 60, 10)} AS pos_pct_60d,
 rn - last_value(rs IGNORE NULLS) OVER ({P} ROWS UNBOUNDED PRECEDING) AS regime_age FROM r""")
def _(t):
    return dl.corr_regime(dl.pair_returns(*pairs(t), on=["series"]))


def ext_sql(name, sym, scale):
    return f"{name} AS (SELECT d.symbol, d.day, e.close / {scale} AS {name}v FROM day d ASOF LEFT JOIN (SELECT day, close FROM day2 WHERE symbol = '{sym}') e ON d.day >= e.day)"


def ext(t, sym, scale):
    """A series of the second set, as of each day, on every symbol."""
    e = t.day2().filter(F.col("symbol") == sym).select(F.lit(1).alias("k"), "day", (F.col("close") / F.lit(float(scale))).alias("value"))
    return joins.asof(t.day().select("symbol", "day").withColumn("k", F.lit(1)), e, ["k"], "day", "day", ["value"]).select("symbol", "day", "value")


@query("vix_block", S + "vix_close:f vix_percentile_252d:f vix_vs_sma20:f vix_change_1d:f vix_change_5d:f vix_regime:i vix_spike:i vix_rv_spread:f vix_es_corr_20d:f vix_es_corr_shift:f vix_term_structure:f "
       "vix_term_spread:f vix_term_z:f vix_term_regime:i vix3m_slope_5d:f", with_(DAY, DAY2, ext_sql("vx", "1-URGENT", "10000"), ext_sql("v3", "2-HIGH", "10000")) + f"""
, j AS (SELECT day.symbol, day.day, close, vxv AS v, v3v AS v3 FROM day JOIN vx USING (symbol, day) JOIN v3 USING (symbol, day)),
k AS (SELECT *, {pct('close')} AS x, {pct('v')} AS y, v / nullif(v3, 0) AS ts, row_number() OVER ({P}) AS rn FROM j),
h AS (SELECT a.symbol, a.day, CASE WHEN count(b.v) >= 60 THEN count(*) FILTER (b.v <= a.v) / count(b.v) END AS pr FROM k a JOIN k b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 251 AND a.rn GROUP BY 1, 2)
SELECT k.symbol, k.day, v AS vix_close, pr AS vix_percentile_252d, v / nullif({roll('avg', 'v', 20, 5)}, 0) - 1 AS vix_vs_sma20, y AS vix_change_1d, {pct('v', 5)} AS vix_change_5d,
 CASE WHEN v >= 30 THEN 3 WHEN v >= 20 THEN 2 WHEN v >= 15 THEN 1 ELSE 0 END AS vix_regime, coalesce((abs(y) > 2 * ({roll('stddev_samp', 'y', 60, 20)}))::INT, 0) AS vix_spike,
 v - ({roll('stddev_samp', 'x', 20, 10)}) * {YEAR} * 100 AS vix_rv_spread, {pair('corr', 'x', 'y', 20, 10)} AS vix_es_corr_20d, ({pair('corr', 'x', 'y', 20, 10)}) - ({pair('corr', 'x', 'y', 60, 20)}) AS vix_es_corr_shift,
 ts AS vix_term_structure, v3 - v AS vix_term_spread, (ts - ({roll('avg', 'ts', 60, 10)})) / nullif({roll('stddev_samp', 'ts', 60, 10)}, 0) AS vix_term_z, coalesce((({roll('avg', 'ts', 20, 5)}) > 1)::INT, 0) AS vix_term_regime,
 {pct('v3', 5)} AS vix3m_slope_5d FROM k JOIN h USING (symbol, day)""")
def _(t):
    return dl.vix_block(t.day(), ext(t, "1-URGENT", 10000), ext(t, "2-HIGH", 10000))


@query("dxy_block", S + "dxy_return_5d:f dxy_return_20d:f dxy_vs_sma50:f dxy_trend:i dxy_es_corr_20d:f dxy_es_corr_60d:f dxy_es_corr_shift:f dxy_es_corr_z:f", with_(DAY, DAY2, ext_sql("dx", "3-MEDIUM", "1000")) + f"""
, j AS (SELECT day.symbol, day.day, close, dxv AS d FROM day JOIN dx USING (symbol, day)), k AS (SELECT *, {pct('close')} AS x, {pct('d')} AS y FROM j),
c AS (SELECT *, {pair('corr', 'x', 'y', 20, 10)} AS dxy_es_corr_20d, {pair('corr', 'x', 'y', 60, 20)} AS dxy_es_corr_60d FROM k)
SELECT *, {pct('d', 5)} AS dxy_return_5d, {pct('d', 20)} AS dxy_return_20d, d / nullif({roll('avg', 'd', 50, 20)}, 0) - 1 AS dxy_vs_sma50, sign({pct('d', 20)}) AS dxy_trend, dxy_es_corr_20d - dxy_es_corr_60d AS dxy_es_corr_shift,
 (dxy_es_corr_20d - ({roll('avg', 'dxy_es_corr_20d', 60, 10)})) / nullif({roll('stddev_samp', 'dxy_es_corr_20d', 60, 10)}, 0) AS dxy_es_corr_z FROM c""")
def _(t):
    return dl.dxy_block(t.day(), ext(t, "3-MEDIUM", 1000))


@query("leading_block", S + "yield_curve_slope:f yield_curve_slope_20d_chg:f yield_curve_z:f skew_z:f skew_change_5d:f credit_stress:f credit_stress_z:f credit_momentum:f hy_ig_spread:f",
       with_(DAY, DAY2, ext_sql("tn", "1-URGENT", "100000"), ext_sql("ir", "2-HIGH", "100000"), ext_sql("sk", "3-MEDIUM", "1000"), ext_sql("hy", "4-NOT SPECIFIED", "1000"), ext_sql("lq", "5-LOW", "1000")) + f"""
, j AS (SELECT day.symbol, day.day, close, tnv - irv AS slope, skv AS sk, hyv, lqv FROM day JOIN tn USING (symbol, day) JOIN ir USING (symbol, day) JOIN sk USING (symbol, day) JOIN hy USING (symbol, day) JOIN lq USING (symbol, day)),
k AS (SELECT *, {pct('hyv', 20)} - {pct('close', 20)} AS cs, {pct('hyv', 20)} - {pct('lqv', 20)} AS hy_ig_spread FROM j)
SELECT symbol, day, slope AS yield_curve_slope, slope - {lag('slope', 20)} AS yield_curve_slope_20d_chg, (slope - ({roll('avg', 'slope', 60, 20)})) / nullif({roll('stddev_samp', 'slope', 60, 20)}, 0) AS yield_curve_z,
 (sk - ({roll('avg', 'sk', 60, 20)})) / nullif({roll('stddev_samp', 'sk', 60, 20)}, 0) AS skew_z, sk - {lag('sk', 5)} AS skew_change_5d, cs AS credit_stress,
 (cs - ({roll('avg', 'cs', 60, 20)})) / nullif({roll('stddev_samp', 'cs', 60, 20)}, 0) AS credit_stress_z, cs - {lag('cs', 5)} AS credit_momentum, hy_ig_spread FROM k""")
def _(t):
    df = t.day()
    for name, sym, scale in (("tnx", "1-URGENT", 100000), ("irx", "2-HIGH", 100000), ("skew", "3-MEDIUM", 1000), ("hyg", "4-NOT SPECIFIED", 1000), ("lqd", "5-LOW", 1000)):
        df = df.join(ext(t, sym, scale).withColumnRenamed("value", name), ["symbol", "day"], "left")
    return dl.leading_block(df)


CUSUM = f"""
cz AS (SELECT symbol, day, row_number() OVER ({P}) AS rn, CASE WHEN row_number() OVER ({P}) > 1 AND ({roll('stddev_samp', 'r', 60, 30)}) >= 1e-10 THEN (r - ({roll('avg', 'r', 60, 30)})) / ({roll('stddev_samp', 'r', 60, 30)}) END AS z FROM rt),
cu AS (SELECT symbol, day, rn, 0::DOUBLE AS up, 0::DOUBLE AS dn, 0::DOUBLE AS cp, 0::DOUBLE AS cn FROM cz WHERE rn = 1 UNION ALL
 SELECT c.symbol, c.day, c.rn, CASE WHEN c.z IS NULL THEN k.up WHEN greatest(k.up + c.z - .5, k.dn - c.z - .5) > 5 THEN 0 ELSE greatest(0, k.up + c.z - .5) END,
  CASE WHEN c.z IS NULL THEN k.dn WHEN greatest(k.up + c.z - .5, k.dn - c.z - .5) > 5 THEN 0 ELSE greatest(0, k.dn - c.z - .5) END,
  CASE WHEN c.z IS NULL THEN 0 ELSE greatest(0, k.up + c.z - .5) END, CASE WHEN c.z IS NULL THEN 0 ELSE greatest(0, k.dn - c.z - .5) END
 FROM cu k JOIN cz c ON c.symbol = k.symbol AND c.rn = k.rn + 1)"""


def with_recursive(*ctes):
    return with_(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@query("cusum", S + "cusum_pos:f cusum_neg:f cusum_score:f", with_recursive(DAY, RET, CUSUM) + "SELECT symbol, day, cp AS cusum_pos, cn AS cusum_neg, greatest(cp, cn) / 5 AS cusum_score FROM cu")
def _(t):
    d = t.day().withColumn("r", F.coalesce(pct_change("close", by(("symbol",), "day")), F.lit(0.0)))
    return dl.cusum(d, "r")


EWZ = f"ez AS (SELECT symbol, day, ema, {z0(f"(ema - ({roll('avg', 'ema', 252, 126)})) / nullif({roll('stddev_samp', 'ema', 252, 126)}, 0)")} AS z FROM e20)"
ANOM = f"an AS (SELECT symbol, day, least(abs(r) * 2, 1) AS a FROM rt)"


def with_anomaly(t):
    r = F.coalesce(pct_change("close", by(("symbol",), "day")), F.lit(0.0))
    return t.day().withColumn("r", r).withColumn("a", F.least(F.abs("r") * 2, F.lit(1.0)))


@query("ewma_z", S + "ewma_value:f ewma_z:f", with_(DAY, RET, ANOM, ema_sql("e20", "an", "a", 20, 10), EWZ) + "SELECT symbol, day, ema AS ewma_value, z AS ewma_z FROM ez")
def _(t):
    return dl.ewma_z(with_anomaly(t), "a")


CHS = f"""ch AS (SELECT symbol, day, CASE WHEN cp >= cn THEN 1 ELSE -1 END AS dir, {z0(f"ema - {lag('ema', 5)}")} AS acc,
 greatest(least(greatest(greatest(cp, cn) / 5, (greatest(least(z, 3), -3) / 3 + 1) / 2), 1), 0) AS score FROM ez JOIN cu USING (symbol, day))"""


@query("change_score", S + "return_cusum_direction:i anomaly_acceleration:f combined_change_score:f",
       with_recursive(DAY, RET, ANOM, ema_sql("e20", "an", "a", 20, 10), EWZ, CUSUM, CHS) + "SELECT symbol, day, dir AS return_cusum_direction, acc AS anomaly_acceleration, score AS combined_change_score FROM ch")
def _(t):
    return dl.change_score(with_anomaly(t), "r", "a")


@query("regime_risk", S + "range_stress:f risk_score:f risk_regime:i", with_recursive(DAY, RET, ANOM, ema_sql("e20", "an", "a", 20, 10), EWZ, CUSUM, CHS, _range_sql(5), _range_sql(20)) + f"""
, f AS (SELECT * FROM ({_range_cols(5)}) JOIN ({_range_cols(20)}) USING (symbol, day)),
s AS (SELECT f.symbol, f.day, greatest(least(((abs(range_breakout_5) + abs(range_breakout_20)) / 2 + (abs(range_pos_5 - .5) + abs(range_pos_20 - .5)) / 2) / 2, 1), 0) AS range_stress, a, score
 FROM f JOIN an USING (symbol, day) JOIN ch USING (symbol, day)),
r AS (SELECT *, greatest(least(.25 * range_stress + .4 * a + .35 * score, 1), 0) AS risk_score FROM s)
SELECT symbol, day, range_stress, risk_score, (risk_score > .25)::INT + (risk_score > .5)::INT + (risk_score > .75)::INT AS risk_regime FROM r""")
def _(t):
    df = dl.range_features_mtf(with_anomaly(t), (5, 20)).join(dl.change_score(with_anomaly(t), "r", "a").select("symbol", "day", "combined_change_score"), ["symbol", "day"])
    return dl.regime_risk(df, ["range_breakout_5", "range_breakout_20"], ["range_pos_5", "range_pos_20"], "a", "combined_change_score")


def _rob(c):
    return f"quantile_cont({c}, .5) FILTER (rn <= 500) AS m_{c}, quantile_cont({c}, .75) FILTER (rn <= 500) - quantile_cont({c}, .25) FILTER (rn <= 500) AS i_{c}"


@query("robust_anomaly_score", S + "anomaly_score:f anomaly_percentile:f", with_(DAY, RET) + f"""
, f AS (SELECT symbol, day, r, (high - low) / close AS g, volume AS v, row_number() OVER ({P}) AS rn FROM rt), st AS (SELECT symbol, {_rob('r')}, {_rob('g')}, {_rob('v')} FROM f GROUP BY 1),
x AS (SELECT f.symbol, day, rn, (coalesce(abs(r - m_r) / nullif(i_r, 0), 0) + coalesce(abs(g - m_g) / nullif(i_g, 0), 0) + coalesce(abs(v - m_v) / nullif(i_v, 0), 0)) / 3 AS raw FROM f JOIN st USING (symbol)),
y AS (SELECT *, greatest(least((raw - min(raw) FILTER (rn <= 500) OVER (PARTITION BY symbol)) / (max(raw) FILTER (rn <= 500) OVER (PARTITION BY symbol) - min(raw) FILTER (rn <= 500) OVER (PARTITION BY symbol)), 1), 0) AS s FROM x)
SELECT a.symbol, a.day, a.s AS anomaly_score, (count(*) FILTER (b.s < a.s) + count(*) FILTER (b.s <= a.s) + (count(*) FILTER (b.s = a.s) > 0)::INT) / 2 / count(*) AS anomaly_percentile
FROM y a JOIN y b ON a.symbol = b.symbol AND b.rn <= 500 GROUP BY 1, 2, 3""")
def _(t):
    d = with_anomaly(t).withColumns({"g": (F.col("high") - F.col("low")) / F.col("close"), "v": F.col("volume")})
    return dl.robust_anomaly_score(d, ["r", "g", "v"], 500)


def _fit(c):
    return f"quantile_disc({c}, .5) AS m_{c}, quantile_disc({c}, .75) - quantile_disc({c}, .25) AS i_{c}"


@query("walk_forward_anomaly", S + "fold:i anomaly_score:f anomaly_label:i anomaly_percentile:f", with_(DAY, RET) + f"""
, f AS (SELECT symbol, day, r, (high - low) / close AS g, volume AS v, row_number() OVER ({P}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rt),
b AS (SELECT *, k AS fold, 500 + k * ((n - 500) // 4) AS te, CASE WHEN k = 3 THEN n ELSE 500 + (k + 1) * ((n - 500) // 4) END AS xe FROM f, generate_series(0, 3) t(k)),
st AS (SELECT symbol, fold, {_fit('r')}, {_fit('g')}, {_fit('v')} FROM b WHERE i < te GROUP BY 1, 2),
x AS (SELECT b.*, (0 + coalesce(abs(r - m_r) / nullif(i_r, 0), 0) + coalesce(abs(g - m_g) / nullif(i_g, 0), 0) + coalesce(abs(v - m_v) / nullif(i_v, 0), 0)) / 3 AS raw FROM b JOIN st USING (symbol, fold)),
a AS (SELECT symbol, fold, min(raw) AS lo, max(raw) AS hi, quantile_disc(raw, .95) AS lim, quantile_disc(raw, [x / 1024 for x in range(1, 1025)]) AS grid FROM x WHERE i < te GROUP BY 1, 2)
SELECT symbol, day, fold, coalesce(greatest(least((raw - lo) / nullif(hi - lo, 0), 1), 0), 0) AS anomaly_score, (raw > lim)::INT AS anomaly_label, len(list_filter(grid, lambda g: g <= raw)) / 1024 AS anomaly_percentile
FROM x JOIN a USING (symbol, fold) WHERE i >= te AND i < xe""")
def _(t):
    d = with_anomaly(t).withColumns({"g": (F.col("high") - F.col("low")) / F.col("close"), "v": F.col("volume")})
    return dl.walk_forward_anomaly(d, ["r", "g", "v"], 4, 500)


@query("fold_lines", S + "fold:i pred:f n_train:i", with_(DAY, RET) + f"""
, f AS (SELECT symbol, day, r, (high - low) / close AS g, row_number() OVER ({P}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rt),
b AS (SELECT *, k AS fold, 500 + k * ((n - 500) // 4) AS te, CASE WHEN k = 3 THEN n ELSE 500 + (k + 1) * ((n - 500) // 4) END AS xe FROM f, generate_series(0, 3) t(k)),
m AS (SELECT symbol, fold, regr_slope(g, abs(r)) AS s, regr_intercept(g, abs(r)) AS c, count(*) AS n_train FROM b WHERE i < te GROUP BY 1, 2)
SELECT symbol, day, fold, c + s * abs(r) AS pred, n_train FROM b JOIN m USING (symbol, fold) WHERE i >= te AND i < xe""")
def _(t):
    d = with_anomaly(t).select("symbol", "day", F.abs("r").alias("x"), ((F.col("high") - F.col("low")) / F.col("close")).alias("y"))

    def line(train, test):
        dx = train["x"] - train["x"].mean()
        slope = (dx * (train["y"] - train["y"].mean())).sum() / (dx * dx).sum()
        pred = train["y"].mean() + slope * (test["x"] - train["x"].mean())
        return test.assign(pred=pred, n_train=len(train))[["symbol", "day", "fold", "pred", "n_train"]]

    cut = sl.walk_forward_folds(d.select("symbol", "day"), 4, 500)
    return folds.fold_apply(d, cut, line, "symbol string, day date, fold int, pred double, n_train long")
