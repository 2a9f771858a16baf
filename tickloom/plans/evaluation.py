"""Selection and evaluation queries.

The evaluated trades are the day-end barrier outcomes of all near-level bars; a score is a
reproducible hash draw pulled towards the outcome.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.calendar import tod_bucket
from tickloom.functions.windows import by, whole
from tickloom.operators import daily as dl, evaluation as ev, labels as lb, selection as sl, sets
from tickloom.plans.adapters import BAR, DAY, with_
from tickloom.plans.catalog import query
from tickloom.plans.daily import SMA
from tickloom.plans.joins_sets import HASH
from tickloom.plans.levels import ALL, ENTRY, barrier_sql, entries, sided
from tickloom.plans.options import cdf_sql
from tickloom.plans.sqlkit import P, atr_sql, lag

ID = "s.symbol || '|' || strftime(s.dt, '%Y-%m-%d %H:%M:%S')"
TR = (*ALL, ENTRY, "rth_bar AS (SELECT * FROM bar WHERE minute <= 779 OR minute >= 900)", barrier_sql(1, "stop", "close", keep_tie=True, path="rth_bar"), f"""
tr0 AS (SELECT s.symbol, s.trading_day, s.dt, s.bar_no, s.minute, s.nearest_level AS level, s.close, bo.direction, exit_type, exit_bars, s.bar_no + exit_bars AS exit_bar, pnl, (exit_type = 'target')::INT AS y,
  {HASH.format(ID + " || '|a'")} / 4294967296.0::DOUBLE AS ha, {HASH.format(ID + " || '|b'")} / 4294967296.0::DOUBLE AS hb FROM bo JOIN sided s USING (symbol, dt)),
tr AS (SELECT *, (ha + .3 * y) / 1.3 AS score, (hb + .1 * y) / 1.1 AS base_score FROM tr0),
cal AS (SELECT DISTINCT symbol, trading_day FROM bar)""")


def trades(t):
    e = entries(t)
    out = lb.barrier_outcome(e, t.bar(), 1, "stop", "close", keep_tie=True, last_minute=779)
    out = out.join(sided(t).select("symbol", "dt", "minute", F.col("nearest_level").alias("level"), "close"), ["symbol", "dt"])
    key = F.concat_ws("|", F.col("symbol"), F.date_format("dt", "yyyy-MM-dd HH:mm:ss"))
    y = (F.col("exit_type") == "target").cast("int")
    out = out.withColumns({"y": y, "ha": sets.unit_hash(key, F.lit("a")), "hb": sets.unit_hash(key, F.lit("b")), "exit_bar": F.col("bar_no") + F.col("exit_bars")})
    return out.withColumns({"score": (F.col("ha") + 0.3 * F.col("y")) / 1.3, "base_score": (F.col("hb") + 0.1 * F.col("y")) / 1.1})


def calendar(t):
    return t.bar().select("symbol", "trading_day").distinct()


EV = "ev AS (SELECT event_id, event_type, value, (value > 50)::INT AS y, (" + HASH.format("event_id::VARCHAR") + " / 4294967296.0::DOUBLE + .4 * (value > 50)::INT) / 1.4 AS score FROM events)"


def scored_events(t):
    y = (F.col("value") > 50).cast("int")
    return t.table("events").select("event_id", "event_type", "value", "ts", y.alias("y"), ((sets.unit_hash(F.col("event_id").cast("string")) + 0.4 * y) / 1.4).alias("score"))


# --- selection --------------------------------------------------------------------------------------

@query("greedy_cooldown", "symbol dt:t direction:i bar_no:i exit_bar:i", with_(*TR).replace("WITH ", "WITH RECURSIVE ", 1) + """
, g AS (SELECT symbol, trading_day, direction, min(bar_no) AS b FROM tr GROUP BY 1, 2, 3),
r AS (SELECT tr.symbol, tr.trading_day, tr.direction, tr.bar_no, tr.exit_bar FROM g JOIN tr ON tr.symbol = g.symbol AND tr.trading_day = g.trading_day AND tr.direction = g.direction AND tr.bar_no = g.b
 UNION ALL SELECT symbol, trading_day, direction, nb, ne FROM (SELECT r.symbol, r.trading_day, r.direction, min(tr.bar_no) AS nb, arg_min(tr.exit_bar, tr.bar_no) AS ne FROM r JOIN tr ON tr.symbol = r.symbol AND tr.trading_day = r.trading_day AND tr.direction = r.direction
  AND tr.bar_no >= r.exit_bar + 3 AND tr.bar_no > r.bar_no GROUP BY r.symbol, r.trading_day, r.direction, r.bar_no))
SELECT r.symbol, tr.dt, r.direction, r.bar_no, r.exit_bar FROM r JOIN tr USING (symbol, trading_day, direction, bar_no)""")
def _(t):
    return sl.greedy_cooldown(trades(t), 3, keys=("symbol", "trading_day", "direction"))


@query("first_k_with_gap", "symbol dt:t minute:i", with_(*TR).replace("WITH ", "WITH RECURSIVE ", 1) + """
, c AS (SELECT symbol, trading_day, dt, minute FROM tr WHERE score >= .4),
r AS (SELECT symbol, trading_day, min(dt) AS m, 1 AS k FROM c GROUP BY 1, 2 UNION ALL
 SELECT symbol, trading_day, m, k FROM (SELECT r.symbol, r.trading_day, min(c.dt) AS m, r.k + 1 AS k FROM r JOIN c ON c.symbol = r.symbol AND c.trading_day = r.trading_day AND c.dt >= r.m + INTERVAL 30 MINUTES WHERE r.k < 4 GROUP BY r.symbol, r.trading_day, r.k))
SELECT c.symbol, c.dt, c.minute FROM r JOIN c ON c.symbol = r.symbol AND c.trading_day = r.trading_day AND c.dt = r.m""")
def _(t):
    # A trading day crosses midnight, so the gap is one of clock time.
    clock = F.floor(F.unix_seconds(F.col("dt").cast("timestamp")) / 60).cast("int")
    return sl.first_k_with_gap(trades(t).withColumn("clock", clock), "score", 0.4, 30, 4, minute="clock")


@query("slot_cap", "symbol trading_day:d bar_no:i level direction:i", with_(*TR).replace("WITH ", "WITH RECURSIVE ", 1) + """
, c AS (SELECT symbol, trading_day, bar_no, level, direction, level || direction::VARCHAR AS k, row_number() OVER (PARTITION BY symbol, trading_day ORDER BY bar_no, level, direction) AS rn FROM tr),
r AS (SELECT symbol, trading_day, rn, bar_no AS last_no, [k] AS ks, true AS ok FROM c WHERE rn = 1 UNION ALL
 SELECT symbol, trading_day, rn, CASE WHEN a THEN bar_no ELSE last_no END, CASE WHEN a THEN list_append(ks, k) ELSE ks END, a
 FROM (SELECT c.*, r.last_no, r.ks, len(r.ks) < 6 AND c.bar_no - r.last_no >= 3 AND len(list_filter(r.ks, lambda x: x = c.k)) < 2 AS a FROM r JOIN c ON c.symbol = r.symbol AND c.trading_day = r.trading_day AND c.rn = r.rn + 1))
SELECT c.symbol, c.trading_day, c.bar_no, c.level, c.direction FROM r JOIN c USING (symbol, trading_day, rn) WHERE ok""")
def _(t):
    return sl.slot_cap(trades(t), 3, 2, 6)


@query("walk_forward_folds", "symbol fold:i role n_days:i first_day:d last_day:d", with_(DAY) + """
, d AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM day),
f AS (SELECT *, 500 + k * ((n - 500) // 6) AS te, CASE WHEN k = 5 THEN n ELSE 500 + (k + 1) * ((n - 500) // 6) END AS xe FROM d, generate_series(0, 5) g(k))
SELECT symbol, k AS fold, CASE WHEN i < te THEN 'train' ELSE 'test' END AS role, count(*) AS n_days, min(day) AS first_day, max(day) AS last_day FROM f WHERE i < xe GROUP BY 1, 2, 3""")
def _(t):
    f = sl.walk_forward_folds(t.day().select("symbol", "day"), 6, 500)
    return f.groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


# --- trades -----------------------------------------------------------------------------------------

M = "n_trades:i win_rate:f avg_pnl:f total_pnl:f max_pnl:f min_pnl:f avg_win:f avg_loss:f profit_factor:f payoff_ratio:f pct_stop:f pct_take:f pct_close:f"
MS = """count(*) AS n_trades, avg((pnl > 0)::INT) AS win_rate, avg(pnl) AS avg_pnl, sum(pnl) AS total_pnl, max(pnl) AS max_pnl, min(pnl) AS min_pnl, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_win, coalesce(avg(pnl) FILTER (pnl < 0), 0) AS avg_loss,
 sum(pnl) FILTER (pnl > 0) / nullif(-sum(pnl) FILTER (pnl < 0), 0) AS profit_factor, avg(pnl) FILTER (pnl > 0) / nullif(-avg(pnl) FILTER (pnl < 0), 0) AS payoff_ratio, avg((exit_type LIKE 'stop%')::INT) AS pct_stop, avg((exit_type = 'target')::INT) AS pct_take,
 avg((exit_type = 'timeout')::INT) AS pct_close"""


@query("trade_metrics", "symbol " + M + " max_day_share:f n_days_traded:i max_drawdown:f", with_(*TR) + f"""
, c AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) AS cum FROM tr), p AS (SELECT *, max(cum) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) - cum AS dd, count(*) OVER (PARTITION BY symbol, trading_day) AS nd FROM c)
SELECT symbol, {MS}, max(nd) / count(*) AS max_day_share, count(DISTINCT trading_day) AS n_days_traded, max(dd) AS max_drawdown FROM p GROUP BY 1""")
def _(t):
    return ev.trade_metrics(trades(t))


@query("group_metrics", "level tod " + M, with_(*TR) + f"SELECT level, CASE WHEN minute < 480 THEN 'open' WHEN minute < 600 THEN 'morning' WHEN minute < 690 THEN 'midday' ELSE 'late' END AS tod, {MS} FROM tr GROUP BY 1, 2")
def _(t):

    return ev.group_metrics(trades(t).withColumn("tod", tod_bucket("minute")), ["level", "tod"])


@query("daily_sharpe_metrics", "symbol n_trades:i mean_trades_per_day:f mean_pnl_per_day:f annualized_daily_sharpe:f zero_trade_day_rate:f zero_target_day_rate:f open_60_share:f post_open_60_share:f "
       "late_morning_120_share:f afternoon_150_share:f zero_post_open_60_day_rate:f zero_after_510_day_rate:f", with_(*TR) + """
, p AS (SELECT c.symbol, c.trading_day, coalesce(sum(pnl), 0) AS p, count(dt) AS n, count(*) FILTER (exit_type = 'target') AS tg, count(*) FILTER (minute >= 390 AND minute < 450) AS w1, count(*) FILTER (minute >= 450 AND minute < 510) AS w2,
 count(*) FILTER (minute >= 510 AND minute < 630) AS w3, count(*) FILTER (minute >= 630 AND minute < 780) AS w4 FROM cal c LEFT JOIN tr USING (symbol, trading_day) GROUP BY 1, 2)
SELECT symbol, sum(n) AS n_trades, avg(n) AS mean_trades_per_day, avg(p) AS mean_pnl_per_day, avg(p) / stddev_samp(p) * sqrt(252::DOUBLE) AS annualized_daily_sharpe, avg((p = 0)::INT) AS zero_trade_day_rate, avg((tg = 0)::INT) AS zero_target_day_rate,
 sum(w1) / sum(n) AS open_60_share, sum(w2) / sum(n) AS post_open_60_share, sum(w3) / sum(n) AS late_morning_120_share, sum(w4) / sum(n) AS afternoon_150_share, avg((w2 = 0)::INT) AS zero_post_open_60_day_rate, avg((w3 + w4 = 0)::INT) AS zero_after_510_day_rate FROM p GROUP BY 1""")
def _(t):
    return ev.daily_sharpe_metrics(trades(t), calendar(t))


@query("selection_metrics", "symbol n_selected:i mean_selected_per_day:f precision:f recall:f no_hit_day_rate:f", with_(*TR) + """
, p AS (SELECT c.symbol, c.trading_day, count(*) FILTER (score >= .6) AS ns, count(*) FILTER (score >= .6 AND y = 1) AS tp, count(*) FILTER (y = 1) AS pos FROM cal c LEFT JOIN tr USING (symbol, trading_day) GROUP BY 1, 2)
SELECT symbol, sum(ns) AS n_selected, avg(ns) AS mean_selected_per_day, sum(tp) / sum(ns) AS precision, sum(tp) / sum(pos) AS recall, avg((tp = 0)::INT) AS no_hit_day_rate FROM p GROUP BY 1""")
def _(t):
    return ev.selection_metrics(trades(t), calendar(t), F.col("score") >= 0.6, F.col("y") == 1)


@query("subset_baselines", "slice " + M, with_(*TR) + f"""
, s AS (SELECT *, 'all' AS slice FROM tr UNION ALL SELECT *, 'subset' FROM tr WHERE level IN ('vwap', 'prev_high') UNION ALL SELECT *, 'level:' || level FROM tr) SELECT slice, {MS} FROM s GROUP BY 1""")
def _(t):
    return ev.subset_baselines(trades(t), ["vwap", "prev_high"])


@query("signal_diversity", "symbol n_levels:i level_hhi:f long_share:f short_share:f early_share:f late_share:f", with_(*TR) + """
, l AS (SELECT symbol, level, count(*) AS n FROM tr GROUP BY 1, 2), h AS (SELECT symbol, count(*) AS n_levels, sum((n / t) * (n / t)) AS level_hhi FROM (SELECT *, sum(n) OVER (PARTITION BY symbol) AS t FROM l) GROUP BY 1)
SELECT symbol, any_value(n_levels) AS n_levels, any_value(level_hhi) AS level_hhi, avg((direction > 0)::INT) AS long_share, avg((direction < 0)::INT) AS short_share, avg((minute < 480)::INT) AS early_share, avg((minute >= 690)::INT) AS late_share FROM tr JOIN h USING (symbol) GROUP BY 1""")
def _(t):
    return ev.signal_diversity(trades(t))


@query("pnl_proxy", "symbol day:d position:i strategy_ret:f cum_ret:f", with_(DAY, SMA) + f"""
, a AS (SELECT symbol, day, close, CASE WHEN close > sma20 THEN 1 ELSE -1 END AS pos FROM sm),
b AS (SELECT symbol, day, coalesce({lag('pos')}, 0) AS position, coalesce({lag('pos')}, 0) * coalesce(close / {lag('close')} - 1, 0) AS strategy_ret FROM a)
SELECT *, sum(strategy_ret) OVER ({P} ROWS UNBOUNDED PRECEDING) AS cum_ret FROM b""")
def _(t):
    d = dl.with_smas(t.day(), (20,)).withColumn("pred", F.when(F.col("close") > F.col("sma20"), 2).otherwise(0))
    return ev.pnl_proxy(d, "pred")


# --- ranges -----------------------------------------------------------------------------------------

PRED = f"prd AS (SELECT * FROM (SELECT symbol, day, low, high, close, {lag('close')} - 1.2 * ({lag('high')} - {lag('low')}) AS pred_low, {lag('close')} + .8 * ({lag('high')} - {lag('low')}) AS pred_high FROM day) WHERE pred_low IS NOT NULL)"


def predicted(t):
    w = by(("symbol",), "day")
    pc, pr = F.lag("close").over(w), F.lag(F.col("high") - F.col("low")).over(w)
    return t.day().withColumns({"pred_low": pc - 1.2 * pr, "pred_high": pc + 0.8 * pr}).filter("pred_low IS NOT NULL")


CM = "n:i full_containment:f high_contained:f low_contained:f any_overlap:f avg_pred_width:f avg_realized_width:f width_ratio:f width_mae:f width_bias:f"
CMS = """count(*) AS n, avg((pred_low <= low AND pred_high >= high)::INT) AS full_containment, avg((high <= pred_high)::INT) AS high_contained, avg((low >= pred_low)::INT) AS low_contained, avg((pred_low <= high AND pred_high >= low)::INT) AS any_overlap,
 avg(pred_high - pred_low) AS avg_pred_width, avg(high - low) AS avg_realized_width, avg(pred_high - pred_low) / avg(high - low) AS width_ratio, avg(abs((pred_high - pred_low) - (high - low))) AS width_mae, avg((pred_high - pred_low) - (high - low)) AS width_bias"""


@query("containment_metrics", "symbol " + CM, with_(DAY, PRED) + f"SELECT symbol, {CMS} FROM prd GROUP BY 1")
def _(t):
    return ev.containment_metrics(predicted(t))


@query("fade_opportunity", "symbol pct_touch_high:f fade_high_win_rate:f n_touched_high:i pct_touch_low:f fade_low_win_rate:f n_touched_low:i", with_(DAY, PRED) + """
SELECT symbol, avg((high >= pred_high)::INT) AS pct_touch_high, count(*) FILTER (high >= pred_high AND close < pred_high) / nullif(count(*) FILTER (high >= pred_high), 0) AS fade_high_win_rate, count(*) FILTER (high >= pred_high) AS n_touched_high,
 avg((low <= pred_low)::INT) AS pct_touch_low, count(*) FILTER (low <= pred_low AND close > pred_low) / nullif(count(*) FILTER (low <= pred_low), 0) AS fade_low_win_rate, count(*) FILTER (low <= pred_low) AS n_touched_low FROM prd GROUP BY 1""")
def _(t):
    return ev.fade_opportunity(predicted(t))


@query("horizon_baseline", "symbol timeframe " + CM, with_(DAY, atr_sql("a14", "day", 14)) + f"""
, h AS (SELECT * FROM (VALUES ('daily', 1), ('weekly', 5), ('monthly', 21)) v(timeframe, h)),
x AS (SELECT symbol, day, {lag('close')} AS pc, {lag('atr')} AS a, row_number() OVER ({P}) AS rn, high, low FROM a14),
q AS (SELECT x.symbol, x.day, timeframe, x.pc - .7 * x.a * sqrt(h::DOUBLE) AS pred_low, x.pc + .7 * x.a * sqrt(h::DOUBLE) AS pred_high, max(y.high) AS high, min(y.low) AS low FROM x, h JOIN x y ON y.symbol = x.symbol AND y.rn BETWEEN x.rn AND x.rn + h - 1 WHERE x.pc IS NOT NULL GROUP BY ALL)
SELECT symbol, timeframe, {CMS} FROM q GROUP BY 1, 2""".replace("FROM x, h JOIN x y ON", "FROM x CROSS JOIN h JOIN x y ON"))
def _(t):
    return ev.horizon_baseline(dl.atr(t.day(), 14), {"daily": 1, "weekly": 5, "monthly": 21}, "atr_14")


@query("vol_regime_bucket", "symbol day:d vol_regime", with_(DAY, atr_sql("a14", "day", 14)) + """
, q AS (SELECT symbol, quantile_cont(atr, .2) AS lo, quantile_cont(atr, .8) AS hi FROM a14 GROUP BY 1) SELECT symbol, day, CASE WHEN atr <= lo THEN 'low' WHEN atr >= hi THEN 'high' ELSE 'mid' END AS vol_regime FROM a14 JOIN q USING (symbol)""")
def _(t):
    return ev.vol_regime_bucket(dl.atr(t.day(), 14), "atr_14")


@query("range_asymmetry", "symbol source regime n:i avg_upside:f avg_downside:f bias:f", with_(DAY, atr_sql("a14", "day", 14)) + f"""
, q AS (SELECT symbol, quantile_cont(atr, .2) AS lo, quantile_cont(atr, .8) AS hi FROM a14 GROUP BY 1),
d AS (SELECT symbol, day, CASE WHEN atr < lo THEN 'low_vol' WHEN atr > hi THEN 'high_vol' ELSE 'normal' END AS regime, {lag('close')} AS pc, {lag('high')} AS ph, {lag('low')} AS pl, high, low FROM a14 JOIN q USING (symbol)),
s AS (SELECT symbol, regime, 'realized' AS source, high - pc AS up, pc - low AS down, 10 AS least FROM d UNION ALL SELECT symbol, regime, 'predicted', ph - pc, pc - pl, 5 FROM d WHERE ph IS NOT NULL),
r AS (SELECT * FROM s UNION ALL SELECT symbol, 'all', source, up, down, 0 FROM s)
SELECT symbol, source, regime, count(*) AS n, avg(up) AS avg_upside, avg(down) AS avg_downside, avg(down) - avg(up) AS bias FROM r GROUP BY 1, 2, 3 HAVING count(*) >= max(least)""")
def _(t):
    w = by(("symbol",), "day")
    guess = t.day().select("symbol", "day", F.lag("high").over(w).alias("pred_high"), F.lag("low").over(w).alias("pred_low")).filter("pred_high IS NOT NULL")
    return ev.range_asymmetry(dl.atr(t.day(), 14), "atr_14", guess)


# --- scores -----------------------------------------------------------------------------------------

AUC = """
cum AS (SELECT score, count(*) AS n, sum(y) AS pos FROM ev GROUP BY 1),
cu2 AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS ge, sum(pos) OVER (ORDER BY score DESC) AS tge, sum(n - pos) OVER (ORDER BY score) - (n - pos) AS nb, sum(n) OVER () AS na, sum(pos) OVER () AS pa FROM cum),
auc AS (SELECT sum(pos * (nb + (n - pos) / 2)) / (max(pa) * (max(na) - max(pa))) AS auc, sum(pos * tge / ge) / max(pa) AS pr_auc FROM cu2)"""


@query("classification_metrics", "tp:i fp:i fn:i tn:i accuracy:f precision:f recall:f f1:f auc:f pr_auc:f", with_(EV, AUC) + """
, c AS (SELECT count(*) FILTER (score >= .5 AND y = 1) AS tp, count(*) FILTER (score >= .5 AND y = 0) AS fp, count(*) FILTER (score < .5 AND y = 1) AS fn, count(*) FILTER (score < .5 AND y = 0) AS tn FROM ev)
SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c, auc""")
def _(t):
    return ev.classification_metrics(scored_events(t), "score", "y")


@query("pr_threshold", "threshold:f precision:f recall:f", with_(EV, AUC) + "SELECT score AS threshold, tge / ge AS precision, tge / pa AS recall FROM cu2 WHERE tge / ge >= .6 ORDER BY recall DESC, score LIMIT 1")
def _(t):
    return ev.precision_constrained_threshold(scored_events(t), "score", "y", 0.6)


@query("threshold_for_recall", "threshold:f precision:f f1:f", with_(EV, AUC) + """
, b AS (SELECT score AS threshold, tge / ge AS precision FROM cu2 WHERE tge / pa >= .7 ORDER BY score DESC LIMIT 1) SELECT *, 2 * precision * .7 / (precision + .7) AS f1 FROM b""")
def _(t):
    return ev.threshold_for_recall(scored_events(t), "score", "y", 0.7)


@query("threshold_sweep", "threshold:f n_predicted:i tp:i fp:i fn:i precision:f recall:f win_rate:f mean_pnl:f total_pnl:f", with_(*TR) + """
SELECT threshold, count(*) FILTER (score >= threshold) AS n_predicted, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 1) AS fn,
 count(*) FILTER (score >= threshold AND y = 1) / greatest(count(*) FILTER (score >= threshold), 1) AS precision, count(*) FILTER (score >= threshold AND y = 1) / greatest(sum(y), 1) AS recall,
 coalesce(avg((pnl > 0)::INT) FILTER (score >= threshold), 0) AS win_rate, coalesce(avg(pnl) FILTER (score >= threshold), 0) AS mean_pnl, coalesce(sum(pnl) FILTER (score >= threshold), 0) AS total_pnl
FROM tr, (SELECT unnest([.5, .55, .6, .65, .7]::DOUBLE[]) AS threshold) GROUP BY 1""")
def _(t):
    return ev.threshold_sweep(trades(t), "score", "y", [0.5, 0.55, 0.6, 0.65, 0.7])


@query("calibration_metrics", "pos_mean_prob:f neg_mean_prob:f prob_cohens_d:f brier:f ece:f pr_auc:f", with_(EV, AUC) + """
, b AS (SELECT least(floor(score * 10), 9) AS b, count(*) AS n, sum(score) AS sp, sum(y) AS sy FROM ev GROUP BY 1)
SELECT avg(score) FILTER (y = 1) AS pos_mean_prob, avg(score) FILTER (y = 0) AS neg_mean_prob, (avg(score) FILTER (y = 1) - avg(score) FILTER (y = 0)) / sqrt((var_samp(score) FILTER (y = 1) + var_samp(score) FILTER (y = 0)) / 2) AS prob_cohens_d,
 avg((score - y) * (score - y)) AS brier, (SELECT sum(abs(sy - sp)) / sum(n) FROM b) AS ece, (SELECT pr_auc FROM auc) AS pr_auc FROM ev""")
def _(t):
    return ev.calibration_metrics(scored_events(t), "score", "y")


@query("effect_size", "event_type n_a:i n_b:i cohens_d:f", with_(EV) + """
, m AS (SELECT event_type, count(*) FILTER (y = 1) AS na, count(*) FILTER (y = 0) AS nb, avg(score) FILTER (y = 1) AS ma, avg(score) FILTER (y = 0) AS mb, var_samp(score) FILTER (y = 1) AS va, var_samp(score) FILTER (y = 0) AS vb FROM ev GROUP BY 1)
SELECT event_type, na AS n_a, nb AS n_b, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS cohens_d FROM m""")
def _(t):
    return ev.effect_size(scored_events(t), "score", F.col("y") == 1, ["event_type"])


KS = """
k0 AS (SELECT event_type, score, sum(y) AS p, count(*) - sum(y) AS q FROM ev GROUP BY 1, 2),
k1 AS (SELECT event_type, sum(p) OVER w / sum(p) OVER a AS fa, sum(q) OVER w / sum(q) OVER a AS fb, sum(p) OVER a AS na, sum(q) OVER a AS nb FROM k0 WINDOW w AS (PARTITION BY event_type ORDER BY score), a AS (PARTITION BY event_type)),
ks AS (SELECT event_type, max(abs(fa - fb)) AS ks, max(na) AS na, max(nb) AS nb FROM k1 GROUP BY 1)"""


@query("ks_stat", "event_type ks:f p_asymptotic:f", with_(EV, KS) + """
SELECT event_type, ks, greatest(least((SELECT sum(2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * ks * ks * na * nb / (na + nb))) FROM generate_series(1, 20) g(k)), 1), 0) AS p_asymptotic FROM ks""")
def _(t):
    return ev.ks_stat(scored_events(t), "score", F.col("y") == 1, ["event_type"])


@query("welch_t", "event_type n_a:i n_b:i mean_a:f mean_b:f t_stat:f p_value:f", with_(EV) + f"""
SELECT *, 2 * (1 - {cdf_sql('abs(t_stat)')}) AS p_value FROM (SELECT event_type, count(*) FILTER (y = 1) AS n_a, count(*) FILTER (y = 0) AS n_b, avg(score) FILTER (y = 1) AS mean_a, avg(score) FILTER (y = 0) AS mean_b,
 (avg(score) FILTER (y = 1) - avg(score) FILTER (y = 0)) / sqrt(var_samp(score) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(score) FILTER (y = 0) / count(*) FILTER (y = 0)) AS t_stat FROM ev GROUP BY 1)""")
def _(t):
    return ev.welch_t(scored_events(t), "score", F.col("y") == 1, ["event_type"])


@query("binom_vs_half", "event_type n:i hits:i share:f z_score:f p_value:f", with_(EV) + f"SELECT *, 2 * (1 - {cdf_sql('abs(z_score)')}) AS p_value FROM (SELECT event_type, count(*) AS n, sum(y) AS hits, avg(y) AS share, (sum(y) - count(*) / 2) / sqrt(count(*) / 4) AS z_score FROM ev GROUP BY 1)")
def _(t):
    return ev.binom_vs_half(scored_events(t), F.col("y") == 1, ["event_type"])


def bins_sql(n):
    qs = "[" + ", ".join(f"{i}/{n}::DOUBLE" for i in range(n + 1)) + "]"
    return f"eg AS (SELECT list_sort(list_distinct(quantile_cont(value, {qs}))) AS e FROM ev), bn AS (SELECT ev.*, greatest(len(list_filter(e, lambda x: x < value)) - 1, 0) AS bin FROM ev, eg)"


@query("quantile_bins", "bin:i n:i lo:f hi:f", with_(EV, bins_sql(10)) + "SELECT bin, count(*) AS n, min(value) AS lo, max(value) AS hi FROM bn GROUP BY 1")
def _(t):
    return ev.quantile_bins(scored_events(t), "value", 10).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("mutual_info_binned", "mutual_info:f n:i", with_(EV.replace("(value > 50)::INT AS y", "(" + HASH.format("event_id::VARCHAR") + " % 100 < value)::INT AS y"), bins_sql(10)) + """
, c AS (SELECT bin, y, count(*) AS n FROM bn GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY bin) AS r, sum(n) OVER (PARTITION BY y) AS k, sum(n) OVER () AS t FROM c) SELECT sum(n / t * ln(n * t / (r * k))) AS mutual_info, any_value(t) AS n FROM m""")
def _(t):
    e = t.table("events").withColumn("y", (sets.hash_order(F.col("event_id").cast("string")) % 100 < F.col("value")).cast("int"))
    return ev.mutual_info_binned(e, "value", "y", 10)


@query("conditional_rate", "bin:i n:i rate:f", with_(EV, bins_sql(5)) + "SELECT bin, count(*) AS n, avg((score > .5)::INT) AS rate FROM bn GROUP BY 1")
def _(t):
    return ev.conditional_rate(scored_events(t).withColumn("r", (F.col("score") > 0.5).cast("int")), "value", "r", 5)


@query("conditioned_rates", "condition n:i rate:f base_rate:f lift:f", with_(EV) + """
, c AS (SELECT 'low_value' AS condition, y, score FROM ev WHERE value < 30 UNION ALL SELECT 'mid_value', y, score FROM ev WHERE value BETWEEN 30 AND 80 UNION ALL SELECT 'signup_high', y, score FROM ev WHERE event_type = 'signup' AND value > 80)
SELECT condition, count(*) AS n, avg((score > .5)::INT) AS rate, (SELECT avg((score > .5)::INT) FROM ev) AS base_rate, avg((score > .5)::INT) - (SELECT avg((score > .5)::INT) FROM ev) AS lift FROM c GROUP BY 1""")
def _(t):
    e = scored_events(t).withColumn("r", (F.col("score") > 0.5).cast("int"))
    return ev.conditioned_rates(e, "r", {"low_value": F.col("value") < 30, "mid_value": F.col("value").between(30, 80), "signup_high": (F.col("event_type") == "signup") & (F.col("value") > 80)})


FT = ["open", "high", "low", "volume"]
CORR = "covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0)"


@query("feature_correlations", "feature corr:f", with_(DAY) + " UNION ALL ".join(f"SELECT '{f}' AS feature, {CORR.format(a=f, b='close')} AS corr FROM day" for f in FT))
def _(t):
    return ev.feature_correlations(t.day(), FT, "close")


@query("redundancy_matrix", "feature match corr:f verdict", with_(DAY) + ", p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS match, {CORR.format(a=a, b=b)} AS corr FROM day" for a in ("close", "volume") for b in ("open", "high", "low")) + """),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(corr) DESC, match DESC) AS rn FROM p) SELECT feature, match, corr, CASE WHEN abs(corr) >= .9 THEN 'redundant' WHEN abs(corr) >= .7 THEN 'high' ELSE 'ok' END AS verdict FROM r WHERE rn = 1""")
def _(t):
    return ev.redundancy_matrix(t.day(), ["close", "volume"], ["open", "high", "low"])


# --- resampling and gates ---------------------------------------------------------------------------

BOOT = f"""
dy AS (SELECT c.symbol, c.trading_day, row_number() OVER (PARTITION BY c.symbol ORDER BY c.trading_day) - 1 AS i, count(*) OVER (PARTITION BY c.symbol) AS nd, coalesce(b_n, 0) AS b_n, coalesce(b_wins, 0) AS b_wins, coalesce(b_pnl, 0) AS b_pnl, coalesce(e_n, 0) AS e_n, coalesce(e_wins, 0) AS e_wins, coalesce(e_pnl, 0) AS e_pnl
  FROM cal c LEFT JOIN (SELECT symbol, trading_day, count(*) FILTER (base_score >= .5) AS b_n, count(*) FILTER (base_score >= .5 AND pnl > 0) AS b_wins, coalesce(sum(pnl) FILTER (base_score >= .5), 0) AS b_pnl,
  count(*) FILTER (score >= .5) AS e_n, count(*) FILTER (score >= .5 AND pnl > 0) AS e_wins, coalesce(sum(pnl) FILTER (score >= .5), 0) AS e_pnl FROM tr GROUP BY 1, 2) USING (symbol, trading_day)),
dr AS (SELECT symbol, rep, {HASH.format("rep::VARCHAR || '|' || i::VARCHAR")} % nd AS j FROM dy, generate_series(0, 199) g(rep)),
bs AS (SELECT dr.symbol, rep, sum(e_wins) / sum(e_n) - sum(b_wins) / sum(b_n) AS wr, sum(e_pnl) / sum(e_n) - sum(b_pnl) / sum(b_n) AS pn FROM dr JOIN dy ON dy.symbol = dr.symbol AND dy.i = dr.j GROUP BY 1, 2),
boot AS (SELECT symbol, avg(wr) AS delta_wr_mean, quantile_cont(wr, .025) AS delta_wr_ci_low, quantile_cont(wr, .975) AS delta_wr_ci_high, avg(pn) AS delta_pnl_mean, quantile_cont(pn, .025) AS delta_pnl_ci_low, quantile_cont(pn, .975) AS delta_pnl_ci_high FROM bs GROUP BY 1)"""


def paired_days(t):
    hit = lambda s: F.col(s) >= 0.5
    n = lambda c: F.sum(c.cast("int"))
    win = F.col("pnl") > 0
    per = trades(t).groupBy("symbol", "trading_day").agg(
        n(hit("base_score")).alias("b_n"), n(hit("base_score") & win).alias("b_wins"), F.sum(F.when(hit("base_score"), F.col("pnl")).otherwise(0.0)).alias("b_pnl"),
        n(hit("score")).alias("e_n"), n(hit("score") & win).alias("e_wins"), F.sum(F.when(hit("score"), F.col("pnl")).otherwise(0.0)).alias("e_pnl"))
    w = by(("symbol",), "trading_day")
    d = calendar(t).withColumns({"index": F.row_number().over(w) - 1, "n_days": F.count(F.lit(1)).over(whole(["symbol"]))})
    return d.join(per, ["symbol", "trading_day"], "left").fillna(0)


@query("paired_day_bootstrap", "symbol delta_wr_mean:f delta_wr_ci_low:f delta_wr_ci_high:f delta_pnl_mean:f delta_pnl_ci_low:f delta_pnl_ci_high:f", with_(*TR, BOOT) + "SELECT * FROM boot")
def _(t):
    return ev.paired_day_bootstrap(paired_days(t), 200)


AUC = """
ix AS (SELECT symbol, trading_day, i, nd FROM dy), sc AS (SELECT ix.symbol, i, y, unnest(['b', 'e']) AS run, unnest([base_score, score]) AS s FROM tr JOIN ix USING (symbol, trading_day)),
dm AS (SELECT symbol, rep, j, count(*) AS times FROM dr GROUP BY 1, 2, 3 UNION ALL SELECT symbol, -1, i, 1 FROM ix),
wt AS (SELECT sc.symbol, rep, run, s, sum(times) AS n, sum(times * y) AS pos FROM sc JOIN dm ON dm.symbol = sc.symbol AND dm.j = sc.i GROUP BY 1, 2, 3, 4),
rk AS (SELECT *, sum(n - pos) OVER (PARTITION BY symbol, rep, run ORDER BY s) - (n - pos) AS below FROM wt),
ra AS (SELECT symbol, rep, run, sum(pos * (below + (n - pos) / 2::DOUBLE)) / nullif(sum(pos) * sum(n - pos), 0) AS auc FROM rk GROUP BY 1, 2, 3),
rd AS (SELECT symbol, rep, max(auc) FILTER (run = 'e') - max(auc) FILTER (run = 'b') AS d FROM ra GROUP BY 1, 2)"""


@query("paired_auc_bootstrap", "symbol delta_auc:f delta_auc_ci_low:f delta_auc_ci_high:f", with_(*TR, BOOT, AUC) + """
SELECT symbol, max(d) FILTER (rep < 0) AS delta_auc, quantile_cont(d, .025) FILTER (rep >= 0) AS delta_auc_ci_low, quantile_cont(d, .975) FILTER (rep >= 0) AS delta_auc_ci_high FROM rd GROUP BY 1""")
def _(t):
    return ev.paired_auc_bootstrap(paired_days(t), trades(t), "y", "base_score", "score", 200)


@query("acceptance_gate", "symbol pass_min_trades:i pass_payoff:i pass_expectancy:i pass_incremental_ci:i pass_all:i", with_(*TR, BOOT) + """
, m AS (SELECT symbol, count(*) AS n, avg(pnl) FILTER (pnl > 0) / nullif(-avg(pnl) FILTER (pnl < 0), 0) AS payoff, avg(pnl) AS e FROM tr WHERE score >= .5 GROUP BY 1),
g AS (SELECT symbol, (n >= 100)::INT AS pass_min_trades, (payoff >= 1.2)::INT AS pass_payoff, (e >= 1)::INT AS pass_expectancy, (delta_pnl_ci_low > 0)::INT AS pass_incremental_ci FROM m JOIN boot USING (symbol))
SELECT *, least(pass_min_trades, pass_payoff, pass_expectancy, pass_incremental_ci) AS pass_all FROM g""")
def _(t):
    m = ev.group_metrics(trades(t).filter("score >= 0.5"), ["symbol"]).join(ev.paired_day_bootstrap(paired_days(t), 200), "symbol")
    return ev.acceptance_gate(m, {"min_trades": F.col("n_trades") >= 100, "payoff": F.col("payoff_ratio") >= 1.2, "expectancy": F.col("avg_pnl") >= 1, "incremental_ci": F.col("delta_pnl_ci_low") > 0})


@query("accuracy_by_minute", "minute:i n:i accuracy:f", with_(*TR) + "SELECT minute, count(*) AS n, avg(((score >= .5)::INT = y)::INT) AS accuracy FROM tr GROUP BY 1")
def _(t):
    return ev.accuracy_by_minute(trades(t), (F.col("score") >= 0.5).cast("int"), F.col("y"))


@query("label_crosstab", "quality:i toxic:i n:i row_share:f agreement:f", """
SELECT quality, toxic, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY quality) AS row_share, (SELECT avg((quality = toxic)::INT) FROM labels) AS agreement FROM labels GROUP BY 1, 2""")
def _(t):
    return ev.label_crosstab(t.table("labels"), "quality", "toxic")


@query("sample_weights", "doc_id:i class_weight:f weight:f", """
WITH n AS (SELECT quality, count(*) AS c FROM labels GROUP BY 1), w AS (SELECT quality, (SELECT count(*) FROM labels) / ((SELECT count(*) FROM n) * c) AS class_weight FROM n)
SELECT doc_id, class_weight, class_weight * (1 + (1 - doc_id % 100 / 100.0::DOUBLE) * (1 - doc_id % 100 / 100.0::DOUBLE)) * CASE WHEN toxic = 1 THEN .5 ELSE 1 END * CASE WHEN doc_id % 2 = 0 THEN 1.25 ELSE 1 END AS weight FROM labels JOIN w USING (quality)""")
def _(t):
    d = t.table("labels").withColumn("progress", F.col("doc_id") % 100 / 100.0)
    return ev.sample_weights(d, "quality", "progress", 2.0, {"toxic": (F.col("toxic") == 1, 0.5), "even": (F.col("doc_id") % 2 == 0, 1.25)})


@query("augment_mirror", "symbol dt:t direction:i y:i mirrored:i", with_(*TR) + "SELECT symbol, dt, direction, y, 0 AS mirrored FROM tr UNION ALL SELECT symbol, dt, -direction, 0, 1 FROM tr WHERE y = 1")
def _(t):
    return ev.augment_mirror(trades(t).select("symbol", "dt", "direction", "y"), outcome="y")


@query("parity_check", "metric left_value:f right_value:f gap:f ok:i", with_(BAR, DAY) + """
, a AS (SELECT symbol AS metric, sum(close) AS v FROM bar GROUP BY 1), b AS (SELECT symbol AS metric, sum(close) + CASE symbol WHEN 'view' THEN 1 ELSE 0 END AS v FROM bar WHERE symbol <> 'click' GROUP BY 1)
SELECT coalesce(a.metric, b.metric) AS metric, a.v AS left_value, b.v AS right_value, abs(a.v - b.v) AS gap, coalesce((abs(a.v - b.v) <= 1e-6)::INT, 0) AS ok FROM a FULL JOIN b ON a.metric = b.metric""")
def _(t):
    a = t.bar().groupBy(F.col("symbol").alias("metric")).agg(F.sum("close").alias("value"))
    b = a.filter("metric <> 'click'").withColumn("value", F.col("value") + F.when(F.col("metric") == "view", 1).otherwise(0))
    return ev.parity_check(a, b)


STATE = f"""
mi AS (SELECT symbol, day, close, lead(close) OVER ({P}) / close - 1 AS nr, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rd FROM day),
st AS (SELECT mi.symbol, mi.day, close, CASE WHEN nr IS NULL THEN -1 WHEN nr > .003 THEN 2 WHEN nr < -.003 THEN 0 ELSE 1 END AS actual, sma20 - sma50 AS trend, CASE WHEN volume >= 200 THEN .2 ELSE .33 END AS p0, CASE WHEN volume >= 200 THEN .3 ELSE .34 END AS p1, CASE WHEN volume >= 200 THEN .5 ELSE .33 END AS p2
  FROM mi JOIN sm USING (symbol, day) WHERE rd <= 250),
stp AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS predicted FROM st)"""


def state(t):
    base = lb.micro_regime(t.day()).select("symbol", "day", "close", F.col("micro_regime").alias("actual"))
    trend = dl.with_smas(t.day(), (20, 50)).select("symbol", "day", (F.col("sma20") - F.col("sma50")).alias("trend"))
    probs = t.day().filter("volume >= 200").select("symbol", "day", F.lit(0.2).alias("p0"), F.lit(0.3).alias("p1"), F.lit(0.5).alias("p2"))
    return ev.state_table(base, [trend], probs, 250)


@query("state_table", "symbol day:d close:f trend:f p0:f p1:f p2:f predicted:i actual:i", with_(DAY, SMA, STATE).replace("close, CASE WHEN nr", "mi.close, CASE WHEN nr") + "SELECT * FROM stp")
def _(t):
    return state(t)


@query("state_accuracy", "n:i accuracy:f macro_f1:f", with_(DAY, SMA, STATE).replace("close, CASE WHEN nr", "mi.close, CASE WHEN nr") + """
, c AS (SELECT k, count(*) FILTER (predicted = k AND actual = k) AS tp, count(*) FILTER (predicted = k) AS p, count(*) FILTER (actual = k) AS a FROM stp, generate_series(0, 2) g(k) WHERE actual >= 0 GROUP BY 1)
SELECT count(*) AS n, avg((predicted = actual)::INT) AS accuracy, (SELECT avg(coalesce(2 * tp / nullif(p + a, 0), 0)) FROM c) AS macro_f1 FROM stp WHERE actual >= 0""")
def _(t):
    return ev.macro_f1(state(t), "predicted", "actual", (0, 1, 2))
