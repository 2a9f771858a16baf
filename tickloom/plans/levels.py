"""Level interaction and forward-outcome queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.windows import by
from tickloom.operators import bars, intraday as it, labels as lb, levels as lv
from tickloom.plans.adapters import BAR, DAY, with_
from tickloom.plans.catalog import query
from tickloom.plans.intraday import B, LEVELS, PREV, VWAP, W_DAY
from tickloom.plans.sqlkit import P, lag

NAMES = lv.LEVELS
FULL = "wide AS (SELECT lv.*, p.prev_high, p.prev_low FROM lv JOIN prev p USING (symbol, trading_day))"
_D = {c: f"coalesce(abs(close - {c}), 1e18)" for c in NAMES}
NEAREST = f"""
nd AS (SELECT *, least({', '.join(_D.values())}) AS d0 FROM wide),
near_all AS (SELECT *, CASE WHEN d0 < 1e18 THEN CASE {' '.join(f"WHEN {_D[c]} = d0 THEN '{c}'" for c in NAMES)} END END AS nearest_all,
  CASE WHEN d0 < 1e18 THEN CASE {' '.join(f"WHEN {_D[c]} = d0 THEN {c}" for c in NAMES)} END END AS price_all FROM nd),
near AS (SELECT *, CASE WHEN d0 <= 5 THEN nearest_all END AS nearest_level, CASE WHEN d0 <= 5 THEN price_all END AS level_price, CASE WHEN d0 <= 5 THEN d0 END AS level_distance FROM near_all),
sided AS (SELECT *, CASE WHEN level_price IS NULL THEN 0 WHEN close >= level_price THEN 1 ELSE -1 END AS side FROM near)"""
ALL = (BAR, VWAP, LEVELS, PREV, FULL, NEAREST)


def leveled(t):
    return it.price_levels(t.bar())


def sided(t):
    return lv.level_side(lv.nearest_level(leveled(t)))


@query("nearest_level", "symbol dt:t nearest_level level_price:f level_distance:f", with_(*ALL) + "SELECT symbol, dt, nearest_level, level_price, level_distance FROM near")
def _(t):
    return lv.nearest_level(leveled(t))


@query("level_side", "symbol dt:t side:i", with_(*ALL) + "SELECT symbol, dt, side FROM sided")
def _(t):
    return sided(t)


@query("level_group", "level_group n:i", with_(*ALL) + """
SELECT CASE WHEN nearest_level LIKE 'vwap%' THEN 'vwap' WHEN nearest_level LIKE 'ovn%' THEN 'overnight' WHEN nearest_level LIKE 'rth%' THEN 'rth' WHEN nearest_level LIKE 'prev%' THEN 'prior_day' ELSE 'other' END AS level_group,
 count(*) AS n FROM near WHERE nearest_level IS NOT NULL GROUP BY 1""")
def _(t):
    return lv.nearest_level(leveled(t)).filter("nearest_level IS NOT NULL").groupBy(lv.level_group(F.col("nearest_level")).alias("level_group")).agg(F.count(F.lit(1)).alias("n"))


@query("level_confluence", "symbol dt:t level_distance_norm:f n_levels_within_3pt:i n_levels_within_5pt:i level_cluster_score:f level_type_strength:i", with_(*ALL) + f"""
, a AS (SELECT symbol, dt, d0 / greatest(close, 1) * 1000 AS level_distance_norm, nearest_all, list_filter([{', '.join(f"CASE WHEN nearest_all <> '{c}' THEN abs({c} - price_all) END" for c in NAMES)}], lambda x: x IS NOT NULL) AS away FROM near_all)
SELECT symbol, dt, level_distance_norm, len(list_filter(away, lambda x: x <= 3)) AS n_levels_within_3pt, len(list_filter(away, lambda x: x <= 5)) AS n_levels_within_5pt,
 coalesce(list_sum(list_transform(away, lambda x: exp(-x / 2))), 0) AS level_cluster_score, CASE WHEN nearest_all = 'vwap' THEN 3 WHEN nearest_all LIKE 'prev%' THEN 1 WHEN nearest_all IS NULL THEN 0 ELSE 2 END AS level_type_strength FROM a""")
def _(t):
    return lv.level_confluence(leveled(t))


HYST = """
hs AS (SELECT *, CASE WHEN level_price IS NULL THEN NULL WHEN close - level_price >= 1 THEN 1 WHEN close - level_price <= -1 THEN -1
  WHEN row_number() OVER (PARTITION BY symbol, trading_day, nearest_level ORDER BY dt) = 1 THEN CASE WHEN close >= level_price THEN 1 ELSE -1 END END AS st FROM near),
hside AS (SELECT *, coalesce(last_value(st IGNORE NULLS) OVER (PARTITION BY symbol, trading_day, nearest_level ORDER BY dt ROWS UNBOUNDED PRECEDING), 0) AS hyst_side FROM hs)"""


@query("level_side_hysteresis", "symbol dt:t side:i", with_(*ALL, HYST) + "SELECT symbol, dt, hyst_side AS side FROM hside")
def _(t):
    return lv.level_side_hysteresis(lv.nearest_level(leveled(t)), 0.5, 1.0)


@query("episode_state", "symbol dt:t level_side_touch_count_day:i bars_since_last_level_side_touch:i level_side_touch_density_30:i level_side_flip_count_day:i level_reclaim_count_day:i bars_since_last_reclaim:i "
       "last_reclaim_dwell_bars:i last_reclaim_penetration_pts:f is_reclaim_bar:i level_touch_count_any_side_day:i bars_since_last_level_touch_any_side:i level_touch_density_any_30:i current_run_bars:i "
       "current_run_max_penetration_pts:f", with_(*ALL) + """
, t0 AS (SELECT symbol, trading_day, dt, bar_no, nearest_level AS l, side, abs(close - level_price) AS pen, coalesce((lag(side) OVER w <> side)::INT, 0) AS flip FROM sided WHERE side <> 0
  WINDOW w AS (PARTITION BY symbol, trading_day, nearest_level ORDER BY bar_no)),
t1 AS (SELECT *, sum(flip) OVER (PARTITION BY symbol, trading_day, l ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS run FROM t0),
runs AS (SELECT symbol, trading_day, l, run, min(bar_no) AS s, max(pen) AS mp FROM t1 GROUP BY 1, 2, 3, 4),
t2 AS (SELECT t1.*, r.s, max(pen) OVER (PARTITION BY t1.symbol, t1.trading_day, t1.l, t1.run ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS rmp, CASE WHEN flip = 1 THEN bar_no - q.s END AS dwell, CASE WHEN flip = 1 THEN q.mp END AS rp,
  CASE WHEN flip = 1 THEN bar_no END AS atb FROM t1 JOIN runs r USING (symbol, trading_day, l, run) LEFT JOIN runs q ON q.symbol = t1.symbol AND q.trading_day = t1.trading_day AND q.l = t1.l AND q.run = t1.run - 1)
SELECT symbol, dt, count(*) OVER ws - 1 AS level_side_touch_count_day, coalesce(bar_no - lag(bar_no) OVER wo, 9999) AS bars_since_last_level_side_touch, count(*) OVER wr AS level_side_touch_density_30,
 run AS level_side_flip_count_day, sum(flip) OVER ws AS level_reclaim_count_day, coalesce(bar_no - max(atb) OVER ws, 9999) AS bars_since_last_reclaim, coalesce(last_value(dwell IGNORE NULLS) OVER ws, 0) AS last_reclaim_dwell_bars,
 coalesce(last_value(rp IGNORE NULLS) OVER ws, 0) AS last_reclaim_penetration_pts, flip AS is_reclaim_bar, count(*) OVER wa - 1 AS level_touch_count_any_side_day, coalesce(bar_no - lag(bar_no) OVER wb, 9999) AS bars_since_last_level_touch_any_side,
 count(*) OVER wc AS level_touch_density_any_30, bar_no - s AS current_run_bars, rmp AS current_run_max_penetration_pts FROM t2
WINDOW ws AS (PARTITION BY symbol, trading_day, l, side ORDER BY bar_no ROWS UNBOUNDED PRECEDING), wo AS (PARTITION BY symbol, trading_day, l, side ORDER BY bar_no), wr AS (PARTITION BY symbol, trading_day, l, side ORDER BY bar_no RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING),
 wa AS (PARTITION BY symbol, trading_day, l ORDER BY bar_no ROWS UNBOUNDED PRECEDING), wb AS (PARTITION BY symbol, trading_day, l ORDER BY bar_no), wc AS (PARTITION BY symbol, trading_day, l ORDER BY bar_no RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING)""")
def _(t):
    return lv.episode_state(sided(t))


@query("direction_stability", "symbol dt:t same_level_side_run_bars:i bars_since_same_level_side_flip:i same_level_side_flip_count_10:i same_level_cross_count_10:i same_level_side_stability_10:f aligned_return_frac_5:f",
       with_(*ALL) + """
, a AS (SELECT symbol, trading_day, dt, bar_no, nearest_level AS l, side, row_number() OVER w AS j, nullif(sign(close - level_price), 0) AS sg, coalesce((lag(side) OVER w <> side)::INT, 0) AS flip, coalesce(((close - lag(close) OVER w) * side > 0)::INT, 0) AS good
  FROM sided WHERE side <> 0 WINDOW w AS (PARTITION BY symbol, trading_day, nearest_level ORDER BY bar_no)),
b AS (SELECT *, coalesce((sg <> last_value(sg IGNORE NULLS) OVER (PARTITION BY symbol, trading_day, l ORDER BY bar_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 0) AS crs, max(CASE WHEN flip = 1 THEN j END) OVER (PARTITION BY symbol, trading_day, l ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS lf FROM a),
c AS (SELECT *, sum(flip) OVER f AS f10, sum(crs) OVER f AS c10, avg(good) OVER (PARTITION BY symbol, trading_day, l ORDER BY bar_no ROWS 4 PRECEDING) AS g5 FROM b WINDOW f AS (PARTITION BY symbol, trading_day, l ORDER BY bar_no ROWS 9 PRECEDING))
SELECT symbol, dt, j - coalesce(lf, 1) + 1 AS same_level_side_run_bars, coalesce(j - lf, j) AS bars_since_same_level_side_flip, f10 AS same_level_side_flip_count_10, c10 AS same_level_cross_count_10, 1.0::DOUBLE / (1 + f10 + c10) AS same_level_side_stability_10,
 g5 AS aligned_return_frac_5 FROM c""")
def _(t):
    return lv.direction_stability(sided(t))


@query("level_encoding", "symbol dt:t is_vwap:i is_ovn_hi:i is_prev_low:i level_is_support:i level_side_bb_interaction:f approach_dir_vs_level:i", with_(*ALL) + """
, a AS (SELECT *, close - lag(close, 5) OVER (PARTITION BY symbol ORDER BY dt) AS chg, (close - low) / greatest(high - low, .01) AS pb FROM sided)
SELECT symbol, dt, coalesce((nearest_level = 'vwap')::INT, 0) AS is_vwap, coalesce((nearest_level = 'ovn_hi')::INT, 0) AS is_ovn_hi, coalesce((nearest_level = 'prev_low')::INT, 0) AS is_prev_low, (side = 1)::INT AS level_is_support, (side = 1)::INT * pb AS level_side_bb_interaction,
 CASE WHEN level_price IS NULL OR chg IS NULL THEN 0 WHEN close >= level_price THEN CASE WHEN chg < 0 THEN -1 ELSE 1 END ELSE CASE WHEN chg > 0 THEN 1 ELSE -1 END END AS approach_dir_vs_level FROM a""")
def _(t):
    df = sided(t).withColumn("pb", (F.col("close") - F.col("low")) / it.bar_range())
    return lv.level_encoding(df, pct_b="pb", block_rows=B)


FWD = "ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING"


def rb_sql(per_day: bool, src: str = "sided", n: int = 45, ambiguous: bool = False) -> str:
    """CTE rb: first touches by a range self join."""
    day = "AND a.trading_day = b.trading_day" if per_day else ""
    hit = {"r": "CASE WHEN a.side > 0 THEN b.high >= a.close + 6 ELSE b.low <= a.close - 6 END", "b": "CASE WHEN a.side > 0 THEN b.low <= a.level_price - 4 ELSE b.high >= a.level_price + 4 END",
           "orr": "CASE WHEN a.side < 0 THEN b.high >= a.close + 6 ELSE b.low <= a.close - 6 END", "ob": "CASE WHEN a.side < 0 THEN b.low <= a.level_price - 4 ELSE b.high >= a.level_price + 4 END"}
    firsts = ", ".join(f"coalesce(min(b.gn - a.gn) FILTER ({e}), 9999) AS {k}" for k, e in hit.items())
    call = lambda r, b: f"CASE WHEN {r} < {b} THEN 'reversal' WHEN {b} < {r} THEN 'breakout' ELSE 'inconclusive' END"
    clash = "o <> 'inconclusive' AND o <> a0 AND least(orr, ob) <= least(r, b) + 2"
    return f"""
rbg AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS gn, count(*) OVER (PARTITION BY symbol, trading_day) AS nday FROM {src}),
rb0 AS (SELECT a.symbol, a.trading_day, a.dt, a.nearest_level, a.side, a.close, a.nday, {firsts} FROM rbg a LEFT JOIN rbg b ON a.symbol = b.symbol {day} AND b.gn BETWEEN a.gn + 1 AND a.gn + {n} WHERE a.side <> 0 GROUP BY ALL),
rb1 AS (SELECT *, {call('r', 'b')} AS a0, {call('orr', 'ob')} AS o FROM rb0),
rb AS (SELECT *, {f"CASE WHEN {clash} THEN 'inconclusive' ELSE a0 END" if ambiguous else 'a0'} AS outcome FROM rb1{' WHERE nday >= 20' if per_day else ''})"""


RB_OUT = " SELECT symbol, dt, nearest_level, outcome, CASE WHEN outcome = 'inconclusive' THEN 0 ELSE least(r, b) END AS bars_to_event, CASE outcome WHEN 'inconclusive' THEN .15 WHEN 'reversal' THEN exp(-.3 * least(r, b)) ELSE 0 END AS p_reversal FROM rb"


@query("reversal_breakout", "symbol dt:t nearest_level outcome bars_to_event:i p_reversal:f", with_(*ALL, rb_sql(True, ambiguous=True)) + RB_OUT)
def _(t):
    return lb.reversal_breakout(sided(t), drop_ambiguous=True)


@query("reversal_breakout_unbounded", "symbol dt:t nearest_level outcome bars_to_event:i p_reversal:f", with_(*ALL, rb_sql(False)) + RB_OUT)
def _(t):
    return lb.reversal_breakout(sided(t), per_day=False, block_rows=B)


@query("trailing_level_rate", "symbol trading_day:d nearest_level rev_rate_20d:f rev_rate_50d:f", with_(*ALL, rb_sql(True)) + f"""
, s AS (SELECT symbol, trading_day, nearest_level, count(*) FILTER (outcome = 'reversal') AS nr, count(*) AS nt FROM rb WHERE outcome <> 'inconclusive' GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT symbol, trading_day, l AS nearest_level FROM bar, (SELECT unnest([{', '.join(f"'{c}'" for c in NAMES)}]) AS l)),
d AS (SELECT g.*, coalesce(nr, 0) AS nr, coalesce(nt, 0) AS nt FROM g LEFT JOIN s USING (symbol, trading_day, nearest_level)),
r AS (SELECT *, sum(nr) OVER f / greatest(sum(nt) OVER f, 1) AS r20, sum(nr) OVER h / greatest(sum(nt) OVER h, 1) AS r50 FROM d WINDOW f AS (PARTITION BY symbol, nearest_level ORDER BY trading_day ROWS 19 PRECEDING), h AS (PARTITION BY symbol, nearest_level ORDER BY trading_day ROWS 49 PRECEDING))
SELECT symbol, trading_day, nearest_level, lag(r20) OVER w AS rev_rate_20d, lag(r50) OVER w AS rev_rate_50d FROM r WINDOW w AS (PARTITION BY symbol, nearest_level ORDER BY trading_day)""")
def _(t):
    df = lb.reversal_breakout(sided(t)).withColumn("outcome", F.when(F.col("outcome") == "reversal", 1).when(F.col("outcome") == "breakout", 0))
    return lv.trailing_level_rate(df, t.bar().select("symbol", "trading_day").distinct())


def stack_sql(cols, src="wide", keep="symbol, trading_day, dt, bar_no, open, high, low, close, ovn"):
    return " UNION ALL ".join(f"SELECT {keep}, '{c}' AS level, {c} AS level_price FROM {src} WHERE {c} IS NOT NULL" for c in cols)


BRK = f"""
wp AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY dt) AS prev_close FROM wide),
brk0 AS ({stack_sql(NAMES, 'wp', 'symbol, trading_day, dt, bar_no, close, prev_close, ovn')}),
brk AS (SELECT *, 1 AS direction FROM brk0 WHERE ovn = 0 AND prev_close <= level_price AND close >= level_price UNION ALL SELECT *, -1 FROM brk0 WHERE ovn = 0 AND prev_close >= level_price AND close <= level_price)"""
REV = f"""
rev0 AS ({stack_sql(NAMES)}),
revt AS (SELECT * FROM (SELECT *, CASE WHEN open > level_price AND low <= level_price AND close > level_price THEN 1 WHEN open < level_price AND high >= level_price AND close < level_price THEN -1 END AS direction FROM rev0 WHERE ovn = 0) WHERE direction IS NOT NULL)"""
WIDE = (BAR, VWAP, LEVELS, PREV, FULL)


@query("breakout_triggers", "symbol dt:t level level_price:f direction:i", with_(*WIDE, BRK) + "SELECT symbol, dt, level, level_price, direction FROM brk")
def _(t):
    return lv.breakout_triggers(leveled(t), block_rows=B)


@query("reversion_triggers", "symbol dt:t level level_price:f direction:i", with_(*WIDE, REV) + "SELECT symbol, dt, level, level_price, direction FROM revt")
def _(t):
    return lv.reversion_triggers(leveled(t))


RETEST = """
gb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS gn FROM bar),
rt0 AS (SELECT t.symbol, t.dt, t.level, t.level_price, t.direction, least(.1 * level_price, 12) AS risk, least(.05 * level_price, least(.1 * level_price, 12) * .5) AS thr, g.gn FROM brk t JOIN gb g USING (symbol, dt)),
rt1 AS (SELECT r.symbol, r.dt, r.level, r.level_price, r.direction, r.risk, min(b.gn) AS en FROM rt0 r JOIN gb b ON b.symbol = r.symbol AND b.gn BETWEEN r.gn + 1 AND r.gn + 12 AND abs(b.close - r.level_price) <= r.thr GROUP BY ALL),
retest AS (SELECT r.symbol, r.dt, r.level, r.level_price, r.direction, r.risk, b.dt AS entry_ts, b.trading_day, b.bar_no, b.close AS entry_price, b.close - r.direction * r.risk AS stop, b.close + r.direction * 2 * r.risk AS target FROM rt1 r JOIN gb b ON b.symbol = r.symbol AND b.gn = r.en)"""


def retests(t):
    return lv.retest_entries(lv.breakout_triggers(leveled(t), block_rows=B).drop("prev_close", "close"), t.bar(), 12, 0.05, 0.1, 12, 2.0, block_rows=B)


@query("retest_entries", "symbol dt:t level direction:i entry_ts:t entry_price:f stop:f target:f risk:f", with_(*WIDE, BRK, RETEST) + "SELECT symbol, dt, level, direction, entry_ts, entry_price, stop, target, risk FROM retest")
def _(t):
    return retests(t)


@query("touch_signals_batch", "symbol level direction:i dt:t kind", with_(*WIDE, BRK, REV) + """
SELECT symbol, level, direction, dt, max(kind) AS kind FROM (SELECT symbol, level, direction, dt, 'breakout' AS kind FROM brk UNION ALL SELECT symbol, level, direction, dt, 'reversion' FROM revt) GROUP BY 1, 2, 3, 4""")
def _(t):
    return lv.touch_signals(leveled(t), block_rows=B)


@query("candidates_to_bars", "symbol dt:t source direction:i quality:f rank:i close:f", with_(*WIDE, BRK, REV) + """
, c AS (SELECT symbol, dt, 'breakout' AS source, direction, max(level_price) AS quality FROM brk GROUP BY ALL UNION ALL SELECT symbol, dt, 'reversion', direction, max(level_price) + 1 FROM revt GROUP BY ALL)
SELECT c.symbol, dt, source, direction, quality, row_number() OVER (PARTITION BY c.symbol, dt ORDER BY quality DESC, source, direction) AS rank, close FROM c JOIN bar USING (symbol, dt)""")
def _(t):
    q = lambda df, k: df.groupBy("symbol", "dt", "direction").agg((F.max("level_price") + k).alias("quality"))
    x = leveled(t)
    return lv.candidates_to_bars({"breakout": q(lv.breakout_triggers(x, block_rows=B), 0), "reversion": q(lv.reversion_triggers(x), 1)}, t.bar())


@query("trend_pullback_filter", "symbol dt:t trend_proxy:f pullback:f", with_(BAR, VWAP) + f"""
, a AS (SELECT *, max((minute >= 390)::INT) OVER w AS on_, arg_min(CASE WHEN minute >= 390 THEN open END, CASE WHEN minute >= 390 THEN dt END) OVER (PARTITION BY symbol, trading_day) AS ro,
  (volume - avg(volume) OVER f) / (stddev_samp(volume) OVER f + 1e-6) AS vz FROM vw WINDOW {W_DAY}, f AS (PARTITION BY symbol, trading_day ORDER BY dt ROWS 19 PRECEDING)),
b AS (SELECT *, max(high) FILTER (on_ = 1) OVER w AS rh, min(low) FILTER (on_ = 1) OVER w AS rl FROM a WINDOW {W_DAY}),
c AS (SELECT symbol, dt, CASE WHEN on_ = 1 THEN abs(close - ro) / greatest(rh - rl, .25) ELSE 0 END * sign(CASE WHEN on_ = 1 THEN close - ro ELSE 0 END) AS trend_proxy, abs(close - vwap) / greatest(vwap, 1e-6) AS pullback, vz FROM b)
SELECT symbol, dt, trend_proxy, pullback FROM c WHERE abs(trend_proxy) >= .2 AND pullback <= .2 AND vz >= 0""")
def _(t):
    return lv.trend_pullback_filter(it.volume_z(it.session_position(t.bar())), 0.2, 0.2, 0.0)


@query("day_gate", "symbol trading_day:d spec n_passed:i active:i", with_(BAR, VWAP) + """
, d AS (SELECT symbol, trading_day, (max(high) >= 150)::INT + (max(volume) >= 12)::INT + (max(vwap_std) >= 40)::INT AS n_passed FROM vw WHERE minute <= 600 GROUP BY 1, 2)
SELECT symbol, trading_day, n_passed, spec, (n_passed >= need)::INT AS active FROM d, (VALUES ('all3', 3), ('two_of_3', 2)) s(spec, need)""")
def _(t):
    return lv.day_gate(it.vwap_running(t.bar()), {"high": 150.0, "volume": 12.0, "vwap_std": 40.0}, 600, {"all3": 3, "two_of_3": 2})


# --- forward outcomes -------------------------------------------------------------------------------

ENTRY = "ent AS (SELECT symbol, trading_day, dt, bar_no, close AS entry_price, side AS direction, close - side * 5 AS stop, close + side * 8 AS target FROM sided WHERE side <> 0)"


def entries(t):
    s = F.col("side")
    return sided(t).filter("side <> 0").select("symbol", "trading_day", "dt", "bar_no", F.col("close").alias("entry_price"), s.alias("direction"),
                                               (F.col("close") - s * 5).alias("stop"), (F.col("close") + s * 8).alias("target"))


def barrier_sql(start: int, tie: str, timeout: str, horizon: int = 100000, src: str = "ent", keep_tie: bool = False, path: str = "bar") -> str:
    wins = "s <= t" if tie == "stop" else "s < t"
    kind = f"CASE WHEN s >= 9999 AND t >= 9999 THEN 'timeout' WHEN {wins} THEN {"CASE WHEN s = t THEN 'stop_tie' ELSE 'stop' END" if keep_tie else "'stop'"} ELSE 'target' END"
    last = "coalesce(lc, entry_price)" if timeout == "close" else "entry_price"
    return f"""
bo0 AS (SELECT e.*, coalesce(min(b.bar_no - e.bar_no + 1 - {start}) FILTER (CASE WHEN direction > 0 THEN b.low <= stop ELSE b.high >= stop END), 9999) AS s,
  coalesce(min(b.bar_no - e.bar_no + 1 - {start}) FILTER (CASE WHEN direction > 0 THEN b.high >= target ELSE b.low <= target END), 9999) AS t, count(b.dt) AS np, arg_max(b.close, b.bar_no) AS lc
  FROM {src} e LEFT JOIN {path} b ON b.symbol = e.symbol AND b.trading_day = e.trading_day AND b.bar_no BETWEEN e.bar_no + {start} AND e.bar_no + {start} + {horizon} - 1 GROUP BY ALL),
bo1 AS (SELECT *, {kind} AS exit_type, CASE WHEN s >= 9999 AND t >= 9999 THEN np ELSE least(s, t) END AS exit_bars FROM bo0),
bo2 AS (SELECT *, CASE exit_type WHEN 'timeout' THEN {last} WHEN 'target' THEN target ELSE stop END AS exit_price FROM bo1),
bo AS (SELECT b2.symbol, b2.dt, b2.direction, exit_type, exit_bars, exit_price, any_value((exit_price - entry_price) * direction) AS pnl, greatest(coalesce(max(CASE WHEN direction > 0 THEN b.high - entry_price ELSE entry_price - b.low END), 0), 0) AS mfe,
  greatest(coalesce(max(CASE WHEN direction > 0 THEN entry_price - b.low ELSE b.high - entry_price END), 0), 0) AS mae FROM bo2 b2
  LEFT JOIN {path} b ON b.symbol = b2.symbol AND b.trading_day = b2.trading_day AND b.bar_no BETWEEN b2.bar_no + {start} AND b2.bar_no + {start} + b2.exit_bars - 1 GROUP BY 1, 2, 3, 4, 5, 6, b2.entry_price)"""


BO = " SELECT symbol, dt, direction, exit_type, exit_bars, exit_price, pnl, mfe, mae FROM bo"
BO_COLS = "symbol dt:t direction:i exit_type exit_bars:i exit_price:f pnl:f mfe:f mae:f"


@query("barrier_outcome_entry_bar", BO_COLS, with_(*ALL, ENTRY, barrier_sql(0, "stop", "close")) + BO)
def _(t):
    return lb.barrier_outcome(entries(t), t.bar(), 0, "stop", "close")


@query("barrier_outcome_target_first", BO_COLS, with_(*ALL, ENTRY, barrier_sql(1, "target", "zero", 45)) + BO)
def _(t):
    return lb.barrier_outcome(entries(t), t.bar(), 1, "target", "zero", 45)


@query("barrier_outcome", BO_COLS, with_(*ALL, ENTRY, barrier_sql(1, "stop", "zero", 45)) + BO)
def _(t):
    return lb.barrier_outcome(entries(t), t.bar(), 1, "stop", "zero", 45)


@query("barrier_outcome_day_end", BO_COLS, with_(*ALL, ENTRY, "rth_bar AS (SELECT * FROM bar WHERE minute <= 779 OR minute >= 900)", barrier_sql(1, "stop", "close", keep_tie=True, path="rth_bar")) + BO)
def _(t):
    return lb.barrier_outcome(entries(t), t.bar(), 1, "stop", "close", keep_tie=True, last_minute=779)


@query("major_move", "symbol dt:t aligned_mfe:f adverse:f terminal_disp:f outcome:i", with_(*ALL) + """
, f AS (SELECT *, max(high) OVER w AS h, min(low) OVER w AS l, last_value(close) OVER w AS e FROM sided WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING)),
m AS (SELECT symbol, dt, CASE WHEN side > 0 THEN h - close ELSE close - l END AS aligned_mfe, greatest(CASE WHEN side > 0 THEN close - l ELSE h - close END, CASE WHEN side > 0 THEN level_price - l ELSE h - level_price END) AS adverse,
 CASE WHEN side > 0 THEN e - close ELSE close - e END AS terminal_disp, greatest(6, .1 * vwap_std) AS rt, greatest(4, .08 * vwap_std) AS bt FROM f WHERE side <> 0),
g AS (SELECT *, aligned_mfe >= rt AND (aligned_mfe + 1e-6) / (adverse + 1e-6) >= 1.4 AND terminal_disp >= .2 * rt AS pos, adverse >= bt AND (adverse + 1e-6) / (aligned_mfe + 1e-6) >= 1.2 AND terminal_disp <= -.2 * bt AS neg FROM m)
SELECT symbol, dt, aligned_mfe, adverse, terminal_disp, CASE WHEN pos AND NOT neg THEN 1 WHEN neg AND NOT pos THEN 0 ELSE 2 END AS outcome FROM g""")
def _(t):
    return lb.major_move(sided(t), vol="vwap_std", block_rows=B)


@query("realized_mfe", "symbol dt:t mfe_pts:f mfe_r:f", with_(*ALL) + """
, f AS (SELECT symbol, dt, CASE WHEN side > 0 THEN max(high) OVER w - close WHEN side < 0 THEN close - min(low) OVER w END AS mfe_pts FROM sided WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 45 FOLLOWING))
SELECT symbol, dt, mfe_pts, mfe_pts / 4 AS mfe_r FROM f""")
def _(t):
    return lb.realized_mfe(sided(t), block_rows=B)


def rev_sql(hi: str, lo: str, slope_n: int, validate: int, min_move: float, bounce: float) -> str:
    """CTE rv: validated slope reversals; hi/lo are the judged columns."""
    return f"""
rv0 AS (SELECT *, CASE WHEN count(*) OVER f >= {slope_n} THEN regr_slope(close, bar_no::DOUBLE) OVER f END AS sl, count(*) OVER (PARTITION BY symbol, trading_day) AS nd, list({hi}) OVER v AS hs, list({lo}) OVER v AS ls FROM bar
  WINDOW f AS (PARTITION BY symbol, trading_day ORDER BY dt ROWS {slope_n - 1} PRECEDING), v AS (PARTITION BY symbol, trading_day ORDER BY dt ROWS BETWEEN CURRENT ROW AND {validate - 1} FOLLOWING)),
rv1 AS (SELECT *, lag(sl) OVER (PARTITION BY symbol, trading_day ORDER BY dt) AS pl FROM rv0),
rv2 AS (SELECT *, CASE WHEN nd < {slope_n + validate} OR bar_no >= nd OR len(hs) < 3 THEN 0 WHEN pl < -1e-4 AND sl > 1e-4 THEN 1 WHEN pl > 1e-4 AND sl < -1e-4 THEN -1 ELSE 0 END AS dir FROM rv1),
rv3 AS (SELECT *, CASE WHEN dir > 0 THEN list_max(hs) ELSE list_min(ls) END AS best, CASE WHEN dir > 0 THEN list_position(hs, list_max(hs)) ELSE list_position(ls, list_min(ls)) END AS atb FROM rv2),
rv4 AS (SELECT *, CASE WHEN dir > 0 THEN best - close ELSE close - best END / close AS mv, CASE WHEN dir > 0 THEN best - list_min(list_slice(ls, atb, 9999)) ELSE list_max(list_slice(hs, atb, 9999)) - best END / close AS back FROM rv3),
rv AS (SELECT *, CASE WHEN dir <> 0 AND mv >= {min_move} AND back <= {bounce} * {min_move}::DOUBLE THEN dir ELSE 0 END AS reversal FROM rv4)"""


@query("strong_reversal", "symbol dt:t reversal:i magnitude:f duration:i prior_trend:f", with_(BAR, rev_sql("close", "close", 10, 8, 0.2, 3.0)) + """
SELECT symbol, dt, reversal, CASE WHEN reversal <> 0 THEN mv ELSE 0 END AS magnitude, CASE WHEN reversal <> 0 THEN atb - 1 ELSE 0 END AS duration, CASE WHEN reversal <> 0 THEN pl ELSE 0 END AS prior_trend FROM rv""")
def _(t):
    return lb.reversals(t.bar(), "close", window=10, validate=8, min_move=0.2, bounce=3.0)


def zone_sql(stop: float, rr: float, lookback: int, anchored: bool) -> str:
    pick = "JOIN anchor USING (symbol, trading_day, bar_no)" if anchored else ""
    cols = ", nearest_level, level_distance" if anchored else ""
    return f"""
zr AS (SELECT symbol, trading_day, bar_no AS rn, reversal, mv, best{cols} FROM rv {pick} WHERE reversal <> 0 AND mv / {stop} >= {rr}),
zs AS (SELECT z.*, b.bar_no AS en, z.rn - b.bar_no AS k, b.close AS px, min(c.low) AS mnl, max(c.high) AS mxh FROM zr z JOIN bar b ON b.symbol = z.symbol AND b.trading_day = z.trading_day AND b.bar_no BETWEEN z.rn - {lookback} AND z.rn
  JOIN bar c ON c.symbol = z.symbol AND c.trading_day = z.trading_day AND c.bar_no BETWEEN b.bar_no AND z.rn GROUP BY ALL),
zm AS (SELECT *, greatest(CASE WHEN reversal > 0 THEN px - mnl ELSE mxh - px END / px, 0) AS mae, CASE WHEN reversal > 0 THEN best - px ELSE px - best END / px AS reward FROM zs),
za AS (SELECT *, max((mae > {stop})::INT) OVER (PARTITION BY symbol, trading_day, rn ORDER BY k ROWS UNBOUNDED PRECEDING) AS dead FROM zm),
zone AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trading_day, en ORDER BY rn DESC) AS pr FROM za WHERE dead = 0 AND reward / {stop} >= {rr}) WHERE pr = 1)"""


ZONE = "SELECT symbol, trading_day, en AS bar_no, reversal AS zone_label, mae AS max_adverse_excursion, reward AS potential_reward, k AS bars_to_reversal, reward / .6 AS reward_risk_ratio, mv AS reversal_magnitude FROM zone"
RULES = dict(window=10, validate=8, min_move=0.2, bounce=6.0)


@query("trade_viable_zone", "symbol trading_day:d bar_no:i zone_label:i max_adverse_excursion:f potential_reward:f bars_to_reversal:i reward_risk_ratio:f reversal_magnitude:f",
       with_(BAR, rev_sql("high", "low", 10, 8, 0.2, 6.0), zone_sql(0.6, 0.4, 10, False)) + ZONE)
def _(t):
    return lb.viable_zones(t.bar(), 0.6, 0.4, 10, **RULES)


@query("level_anchored_zone", "symbol trading_day:d bar_no:i zone_label:i zone_probability:f nearest_level level_distance:f bars_to_reversal:i",
       with_(*WIDE, rev_sql("high", "low", 10, 8, 0.2, 6.0), f"""
md AS (SELECT symbol, trading_day, {', '.join(f"CASE WHEN arg_min({c}, dt) FILTER ({c} IS NOT NULL) <> 0 THEN median({c}) END AS {c}" for c in NAMES)} FROM wide GROUP BY 1, 2),
an0 AS (SELECT rv.symbol, rv.trading_day, rv.bar_no, rv.close, {', '.join('md.' + c for c in NAMES)} FROM rv JOIN md USING (symbol, trading_day)),
an1 AS (SELECT *, least({', '.join(_D.values())}) AS d0 FROM an0),
anchor AS (SELECT symbol, trading_day, bar_no, d0 AS level_distance, CASE {' '.join(f"WHEN {_D[c]} = d0 THEN '{c}'" for c in NAMES)} END AS nearest_level FROM an1 WHERE d0 <= 20)""", zone_sql(0.6, 0.4, 10, True)) + """
SELECT symbol, trading_day, en AS bar_no, reversal AS zone_label, exp(-.5 * k) AS zone_probability, nearest_level, level_distance, k AS bars_to_reversal FROM zone""")
def _(t):
    return lb.viable_zones(leveled(t), 0.6, 0.4, 10, levels=NAMES, proximity=20.0, **RULES)


@query("zone_distribution", "bars_to_reversal:i n:i avg_mae:f avg_reward:f avg_rr:f pct_bull:f pct_bear:f", with_(BAR, rev_sql("high", "low", 10, 8, 0.2, 6.0), zone_sql(0.6, 0.4, 10, False)) + """
SELECT k AS bars_to_reversal, count(*) AS n, avg(mae) AS avg_mae, avg(reward) AS avg_reward, avg(reward / .6) AS avg_rr, avg((reversal = 1)::INT) AS pct_bull, avg((reversal = -1)::INT) AS pct_bear FROM zone GROUP BY 1""")
def _(t):
    return lb.zone_distribution(lb.viable_zones(t.bar(), 0.6, 0.4, 10, **RULES))


@query("forward_range_targets", "symbol day:d range_high_pct:f range_low_pct:f width_pct:f center_pct:f", with_(DAY) + f"""
, t AS (SELECT symbol, day, {lag('close')} AS pc, max(high) OVER f AS h, min(low) OVER f AS l FROM day WINDOW f AS ({P} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT symbol, day, (h - pc) / pc AS range_high_pct, (pc - l) / pc AS range_low_pct, (h - l) / pc AS width_pct, ((h - pc) / pc - (pc - l) / pc) / 2 AS center_pct FROM t""")
def _(t):
    return lb.forward_range_targets(t.day(), 5)


@query("predicted_range_attach", "symbol dt:t pred_high:f pred_low:f pred_width:f pred_pos:f", with_(BAR, PREV) + """
SELECT symbol, dt, coalesce(prev_high, 0) AS pred_high, coalesce(prev_low, 0) AS pred_low, coalesce(prev_high - prev_low, 0) AS pred_width, coalesce((close - prev_low) / nullif(prev_high - prev_low, 0), 0) AS pred_pos FROM bar LEFT JOIN prev USING (symbol, trading_day)""")
def _(t):
    r = it.daily_shifted(t.bar(), {"pred_high": F.max("high"), "pred_low": F.min("low")})
    return lb.predicted_range_attach(t.bar(), r)


@query("predicted_ranges_attach", "symbol dt:t pred_range_high_daily:f pred_range_low_daily:f pred_range_width_daily:f pred_range_pos_daily:f pred_range_width_weekly:f pred_range_pos_weekly:f pred_rth_high:f pred_rth_low:f pred_rth_width:f", with_(BAR, PREV) + """
, rp AS (SELECT symbol, trading_day, lag(h) OVER w AS rh, lag(l) OVER w AS rl FROM (SELECT symbol, trading_day, max(high) AS h, min(low) AS l FROM bar WHERE minute BETWEEN 390 AND 779 GROUP BY 1, 2) WINDOW w AS (PARTITION BY symbol ORDER BY trading_day)),
lw AS (SELECT symbol, date_trunc('week', trading_day) AS week, trading_day, max(dh) OVER w AS h, min(dl) OVER w AS l FROM pd WINDOW w AS (PARTITION BY symbol ORDER BY trading_day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
fw AS (SELECT symbol, week, h AS wh, l AS wl FROM lw QUALIFY row_number() OVER (PARTITION BY symbol, week ORDER BY trading_day) = 1)
SELECT b.symbol, b.dt, coalesce(prev_high, 0) AS pred_range_high_daily, coalesce(prev_low, 0) AS pred_range_low_daily, coalesce(prev_high - prev_low, 0) AS pred_range_width_daily, coalesce((close - prev_low) / nullif(prev_high - prev_low, 0), 0) AS pred_range_pos_daily,
 coalesce(wh - wl, 0) AS pred_range_width_weekly, coalesce(CASE WHEN wh > wl THEN (close - wl) / (wh - wl) WHEN wh IS NOT NULL THEN .5 END, 0) AS pred_range_pos_weekly, coalesce(rh, 0) AS pred_rth_high, coalesce(rl, 0) AS pred_rth_low, coalesce(rh - rl, 0) AS pred_rth_width
FROM bar b LEFT JOIN prev USING (symbol, trading_day) LEFT JOIN rp USING (symbol, trading_day) LEFT JOIN fw ON fw.symbol = b.symbol AND fw.week = date_trunc('week', b.trading_day)""")
def _(t):
    days = t.bar().groupBy("symbol", "trading_day").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    before = by(("symbol",), "trading_day").rowsBetween(-5, -1)
    weekly = days.select("symbol", "trading_day", F.max("high").over(before).alias("pred_high"), F.min("low").over(before).alias("pred_low"))
    spans = {"pred_high": F.max("high"), "pred_low": F.min("low")}
    return lb.predicted_ranges_attach(t.bar(), it.daily_shifted(t.bar(), spans), weekly, it.daily_shifted(t.bar(), spans, where=F.col("minute").between(390, 779)))


SWING = f"sw AS (SELECT *, CASE WHEN count(*) OVER f = 21 AND high = max(high) OVER f THEN 1 ELSE 0 END AS swing_high, CASE WHEN count(*) OVER f = 21 AND low = min(low) OVER f THEN 1 ELSE 0 END AS swing_low FROM day WINDOW f AS ({P} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))"


@query("swing_points", "symbol day:d swing_high:i swing_low:i", with_(DAY, SWING) + "SELECT symbol, day, swing_high, swing_low FROM sw")
def _(t):
    return lb.swing_points(t.day())


@query("macro_regime", "symbol day:d macro_regime:i", with_(DAY, SWING) + f"""
, a AS (SELECT symbol, day, list(high) FILTER (swing_high = 1) OVER r AS hs, list(low) FILTER (swing_low = 1) OVER r AS ls FROM sw WINDOW r AS ({P} ROWS UNBOUNDED PRECEDING)),
b AS (SELECT symbol, day, len(hs) >= 2 AND len(ls) >= 2 AS ok, ls[-1] > ls[-2] AS hl, hs[-1] < hs[-2] AS lh FROM a)
SELECT symbol, day, CASE WHEN ok AND hl AND NOT lh THEN 2 WHEN ok AND lh AND NOT hl THEN 0 ELSE 1 END AS macro_regime FROM b""")
def _(t):
    return lb.macro_regime(t.day())


@query("micro_regime", "symbol day:d micro_regime:i", with_(DAY) + f"""
, a AS (SELECT symbol, day, lead(close) OVER ({P}) / close - 1 AS nr FROM day) SELECT symbol, day, CASE WHEN nr IS NULL THEN -1 WHEN nr > .003 THEN 2 WHEN nr < -.003 THEN 0 ELSE 1 END AS micro_regime FROM a""")
def _(t):
    return lb.micro_regime(t.day())


ZZ = """
zc AS (SELECT symbol, day, close AS px, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i FROM day),
zz AS (SELECT symbol, i, 0 AS seek, i AS hi_i, px AS hi_p, i AS lo_i, px AS lo_p, 0 AS n, NULL::BIGINT AS t_i, NULL::VARCHAR AS kind FROM zc WHERE i = 0 UNION ALL
 SELECT symbol, CASE WHEN seek = 0 AND (up OR dn) THEN CASE WHEN up THEN lo_i ELSE hi_i END ELSE j END, CASE WHEN up THEN 1 WHEN dn THEN -1 ELSE seek END, CASE WHEN up THEN j ELSE hi_i END, CASE WHEN up THEN px ELSE hi_p END, CASE WHEN dn THEN j ELSE lo_i END,
  CASE WHEN dn THEN px ELSE lo_p END, n + (up OR dn)::INT, CASE WHEN up THEN lo_i WHEN dn THEN hi_i END, CASE WHEN up THEN 'trough' WHEN dn THEN 'peak' END
 FROM (SELECT *, NOT up AND seek >= 0 AND 1 - px / hi_p >= .05::DOUBLE AS dn FROM (SELECT *, seek <= 0 AND px / lo_p - 1 >= .05::DOUBLE AS up FROM (
  SELECT z.symbol, c.i AS j, c.px, z.seek, z.n, CASE WHEN z.seek >= 0 AND c.px > z.hi_p THEN c.i ELSE z.hi_i END AS hi_i, CASE WHEN z.seek >= 0 AND c.px > z.hi_p THEN c.px ELSE z.hi_p END AS hi_p,
   CASE WHEN z.seek <= 0 AND c.px < z.lo_p THEN c.i ELSE z.lo_i END AS lo_i, CASE WHEN z.seek <= 0 AND c.px < z.lo_p THEN c.px ELSE z.lo_p END AS lo_p FROM zz z JOIN zc c ON c.symbol = z.symbol AND c.i = z.i + 1)))),
turns AS (SELECT zz.symbol, zc.day, zc.px AS close, zz.kind, zz.n AS turn_no FROM zz JOIN zc ON zc.symbol = zz.symbol AND zc.i = zz.t_i)"""


@query("zigzag", "symbol day:d close:f kind turn_no:i", with_(DAY, ZZ).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT * FROM turns")
def _(t):
    return lb.zigzag(t.day())


@query("pct_regime", "symbol day:d pct_regime:i", with_(DAY, ZZ).replace("WITH ", "WITH RECURSIVE ", 1) + """
, e AS (SELECT symbol, max(day) AS ed, arg_max(close, day) AS ec FROM day GROUP BY 1),
s AS (SELECT t.*, lead(day) OVER w AS nd, lead(close) OVER w AS nc, count(*) OVER (PARTITION BY symbol) AS n FROM turns t WINDOW w AS (PARTITION BY symbol ORDER BY turn_no)),
g AS (SELECT s.symbol, turn_no, day AS f, coalesce(nd, ed) AS u, CASE WHEN kind = 'trough' AND (coalesce(nc, ec) - close) / close > .1::DOUBLE THEN 2 WHEN kind = 'peak' AND abs((coalesce(nc, ec) - close) / close) > .07::DOUBLE THEN 0 WHEN nd IS NULL THEN 1 END AS call FROM s JOIN e USING (symbol) WHERE n >= 2)
SELECT d.symbol, d.day, coalesce(arg_max(call, turn_no), 1) AS pct_regime FROM day d LEFT JOIN g ON g.symbol = d.symbol AND d.day BETWEEN g.f AND g.u AND call IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return lb.pct_regime(t.day())
