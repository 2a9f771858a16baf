"""Calendar, projection and bar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import calendar as cal
from tickloom.functions.windows import by
from tickloom.operators import bars
from tickloom.plans.adapters import BAR, DAY, DAY2, TICK, with_, with_series
from tickloom.plans.catalog import query

LA = "America/Los_Angeles"


@query("session_trading_day", "symbol ts:t next_day:d prev_day:d", with_(TICK) + """
SELECT symbol, date_trunc('second', ts) AS ts,
  CASE WHEN date_part('hour', ts) >= 15 THEN ts::DATE + 1 ELSE ts::DATE END AS next_day,
  CASE WHEN date_part('hour', ts) < 15 THEN ts::DATE - 1 ELSE ts::DATE END AS prev_day FROM tick""")
def _(t):
    return t.tick().withColumns({"next_day": cal.trading_day("ts"), "prev_day": cal.trading_day("ts", 15, "previous")})


@query("session_ovn_flag", "symbol dt:t ovn:i rth_half_open:i", with_(BAR) + """
SELECT symbol, dt, CASE WHEN date_part('hour', dt) < 6 OR date_part('hour', dt) > 13
    OR (date_part('hour', dt) = 6 AND date_part('minute', dt) < 30) THEN 1 ELSE 0 END AS ovn,
  CASE WHEN minute >= 390 AND minute < 780 THEN 1 ELSE 0 END AS rth_half_open FROM bar""")
def _(t):
    return t.bar().withColumns({"ovn": cal.overnight_flag("dt"),
                                "rth_half_open": cal.between_minutes("dt", 390, 779).cast("int")})


@query("session_window_bounds", "trading_day:d session_start:i session_end:i prev_session_start:i", with_(BAR) + f"""
SELECT DISTINCT trading_day,
  epoch(timezone('{LA}', (trading_day - 1)::TIMESTAMP + INTERVAL 15 HOURS)) AS session_start,
  epoch(timezone('{LA}', (trading_day - 1)::TIMESTAMP + INTERVAL '15 hours' + INTERVAL 86399 SECONDS)) AS session_end,
  epoch(timezone('{LA}', (trading_day - 1 - CASE isodow(trading_day - 1) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END)::TIMESTAMP
    + INTERVAL 15 HOURS)) AS prev_session_start FROM bar""")
def _(t):
    days = t.bar().select("trading_day").distinct()
    noon = F.col("trading_day").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")
    return days.withColumns({**cal.session_bounds("trading_day", LA), "prev_session_start": cal.previous_session_start(noon, LA)})


@query("session_renumber_drop_stubs", "symbol dt:t session_no:i n_bars:i", with_(BAR) + """
, s AS (SELECT symbol, dt, CASE WHEN date_part('hour', dt) < 15 THEN dt::DATE - 1 ELSE dt::DATE END AS session FROM bar),
n AS (SELECT *, count(*) OVER (PARTITION BY symbol, session) AS n_bars FROM s)
SELECT symbol, dt, n_bars, dense_rank() OVER (PARTITION BY symbol ORDER BY session) - 1 AS session_no FROM n WHERE n_bars >= 30""")
def _(t):
    return bars.renumber_sessions(t.bar(), min_bars=30)


@query("minute_of_day", "symbol ts:t minute:i", with_(TICK) + """
SELECT symbol, date_trunc('second', ts) AS ts, date_part('hour', ts) * 60 + date_part('minute', ts) AS minute FROM tick""")
def _(t):
    return t.tick().withColumn("minute", cal.minute_of_day("ts"))


@query("tod_bucket", "tod n_ticks:i volume:f", with_(TICK) + """
, m AS (SELECT *, date_part('hour', ts) * 60 + date_part('minute', ts) AS minute FROM tick)
SELECT CASE WHEN minute < 480 THEN 'open' WHEN minute < 600 THEN 'morning' WHEN minute < 690 THEN 'midday' ELSE 'late' END AS tod,
  count(*) AS n_ticks, sum(volume) AS volume FROM m GROUP BY 1""")
def _(t):
    return t.tick().groupBy(cal.tod_bucket(cal.minute_of_day("ts")).alias("tod")).agg(
        F.count(F.lit(1)).alias("n_ticks"), F.sum("volume").alias("volume"))


@query("calendar_features", "symbol day:d dow:i dom:i month_sin:f month_cos:f is_monday:i is_friday:i is_opex_week:i is_quarter_end:i",
       with_(DAY) + """
SELECT symbol, day, isodow(day) - 1 AS dow, date_part('day', day) AS dom, sin(2 * pi() * date_part('month', day) / 12) AS month_sin,
  cos(2 * pi() * date_part('month', day) / 12) AS month_cos, (isodow(day) = 1)::INT AS is_monday, (isodow(day) = 5)::INT AS is_friday,
  (date_part('day', day) BETWEEN 15 AND 21)::INT AS is_opex_week,
  (date_part('month', day) IN (3, 6, 9, 12) AND date_part('day', day) >= 25)::INT AS is_quarter_end FROM day""")
def _(t):
    return t.day().withColumns(cal.calendar_features("day"))


@query("normalize_orderflow", "symbol ts:t askvolume:f bidvolume:f", """
SELECT event_type AS symbol, date_trunc('second', ts) AS ts, CASE WHEN event_id % 2 = 0 THEN (1 + user_id % 7) ELSE 0 END AS askvolume,
  CASE WHEN event_id % 2 = 0 THEN 0 ELSE (1 + user_id % 7) END AS bidvolume FROM events""")
def _(t):
    legacy = t.tick().withColumnsRenamed({"askvolume": "buys", "bidvolume": "sells"})
    return bars.normalize_orderflow(legacy)


@query("filter_rth", "symbol trading_day:d n_bars:i volume:f", with_(BAR) + """
SELECT symbol, trading_day, count(*) AS n_bars, sum(volume) AS volume FROM bar WHERE minute BETWEEN 390 AND 780 GROUP BY 1, 2""")
def _(t):
    return t.bar().filter(cal.between_minutes("dt", 390, 780)).groupBy("symbol", "trading_day").agg(
        F.count(F.lit(1)).alias("n_bars"), F.sum("volume").alias("volume"))


@query("between_time", "symbol dt:t close:f", with_(BAR) + "SELECT symbol, dt, close FROM bar WHERE minute BETWEEN 390 AND 450")
def _(t):
    return t.bar().filter(cal.between_minutes("dt", 390, 450))


@query("validate_bars", "symbol n_bars:i n_duplicate:i n_null:i n_inverted:i n_gaps:i max_gap_minutes:f", with_(BAR) + """
, g AS (SELECT *, epoch(dt - lag(dt) OVER (PARTITION BY symbol ORDER BY dt)) / 60 AS gap FROM bar)
SELECT symbol, count(*) AS n_bars, count(*) - count(DISTINCT dt) AS n_duplicate,
  count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS n_null,
  count(*) FILTER (high < low) AS n_inverted, count(*) FILTER (gap > 60) AS n_gaps, max(gap) AS max_gap_minutes FROM g GROUP BY 1""")
def _(t):
    return bars.validate_bars(t.bar(), max_gap_minutes=60)


@query("upsample_bar_to_ticks", "symbol ts:t price:f volume:f", with_(BAR) + """
SELECT symbol, dt + INTERVAL 1 SECOND * (15 * i) AS ts, CASE i WHEN 0 THEN open WHEN 1 THEN high WHEN 2 THEN low ELSE close END AS price,
  volume / 4 AS volume FROM bar, (SELECT unnest([0, 1, 2, 3]) AS i)""")
def _(t):
    return bars.upsample_to_ticks(t.bar())


@query("build_minute_bars", "symbol dt:t open:f high:f low:f close:f volume:f bidvolume:f askvolume:f price:f filled:i", with_(TICK) + """
, m AS (SELECT symbol, date_trunc('minute', ts) AS dt, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, seq) AS close, sum(volume) AS volume, sum(bidvolume) AS bidvolume, sum(askvolume) AS askvolume,
  avg(price) AS price FROM tick GROUP BY 1, 2),
span AS (SELECT symbol, unnest(generate_series(min(dt), max(dt), INTERVAL 1 MINUTE)) AS dt FROM m GROUP BY symbol)
SELECT s.symbol, s.dt, a.open, a.high, a.low, a.close, coalesce(m.volume, 0) AS volume, coalesce(m.bidvolume, 0) AS bidvolume,
  coalesce(m.askvolume, 0) AS askvolume, a.price, (m.dt IS NULL)::INT AS filled
FROM span s LEFT JOIN m ON m.symbol = s.symbol AND m.dt = s.dt ASOF JOIN m a ON a.symbol = s.symbol AND s.dt >= a.dt""")
def _(t):
    return bars.fill_empty_bars(bars.build_bars(t.tick(), 1), 1)


@query("merge_incremental_bars", "symbol dt:t open:f high:f low:f close:f volume:f n_ticks:i", with_(TICK) + """
, m AS (SELECT symbol, date_trunc('minute', ts) AS dt, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, seq) AS close, sum(volume) AS volume, count(*) AS n_ticks FROM tick GROUP BY 1, 2) SELECT * FROM m""")
def _(t):
    ticks = t.tick()
    cut = F.lit("2024-01-20 00:00:30").cast("timestamp_ntz")
    old = bars.build_bars(ticks.filter(F.col("ts") < cut), 1)
    return bars.merge_incremental(old, ticks, ticks.filter(F.col("ts") >= cut), 1)


@query("resample_htf", "symbol trading_day:d dt:t open:f high:f low:f close:f volume:f", with_(BAR) + """
SELECT symbol, trading_day, time_bucket(INTERVAL '60 minutes', dt) AS dt, arg_min(open, dt) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, dt) AS close, sum(volume) AS volume FROM bar GROUP BY symbol, trading_day, time_bucket(INTERVAL '60 minutes', dt)""")
def _(t):
    return bars.resample(t.bar(), 60)


@query("daily_bars", "symbol trading_day:d open:f high:f low:f close:f volume:f price:f", with_(BAR) + """
SELECT symbol, trading_day, arg_min(open, dt) AS open, max(high) AS high, min(low) AS low, arg_max(close, dt) AS close,
  sum(volume) AS volume, avg(price) AS price FROM bar GROUP BY 1, 2""")
def _(t):
    return bars.daily_bars(t.bar(), extra_mean="price")


@query("daily_bars_rth", "symbol trading_day:d rth_open:f rth_high:f rth_low:f rth_close:f rth_volume:f", with_(BAR) + """
SELECT symbol, trading_day, arg_min(open, dt) AS rth_open, max(high) AS rth_high, min(low) AS rth_low, arg_max(close, dt) AS rth_close,
  sum(volume) AS rth_volume FROM bar WHERE minute BETWEEN 390 AND 779 GROUP BY 1, 2""")
def _(t):
    return bars.daily_bars_rth(t.bar())


@query("weekly_bars", "symbol year_week day:d open:f high:f low:f close:f volume:f", with_(DAY) + """
SELECT symbol, isoyear(day) || '_' || lpad(week(day)::VARCHAR, 2, '0') AS year_week, arg_min(open, day) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, day) AS close, sum(volume) AS volume, max(day) AS day FROM day GROUP BY symbol, 2""")
def _(t):
    return bars.require_unique_weeks(bars.weekly_bars(t.day()))


@query("weekly_close_ffill", "symbol day:d weekly_close:f weekly_sma_fast:f weekly_sma_slow:f", with_(DAY) + """
, w0 AS (SELECT symbol, (day + ((4 - (isodow(day) - 1) + 7) % 7)::INT)::DATE AS week_end, arg_max(close, day) AS weekly_close FROM day GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN count(*) OVER f >= 20 THEN avg(weekly_close) OVER f END AS weekly_sma_fast,
  CASE WHEN count(*) OVER s >= 50 THEN avg(weekly_close) OVER s END AS weekly_sma_slow FROM w0
  WINDOW f AS (PARTITION BY symbol ORDER BY week_end ROWS 19 PRECEDING), s AS (PARTITION BY symbol ORDER BY week_end ROWS 49 PRECEDING))
SELECT d.symbol, d.day, w.weekly_close, w.weekly_sma_fast, w.weekly_sma_slow FROM day d ASOF LEFT JOIN w
ON w.symbol = d.symbol AND d.day >= w.week_end""")
def _(t):
    return bars.weekly_close_context(t.day())


@query("checkpoint_rows", "symbol trading_day:d bar_no:i cp_high:f cp_low:f cp_close:f cp_volume:f cp_range:f cp_position:f day_high:f day_low:f day_close:f remaining_up:f",
       with_(BAR) + """
, r AS (SELECT symbol, trading_day, bar_no, close, max(high) OVER w AS cp_high, min(low) OVER w AS cp_low, sum(volume) OVER w AS cp_volume,
  max(high) OVER d AS day_high, min(low) OVER d AS day_low, last_value(close) OVER (PARTITION BY symbol, trading_day ORDER BY dt
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS day_close, count(*) OVER d AS n FROM bar
  WINDOW w AS (PARTITION BY symbol, trading_day ORDER BY dt ROWS UNBOUNDED PRECEDING), d AS (PARTITION BY symbol, trading_day))
SELECT symbol, trading_day, bar_no, cp_high, cp_low, close AS cp_close, cp_volume, cp_high - cp_low AS cp_range,
  CASE WHEN cp_high > cp_low THEN (close - cp_low) / (cp_high - cp_low) ELSE 0.5 END AS cp_position, day_high, day_low, day_close,
  day_high - cp_high AS remaining_up FROM r WHERE bar_no % 30 = 0 OR bar_no = n""")
def _(t):
    return bars.checkpoint_rows(t.bar(), every=30)


@query("align_instruments", "symbol series day:d close:f other_close:f", with_(DAY, DAY2) + """
, base AS (SELECT symbol AS series, day, close AS other FROM day2),
j AS (SELECT d.symbol, d.series, d.day, d.close, b.other FROM (SELECT * FROM day, (SELECT DISTINCT series FROM base)) d LEFT JOIN base b ON b.series = d.series AND b.day = d.day),
f AS (SELECT symbol, series, day, close, coalesce(other, lag(other) OVER w, lag(other, 2) OVER w) AS other_close FROM j WINDOW w AS (PARTITION BY symbol, series ORDER BY day))
SELECT * FROM f WHERE other_close IS NOT NULL""")
def _(t):
    other = t.day2().select(F.col("symbol").alias("series"), "day", F.col("close").alias("other_close"))
    return bars.align_to_primary(with_series(t.day()), other, "day", ["other_close"], limit=2, keys=("symbol", "series"), match=("series",))


@query("prepare_targets_join", "symbol day:d ret1:f gap:f up_from_prev:f down_from_prev:f", with_(DAY) + """
, f AS (SELECT symbol, day, close / lag(close) OVER w - 1 AS ret1, open - lag(close) OVER w AS gap, lag(close) OVER w AS pc,
  max(high) OVER n AS fh, min(low) OVER n AS fl FROM day WINDOW w AS (PARTITION BY symbol ORDER BY day),
  n AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT symbol, day, coalesce(ret1, 0) AS ret1, coalesce(gap, 0) AS gap, (fh - pc) / pc AS up_from_prev, (pc - fl) / pc AS down_from_prev
FROM f WHERE pc IS NOT NULL""")
def _(t):
    w = by(("symbol",), "day")
    d = t.day()
    pc = F.lag("close").over(w)
    feats = d.select("symbol", "day", (F.col("close") / pc - 1).alias("ret1"), (F.col("open") - pc).alias("gap"))
    nxt = w.rowsBetween(0, 4)
    targets = d.select("symbol", "day", ((F.max("high").over(nxt) - pc) / pc).alias("up_from_prev"),
                       ((pc - F.min("low").over(nxt)) / pc).alias("down_from_prev"))
    return bars.join_targets(feats, targets, ["symbol", "day"], ["up_from_prev", "down_from_prev"])
