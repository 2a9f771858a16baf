"""Join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.windows import by
from tickloom.operators import bars, joins, sets
from tickloom.plans.adapters import BAR, CHAIN, DAY, DAY2, TICK, with_, with_series
from tickloom.plans.catalog import query

HASH = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


@query("join_broadcast_daily", "symbol dt:t close:f day_high:f day_low:f", with_(BAR) + """
SELECT symbol, dt, close, max(high) OVER d AS day_high, min(low) OVER d AS day_low FROM bar WINDOW d AS (PARTITION BY symbol, trading_day)""")
def _(t):
    daily = bars.daily_bars(t.bar(), prefix="day_").select("symbol", "trading_day", "day_high", "day_low")
    return joins.join_daily(t.bar(), daily)


SIGNUP = "SELECT date_trunc('hour', ts) AS h, avg(value) AS sec_price, count(*) AS sec_n FROM events WHERE event_type = 'signup' GROUP BY 1"


@query("join_left_minute_features", "symbol dt:t sec_price:f sec_n:i sec_price_is_missing:i sec_n_is_missing:i", with_(BAR) + f"""
, f AS ({SIGNUP}) SELECT symbol, dt, sec_price, sec_n, (sec_price IS NULL)::INT AS sec_price_is_missing, (sec_n IS NULL)::INT AS sec_n_is_missing
FROM bar LEFT JOIN f ON f.h = bar.dt""")
def _(t):
    feats = t.tick().filter("symbol = 'signup'").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("dt")).agg(
        F.avg("price").alias("sec_price"), F.count(F.lit(1)).alias("sec_n"))
    return joins.join_minute_features(t.bar(), feats, ["sec_price", "sec_n"], keys=("dt",))


@query("feature_coverage", "symbol feature n_rows:i n_matched:i coverage:f", with_(BAR) + f"""
, f AS ({SIGNUP}), j AS (SELECT symbol, sec_price, sec_n FROM bar LEFT JOIN f ON f.h = bar.dt)
SELECT symbol, 'sec_price' AS feature, count(*) AS n_rows, count(sec_price) AS n_matched, count(sec_price) / count(*) AS coverage FROM j GROUP BY 1
UNION ALL SELECT symbol, 'sec_n', count(*), count(sec_n), count(sec_n) / count(*) FROM j GROUP BY 1""")
def _(t):
    feats = t.tick().filter("symbol = 'signup'").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("dt")).agg(
        F.avg("price").alias("sec_price"), F.count(F.lit(1)).alias("sec_n"))
    return joins.coverage(joins.join_minute_features(t.bar(), feats, ["sec_price", "sec_n"], keys=("dt",)), ["sec_price", "sec_n"], ["symbol"])


@query("join_inner_chain_oi", "trade_date:d expiration:d strike:f instrument_class iv:f open_interest:f stat_oi:f", with_(CHAIN) + """
, oi AS (SELECT date_trunc('week', l_shipdate)::DATE AS trade_date, (date_trunc('week', l_shipdate)::DATE + (4 + 7 * l_linenumber)::INT)::DATE AS expiration,
  round(p_retailprice / 5) * 5 AS strike, CASE WHEN l_orderkey % 2 = 0 THEN 'C' ELSE 'P' END AS instrument_class, max(l_quantity) AS stat_oi
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' GROUP BY 1, 2, 3, 4)
SELECT c.*, oi.stat_oi FROM chain c JOIN oi USING (trade_date, expiration, strike, instrument_class)""")
def _(t):
    oi = t.quotes().filter("l_linestatus = 'O'").groupBy("trade_date", "expiration", "strike", "instrument_class").agg(F.max("l_quantity").alias("stat_oi"))
    return t.chain().join(oi, ["trade_date", "expiration", "strike", "instrument_class"])


@query("join_left_dedup_right", "symbol trading_day:d close:f first_user:i", with_(BAR) + """
, d AS (SELECT symbol, trading_day, arg_max(close, dt) AS close FROM bar GROUP BY 1, 2),
r AS (SELECT event_type AS symbol, ts::DATE AS trading_day, first(user_id ORDER BY ts, event_id) AS first_user FROM events GROUP BY 1, 2)
SELECT symbol, trading_day, close, first_user FROM d LEFT JOIN r USING (symbol, trading_day)""")
def _(t):
    right = t.table("events").select(
        F.col("event_type").alias("symbol"), F.to_date("ts").alias("trading_day"), F.col("user_id").alias("first_user"), "ts", "event_id")
    out = joins.join_left_dedup_right(bars.daily_bars(t.bar()).select("symbol", "trading_day", "close"), right, ["symbol", "trading_day"], ["ts", "event_id"])
    return out


ASOF_RIGHT = "ext AS (SELECT symbol AS series, day, close AS ext_close FROM day2), lt AS (SELECT day.*, series FROM day, (SELECT DISTINCT series FROM ext))"


@query("asof_ffill", "symbol series day:d close:f matched_day:d ext_close:f", with_(DAY, DAY2, ASOF_RIGHT) + """
SELECT d.symbol, d.series, d.day, d.close, e.day AS matched_day, e.ext_close FROM lt d ASOF LEFT JOIN ext e ON d.series = e.series AND d.day >= e.day""")
def _(t):
    ext = t.day2().select(F.col("symbol").alias("series"), "day", F.col("close").alias("ext_close"))
    left = with_series(t.day())
    return joins.asof(left, ext, ["series"], "day", "day", ["ext_close"])


@query("asof_bounded_bday", "symbol series day:d matched_day:d ext_close:f", with_(DAY, DAY2, ASOF_RIGHT) + """
, j AS (SELECT d.symbol, d.series, d.day, e.day AS m, e.ext_close FROM lt d ASOF LEFT JOIN ext e ON d.series = e.series AND d.day >= e.day),
k AS (SELECT *, (SELECT count(*) FROM generate_series(m + 1, day, INTERVAL 1 DAY) g(x) WHERE isodow(x) < 6) AS bd FROM j)
SELECT symbol, series, day, CASE WHEN bd <= 3 THEN m END AS matched_day, CASE WHEN bd <= 3 THEN ext_close END AS ext_close FROM k""")
def _(t):
    ext = t.day2().select(F.col("symbol").alias("series"), "day", F.col("close").alias("ext_close"))
    left = with_series(t.day())
    return joins.asof_business_days(left, ext, ["series"], "day", "day", ["ext_close"])


SPAN = "span AS (SELECT event_id AS span_id, event_type AS symbol, ts AS s, ts + INTERVAL 6 HOURS AS e FROM events)"


@query("interval_join_agg", "span_id:i symbol any_big:i max_price:f n_ticks:i mode_volume:f", with_(TICK, SPAN) + """
, h AS (SELECT span_id, span.symbol, price, volume FROM span JOIN tick ON tick.symbol = span.symbol AND ts BETWEEN s AND e),
v AS (SELECT span_id, volume, count(*) AS n FROM h GROUP BY 1, 2),
m AS (SELECT span_id, first(volume ORDER BY n DESC, volume) AS mode_volume FROM v GROUP BY 1)
SELECT h.span_id, symbol, max((price > 200)::INT) AS any_big, max(price) AS max_price, count(*) AS n_ticks, any_value(mode_volume) AS mode_volume
FROM h JOIN m USING (span_id) GROUP BY 1, 2""")
def _(t):
    spans = t.tick().select(F.col("seq").alias("span_id"), "symbol", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("e"))
    parts = {"n_ticks": (F.count(F.lit(1)), F.sum), "max_price": (F.max("price"), F.max)}
    final = [F.max("max_price").alias("max_price"), (F.max("max_price") > 200).cast("int").alias("any_big"), F.sum("n_ticks").alias("n_ticks"), F.max_by("volume", F.struct("n_ticks", -F.col("volume"))).alias("mode_volume")]
    return joins.interval_aggregate(spans, t.tick(), ["symbol"], "s", "e", "ts", parts, final, ["span_id"], by=["volume"])


SPOT = "spot AS (SELECT trade_date, median(strike) AS spot FROM chain GROUP BY 1)"


@query("theta_join_moneyness", "trade_date:d strike:f instrument_class expiration:d spot:f moneyness:f", with_(CHAIN, SPOT) + """
SELECT c.trade_date, strike, instrument_class, expiration, spot, strike / spot AS moneyness FROM chain c JOIN spot USING (trade_date)
WHERE abs(strike - spot) <= 0.03 * spot""")
def _(t):
    chain = t.chain()
    spot = t.spot(chain)
    j = chain.join(spot, "trade_date").filter(F.abs(F.col("strike") - F.col("spot")) <= 0.03 * F.col("spot"))
    return j.withColumn("moneyness", F.col("strike") / F.col("spot"))


@query("cross_join_grid", "trade_date:d grid_i:i level:f oi_above:f n:i", with_(CHAIN, SPOT) + """
, g AS (SELECT trade_date, i AS grid_i, spot * (0.95 + 0.1 * i / 20) AS level FROM spot, generate_series(0, 20) t(i))
SELECT g.trade_date, grid_i, level, sum(CASE WHEN strike > level THEN open_interest ELSE 0 END) AS oi_above, count(*) AS n
FROM g JOIN chain c USING (trade_date) GROUP BY 1, 2, 3""")
def _(t):
    chain = t.chain()
    level = lambda i: F.col("spot") * (0.95 + 0.1 * i / 20)
    # A contract counts for the levels below its strike, which are the first ones: only how many is summed by date.
    below = F.size(F.filter(F.sequence(F.lit(0), F.lit(20)), lambda i: F.col("strike") > level(i)))
    j = chain.select("trade_date", "strike", "open_interest").join(t.spot(chain), "trade_date").groupBy("trade_date", "spot", below.alias("below")).agg(F.sum("open_interest").alias("oi"), F.count(F.lit(1)).alias("n"))
    per = j.groupBy("trade_date", "spot").agg(F.collect_list(F.struct("below", "oi")).alias("steps"), F.sum("n").alias("n"))
    grid = per.withColumn("grid_i", F.explode(F.sequence(F.lit(0), F.lit(20))))
    above = F.aggregate(F.filter("steps", lambda x: x["below"] > F.col("grid_i")), F.lit(0.0), lambda a, x: a + x["oi"])
    return grid.select("trade_date", "grid_i", level(F.col("grid_i")).alias("level"), above.alias("oi_above"), "n")


ACTIVE = "active AS (SELECT DISTINCT symbol, trading_day FROM bar WHERE high > 200)"


@query("semi_join_days", "symbol trading_day:d n_bars:i", with_(BAR, ACTIVE) + """
SELECT symbol, trading_day, count(*) AS n_bars FROM bar WHERE (symbol, trading_day) IN (SELECT symbol, trading_day FROM active) GROUP BY 1, 2""")
def _(t):
    active = t.bar().filter("high > 200").select("symbol", "trading_day").distinct()
    return t.bar().join(active, ["symbol", "trading_day"], "left_semi").groupBy("symbol", "trading_day").agg(F.count(F.lit(1)).alias("n_bars"))


@query("anti_join_missing_dates", "symbol day:d", with_(DAY) + """
, d AS (SELECT symbol, day, volume, row_number() OVER (PARTITION BY symbol ORDER BY day) AS rn FROM day)
SELECT symbol, day FROM d WHERE rn > 60 AND volume < 200""")
def _(t):
    days = t.day()
    cached = days.filter("volume >= 200").select("symbol", "day")
    return joins.anti_join_missing_dates(days.select("symbol", "day"), cached, warmup=60)


@query("backfill_pending_actuals", "symbol day:d actual:i", with_(DAY) + """
, d AS (SELECT symbol, day, volume, CASE WHEN lead(close) OVER (PARTITION BY symbol ORDER BY day) > close THEN 1 ELSE 0 END AS known,
 lead(close) OVER (PARTITION BY symbol ORDER BY day) AS nx FROM day)
SELECT symbol, day, CASE WHEN volume >= 250 THEN 0 WHEN nx IS NULL THEN -1 ELSE known END AS actual FROM d""")
def _(t):
    nxt = F.lead("close").over(by(("symbol",), "day"))
    d = t.day().withColumns({"nx": nxt, "known": F.when(nxt > F.col("close"), 1).otherwise(0)})
    preds = d.select("symbol", "day", F.when(F.col("volume") >= 250, 0).otherwise(-1).alias("actual"))
    actuals = d.filter("nx IS NOT NULL").select("symbol", "day", F.col("known").alias("actual"))
    return joins.backfill_pending(preds, actuals, ["symbol", "day"])


@query("self_join_forward_window", "symbol dt:t n_ahead:i max_ahead:f min_ahead:f first_above:i", with_(BAR) + """
SELECT a.symbol, a.dt, count(b.dt) AS n_ahead, max(b.high) AS max_ahead, min(b.low) AS min_ahead,
  min(b.bar_no - a.bar_no) FILTER (b.high > a.high) AS first_above FROM bar a
LEFT JOIN bar b ON a.symbol = b.symbol AND a.trading_day = b.trading_day AND b.bar_no BETWEEN a.bar_no + 1 AND a.bar_no + 12 GROUP BY 1, 2""")
def _(t):
    return bars.forward_window(t.bar(), 12)


@query("union_prefer_right", "symbol dt:t close:f source", with_(BAR) + """
, r AS (SELECT *, 'recent' AS source FROM bar WHERE dt >= TIMESTAMP '2024-01-20'), f AS (SELECT symbol, min(dt) AS first_dt FROM r GROUP BY 1),
h AS (SELECT *, 'history' AS source FROM bar WHERE dt < TIMESTAMP '2024-01-22')
SELECT h.symbol, dt, close, source FROM h JOIN f USING (symbol) WHERE dt < first_dt UNION ALL SELECT symbol, dt, close, source FROM r""")
def _(t):
    b = t.bar().select("symbol", "dt", "close")
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    return sets.union_prefer_right(b.filter(F.col("dt") < ts("2024-01-22")).withColumn("source", F.lit("history")),
                                   b.filter(F.col("dt") >= ts("2024-01-20")).withColumn("source", F.lit("recent")))


@query("dedup_keep_last", "symbol user_id:i last_value:f last_id:i", """
SELECT event_type AS symbol, user_id, last(value ORDER BY ts, event_id) AS last_value, last(event_id ORDER BY ts, event_id) AS last_id FROM events GROUP BY 1, 2""")
def _(t):
    e = t.table("events").select(F.col("event_type").alias("symbol"), "user_id", "ts", F.col("event_id").alias("last_id"), F.col("value").alias("last_value"))
    return sets.dedup_keep_last(e, ["symbol", "user_id"], ["ts", "last_id"])


@query("intersect_dates", "day:d", with_(DAY, DAY2) + "SELECT day FROM day WHERE symbol = 'A' INTERSECT SELECT day FROM day2 WHERE symbol = '5-LOW'")
def _(t):
    return t.day().filter("symbol = 'A'").select("day").intersect(t.day2().filter("symbol = '5-LOW'").select("day"))


@query("union_days", "day:d", with_(DAY, DAY2) + "SELECT day FROM day UNION SELECT day FROM day2")
def _(t):
    return t.day().select("day").union(t.day2().select("day")).distinct()


@query("wide_to_long_calls_puts", "trade_date:d strike:f instrument_class iv:f open_interest:f", with_(CHAIN) + """
SELECT trade_date, strike, instrument_class, max(iv) AS iv, sum(open_interest) AS open_interest FROM chain GROUP BY 1, 2, 3""")
def _(t):
    c = t.chain()
    is_c, is_p = F.col("instrument_class") == "C", F.col("instrument_class") == "P"
    wide = c.groupBy("trade_date", "strike").agg(
        F.max(F.when(is_c, F.col("iv"))).alias("c_iv"), F.sum(F.when(is_c, F.col("open_interest"))).alias("c_oi"),
        F.max(F.when(is_p, F.col("iv"))).alias("p_iv"), F.sum(F.when(is_p, F.col("open_interest"))).alias("p_oi"))
    return sets.calls_puts_to_long(wide, ["trade_date", "strike"])


@query("pivot_statistics", "symbol trading_day:d open_interest:f settlement:f volume_stat:f", """
WITH s AS (SELECT l_returnflag AS symbol, l_shipdate::DATE AS trading_day, l_linestatus AS k, l_orderkey AS ts, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem)
SELECT symbol, trading_day, max(l_quantity) FILTER (k = 'O') AS open_interest,
  last(l_extendedprice ORDER BY ts, l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (k = 'F') AS settlement,
  last(l_quantity ORDER BY ts, l_linenumber, l_partkey, l_suppkey, l_quantity) FILTER (k = 'F') AS volume_stat FROM s GROUP BY 1, 2""")
def _(t):
    li = t.table("lineitem").select(
        F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("trading_day"), "l_linestatus", "l_quantity", "l_extendedprice",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    stat = lambda name, value: F.struct(F.lit(name).alias("stat"), F.col(value).alias("value"))
    rows = li.withColumn("_s", F.explode(F.when(F.col("l_linestatus") == "O", F.array(stat("open_interest", "l_quantity"))).otherwise(
        F.array(stat("settlement", "l_extendedprice"), stat("volume_stat", "l_quantity"))))).select("symbol", "trading_day", "at", "_s.*")
    return sets.pivot_statistics(rows, ["symbol", "trading_day"], ["open_interest", "settlement", "volume_stat"], largest={"open_interest"})


@query("last_n_days", "symbol trading_day:d n_bars:i", with_(BAR) + """
, r AS (SELECT symbol, trading_day, dense_rank() OVER (PARTITION BY symbol ORDER BY trading_day DESC) AS r FROM bar WHERE trading_day < DATE '2024-01-25')
SELECT symbol, trading_day, count(*) AS n_bars FROM r WHERE r <= 5 GROUP BY 1, 2""")
def _(t):
    return sets.last_n_days(t.bar(), 5, before=F.lit("2024-01-25").cast("date")).groupBy("symbol", "trading_day").agg(F.count(F.lit(1)).alias("n_bars"))


@query("topk_by_abs", "symbol day:d ret:f", with_(DAY) + """
, r AS (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM day),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(ret) DESC, day) AS rn FROM r WHERE ret IS NOT NULL) SELECT symbol, day, ret FROM k WHERE rn <= 10""")
def _(t):
    r = t.day().withColumn("ret", F.col("close") / F.lag("close").over(by(("symbol",), "day")) - 1).filter("ret IS NOT NULL")
    return sets.top_k(r, 10, [F.abs("ret").desc(), F.col("day")], ["symbol"])


@query("episode_first", "symbol trading_day:d side:i bar_no:i", with_(BAR) + """
, s AS (SELECT symbol, trading_day, bar_no, CASE WHEN close >= open THEN 1 ELSE -1 END AS side FROM bar),
g AS (SELECT *, bar_no - lag(bar_no) OVER (PARTITION BY symbol, trading_day, side ORDER BY bar_no) AS gap FROM s)
SELECT symbol, trading_day, side, bar_no FROM g WHERE gap IS NULL OR gap > 2""")
def _(t):
    b = t.bar().withColumn("side", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1))
    return sets.first_of_episode(b, ["symbol", "trading_day", "side"], "bar_no", 2)


@query("stratified_sample_by_day", "symbol trading_day:d dt:t", with_(BAR) + f"""
, r AS (SELECT symbol, trading_day, dt, row_number() OVER (PARTITION BY symbol, trading_day ORDER BY {HASH.format("symbol || '|' || strftime(dt, '%Y-%m-%d %H:%M:%S')")}, dt) AS rn FROM bar)
SELECT symbol, trading_day, dt FROM r WHERE rn <= 12""")
def _(t):
    return sets.stratified_sample(t.bar(), ["symbol", "trading_day"], 12, ["symbol", "dt"])


@query("negative_subsample", "symbol trading_day:d dt:t positive:i", with_(BAR) + f"""
, m AS (SELECT *, (high > 200)::INT AS positive, {HASH.format("symbol || '|' || strftime(dt, '%Y-%m-%d %H:%M:%S')")} AS h FROM bar WHERE high > 200 OR high < 100),
r AS (SELECT *, sum(positive) OVER (PARTITION BY symbol, trading_day) AS np, row_number() OVER (PARTITION BY symbol, trading_day, positive ORDER BY h, symbol, dt) AS rn FROM m)
SELECT symbol, trading_day, dt, positive FROM r WHERE positive = 1 OR rn <= 3 * np""")
def _(t):
    out = sets.negative_subsample(t.bar(), ["symbol", "trading_day"], F.col("high") > 200, F.col("high") < 100, 3, ["symbol", "dt"])
    return out.withColumn("positive", (F.col("high") > 200).cast("int"))


@query("upsert_by_date", "symbol day:d close:f version:i", with_(DAY) + """
SELECT symbol, day, CASE WHEN day >= DATE '2000-01-01' THEN round(close) ELSE close END AS close, CASE WHEN day >= DATE '2000-01-01' THEN 2 ELSE 1 END AS version FROM day""")
def _(t):
    d = t.day().select("symbol", "day", "close")
    new = d.filter("day >= DATE'2000-01-01'").withColumns({"close": F.round("close"), "version": F.lit(2)})
    return sets.upsert(d.withColumn("version", F.lit(1)), new, ["day"])
