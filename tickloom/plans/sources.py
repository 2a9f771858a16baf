"""Source, sink, text, scaling and model queries. Files are written by Spark from the given
tables to a stage folder and read back through the source under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import text as tx
from tickloom.functions.calendar import wall_seconds
from tickloom.functions.scratch import stage_dir
from tickloom.functions.windows import by
from tickloom.operators import daily as dl, labels as lb, models as md, profile as pf
from tickloom.plans.adapters import BAR, CHAIN, DAY, DAY2, TICK, with_
from tickloom.plans.catalog import query
from tickloom.plans.sqlkit import P, lag, rsi_sql
from tickloom.sources import files, rdbms, sinks


def staged_csv(t, df, name):
    path = stage_dir(t.spark, name)
    df.write.option("header", True).csv(path)
    return path


OHLCV = "open:f high:f low:f close:f volume:f"


@query("scan_bars_csv", "symbol dt:t " + OHLCV + " bidvolume:f askvolume:f nearby_gamma_score:f", with_(BAR) + "SELECT symbol, dt, open, high, low, close, volume, bidvolume, 0 AS askvolume, 0 AS nearby_gamma_score FROM bar")
def _(t):
    b = t.bar().select("symbol", F.date_format("dt", "MM/dd/yyyy").alias("Date"), F.date_format("dt", "HH:mm:ss").alias(" Time"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"),
                       F.col("close").alias("Close"), F.col("volume").alias("Volume"), F.col("bidvolume").alias("BidVolume"))
    return files.read_bars_csv(t.spark, staged_csv(t, b, "bars"))


# Every symbol is delivered in one of two vendor layouts: local times with "close", or UTC times with "Last".
LOCAL, UTC = ("click", "purchase", "signup"), ("view", "error")


@query("scan_multi_schema", "symbol dt:t " + OHLCV, with_(BAR) + """
SELECT symbol, CASE WHEN symbol IN ('click', 'purchase', 'signup') THEN timezone('UTC', timezone('America/New_York', dt)) ELSE dt END AS dt, open, high, low, close, volume FROM bar""")
def _(t):
    b = lambda s: t.bar().filter(F.col("symbol") == s).select(F.date_format("dt", "yyyy-MM-dd").alias("Date"), F.date_format("dt", "HH:mm:ss").alias("Time"), "open", "high", "low", "close", "volume")
    files_of = [(staged_csv(t, b(s), f"combined-{s}"), "combined", s, "America/New_York") for s in LOCAL]
    files_of += [(staged_csv(t, b(s).withColumnRenamed("close", "Last"), f"mnt-{s}"), "mnt_standard", s, None) for s in UTC]
    return files.read_many(t.spark, files_of)


@query("scan_historical_merge_fmt", "symbol dt:t " + OHLCV, with_(BAR) + "SELECT symbol, dt, open, high, low, close, volume FROM bar")
def _(t):
    b = t.bar().select("symbol", F.date_format("dt", "yyyy/M/d").alias(" Date"), F.date_format("dt", "HH:mm:ss.SSSSSS").alias(" Time"), F.col("open").alias(" Open"), F.col("high").alias(" High"), F.col("low").alias(" Low"), F.col("close").alias(" Last"), F.col("volume").alias(" Volume"))
    return files.read_historical(t.spark, staged_csv(t, b, "hist"))


@query("scan_second_bars", "symbol dt:t " + OHLCV + " bidvolume:f askvolume:f", with_(TICK) + "SELECT symbol, date_trunc('second', ts) AS dt, price AS open, price AS high, price AS low, price AS close, greatest(volume - 3, 0) AS volume, bidvolume, askvolume FROM tick WHERE price > 1")
def _(t):
    px = F.when(F.col("price") > 1, F.col("price"))
    b = t.tick().select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("BarEndingTime"), *[px.alias(f"Series.{c}") for c in ("Open", "High", "Low", "Close")], (F.col("volume") - 3).alias("Series.Volume"), F.col("bidvolume").alias("BidVolume"), F.col("askvolume").alias("AskVolume"))
    return files.read_second_bars(t.spark, staged_csv(t, b, "sec") + "/*.csv")


@query("scan_feature_parquet", "symbol dt:t close:f", with_(BAR) + "SELECT symbol, dt, close FROM bar")
def _(t):
    root = stage_dir(t.spark, "feat")
    t.bar().select("symbol", "dt", "close").write.partitionBy("symbol").parquet(root)
    return files.read_feature_parquet(t.spark, root)


@query("combine_parquets", "symbol dt:t close:f", with_(BAR) + "SELECT symbol, dt, close FROM bar")
def _(t):
    a, b = stage_dir(t.spark, "part-a"), stage_dir(t.spark, "part-b")
    bar = t.bar().select("symbol", "dt", "close")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    bar.filter(F.col("dt") < cut).write.parquet(a)
    bar.filter(F.col("dt") >= cut).select("close", "dt", "symbol").write.parquet(b)
    return files.combine_parquets(t.spark, [a, b])


@query("scan_rdbms_range", "symbol ts:i price:f", with_(TICK) + "SELECT symbol, floor(epoch(ts)) AS ts, price FROM tick WHERE symbol = 'click' AND floor(epoch(ts)) BETWEEN 1704240000 AND 1705240000")
def _(t):
    return rdbms.fetch_range(t.tick().withColumn("ts", wall_seconds("ts")), "click", 1704240000, 1705240000, "ts")


@query("scan_rdbms_since", "symbol first_ts:i last_ts:i n:i", with_(TICK) + "SELECT symbol, min(floor(epoch(ts))) AS first_ts, max(floor(epoch(ts))) AS last_ts, count(*) AS n FROM tick WHERE symbol = 'view' AND floor(epoch(ts)) > 1705240000 GROUP BY 1")
def _(t):
    x = rdbms.fetch_since(t.tick().withColumn("ts", wall_seconds("ts")), "view", 1705240000, "ts")
    return rdbms.time_bounds(x, "ts").join(x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "symbol")


def staged_chain(t):
    root = stage_dir(t.spark, "snap")
    sinks.write_snapshots(t.chain().withColumn("underlying_price", F.lit(950.0)), root)
    return root


@query("scan_snapshot_partitions", "date:d n:i oi:f", with_(CHAIN) + "SELECT trade_date AS date, count(*) AS n, sum(open_interest) AS oi FROM chain WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND isodow(trade_date) < 6 GROUP BY 1")
def _(t):
    return files.read_snapshots(t.spark, staged_chain(t), "1997-01-01", "1998-12-31").groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("open_interest").alias("oi"))


@query("sink_snapshot_partition", "date:d", with_(CHAIN) + "SELECT DISTINCT trade_date AS date FROM chain")
def _(t):
    return files.list_snapshot_dates(t.spark, staged_chain(t))


@query("scan_statistics_daychunk", "day:d n:i value:f", "SELECT ts::DATE AS day, count(*) AS n, sum(value) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1")
def _(t):
    return files.read_day_range(t.table("events"), "ts", "2024-01-05", "2024-01-20").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


@query("scan_external_series", "series date:d close:f", with_(DAY2) + "SELECT symbol AS series, day AS date, close FROM day2 WHERE close >= 100000")
def _(t):
    d = t.day2().select(F.col("symbol").alias("series"), F.date_format("day", "yyyy-MM-dd").alias("DATE"), F.when(F.col("close") >= 100000, F.col("close").cast("string")).otherwise(".").alias("VIXCLS"))
    return files.read_external_series(t.spark, staged_csv(t, d, "ext"))


CANON = "symbol Date Time Open:f High:f Low:f Close:f Volume:f BidVolume:f AskVolume:f ovn:i trading_day:d nearby_gamma_score:f"


@query("sink_bars_canonical", CANON, with_(BAR) + "SELECT symbol, strftime(dt, '%m/%d/%Y') AS Date, strftime(dt, '%H:%M:%S') AS Time, open AS Open, high AS High, low AS Low, close AS Close, volume AS Volume, bidvolume AS BidVolume, askvolume AS AskVolume, ovn, trading_day, 0 AS nearby_gamma_score FROM bar")
def _(t):
    path = stage_dir(t.spark, "canon")
    sinks.write_bars(sinks.canonical_bars(t.bar()), path)
    return t.spark.read.option("header", True).csv(path).withColumn("trading_day", F.to_date("trading_day"))


@query("sink_signals_jsonl", "signal_id symbol ts:t price:f score:f", with_(TICK) + """
SELECT substr(sha1(symbol || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || seq::VARCHAR), 1, 16) AS signal_id, symbol, date_trunc('second', ts) AS ts, price, CASE WHEN seq % 3 <> 0 THEN price / 100 END AS score FROM tick""")
def _(t):
    s = t.tick().select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "seq", "price", F.when(F.col("seq") % 3 != 0, F.col("price") / 100).otherwise(F.lit(float("nan"))).alias("score"))
    path = stage_dir(t.spark, "jsonl")
    sinks.write_jsonl(sinks.signal_payload(s, ["symbol", "ts", "seq"], ["symbol", "ts", "price", "score"]), path)
    back = t.spark.read.schema("signal_id string, symbol string, ts string, payload string").json(path)
    p = F.from_json("payload", "price double, score double")
    return back.select("signal_id", "symbol", F.to_timestamp("ts").cast("timestamp_ntz").alias("ts"), p["price"].alias("price"), p["score"].alias("score"))


# --- text ---------------------------------------------------------------------------------------------

@query("normalize_range_text", "date:d timeframe symbol range_low:f range_high:f rating", """
WITH r AS (SELECT o_orderkey AS k, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS ts, o_totalprice AS p FROM orders),
x AS (SELECT CASE WHEN date_part('hour', ts) >= 15 OR isodow(ts) >= 6 THEN ts::DATE ELSE ts::DATE - 1 END AS date, ['daily', 'weekly', 'monthly', 'monthly', 'quarterly'][(k % 5 + 1)::INT] AS timeframe, ['ES', 'NQ', 'CL', 'VIX'][(k % 4 + 1)::INT] AS symbol,
 least(p, p * 2 - 300000) AS range_low, greatest(p, p * 2 - 300000) AS range_high, ['+', '-', '0', NULL][(k % 4 + 1)::INT] AS rating, k FROM r) SELECT * FROM x WHERE k % 11 <> 0""")
def _(t):
    k = F.col("o_orderkey")
    pick = lambda items, n: F.element_at(F.array(*[F.lit(x) for x in items]), (k % n + 1).cast("int"))
    p = F.col("o_totalprice")
    comma = lambda c: F.format_number(c, 2)
    raw = t.table("orders").select(
        (F.col("o_orderdate") + F.make_dt_interval(hours=(k % 24).cast("int"))).alias("mail_ts"), pick(["Day session", " Weekly view", "MONTH end", "october 2025", "Quarterly"], 5).alias("section"),
        pick(["e-mini S&P (+)", "Nasdaq 100 (-)", "Crude oil (0)", "VIX index"], 4).alias("name"), F.when(k % 11 == 0, "112'170").otherwise(comma(p)).alias("low_text"), comma(p * 2 - 300000).alias("high_text"))
    return tx.normalize_range_records(raw)


REC = f"rec AS (SELECT symbol, day, low - 5 AS range_low, high + 5 AS range_high FROM day), pvc AS (SELECT symbol, day, {lag('close')} AS prev_close FROM day), rr AS (SELECT symbol, day, (range_high - range_low) / prev_close AS width_pct, (range_high - prev_close) / prev_close AS high_pct, (prev_close - range_low) / prev_close AS low_pct FROM rec JOIN pvc USING (symbol, day) WHERE prev_close IS NOT NULL)"


@query("range_record_features", "symbol day:d width_pct:f high_pct:f low_pct:f width_pct_lag1:f width_pct_lag5:f high_pct_lag1:f low_pct_lag3:f", with_(DAY, REC) + f"SELECT *, {lag('width_pct')} AS width_pct_lag1, {lag('width_pct', 5)} AS width_pct_lag5, {lag('high_pct')} AS high_pct_lag1, {lag('low_pct', 3)} AS low_pct_lag3 FROM rr")
def _(t):
    rec = t.day().select("symbol", "day", (F.col("low") - 5).alias("range_low"), (F.col("high") + 5).alias("range_high"))
    return md.range_record_features(rec, t.day())


# --- scaling ------------------------------------------------------------------------------------------

@query("normalize_bounded", "symbol day:d rsi01:f pct01:f", with_(DAY, rsi_sql("r1", "day", "close", 14)) + f"""
, b AS (SELECT symbol, day, rsi / 100 AS rsi01, coalesce((close - (avg(close) OVER f - 2 * stddev_samp(close) OVER f)) / nullif(4 * stddev_samp(close) OVER f, 0), 0) AS pb FROM r1 WINDOW f AS ({P} ROWS 19 PRECEDING)) SELECT symbol, day, rsi01, (greatest(least(pb, 1.5), -.5) + .5) / 2 AS pct01 FROM b""")
def _(t):
    return dl.trend_exhaustion(t.day()).withColumns({"rsi01": md.normalize_bounded("rsi_14", "rsi"), "pct01": md.normalize_bounded("bb_pct_b", "pct_b")})


STATS = "s AS (SELECT avg(volume) AS m, stddev_pop(volume) AS sd, avg(close) AS cm, stddev_pop(close) AS csd FROM day WHERE day < DATE '1999-01-01')"


@query("normalize_log", "symbol day:d z:f", with_(DAY, STATS) + "SELECT symbol, day, greatest(least((ln(CASE WHEN volume > 0 THEN volume ELSE 1e-6 END) - ln(m)) / (sd / m), 5), -5) AS z FROM day, s")
def _(t):
    st = md.fit_stats(t.day().filter("day < DATE'1999-01-01'"), ["volume"])
    return md.apply_stats(t.day(), st).withColumn("z", md.normalize_log("volume"))


@query("normalize_zscore", "symbol day:d z:f", with_(DAY, STATS) + "SELECT symbol, day, greatest(least((close - cm) / csd, 5), -5) AS z FROM day, s")
def _(t):
    st = md.fit_stats(t.day().filter("day < DATE'1999-01-01'"), ["close"])
    return md.apply_stats(t.day(), st).withColumn("z", md.normalize_zscore("close"))


# --- models -------------------------------------------------------------------------------------------

def width_table(t):
    w = by(("symbol",), "day")
    width = F.col("high") - F.col("low")
    r = F.lag("close").over(w) / F.lag("close", 2).over(w) - 1
    return t.day().select("symbol", "day", width.alias("width"), F.lag(width).over(w).alias("lag1"), r.alias("prev_ret"), F.abs(r).alias("abs_ret")).dropna()


@query("width_formula", "symbol n:i mae:f r2:f", with_(DAY) + f"""
, w AS (SELECT symbol, day, width, lag1, row_number() OVER ({P}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT symbol, day, high - low AS width, {lag('high - low')} AS lag1, {lag('close', 2)} AS c2 FROM day) WHERE c2 IS NOT NULL),
f AS (SELECT w.*, k, 500 + k * ((n - 500) // 5) AS te, CASE WHEN k = 4 THEN n ELSE 500 + (k + 1) * ((n - 500) // 5) END AS xe FROM w, generate_series(0, 4) g(k)),
c AS (SELECT symbol, k, regr_slope(width, lag1) AS b, regr_intercept(width, lag1) AS a FROM f WHERE i < te GROUP BY 1, 2),
p AS (SELECT f.symbol, width, greatest(a + b * lag1, 0) AS pred FROM f JOIN c USING (symbol, k) WHERE i >= te AND i < xe)
SELECT symbol, count(*) AS n, avg(abs(width - pred)) AS mae, 1 - sum((width - pred) * (width - pred)) / (var_pop(width) * count(*)) AS r2 FROM p GROUP BY 1""")
def _(t):
    return md.formula_quality(md.width_formula(width_table(t), "lag1", "width", 5, 500), "width")


@query("width_formula_multi", "symbol n:i mae:f4 r2:f4")
def _(t):
    return md.formula_quality(md.width_formula_multi(width_table(t), ["lag1", "prev_ret", "abs_ret"], "width", 5, 500), "width")


@query("fold_models", "symbol day:d fold:i actual:i predicted:i")
def _(t):
    d = dl.sma_z_slope_alignment(dl.returns_momentum(lb.micro_regime(t.day())))
    return md.fold_models(d.filter("micro_regime >= 0"), ["return_1d", "return_5d", "rsi_14", "close_vs_sma20_z", "ma_alignment"], "micro_regime", 2, 800, trees=10)


@query("day_clusters", "symbol trading_day:d cluster:i")
def _(t):
    return md.day_clusters(pf.day_profile_summary(t.bar(), 5.0), ["poc_rel", "va_width_rel", "entropy", "skew"], 3)


DX = "CASE WHEN {t} > 0 AND {p} + {m} > 0 THEN 100 * abs({p} / {t} - {m} / {t}) / ({p} / {t} + {m} / {t}) ELSE 0 END"
WILDER = f"""
w0 AS (SELECT symbol, day, row_number() OVER ({P}) - 1 AS i, greatest(close - {lag('close')}, 0) AS u, greatest({lag('close')} - close, 0) AS d, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr,
 CASE WHEN high - {lag('high')} > {lag('low')} - low AND high - {lag('high')} > 0 THEN high - {lag('high')} ELSE 0 END AS pm, CASE WHEN {lag('low')} - low > high - {lag('high')} AND {lag('low')} - low > 0 THEN {lag('low')} - low ELSE 0 END AS nm FROM day),
w1 AS (SELECT symbol, 14::BIGINT AS i, avg(u) AS g, avg(d) AS s, sum(tr) AS t, sum(pm) AS p, sum(nm) AS m FROM w0 WHERE i BETWEEN 1 AND 14 GROUP BY 1),
wr AS (SELECT *, 1 AS k, {DX.format(t='t', p='p', m='m')} AS ds, NULL::DOUBLE AS adx FROM w1 UNION ALL
 SELECT symbol, i, g, s, t, p, m, k, ds + dx, CASE WHEN k = 14 THEN (ds + dx) / 14 WHEN k > 14 THEN (adx * 13 + dx) / 14 END FROM (SELECT *, {DX.format(t='t', p='p', m='m')} AS dx FROM (
  SELECT w.symbol, w.i, (r.g * 13 + w.u) / 14 AS g, (r.s * 13 + w.d) / 14 AS s, r.t - r.t / 14 + w.tr AS t, r.p - r.p / 14 + w.pm AS p, r.m - r.m / 14 + w.nm AS m, r.k + 1 AS k, r.ds, r.adx FROM wr r JOIN w0 w ON w.symbol = r.symbol AND w.i = r.i + 1)))"""


@query("wilder_rsi_adx", "symbol day:d rsi:f adx:f", with_(DAY, WILDER).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT w0.symbol, w0.day, coalesce(CASE WHEN g + s > 0 THEN 100 * g / (g + s) WHEN g IS NOT NULL THEN 50 END, 50) AS rsi, coalesce(adx, 0) AS adx FROM w0 LEFT JOIN wr ON wr.symbol = w0.symbol AND wr.i = w0.i""")
def _(t):
    return md.wilder_rsi_adx(t.day())
