"""Options queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import options as op
from tickloom.functions.windows import by
from tickloom.operators import bars, exposure as ex
from tickloom.plans.adapters import CHAIN, DAY, with_
from tickloom.plans.catalog import query
from tickloom.plans.joins_sets import SPOT


def pdf_sql(x: str) -> str:
    return f"(exp(-0.5 * {x} * {x}) / {op.SQRT_2PI!r}::DOUBLE)"


def cdf_sql(x: str) -> str:
    """The normal distribution by the same rational approximation, written out."""
    def poly(c):
        out = f"{c[0]!r}::DOUBLE"
        for v in c[1:]:
            out = f"({out} * abs({x}) + {v!r}::DOUBLE)"
        return out
    far = f"(abs({x}) + 0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        far = f"(abs({x}) + {k} / {far})"
    c = f"(CASE WHEN abs({x}) > 37 THEN 0 WHEN abs({x}) < 7.07106781186547 THEN exp(-abs({x}) * abs({x}) / 2) * {poly(op.HART_NUM)} / {poly(op.HART_DEN)} ELSE exp(-abs({x}) * abs({x}) / 2) / {far} / {op.SQRT_2PI!r}::DOUBLE END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {c} ELSE {c} END)"


@query("norm_pdf", "event_id:i pdf:f", f"SELECT event_id, {pdf_sql('((value - 50) / 25)')} AS pdf FROM events")
def _(t):
    return t.table("events").withColumn("pdf", op.norm_pdf((F.col("value") - 50) / 25))


@query("norm_cdf", "event_id:i cdf:f", f"WITH x AS (SELECT event_id, (value - 50) / 25 AS x FROM events) SELECT event_id, {cdf_sql('x')} AS cdf FROM x")
def _(t):
    return t.table("events").withColumn("x", (F.col("value") - 50) / 25).withColumn("cdf", op.norm_cdf("x"))


PREP = f"prep AS (SELECT c.*, spot, greatest(date_diff('day', trade_date, expiration) / 365.25::DOUBLE, 1e-6) AS tte, date_diff('day', trade_date, expiration) AS dte FROM chain c JOIN spot USING (trade_date) WHERE iv > 0 AND open_interest > 0)"
KEY = "trade_date:d expiration:d strike:f instrument_class "


def prepared(t):
    c = t.chain()
    return ex.chain_prepare(c).join(t.spot(c), "trade_date")


@query("chain_prepare", KEY + "tte:f dte:i", with_(CHAIN, SPOT, PREP) + "SELECT * FROM prep")
def _(t):
    return prepared(t)


BS = """
bs0 AS (SELECT *, (ln(spot / strike) + (.04 - .01 + .5 * iv * iv) * tte) / (iv * sqrt(tte)) AS x FROM prep),
bs1 AS (SELECT *, x - iv * sqrt(tte) AS y FROM bs0)"""
PRICE = f"CASE WHEN instrument_class = 'C' THEN spot * exp(-.01 * tte) * {cdf_sql('x')} - strike * exp(-.04 * tte) * {cdf_sql('y')} ELSE strike * exp(-.04 * tte) * {cdf_sql('(-y)')} - spot * exp(-.01 * tte) * {cdf_sql('(-x)')} END"


@query("bs_greeks", KEY + "d1:f gamma:f delta:f vega:f price:f", with_(CHAIN, SPOT, PREP, BS) + f"""
SELECT *, x AS d1, {pdf_sql('x')} / (spot * iv * sqrt(tte)) AS gamma, CASE WHEN instrument_class = 'C' THEN {cdf_sql('x')} ELSE {cdf_sql('x')} - 1 END AS delta,
 spot * exp(-.01 * tte) * {pdf_sql('x')} * sqrt(tte) AS vega, {PRICE} AS price FROM bs1""")
def _(t):
    return op.with_greeks(prepared(t), "spot", "strike", 0.04, 0.01, "iv", "tte", F.col("instrument_class") == "C")


@query("gamma_shares", KEY + "gamma_shares:f", with_(CHAIN, SPOT, PREP) + f"""
, x AS (SELECT *, (ln(spot / strike) + (.05 + .5 * iv * iv) * tte) / (iv * sqrt(tte)) AS x FROM prep)
SELECT *, abs({pdf_sql('x')} / (spot * iv * sqrt(tte)) * 100 * open_interest) AS gamma_shares FROM x""")
def _(t):
    return prepared(t).withColumn("gamma_shares", op.gamma_shares("spot", "strike", 0.05, "iv", "tte", "open_interest"))


@query("chain_implied_vol", KEY + "implied:f4", with_(CHAIN, SPOT, PREP) + "SELECT *, iv AS implied FROM prep")
def _(t):
    call = F.col("instrument_class") == "C"
    quoted = op.with_greeks(prepared(t), "spot", "strike", 0.04, 0.01, "iv", "tte", call)
    return quoted.withColumn("implied", op.implied_vol("price", "spot", "strike", "tte", 0.04, 0.01, call))


@query("parse_option_symbol", "symbol root expiration:d instrument_class strike:f", with_(CHAIN) + """
SELECT rpad('SPXW', 6, ' ') || strftime(expiration, '%y%m%d') || instrument_class || lpad((strike * 1000)::BIGINT::VARCHAR, 8, '0') AS symbol, 'SPXW' AS root, expiration, instrument_class, strike FROM chain""")
def _(t):
    text = F.concat(F.rpad(F.lit("SPXW"), 6, " "), F.date_format("expiration", "yyMMdd"), F.col("instrument_class"), F.lpad((F.col("strike") * 1000).cast("bigint").cast("string"), 8, "0"))
    raw = t.chain().select(text.alias("symbol"))
    return raw.withColumns(op.parse_option_symbol("symbol"))


@query("flatten_chain_json", KEY + "dte:i iv:f open_interest:f", with_(CHAIN, SPOT, PREP) + "SELECT trade_date, expiration, strike, instrument_class, dte, iv, open_interest FROM prep")
def _(t):
    c = ex.chain_prepare(t.chain())
    key = F.concat(F.date_format("expiration", "yyyy-MM-dd"), F.lit(":"), F.col("dte"))
    contract = F.array(F.struct((F.col("iv") * 100).alias("volatility"), F.col("open_interest").alias("openInterest"), F.lit(1.0).alias("mark")))
    strikes = c.groupBy("trade_date", "instrument_class", key.alias("e")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("strike").cast("string"), contract))).alias("s"))
    sides = strikes.groupBy("trade_date").agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("instrument_class") == k, F.struct("e", "s")))).alias(n) for k, n in (("C", "callExpDateMap"), ("P", "putExpDateMap"))])
    return ex.flatten_chain_json(sides.select("trade_date", F.to_json(F.struct("callExpDateMap", "putExpDateMap")).alias("payload")))


RANGES = """
pw AS (SELECT symbol, day, high - low AS rng, lag(high - low) OVER (PARTITION BY symbol ORDER BY day) AS w FROM day)"""


def with_width(t):
    rng = F.col("high") - F.col("low")
    return t.day().withColumns({"rng": rng, "w": F.lag(rng).over(by(("symbol",), "day"))})


@query("position_size_mult", "symbol day:d mult:f", with_(DAY, RANGES) + "SELECT symbol, day, CASE WHEN w > 0 THEN greatest(least(500 / w, 3), .3) ELSE 1 END AS mult FROM pw")
def _(t):
    return with_width(t).withColumn("mult", op.position_size_mult("w", 500.0))


@query("forward_vol_bucket", "symbol day:d consumption_ratio:f vol_bucket expected_range:f size_modulator:f", with_(DAY, RANGES) + """
, r AS (SELECT *, CASE WHEN w > 0 THEN rng / w END AS c FROM pw)
SELECT symbol, day, coalesce(c, 0) AS consumption_ratio, CASE WHEN c IS NULL THEN 'unknown' WHEN c < .3 THEN 'low' WHEN c < .7 THEN 'normal' WHEN c < .9 THEN 'elevated' WHEN c < 999 THEN 'extreme' ELSE 'normal' END AS vol_bucket,
 CASE WHEN c IS NULL THEN 12 WHEN c < .3 THEN 8.7 WHEN c < .7 THEN 12.4 WHEN c < .9 THEN 15 WHEN c < 999 THEN 26.2 ELSE 12.4 END AS expected_range,
 CASE WHEN c IS NULL THEN 1 ELSE greatest(least(12.4::DOUBLE / CASE WHEN c < .3 THEN 8.7 WHEN c < .7 THEN 12.4 WHEN c < .9 THEN 15 WHEN c < 999 THEN 26.2 ELSE 12.4 END, 1.5), .3) END AS size_modulator FROM r""")
def _(t):
    return with_width(t).withColumns(op.forward_vol_bucket("rng", "w"))


N = 41
GRID = f"""
g0 AS (SELECT trade_date, spot, i, spot * (1 - .05 + .1 * i / {N - 1}) AS level, strike, greatest(iv, 1e-5) AS iv, open_interest AS oi, tte, instrument_class = 'C' AS call FROM prep, generate_series(0, {N - 1}) s(i)),
g1 AS (SELECT *, (ln(level / strike) + (.04 + .5 * iv * iv) * tte) / (iv * sqrt(tte)) AS x FROM g0),
g2 AS (SELECT *, {pdf_sql('x')} / (level * iv * sqrt(tte)) * oi * 100 * level * level * .01 AS g, -(CASE WHEN call THEN {cdf_sql('x')} ELSE {cdf_sql('x')} - 1 END) * oi * 100 AS d FROM g1),
grid AS (SELECT trade_date, i, spot, level, sum(CASE WHEN call THEN g ELSE 0 END) AS call_gex, sum(CASE WHEN call THEN 0 ELSE -g END) AS put_gex, sum(CASE WHEN call THEN g ELSE -g END) AS gex, sum(d) AS dealer_delta FROM g2 GROUP BY 1, 2, 3, 4)"""
GREEK = (CHAIN, SPOT, PREP)


@query("gex_grid", "trade_date:d i:i level:f call_gex:f put_gex:f gex:f dealer_delta:f", with_(*GREEK, GRID) + "SELECT trade_date, i, level, call_gex / 1e6 AS call_gex, put_gex / 1e6 AS put_gex, gex / 1e6 AS gex, dealer_delta / 1e3 AS dealer_delta FROM grid")
def _(t):
    c = t.chain()
    g = ex.gex_grid(c, t.spot(c), N)
    return g.withColumns({k: F.col(k) / 1e6 for k in ("call_gex", "put_gex", "gex")}).withColumn("dealer_delta", F.col("dealer_delta") / 1e3)


MODEL = """
k0 AS (SELECT *, lead(gex) OVER w AS g1, lead(level) OVER w AS l1 FROM grid WINDOW w AS (PARTITION BY trade_date ORDER BY i)),
fl AS (SELECT trade_date, level - gex / (g1 - gex) * (l1 - level) AS gamma_flip, row_number() OVER (PARTITION BY trade_date ORDER BY abs((level + l1) / 2 - spot), i) AS rn FROM k0 WHERE sign(gex) <> sign(g1)),
mg AS (SELECT trade_date, level AS max_gamma, row_number() OVER (PARTITION BY trade_date ORDER BY abs(gex) DESC, i) AS rn FROM grid),
pwl AS (SELECT trade_date, level AS put_wall, row_number() OVER (PARTITION BY trade_date ORDER BY put_gex, i) AS rn FROM grid WHERE level <= spot AND put_gex < 0),
cwl AS (SELECT trade_date, level AS call_wall, row_number() OVER (PARTITION BY trade_date ORDER BY call_gex DESC, i) AS rn FROM grid WHERE level >= spot AND call_gex > 0),
tot AS (SELECT trade_date, any_value(spot) AS spot, median(abs(gex)) FILTER (abs(gex) > 0) AS median_gex, sum(abs(gex)) AS total_gex, list(gex ORDER BY i) AS ga, list(dealer_delta ORDER BY i) AS da, min(level) AS lo, max(level) AS hi FROM grid GROUP BY 1),
ne AS (SELECT trade_date, sum(CASE WHEN call THEN g ELSE -g END) AS near_gex FROM (SELECT p.trade_date, instrument_class = 'C' AS call, """ + pdf_sql("x") + """ / (spot * iv * sqrt(tte)) * open_interest * 100 * spot * spot * .01 AS g
  FROM (SELECT *, (ln(spot / strike) + (.04 + .5 * iv * iv) * tte) / (iv * sqrt(tte)) AS x FROM prep WHERE dte <= 3) p) GROUP BY 1),
model0 AS (SELECT tot.*, gamma_flip, max_gamma, put_wall, call_wall, near_gex FROM tot LEFT JOIN (FROM fl WHERE rn = 1) USING (trade_date) JOIN (FROM mg WHERE rn = 1) USING (trade_date) LEFT JOIN (FROM pwl WHERE rn = 1) USING (trade_date)
  LEFT JOIN (FROM cwl WHERE rn = 1) USING (trade_date) LEFT JOIN ne USING (trade_date))"""


def interp_sql(arr: str, x: str) -> str:
    pos = f"least(greatest(({x} - lo) / (hi - lo) * {N - 1}, 0), {N - 1})"
    i = f"least(floor({pos}), {N - 2})::INT"
    return f"({arr}[{i} + 1] + ({arr}[{i} + 2] - {arr}[{i} + 1]) * ({pos} - {i}))"


MODEL += f""",
model1 AS (SELECT *, {interp_sql('ga', 'spot')} AS net_gex FROM model0),
model AS (SELECT *, CASE WHEN abs(net_gex) < median_gex * .1 THEN 0 WHEN net_gex > 0 THEN 1 ELSE -1 END AS regime_sign,
 CASE WHEN abs(net_gex) < median_gex * .1 THEN 'low_gamma' WHEN net_gex > median_gex * 3 THEN 'gamma_pinned' WHEN net_gex > 0 THEN 'positive_gamma' ELSE 'negative_gamma' END AS regime_label FROM model1)"""


def model(t):
    c = t.chain()
    return ex.exposure_model(c, t.spot(c), N)


@query("gex_key_levels", "trade_date:d gamma_flip:f max_gamma:f put_wall:f call_wall:f", with_(*GREEK, GRID, MODEL) + "SELECT trade_date, gamma_flip, max_gamma, put_wall, call_wall FROM model")
def _(t):
    return model(t)


@query("gex_regime", "trade_date:d net_gex:f regime_sign:i regime_label", with_(*GREEK, GRID, MODEL) + "SELECT trade_date, net_gex / 1e6 AS net_gex, regime_sign, regime_label FROM model")
def _(t):
    return model(t).withColumn("net_gex", F.col("net_gex") / 1e6)


def features_sql(x: str, atr: str, sd: str) -> str:
    g, d = (lambda e: interp_sql("ga", e)), (lambda e: interp_sql("da", e))
    up, dn = f"-({d(f'({x} * 1.01::DOUBLE)')} - {d(x)})", f"-({d(f'({x} * 0.99::DOUBLE)')} - {d(x)})"
    hood = " + ".join(f"abs({g(f'({x} + ({o}))')})" for o in range(-15, 16, 5))
    dx = f"({x} * 0.001::DOUBLE)"
    return f"""regime_sign AS gex_regime_sign, net_gex / greatest({sd}, 1e-10) AS gex_net_normalized, coalesce(({x} - gamma_flip) / {atr}, 0) AS gamma_flip_distance, ({x} - max_gamma) / {atr} AS dist_to_max_gamma,
 coalesce(({x} - put_wall) / {atr}, 0) AS dist_to_put_wall, coalesce(({x} - call_wall) / {atr}, 0) AS dist_to_call_wall, ({up}) / 1e3 AS hedge_flow_1pct_up, ({dn}) / 1e3 AS hedge_flow_1pct_down,
 (abs({up}) - abs({dn})) / 1e3 AS hedge_flow_asymmetry, abs({g(x)}) / greatest(total_gex, 1e-10) AS gex_concentration, CASE WHEN abs(net_gex) < 1e-10 THEN 0 ELSE least(abs(coalesce(near_gex, 0)) / greatest(abs(net_gex), 1e-10), 1) END AS near_expiry_gamma_pct,
 ({g(f'({x} + {dx})')} - {g(f'({x} - {dx})')}) / (2 * {dx}) / 1e6 AS gex_slope_at_spot, abs({g(x)}) / greatest({hood}, 1e-10) AS nearby_gamma_score"""


FEATS = ("gex_regime_sign:i gex_net_normalized:f gamma_flip_distance:f dist_to_max_gamma:f dist_to_put_wall:f dist_to_call_wall:f hedge_flow_1pct_up:f hedge_flow_1pct_down:f hedge_flow_asymmetry:f "
         "gex_concentration:f near_expiry_gamma_pct:f gex_slope_at_spot:f nearby_gamma_score:f")


def scaled(df):
    return df.withColumns({**{c: F.col(c) / 1e3 for c in ("hedge_flow_1pct_up", "hedge_flow_1pct_down", "hedge_flow_asymmetry")}, "gex_slope_at_spot": F.col("gex_slope_at_spot") / 1e6})


@query("gex_features", "trade_date:d " + FEATS, with_(*GREEK, GRID, MODEL) + f"SELECT trade_date, {features_sql('spot', '20', '1e6')} FROM model")
def _(t):
    return scaled(ex.gex_features(model(t), "spot", F.lit(20.0), F.lit(1e6)))


BARG = f"""
gb AS (SELECT symbol, day, close / open AS rel, 10.0::DOUBLE AS atr, day - CASE isodow(day) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS pv FROM day),
gj AS (SELECT b.*, m.* FROM gb b ASOF JOIN model m ON b.pv >= m.trade_date),
gk AS (SELECT *, spot * rel AS px FROM gj WHERE (SELECT count(*) FROM generate_series(trade_date + 1, pv, INTERVAL 1 DAY) g(x) WHERE isodow(x) < 6) <= 3),
gn AS (SELECT *, {interp_sql('ga', 'px')} AS net0 FROM gk),
gs AS (SELECT *, CASE WHEN count(*) OVER f >= 10 THEN stddev_pop(net0) OVER f ELSE 1 END AS sd0 FROM gn WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"""


@query("gex_bar_features", "symbol day:d " + FEATS.replace("gex_net_normalized:f", "gex_net_normalized:f4"), with_(DAY, *GREEK, GRID, MODEL, BARG) + f"SELECT symbol, day, {features_sql('px', 'atr', 'sd0').replace('AS gex_net_normalized', '* CASE WHEN sd0 = 1 THEN 1e-6 ELSE 1 END AS gex_net_normalized')} FROM gs")
def _(t):
    b = t.day().select("symbol", "day", (F.col("close") / F.col("open")).alias("rel"), F.lit(10.0).alias("atr"))
    df = scaled(ex.gex_bar_features(b, model(t)))
    # warm-up rows are normalised by 1; shown in millions
    few = F.row_number().over(by(("symbol",), "day")) <= 10
    return df.withColumn("gex_net_normalized", F.col("gex_net_normalized") * F.when(few, 1e-6).otherwise(1.0))


@query("local_gamma_score", "symbol trade_date:d px:f gamma_score:f", with_(DAY, *GREEK) + f"""
, pt AS (SELECT d.symbol, d.day AS trade_date, spot * close / open AS px FROM day d JOIN spot ON spot.trade_date = d.day),
j AS (SELECT pt.*, abs(px - strike) AS gap, (ln(px / strike) + (.04 + .5 * iv * iv) * tte) / (iv * sqrt(tte)) AS x, iv, tte, open_interest AS oi FROM pt JOIN prep USING (trade_date) WHERE abs(px - strike) <= 15),
s AS (SELECT symbol, trade_date, px, sum(CASE WHEN gap <= 5 THEN {pdf_sql('x')} / (px * iv * sqrt(tte)) * oi ELSE 0 END) AS l, sum({pdf_sql('x')} / (px * iv * sqrt(tte)) * oi) AS r FROM j GROUP BY 1, 2, 3)
SELECT pt.symbol, pt.trade_date, pt.px, greatest(least(coalesce(l / nullif(r, 0), 0), 1), 0) AS gamma_score FROM pt LEFT JOIN s USING (symbol, trade_date)""")
def _(t):
    c = t.chain()
    pts = t.day().select("symbol", F.col("day").alias("trade_date"), "close", "open").join(t.spot(c), "trade_date")
    return ex.local_gamma_score(pts.select("symbol", "trade_date", (F.col("spot") * F.col("close") / F.col("open")).alias("px")), c)


@query("iv_moneyness_map", KEY + "mapped_iv:f", with_(CHAIN, SPOT) + """
, k AS (SELECT c.*, ln(strike / spot) AS m FROM chain c JOIN spot USING (trade_date)),
n AS (SELECT *, lead(m) OVER w AS m1, lead(iv) OVER w AS v1, lag(m) OVER w AS m0, lag(iv) OVER w AS v0, count(*) OVER (PARTITION BY trade_date, expiration, instrument_class) AS n FROM k WINDOW w AS (PARTITION BY trade_date, expiration, instrument_class ORDER BY m)),
s AS (SELECT trade_date, expiration, instrument_class, m AS at, CASE WHEN m1 IS NULL THEN m0 ELSE m END AS a, CASE WHEN m1 IS NULL THEN v0 ELSE iv END AS va, CASE WHEN m1 IS NULL THEN m ELSE m1 END AS b, CASE WHEN m1 IS NULL THEN iv ELSE v1 END AS vb,
  min(m) OVER (PARTITION BY trade_date, expiration, instrument_class) AS fm FROM n),
q AS (SELECT trade_date, expiration, instrument_class, strike, n, m - ln(1.01) AS x, greatest(m - ln(1.01), min(m) OVER (PARTITION BY trade_date, expiration, instrument_class)) AS xa FROM n)
SELECT q.trade_date, q.expiration, q.instrument_class, q.strike, greatest(least(CASE WHEN q.n > 1 THEN va + (vb - va) * (x - a) / nullif(b - a, 0) ELSE 0 END, 10), 1e-5) AS mapped_iv
FROM q ASOF JOIN s ON q.trade_date = s.trade_date AND q.expiration = s.expiration AND q.instrument_class = s.instrument_class AND q.xa >= s.at""".replace(" AS at,", " AS knot,").replace("s.at", "s.knot"))
def _(t):
    c = t.chain()
    return ex.iv_moneyness_map(c.join(t.spot(c), "trade_date").withColumn("shift", F.ln(F.lit(1.01))), "shift")


IVS = """
m AS (SELECT trade_date, strike / spot - 1 AS mny, instrument_class = 'C' AS call, iv, open_interest AS oi, greatest(date_diff('day', trade_date, expiration), 0) AS dte FROM chain JOIN spot USING (trade_date)),
a AS (SELECT trade_date, coalesce(median(iv) FILTER (abs(mny) < .005), 0) AS v, median(iv) FILTER (NOT call AND mny > -.06 AND mny < -.02) AS p0, median(iv) FILTER (call AND mny > .02 AND mny < .06) AS c0,
 median(iv) FILTER (abs(mny) < .005 AND dte > 0 AND dte <= 10) AS n0, median(iv) FILTER (abs(mny) < .005 AND dte > 20 AND dte <= 60) AS f0, coalesce(sum(oi) FILTER (call), 0) AS coi, coalesce(sum(oi) FILTER (NOT call), 0) AS poi,
 coalesce(sum(oi) FILTER (NOT call AND mny < -.01), 0) AS op, coalesce(sum(oi) FILTER (call AND mny > .01), 0) AS oc, coalesce(sum(oi) FILTER (abs(mny) < .01), 0) AS aoi, coalesce(sum(mny * oi) FILTER (call), 0) AS cm, coalesce(sum(mny * oi) FILTER (NOT call), 0) AS pm,
 coalesce(sum(oi) FILTER (dte <= 1), 0) AS z, coalesce(sum(oi) FILTER (dte <= 7), 0) AS n7 FROM m GROUP BY 1),
b AS (SELECT *, v AS atm_iv, coalesce(p0, v) - coalesce(c0, v) AS iv_skew_25d, coalesce(f0, v) - coalesce(n0, v) AS iv_term_slope, coalesce(f0, v) / greatest(coalesce(n0, v), 1e-6) AS iv_term_ratio, (coalesce(p0, v) + coalesce(c0, v)) / 2 - v AS iv_butterfly FROM a),
ivs AS (SELECT *, CASE WHEN coi > 0 THEN poi / greatest(coi, 1) ELSE 1 END AS put_call_oi_ratio, op / greatest(oc, 1) AS put_call_oi_ratio_otm, coalesce(pm / nullif(poi, 0), 0) AS put_oi_avg_moneyness, coalesce(cm / nullif(coi, 0), 0) AS call_oi_avg_moneyness,
 z / (coi + poi) AS zero_dte_oi_pct, n7 / (coi + poi) AS near_dte_oi_pct, coalesce(atm_iv - lag(atm_iv) OVER w, 0) AS atm_iv_chg1d, coalesce(iv_skew_25d - lag(iv_skew_25d) OVER w, 0) AS iv_skew_25d_chg1d, coalesce(iv_term_slope - lag(iv_term_slope) OVER w, 0) AS iv_term_slope_chg1d,
 coalesce(iv_butterfly - lag(iv_butterfly) OVER w, 0) AS iv_butterfly_chg1d, coalesce(atm_iv - lag(atm_iv, 5) OVER w, 0) AS atm_iv_chg5d, coalesce(iv_skew_25d - lag(iv_skew_25d, 5) OVER w, 0) AS iv_skew_25d_chg5d, coalesce(iv_term_slope - lag(iv_term_slope, 5) OVER w, 0) AS iv_term_slope_chg5d,
 coalesce(iv_butterfly - lag(iv_butterfly, 5) OVER w, 0) AS iv_butterfly_chg5d, coalesce((coi - lag(coi) OVER w) / greatest(lag(coi + poi) OVER w, 1), 0) AS call_oi_change, coalesce((poi - lag(poi) OVER w) / greatest(lag(coi + poi) OVER w, 1), 0) AS put_oi_change,
 coalesce((aoi - lag(aoi) OVER w) / greatest(lag(coi + poi) OVER w, 1), 0) AS atm_oi_change FROM b WINDOW w AS (ORDER BY trade_date))"""


@query("iv_surface_daily", "trade_date:d " + " ".join(f"{c}:f" for c in (
    "atm_iv iv_skew_25d iv_term_slope iv_term_ratio iv_butterfly put_call_oi_ratio put_call_oi_ratio_otm put_oi_avg_moneyness call_oi_avg_moneyness call_oi_change put_oi_change atm_oi_change zero_dte_oi_pct near_dte_oi_pct "
    "atm_iv_chg1d iv_skew_25d_chg1d iv_term_slope_chg1d iv_butterfly_chg1d atm_iv_chg5d iv_skew_25d_chg5d iv_term_slope_chg5d iv_butterfly_chg5d").split()), with_(CHAIN, SPOT, IVS) + "SELECT * FROM ivs")
def _(t):
    c = t.chain()
    return ex.iv_surface_daily(c, t.spot(c))


@query("skew_regime", "trade_date:d skew_regime skew_percentile:f long_fade_bias:f short_fade_bias:f", with_(CHAIN, SPOT, IVS) + """
, h AS (SELECT trade_date, iv_skew_25d AS x, count(*) OVER f AS n, quantile_cont(iv_skew_25d, 1 / 3::DOUBLE) OVER f AS t1, quantile_cont(iv_skew_25d, 2 / 3::DOUBLE) OVER f AS t2, list(iv_skew_25d) OVER f AS l FROM ivs WINDOW f AS (ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CASE WHEN n < 20 THEN 'mid_skew' WHEN x <= t1 THEN 'low_skew' WHEN x >= t2 THEN 'high_skew' ELSE 'mid_skew' END AS skew_regime, CASE WHEN n < 20 THEN .5 ELSE len(list_filter(l, lambda e: e < x)) / len(l) END AS skew_percentile FROM h)
SELECT *, CASE skew_regime WHEN 'low_skew' THEN .6 WHEN 'high_skew' THEN 1.5 ELSE 1 END AS long_fade_bias, CASE skew_regime WHEN 'low_skew' THEN 1.2 WHEN 'high_skew' THEN .7 ELSE 1 END AS short_fade_bias FROM r""")
def _(t):
    c = t.chain()
    return ex.skew_regime(ex.iv_surface_daily(c, t.spot(c)))


@query("gex_validation", "regime_label n:i mean_range:f median_range:f magnet_share:f n_crossed:i mean_range_crossed:f mean_range_not_crossed:f", with_(DAY, *GREEK, GRID, MODEL) + """
, d AS (SELECT m.*, m.spot AS o, m.spot * d.close / d.open AS c, m.spot * d.high / d.open AS h, m.spot * d.low / d.open AS l FROM day d JOIN model m ON m.trade_date = d.day)
SELECT regime_label, count(*) AS n, avg(h - l) AS mean_range, median(h - l) AS median_range, avg((abs(c - max_gamma) < abs(o - max_gamma))::INT) AS magnet_share, sum((l <= gamma_flip AND h >= gamma_flip)::INT) AS n_crossed,
 avg(h - l) FILTER (l <= gamma_flip AND h >= gamma_flip) AS mean_range_crossed, avg(h - l) FILTER (NOT (l <= gamma_flip AND h >= gamma_flip)) AS mean_range_not_crossed FROM d GROUP BY 1""")
def _(t):
    d = t.day().withColumnRenamed("day", "trade_date").join(model(t), "trade_date")
    px = lambda c: F.col("spot") * F.col(c) / F.col("open")
    d = d.withColumns({"_h": px("high"), "_l": px("low"), "_c": px("close")}).withColumns({"high": F.col("_h"), "low": F.col("_l"), "close": F.col("_c"), "open": F.col("spot")})
    return ex.gex_validation(d)
