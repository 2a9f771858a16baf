"""Dealer exposure and the implied-volatility surface of option chains.

A chain row is expanded over its date's price grid and summed again in the same stage
(explode, then partial aggregation), so what is shuffled is one partial row per date and
grid point, never the contract-by-level matrix. Downstream a date's grid is an array of a
few hundred numbers, interpolated by index arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions import calendar as cal, options as op
from tickloom.functions.windows import by, last_rows, safe_div, whole
from tickloom.operators import joins

RATE = 0.04


def chain_prepare(chain: DataFrame) -> DataFrame:
    """Quotes with a vol and open interest; class letter, years and days to expiry."""
    days = F.datediff("expiration", "trade_date")
    return chain.filter((F.col("iv") > 0) & (F.col("open_interest") > 0)).withColumns({
        "instrument_class": F.upper(F.substring("instrument_class", 1, 1)),
        "tte": F.greatest(days / 365.25, F.lit(1e-6)), "dte": days})


def gex_grid(chain: DataFrame, spot: DataFrame, levels: int = 201, span: float = 0.05, mult: float = 100.0, keys=("trade_date",)) -> DataFrame:
    """Call, put and net gamma exposure and dealer delta on a grid around each date's spot."""
    keys = list(keys)
    df = chain_prepare(chain).join(spot, keys).select(*keys, "spot", "strike", F.greatest("iv", F.lit(1e-5)).alias("iv"), "open_interest", "tte", "instrument_class")
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    level = F.col("spot") * (1 - span + 2 * span * F.col("i") / (levels - 1))
    df = df.withColumn("level", level)
    x = op.d1("level", "strike", RATE, 0.0, "iv", "tte")
    df = df.withColumn("_x", x)
    gex = op.norm_pdf("_x") / (F.col("level") * F.col("iv") * F.sqrt("tte")) * F.col("open_interest") * mult * F.col("level") * F.col("level") * 0.01
    call = F.col("instrument_class") == "C"
    delta = F.when(call, op.norm_cdf("_x")).otherwise(op.norm_cdf("_x") - 1.0)
    return df.groupBy(*keys, "i").agg(
        F.first("spot").alias("spot"), F.first("level").alias("level"), F.sum(F.when(call, gex).otherwise(0.0)).alias("call_gex"),
        F.sum(F.when(~call, -gex).otherwise(0.0)).alias("put_gex"), F.sum(F.when(call, gex).otherwise(-gex)).alias("gex"),
        F.sum(-delta * F.col("open_interest") * mult).alias("dealer_delta"))


def gex_key_levels(grid: DataFrame, keys=("trade_date",)) -> DataFrame:
    """Gamma flip nearest to spot (linear root), largest |GEX| level, put and call walls; the
    lowest grid point wins ties."""
    w = by(keys, "i")
    df = grid.withColumns({"_g1": F.lead("gex").over(w), "_l1": F.lead("level").over(w)})
    mid = (F.col("level") + F.col("_l1")) / 2
    step = F.col("_g1") - F.col("gex")
    root = F.when(F.abs(step) > 1e-20, F.col("level") - F.col("gex") / F.when(F.abs(step) > 1e-20, step) * (F.col("_l1") - F.col("level"))).otherwise(mid)
    flips = F.signum("gex") != F.signum("_g1")
    below, above = F.col("level") <= F.col("spot"), F.col("level") >= F.col("spot")
    return df.groupBy(*keys).agg(
        F.first("spot").alias("spot"),
        F.min_by(root, F.when(flips, F.struct(F.abs(mid - F.col("spot")), F.col("i")))).alias("gamma_flip"),
        F.min_by("level", F.struct(-F.abs("gex"), F.col("i"))).alias("max_gamma"),
        F.min_by("level", F.when(below & (F.col("put_gex") < 0), F.struct("put_gex", "i"))).alias("put_wall"),
        F.min_by("level", F.when(above & (F.col("call_gex") > 0), F.struct(-F.col("call_gex"), F.col("i")))).alias("call_wall"),
        F.median(F.when(F.abs("gex") > 0, F.abs("gex"))).alias("median_gex"), F.sum(F.abs("gex")).alias("total_gex"),
        F.sort_array(F.collect_list(F.struct("i", "level", "gex", "dealer_delta"))).alias("grid"))


def interp(field: str, x: Column, grid: str = "grid") -> Column:
    """Linear interpolation of an evenly spaced grid array, flat outside it."""
    n = F.size(grid)
    lo, hi = F.element_at(grid, F.lit(1))["level"], F.element_at(grid, F.lit(-1))["level"]
    pos = F.least(F.greatest((x - lo) / (hi - lo) * (n - 1), F.lit(0.0)), (n - 1).cast("double"))
    i = F.least(F.floor(pos).cast("int"), n - 2)
    a, b = F.element_at(grid, i + 1)[field], F.element_at(grid, i + 2)[field]
    return a + (b - a) * (pos - i)


def gex_regime(model: DataFrame) -> DataFrame:
    """Sign and label of the net exposure at spot against the grid's median."""
    m = F.coalesce("median_gex", F.lit(1.0))
    df = model.withColumn("net_gex", interp("gex", F.col("spot")))
    g = F.col("net_gex")
    weak = F.abs(g) < m * 0.1
    return df.withColumns({
        "regime_sign": F.when(weak, 0).when(g > 0, 1).otherwise(-1),
        "regime_label": F.when(weak, "low_gamma").when(g > m * 3, "gamma_pinned").when(g > 0, "positive_gamma").otherwise("negative_gamma")})


def near_expiry_gex(chain: DataFrame, spot: DataFrame, max_dte: int = 3, mult: float = 100.0, keys=("trade_date",)) -> DataFrame:
    """Net exposure at spot of the contracts about to expire."""
    df = chain_prepare(chain).filter(F.col("dte") <= max_dte).join(spot, list(keys))
    gex = op.gamma_shares("spot", "strike", RATE, "iv", "tte", "open_interest", mult) * F.col("spot") * F.col("spot") * 0.01
    return df.groupBy(*keys).agg(F.sum(F.when(F.col("instrument_class") == "C", gex).otherwise(-gex)).alias("near_gex"))


def gex_features(df: DataFrame, x: str = "spot", atr: Column | None = None, gex_std: Column | None = None) -> DataFrame:
    """Exposure features of a price ``x`` against its model row (output of ``gex_regime``
    joined with ``near_expiry_gex``)."""
    px = F.col(x)
    a = F.greatest(atr if atr is not None else F.lit(1.0), F.lit(0.01))
    sd = F.greatest(gex_std if gex_std is not None else F.lit(1.0), F.lit(1e-10))
    g = lambda c: interp("gex", c)
    d = lambda c: interp("dealer_delta", c)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    up, dn = -(d(px * 1.01) - d(px)), -(d(px * 0.99) - d(px))
    dx = px * 0.001
    hood = sum((F.abs(g(px + float(o))) for o in range(-15, 16, 5)), F.lit(0.0))
    here = F.abs(g(px))
    return df.withColumns({
        "gex_regime_sign": F.col("regime_sign"), "gex_net_normalized": F.col("net_gex") / sd,
        "gamma_flip_distance": zero((px - F.col("gamma_flip")) / a), "dist_to_max_gamma": zero((px - F.col("max_gamma")) / a),
        "dist_to_put_wall": zero((px - F.col("put_wall")) / a), "dist_to_call_wall": zero((px - F.col("call_wall")) / a),
        "hedge_flow_1pct_up": up, "hedge_flow_1pct_down": dn, "hedge_flow_asymmetry": F.abs(up) - F.abs(dn),
        "gex_concentration": here / F.greatest("total_gex", F.lit(1e-10)),
        "near_expiry_gamma_pct": F.when(F.abs("net_gex") < 1e-10, 0.0).otherwise(F.least(F.abs(zero(F.col("near_gex"))) / F.greatest(F.abs("net_gex"), F.lit(1e-10)), F.lit(1.0))),
        "gex_slope_at_spot": (g(px + dx) - g(px - dx)) / (2 * dx), "nearby_gamma_score": here / F.greatest(hood, F.lit(1e-10))})


def exposure_model(chain: DataFrame, spot: DataFrame, levels: int = 201, keys=("trade_date",)) -> DataFrame:
    """One row per date: key levels, regime, near-expiry exposure and the grid array."""
    model = gex_regime(gex_key_levels(gex_grid(chain, spot, levels, keys=keys), keys))
    return model.join(near_expiry_gex(chain, spot, keys=keys), list(keys), "left")


def gex_bar_features(bars: DataFrame, model: DataFrame, day: str = "day", max_days: int = 3, history: int = 60, min_history: int = 10) -> DataFrame:
    """Features of the last chain before each bar's day (at most ``max_days`` business days
    old) at the bar's price, given as ``rel``: price over the day's reference. The net
    exposure is scaled by the deviation of its own last ``history`` daily closes."""
    m = model.withColumn("_k", F.lit(1)).select("_k", F.col("trade_date").alias("chain_day"), F.struct(*[c for c in model.columns]).alias("m"))
    left = bars.withColumn("_k", F.lit(1)).withColumn("_prev", cal.previous_business_date(day))
    hit = joins.asof_business_days(left, m, ["_k"], "_prev", "chain_day", ["m"], max_days).filter(F.col("m").isNotNull())
    df = hit.select(*bars.columns, "m.*").withColumn("px", F.col("spot") * F.col("rel"))
    w = by(("symbol",), day)
    df = df.withColumn("_net", interp("gex", F.col("px")))
    f = last_rows(w, history, skip_current=True)
    sd = F.when(F.count("_net").over(f) >= min_history, F.stddev_pop("_net").over(f)).otherwise(1.0)
    return gex_features(df.withColumn("_sd", sd), "px", F.col("atr"), F.col("_sd")).drop("_net", "_sd")


def local_gamma_score(points: DataFrame, chain: DataFrame, local: float = 5.0, relative: float = 15.0, keys=("trade_date",)) -> DataFrame:
    """Gamma within ``local`` of a price over gamma within ``relative``. Strikes are bucketed
    by the wider radius; a price visits its own bucket and both neighbours."""
    keys = list(keys)
    c = chain_prepare(chain).withColumn("_b", F.floor(F.col("strike") / relative))
    p = points.withColumn("_b", F.explode(F.array(*[F.floor(F.col("px") / relative) + k for k in (-1, 0, 1)])))
    j = p.join(c.select(*keys, "_b", "strike", "iv", "open_interest", "tte"), [*keys, "_b"])
    gap = F.abs(F.col("px") - F.col("strike"))
    g = op.bs_gamma("px", "strike", RATE, F.greatest("iv", F.lit(0.00001)), "tte") * F.col("open_interest") * 100 * F.col("px") * F.col("px") * 0.01
    s = j.filter(gap <= relative).groupBy(*points.columns).agg(F.sum(F.when(gap <= local, g).otherwise(0.0)).alias("_l"), F.sum(g).alias("_r"))
    out = points.join(s, points.columns, "left")
    return out.withColumn("gamma_score", F.coalesce(F.least(F.greatest(safe_div("_l", "_r"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).drop("_l", "_r")


def iv_moneyness_map(chain: DataFrame, shift: str, keys=("trade_date", "expiration", "instrument_class")) -> DataFrame:
    """IV of each contract after the spot moves by the log factor in ``shift``: the smile at
    its new moneyness, linear between strikes and beyond the ends, clipped to [1e-5, 10].

    Knots and query points of a smile are unioned and the last knot is carried, so a smile is
    sorted once instead of being paired with itself. Needs at least two strikes, else 1e-5.
    """
    keys = list(keys)
    w = by(keys, "m")
    k = chain.withColumn("m", F.ln(F.col("strike") / F.col("spot"))).withColumns({
        "m1": F.lead("m").over(w), "v1": F.lead("iv").over(w), "m0": F.lag("m").over(w), "v0": F.lag("iv").over(w), "_n": F.count(F.lit(1)).over(whole(keys))})
    # the segment a knot opens; the last knot reuses the one before it
    seg = F.when(F.col("m1").isNotNull(), F.struct(F.col("m").alias("a"), F.col("iv").alias("va"), F.col("m1").alias("b"), F.col("v1").alias("vb"))).otherwise(
        F.struct(F.col("m0").alias("a"), F.col("v0").alias("va"), F.col("m").alias("b"), F.col("iv").alias("vb")))
    k = k.withColumn("_seg", seg)
    knots = k.select(*keys, F.col("m").alias("_x"), F.lit(0).alias("_side"), "_seg", F.lit(None).cast("double").alias("strike"), F.col("_n"))
    asks = k.select(*keys, (F.col("m") - F.col(shift)).alias("_x"), F.lit(1).alias("_side"), F.lit(None).cast(k.schema["_seg"].dataType).alias("_seg"), "strike", "_n")
    o = by(keys, ["_x", "_side"])
    u = knots.unionByName(asks).withColumns({
        "_hit": F.last("_seg", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, 0)),
        "_first": F.first("_seg", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    u = u.filter(F.col("_side") == 1).withColumn("_s", F.coalesce("_hit", "_first"))
    s = F.col("_s")
    line = s["va"] + (s["vb"] - s["va"]) * (F.col("_x") - s["a"]) / F.nullif(s["b"] - s["a"], F.lit(0.0))
    return u.select(*keys, "strike", F.greatest(F.least(F.when(F.col("_n") > 1, line).otherwise(0.0), F.lit(10.0)), F.lit(1e-5)).alias("mapped_iv"))


def iv_surface_daily(chain: DataFrame, spot: DataFrame, keys=("trade_date",)) -> DataFrame:
    """Smile, term-structure and open-interest positioning per date, with changes against the
    previous and the fifth previous date. One aggregation pass over the chain."""
    df = chain.join(spot, list(keys)).withColumns({"mny": F.col("strike") / F.col("spot") - 1.0, "dte": F.greatest(F.datediff("expiration", "trade_date"), F.lit(0))})
    m, call, oi, iv = F.col("mny"), F.col("instrument_class") == "C", F.col("open_interest"), F.col("iv")
    atm, dte = F.abs(m) < 0.005, F.col("dte")
    med = lambda cond: F.median(F.when(cond, iv))
    tot = lambda cond: F.sum(F.when(cond, oi).otherwise(0.0))
    a = df.groupBy(*keys).agg(
        med(atm).alias("_atm"), med(~call & (m > -0.06) & (m < -0.02)).alias("_p25"), med(call & (m > 0.02) & (m < 0.06)).alias("_c25"),
        med(atm & (dte > 0) & (dte <= 10)).alias("_near"), med(atm & (dte > 20) & (dte <= 60)).alias("_far"),
        tot(call).alias("_coi"), tot(~call).alias("_poi"), tot(~call & (m < -0.01)).alias("_otmp"), tot(call & (m > 0.01)).alias("_otmc"), tot(F.abs(m) < 0.01).alias("_aoi"),
        F.sum(F.when(call, m * oi).otherwise(0.0)).alias("_cm"), F.sum(F.when(~call, m * oi).otherwise(0.0)).alias("_pm"), tot(dte <= 1).alias("_z"), tot(dte <= 7).alias("_n7"))
    zero, one = F.lit(0.0), F.lit(1.0)
    v = F.coalesce("_atm", zero)
    p, c = F.coalesce("_p25", v), F.coalesce("_c25", v)
    near, far = F.coalesce("_near", v), F.coalesce("_far", v)
    toi = F.col("_coi") + F.col("_poi")
    a = a.withColumns({
        "atm_iv": v, "iv_skew_25d": p - c, "iv_term_slope": far - near, "iv_term_ratio": far / F.greatest(near, F.lit(1e-6)), "iv_butterfly": (p + c) / 2 - v,
        "put_call_oi_ratio": F.when(F.col("_coi") > 0, F.col("_poi") / F.greatest("_coi", one)).otherwise(1.0), "put_call_oi_ratio_otm": F.col("_otmp") / F.greatest("_otmc", one),
        "put_oi_avg_moneyness": F.coalesce(safe_div("_pm", "_poi"), zero), "call_oi_avg_moneyness": F.coalesce(safe_div("_cm", "_coi"), zero),
        "zero_dte_oi_pct": F.coalesce(safe_div("_z", toi), zero), "near_dte_oi_pct": F.coalesce(safe_div("_n7", toi), zero), "_toi": toi})
    w = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]) if len(keys) > 1 else Window.partitionBy(F.lit(1)).orderBy(keys[0])
    prev = lambda c, n=1: F.lag(c, n).over(w)
    cols = {}
    for n, tag in ((1, "1d"), (5, "5d")):
        for b in ("atm_iv", "iv_skew_25d", "iv_term_slope", "iv_butterfly"):
            cols[f"{b}_chg{tag}"] = F.coalesce(F.col(b) - prev(b, n), zero)
    for name, c0 in (("call_oi_change", "_coi"), ("put_oi_change", "_poi"), ("atm_oi_change", "_aoi")):
        cols[name] = F.coalesce((F.col(c0) - prev(c0)) / F.greatest(prev("_toi"), one), zero)
    return a.withColumns(cols).drop(*[c for c in a.columns if c.startswith("_")])


# Size bias of long and short fades per skew regime.
SKEW_BIAS = {"low_skew": (0.6, 1.2), "mid_skew": (1.0, 1.0), "high_skew": (1.5, 0.7)}


def skew_regime(daily: DataFrame, column: str = "iv_skew_25d", history: int = 60, min_history: int = 20, day: str = "trade_date") -> DataFrame:
    """Tercile of the skew in its trailing history, its percentile and the fade biases. One
    row per date: a bounded series."""
    f = Window.partitionBy(F.lit(1)).orderBy(day).rowsBetween(-history, -1)
    df = daily.withColumns({"_n": F.count(column).over(f), "_t1": F.percentile(column, F.lit(1 / 3)).over(f), "_t2": F.percentile(column, F.lit(2 / 3)).over(f), "_h": F.collect_list(column).over(f)})
    x = F.col(column)
    known = (F.col("_n") >= min_history) & x.isNotNull()
    reg = F.when(known & (x <= F.col("_t1")), "low_skew").when(known & (x >= F.col("_t2")), "high_skew").otherwise("mid_skew")
    df = df.withColumns({"skew_regime": reg, "skew_percentile": F.when(known, F.size(F.filter("_h", lambda e: e < x)) / F.nullif(F.size("_h"), F.lit(0))).otherwise(0.5)})
    bias = lambda i: F.coalesce(*[F.when(F.col("skew_regime") == k, F.lit(v[i])) for k, v in SKEW_BIAS.items()])
    return df.withColumns({"long_fade_bias": bias(0), "short_fade_bias": bias(1)}).drop("_n", "_t1", "_t2", "_h")


def gex_validation(df: DataFrame) -> DataFrame:
    """By regime: days, mean and median range, share closing nearer to the largest-gamma
    level than they opened, and the ranges of days that did and did not cross the flip."""
    rng = F.col("high") - F.col("low")
    nearer = F.abs(F.col("close") - F.col("max_gamma")) < F.abs(F.col("open") - F.col("max_gamma"))
    crossed = F.when(F.col("gamma_flip").isNotNull(), (F.col("low") <= F.col("gamma_flip")) & (F.col("high") >= F.col("gamma_flip")))
    return df.groupBy("regime_label").agg(
        F.count(F.lit(1)).alias("n"), F.avg(rng).alias("mean_range"), F.median(rng).alias("median_range"), F.avg(nearer.cast("int")).alias("magnet_share"),
        F.sum(crossed.cast("int")).alias("n_crossed"), F.avg(F.when(crossed, rng)).alias("mean_range_crossed"), F.avg(F.when(~crossed, rng)).alias("mean_range_not_crossed"))


CONTRACT = "array<struct<volatility:double,openInterest:double,mark:double>>"


def flatten_chain_json(snapshots: DataFrame, text: str = "payload", keys=("trade_date",)) -> DataFrame:
    """Nested {callExpDateMap, putExpDateMap: {"date:dte": {strike: [contract]}}} to rows;
    vols quoted in percent (median above 1) become fractions."""
    schema = f"struct<callExpDateMap:map<string,map<string,{CONTRACT}>>,putExpDateMap:map<string,map<string,{CONTRACT}>>>"
    p = snapshots.withColumn("_p", F.from_json(text, schema))
    out = None
    for field, letter in (("callExpDateMap", "C"), ("putExpDateMap", "P")):
        side = p.select(*keys, F.lit(letter).alias("instrument_class"), F.explode(f"_p.{field}").alias("_e", "_s")) \
            .select(*keys, "instrument_class", "_e", F.explode("_s").alias("_k", "_c")).select(*keys, "instrument_class", "_e", "_k", F.explode("_c").alias("c"))
        out = side if out is None else out.unionByName(side)
    exp = F.split("_e", ":")
    out = out.select(*keys, "instrument_class", F.to_date(exp[0]).alias("expiration"), exp[1].cast("int").alias("dte"), F.col("_k").cast("double").alias("strike"),
                     F.col("c.volatility").alias("iv"), F.col("c.openInterest").alias("open_interest"), F.col("c.mark").alias("mark"))
    med = out.groupBy(*keys).agg(F.median("iv").alias("_m"))
    return out.join(med, list(keys)).withColumn("iv", F.when(F.col("_m") > 1.0, F.col("iv") / 100.0).otherwise(F.col("iv"))).drop("_m")
