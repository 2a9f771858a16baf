"""Option pricing as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.calendar import col

SQRT_2PI = 2.5066282746310002

# Hart's rational approximation of the normal tail (as given by West, 2005).
HART_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def norm_pdf(x) -> Column:
    x = col(x)
    return F.exp(-0.5 * x * x) / F.lit(SQRT_2PI)


def _horner(coef, x: Column) -> Column:
    out = F.lit(coef[0])
    for c in coef[1:]:
        out = out * x + F.lit(c)
    return out


def norm_cdf(x) -> Column:
    """Normal distribution function, near double precision; Spark has no erf."""
    x = col(x)
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    tail = e * _horner(HART_NUM, a) / _horner(HART_DEN, a)
    far = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = a + k / far
    c = F.when(a > 37, 0.0).when(a < 7.07106781186547, tail).otherwise(e / far / F.lit(SQRT_2PI))
    return F.when(x > 0, 1.0 - c).otherwise(c)


def d1(s, k, r, q, sigma, t) -> Column:
    s, k, sigma, t = col(s), col(k), col(sigma), col(t)
    return (F.ln(s / k) + (r - q + 0.5 * sigma * sigma) * t) / (sigma * F.sqrt(t))


def bs_gamma(s, k, r, sigma, t) -> Column:
    """Black-Scholes gamma, 0 when vol or time is gone."""
    s, sigma, t = col(s), col(sigma), col(t)
    ok = (sigma > 0) & (t > 0) & (s > 0)
    sd, tt = F.when(ok, sigma).otherwise(1.0), F.when(ok, t).otherwise(1.0)
    return F.when(ok, norm_pdf(d1(s, k, r, 0.0, sd, tt)) / (s * sd * F.sqrt(tt))).otherwise(0.0)


def with_greeks(df: DataFrame, s: str, k: str, r: float, q: float, sigma: str, t: str, is_call: Column) -> DataFrame:
    """Adds d1, gamma, delta, vega and price (continuous yield ``q``); zero greeks and the
    payoff when vol or time is gone. Each normal probability is a column of its own layer:
    one expression tree would repeat d1 dozens of times."""
    s, k, sigma, t = F.col(s), F.col(k), F.col(sigma), F.col(t)
    ok = (sigma > 0) & (t > 0) & (s > 0)
    df = df.withColumns({"_ok": ok, "_call": is_call, "_sd": F.when(ok, sigma * F.sqrt(t)).otherwise(1.0), "_t": F.when(ok, t).otherwise(1.0)})
    df = df.withColumn("_x", (F.ln(s / k) + (r - q) * F.col("_t")) / F.col("_sd") + F.col("_sd") / 2).withColumn("_y", F.col("_x") - F.col("_sd"))
    df = df.withColumns({"_nx": norm_cdf("_x"), "_ny": norm_cdf("_y"), "_px": norm_pdf("_x"), "_dq": F.exp(-q * F.col("_t")), "_dr": F.exp(-r * F.col("_t"))})
    nx, ny, px, call, sq, kr = (F.col(c) for c in ("_nx", "_ny", "_px", "_call", "_dq", "_dr"))
    value = F.when(call, s * sq * nx - k * kr * ny).otherwise(k * kr * (1.0 - ny) - s * sq * (1.0 - nx))
    pick = lambda c: F.when(F.col("_ok"), c).otherwise(0.0)
    df = df.withColumns({
        "d1": pick(F.col("_x")), "gamma": pick(px / (s * F.col("_sd"))), "delta": pick(F.when(call, nx).otherwise(nx - 1.0)), "vega": pick(s * sq * px * F.sqrt("_t")),
        "price": F.when(F.col("_ok"), value).otherwise(F.greatest(F.when(call, s - k).otherwise(k - s), F.lit(0.0)))})
    return df.drop("_ok", "_call", "_sd", "_t", "_x", "_y", "_nx", "_ny", "_px", "_dq", "_dr")


def gamma_shares(s, k, r, sigma, t, oi, mult: float = 100.0) -> Column:
    """|gamma * contract size * open interest|, 0 without a valid vol or open interest."""
    g = bs_gamma(s, k, r, sigma, t)
    ok = (col(sigma) > 0) & (col(oi) > 0)
    return F.when(ok, F.abs(g * mult * col(oi))).otherwise(0.0)


def _cdf_array(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    e = np.exp(-a * a / 2)
    far = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = a + k / far
    near = np.polyval(HART_NUM, a) / np.polyval(HART_DEN, a)
    c = np.where(a > 37, 0.0, e * np.where(a < 7.07106781186547, near, 1.0 / far / SQRT_2PI))
    return np.where(x > 0, 1.0 - c, c)


def implied_vol(price, s, k, t, r: float, q: float, is_call, low: float = 1e-12, high: float = 10.0, steps: int = 60) -> Column:
    """Volatility that reprices the quote: a fixed number of bisection steps on whole Arrow
    batches (as a JVM fold of the same steps it measured fifty times slower). Prices outside
    the no-arbitrage band move to its edge; intrinsic gives 0."""
    @F.pandas_udf("double")
    def solve(price: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, call: pd.Series) -> pd.Series:
        px, s, k, t, call = (np.asarray(c, dtype=float) for c in (price, s, k, t, call))
        sd, kd = s * np.exp(-q * t), k * np.exp(-r * t)
        lower = np.maximum(np.where(call > 0, sd - kd, kd - sd), 0.0)
        upper = np.where(call > 0, sd, kd)
        p = np.minimum(np.maximum(px, lower + 2e-12), upper - 2e-12)
        root_t, drift = np.sqrt(t), np.log(s / k) + (r - q) * t
        lo, hi = np.full(len(px), low), np.full(len(px), high)
        for _ in range(steps):
            mid = (lo + hi) / 2
            w = mid * root_t
            x = drift / w + w / 2
            nx, ny = _cdf_array(x), _cdf_array(x - w)
            model = np.where(call > 0, sd * nx - kd * ny, kd * (1.0 - ny) - sd * (1.0 - nx))
            cheap = model < p
            lo, hi = np.where(cheap, mid, lo), np.where(cheap, hi, mid)
        return pd.Series(np.where(np.abs(px - lower) < 1e-10, 0.0, (lo + hi) / 2))

    return solve(col(price), col(s), col(k), col(t), col(is_call).cast("int"))


def parse_option_symbol(text) -> dict[str, Column]:
    """21 characters: root (6), yymmdd, C or P, strike in thousandths (8)."""
    t = F.when(F.length(col(text)) == 21, col(text))
    century = F.when(F.substring(t, 7, 2).cast("int") >= 69, "19").otherwise("20")
    return {"root": F.trim(F.substring(t, 1, 6)), "expiration": F.to_date(F.try_to_timestamp(F.concat(century, F.substring(t, 7, 6)), F.lit("yyyyMMdd"))),
            "instrument_class": F.substring(t, 13, 1), "strike": F.substring(t, 14, 8).cast("double") / 1000.0}


def position_size_mult(width, target: float = 10.0, lo: float = 0.3, hi: float = 3.0) -> Column:
    """Risk budget over predicted width, bounded; 1 without a width."""
    w = col(width)
    ok = w > 0
    return F.when(ok, F.greatest(F.least(target / F.when(ok, w), F.lit(hi)), F.lit(lo))).otherwise(1.0)


# Consumption-ratio buckets (name, upper bound, expected next half-hour range).
CONSUMPTION = (("low", 0.3, 8.7), ("normal", 0.7, 12.4), ("elevated", 0.9, 15.0), ("extreme", 999.0, 26.2))


def forward_vol_bucket(range_so_far, width) -> dict[str, Column]:
    """Consumed share of the predicted range, its bucket, expected range and size factor."""
    w = col(width)
    ratio = F.when(w > 0, col(range_so_far) / F.when(w > 0, w))
    name = exp = None
    for n, hi, e in CONSUMPTION:
        name = F.when(ratio < hi, n) if name is None else name.when(ratio < hi, n)
        exp = F.when(ratio < hi, e) if exp is None else exp.when(ratio < hi, e)
    name, exp = name.otherwise("normal"), exp.otherwise(12.4)
    known = ratio.isNotNull()
    return {"consumption_ratio": F.coalesce(ratio, F.lit(0.0)), "vol_bucket": F.when(known, name).otherwise("unknown"),
            "expected_range": F.when(known, exp).otherwise(12.0), "size_modulator": F.when(known, F.greatest(F.least(12.4 / exp, F.lit(1.5)), F.lit(0.3))).otherwise(1.0)}
