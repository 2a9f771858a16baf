"""Scans over blocks equal a plain walk over each series, whatever the block size."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import daily as dl, labels as lb, models as md, scans

SCHEMA = "symbol string, day date, at long, high double, low double, close double, z double"


def series(n_series=12, n=150, seed=3):
    """Series of different volatility; a null key, missing values, repeated prices, short ones."""
    rng, out = random.Random(seed), []
    for k in range(n_series):
        px, vol = 100.0, 0.004 * (k + 1)
        for i in range(n if k else 3):
            px = round(px * (1 + rng.gauss(0, vol)), 1)
            z = None if rng.random() < 0.05 else rng.gauss(0.3 * (k % 3), 1 + k / 4)
            out.append((f"s{k}" if k != 5 else None, dt.date(2019, 12, 1) + dt.timedelta(days=3 * i), i, px + rng.random(), px - rng.random(), px, z))
    return out


@pytest.fixture(scope="module")
def rows():
    return series()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def by_symbol(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("block", [1, 8, 1000])
def test_resetting_sums(table, rows, block):
    got = {(r["symbol"], r["at"]): (r["up"], r["down"]) for r in scans.resetting_sums(table, ["symbol"], "at", "z", 0.5, 5.0, block).collect()}
    assert len(got) == len(rows)
    resets = 0
    for symbol, part in by_symbol(rows).items():
        up = down = 0.0
        for r in part:
            want = (0.0, 0.0)
            if r[6] is not None:
                up, down = want = max(0.0, up + r[6] - 0.5), max(0.0, down - r[6] - 0.5)
                if max(up, down) > 5:
                    up, down, resets = 0.0, 0.0, resets + 1
            assert got[symbol, r[2]] == pytest.approx(want, abs=1e-9)
    assert resets > 100


def turns_of(prices, threshold):
    """The turning points by the walk's definition, as (row, kind)."""
    out, hi, lo, seek, i = [], 0, 0, 0, 0
    while i + 1 < len(prices):
        i += 1
        if seek >= 0 and prices[i] > prices[hi]:
            hi = i
        if seek <= 0 and prices[i] < prices[lo]:
            lo = i
        opening = seek == 0
        if seek <= 0 and prices[i] / prices[lo] - 1.0 >= threshold:
            out.append((lo, "trough"))
            seek, hi = 1, i
        elif seek >= 0 and 1.0 - prices[i] / prices[hi] >= threshold:
            out.append((hi, "peak"))
            seek, lo = -1, i
        if opening and out:
            i = out[0][0]
    return out


@pytest.mark.parametrize("block", [1, 8, 1000])
def test_turning_points(table, rows, block):
    got = {}
    for r in lb.zigzag(table, 0.05, block_rows=block).orderBy("turn_no").collect():
        got.setdefault(r["symbol"], []).append((r["day"], r["close"], r["kind"], r["turn_no"]))
    found = 0
    for symbol, part in by_symbol(rows).items():
        want = [(part[i][1], part[i][5], kind, n + 1) for n, (i, kind) in enumerate(turns_of([r[5] for r in part], 0.05))]
        assert got.get(symbol, []) == want
        found += len(want)
    assert found > 200


def test_turning_points_skip_missing_prices(spark):
    prices = [None, 100.0, None, 106.0, None, 100.0, 90.0, None]
    rows = [("x", dt.date(2020, 1, 1) + dt.timedelta(days=i), p) for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "symbol string, day date, close double")
    for block in (1, 3, 100):
        got = [(r["close"], r["kind"]) for r in lb.zigzag(df, 0.05, block_rows=block).orderBy("turn_no").collect()]
        assert got == [(100.0, "trough"), (106.0, "peak")]


def wilder(part, period=14):
    out, g, s, t, p, m, dxs, adx = [(50.0, 0.0)], 0.0, 0.0, 0.0, 0.0, 0.0, [], 0.0
    for i in range(1, len(part)):
        (_, _, _, h0, l0, c0, _), (_, _, _, h, l, c, _) = part[i - 1], part[i]
        up, down = h - h0, l0 - l
        keep, a = (1.0, 1.0) if i <= period else ((period - 1) / period, (period - 1) / period)
        g, s = g * a + max(c - c0, 0) / period, s * a + max(c0 - c, 0) / period
        t = t * keep + max(h - l, abs(h - c0), abs(l - c0))
        p, m = p * keep + (up if up > down and up > 0 else 0), m * keep + (down if down > up and down > 0 else 0)
        if i < period:
            out.append((50.0, 0.0))
            continue
        dxs.append(100 * abs(p - m) / (p + m) if p + m > 0 else 0.0)
        if len(dxs) == period:
            adx = sum(dxs) / period
        elif len(dxs) > period:
            adx = (adx * (period - 1) + dxs[-1]) / period
        out.append((100 * g / (g + s) if g + s > 0 else 50.0, adx))
    return out


@pytest.mark.parametrize("block", [1, 16, 1000])
def test_wilder(table, rows, block):
    got = {(r["symbol"], r["day"]): (r["rsi"], r["adx"]) for r in md.wilder_rsi_adx(table, block_rows=block).collect()}
    assert len(got) == len(rows)
    for symbol, part in by_symbol(rows).items():
        for r, want in zip(part, wilder(part)):
            assert got[symbol, r[1]] == pytest.approx(want, abs=1e-7)


def test_empty_tables(table):
    none = table.filter(F.lit(False))
    assert dl.cusum(none, "close").collect() == []
    assert lb.zigzag(none).collect() == []
    assert md.wilder_rsi_adx(none).collect() == []


def test_no_python_in_the_plans(table):
    for df in (dl.cusum(table, "close"), lb.zigzag(table), md.wilder_rsi_adx(table)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Pandas" not in plan and "Python" not in plan
