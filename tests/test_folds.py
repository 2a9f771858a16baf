"""Walk-forward callbacks see their own past only, and every test row once."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import daily as dl, evaluation as ev, folds, labels as lb, selection as sl


@pytest.fixture(scope="module")
def table(spark):
    rng, rows = random.Random(5), []
    for symbol, n in (("a", 60), (None, 47), ("short", 20)):
        for i in range(n):
            x = None if rng.random() < 0.05 else rng.gauss(0, 1)
            rows.append((symbol, dt.date(2021, 12, 1) + dt.timedelta(days=2 * i), x, rng.expovariate(1.0), 7.0))
    return spark.createDataFrame(rows, "symbol string, day date, x double, y double, flat double")


def borders(n, n_folds, first):
    per = (n - first) // n_folds
    return [(first + f * per, n if f == n_folds - 1 else first + (f + 1) * per) for f in range(n_folds)]


def by_symbol(df):
    out = {}
    for r in df.orderBy("day").collect():
        out.setdefault(r["symbol"], []).append(r)
    return out


def test_callback_sees_its_past(table):
    cut = sl.walk_forward_folds(table.select("symbol", "day"), 3, 20)
    span = lambda train, test: test.assign(last=train["day"].max(), n=len(train))[["symbol", "day", "fold", "last", "n"]]
    got = by_symbol(folds.fold_apply(table, cut, span, "symbol string, day date, fold int, last date, n long"))
    for symbol, rows in by_symbol(table).items():
        want = [(rows[i]["day"], f, rows[a - 1]["day"], a) for f, (a, b) in enumerate(borders(len(rows), 3, 20)) for i in range(a, b)]
        assert [(r["day"], r["fold"], r["last"], r["n"]) for r in got.get(symbol, [])] == want


def test_too_large_folds_end_with_an_error(table):
    cut = sl.walk_forward_folds(table.select("symbol", "day"), 3, 20)
    with pytest.raises(Exception, match="more than 30 rows"):
        folds.fold_apply(table, cut, lambda train, test: test[["day"]], "day date", max_rows=30).collect()


def test_fit_by_spark(table):
    cut = sl.walk_forward_folds(table.select("symbol", "day"), 3, 20)

    def fit(train):
        mean = train.agg(F.avg("y")).first()[0]
        return lambda test: test.select("symbol", "day", "fold", F.lit(mean).alias("pred"))

    got = {(r["symbol"], r["day"]): (r["fold"], r["pred"]) for r in folds.fold_fit(table, cut, 3, fit).collect()}
    parts = by_symbol(table)
    marks = {s: borders(len(rows), 3, 20) for s, rows in parts.items()}
    for f in range(3):
        mean = np.mean([r["y"] for s, rows in parts.items() for r in rows[:marks[s][f][0]]])
        for s, rows in parts.items():
            for r in rows[slice(*marks[s][f])]:
                assert got[s, r["day"]] == (f, pytest.approx(mean))


def test_walk_forward_anomaly(table):
    got = by_symbol(dl.walk_forward_anomaly(table, ["x", "y", "flat"], 3, 20, steps=64))
    disc = lambda v, p: sorted(v)[int(np.ceil(p * len(v))) - 1]
    for symbol, rows in by_symbol(table).items():
        data, out = np.array([[r["x"] or 0.0, r["y"], r["flat"]] for r in rows]), []
        for a, b in borders(len(rows), 3, 20):
            raw = np.zeros(len(rows))
            for c in range(2):  # the third feature has no spread
                past = data[:a, c]
                raw += np.abs(data[:, c] - disc(past, 0.5)) / (disc(past, 0.75) - disc(past, 0.25)) / 3
            past, limit = raw[:a], disc(raw[:a], 0.95)
            for i in range(a, b):
                score = np.clip((raw[i] - past.min()) / (past.max() - past.min()), 0, 1)
                out.append((pytest.approx(score), int(raw[i] > limit), np.floor((past <= raw[i]).mean() * 64 + 1e-9) / 64))
        assert [(r["anomaly_score"], r["anomaly_label"], r["anomaly_percentile"]) for r in got.get(symbol, [])] == out


def test_weekly_range_is_that_of_the_weeks_first_row(spark):
    day = lambda i: dt.date(2024, 3, 4) + dt.timedelta(days=i)  # a Monday
    bars = spark.createDataFrame([("s", day(i), 105.0) for i in (0, 2, 8, 9, 14)], "symbol string, trading_day date, close double")
    ranges = spark.createDataFrame([("s", day(0), 110.0, 100.0), ("s", day(2), 200.0, 100.0), ("s", day(8), 105.0, 105.0)], "symbol string, trading_day date, pred_high double, pred_low double")
    got = [tuple(r) for r in lb.predicted_ranges_attach(bars, ranges, ranges).orderBy("trading_day").select("pred_range_pos_daily", "pred_range_width_weekly", "pred_range_pos_weekly").collect()]
    assert got == [(0.5, 10.0, 0.5), (0.05, 10.0, 0.5), (0.0, 0.0, 0.5), (0.0, 0.0, 0.5), (0.0, 0.0, 0.0)]


def test_small_regimes_are_left_out(spark):
    rows = [("s", dt.date(2024, 1, 1) + dt.timedelta(days=i), 12.0 + i, 9.0 + i, 10.0 + i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, day date, high double, low double, close double, atr double")
    guess = df.filter("atr < 3").select("symbol", "day", (F.col("high") + 1).alias("pred_high"), F.col("low").alias("pred_low"))
    got = {(r["source"], r["regime"]): (r["n"], r["avg_upside"], r["avg_downside"], r["bias"]) for r in ev.range_asymmetry(df, "atr", guess).collect()}
    # 8 days each are beyond the quantiles, below the 10 asked for; 3 predicted days, below 5
    assert got == {("realized", "all"): (40, 3.0, 0.0, -3.0), ("realized", "normal"): (24, 3.0, 0.0, -3.0), ("predicted", "all"): (3, 4.0, 0.0, -4.0)}
