"""Properties every plan must keep: causality, partition invariance, block invariance."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import column
from tickloom.functions import options as op
from tickloom.functions.ema import with_ema
from tickloom.operators import daily as dl, evaluation as ev, intraday as it, joins, labels as lb, profile as pf, selection as sl


def walk(n, seed=1, start=100.0):
    rng = random.Random(seed)
    out, p = [], start
    for _ in range(n):
        o = p
        c = round(o + rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5]), 2)
        out.append((o, max(o, c) + 0.25, min(o, c) - 0.25, c))
        p = c
    return out


FEATURES = {
    "bollinger": (lambda df: it.bollinger(df, block_rows=100), "bb_width_z"),
    "temporal": (lambda df: it.temporal_interactions(df, tod_mode="running", block_rows=100), "delta_exhaustion"),
    "levels": (it.price_levels, "vwap_z"),
    "slope": (lambda df: it.rolling_slope_norm(df, {"s": "volume"}, block_rows=100), "s"),
    "same_dir": (lambda df: it.consecutive_same_dir(df, block_rows=100), "consecutive_same_dir"),
}


@pytest.mark.parametrize("name", FEATURES)
def test_prefix_equals_full(make_bars, name):
    fn, col = FEATURES[name]
    bars = make_bars(walk(400), step=5)
    full, part = column(fn(bars), col), column(fn(bars.orderBy("dt").limit(250)), col)
    assert [None if x is None else round(x, 9) for x in full[:250]] == [None if x is None else round(x, 9) for x in part]


@pytest.mark.parametrize("name", ["bollinger", "slope", "same_dir"])
def test_blocks_do_not_change_results(make_bars, name):
    bars = make_bars(walk(400, 3), step=5)
    small = {"bollinger": lambda b: it.bollinger(bars, block_rows=b), "slope": lambda b: it.rolling_slope_norm(bars, {"s": "volume"}, block_rows=b), "same_dir": lambda b: it.consecutive_same_dir(bars, block_rows=b)}[name]
    col = FEATURES[name][1]
    assert [round(x, 9) for x in column(small(83), col)] == [round(x, 9) for x in column(small(100000), col)]


def test_forward_frames_cross_blocks(make_bars):
    bars = make_bars(walk(300, 5), step=5).withColumn("side", F.lit(1))
    a, b = (column(lb.realized_mfe(bars, 45, block_rows=n), "mfe_pts") for n in (47, 100000))
    assert a == b


@pytest.mark.parametrize("parts", [1, 4, 200])
def test_partition_invariance(spark, make_bars, parts):
    bars = make_bars(walk(300, 7), step=5)
    want = column(it.vwap_sigma_bands(bars), "vwap_up_1s")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = column(it.vwap_sigma_bands(bars.orderBy(F.rand(3)).repartition(parts)), "vwap_up_1s")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    rnd = lambda xs: [None if x is None else round(x, 9) for x in xs]
    assert rnd(got) == rnd(want)


def daily_frame(spark, n=900, seed=2):
    rows = walk(n, seed)
    days = pd.bdate_range("2015-01-01", periods=n)
    pdf = pd.DataFrame(rows, columns=["open", "high", "low", "close"]).assign(symbol="X", day=[d.date() for d in days], volume=10.0)
    return pdf, spark.createDataFrame(pdf, "open double, high double, low double, close double, symbol string, day date, volume double")


@pytest.mark.parametrize("span", [2, 14, 252])
def test_ema_matches_pandas(spark, span):
    pdf, df = daily_frame(spark)
    pdf.loc[::7, "close"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    got = column(with_ema(df, {"e": ("close", span, 5)}), "e", "day")
    want = pdf["close"].ewm(span=span, min_periods=5).mean()
    for g, w in zip(got, want):
        assert (g is None and math.isnan(w)) or g == pytest.approx(w, rel=1e-10)


def test_cusum_resets(spark):
    pdf, df = daily_frame(spark, 300)
    df = df.withColumn("r", F.col("close") - 100)
    got = [(r["cusum_pos"], r["cusum_neg"]) for r in dl.cusum(df, "r").orderBy("day").collect()]
    r = pdf["close"] - 100
    m, s = r.rolling(60, min_periods=30).mean(), r.rolling(60, min_periods=30).std()
    up = dn = 0.0
    for i, g in enumerate(got):
        want = (0.0, 0.0)
        if i and s[i] >= 1e-10:
            z = (r[i] - m[i]) / s[i]
            up, dn = max(0.0, up + z - 0.5), max(0.0, dn - z - 0.5)
            want = (up, dn)
            if max(up, dn) > 5:
                up = dn = 0.0
        assert g == pytest.approx(want)


def test_zigzag_turns(spark):
    closes = [100, 104, 106, 103, 100, 97, 95, 99, 101, 108, 102]
    pdf = pd.DataFrame({"symbol": "X", "day": pd.date_range("2024-01-01", periods=len(closes)).date, "close": [float(c) for c in closes]})
    turns = [(r["close"], r["kind"]) for r in lb.zigzag(spark.createDataFrame(pdf), 0.05).orderBy("turn_no").collect()]
    assert turns == [(100.0, "trough"), (106.0, "peak"), (95.0, "trough"), (108.0, "peak")]
    reg = [r["pct_regime"] for r in lb.pct_regime(spark.createDataFrame(pdf).withColumns({"high": F.col("close"), "low": F.col("close")}), 0.05, 0.10, 0.07).orderBy("day").collect()]
    assert reg == [1, 1, 0, 0, 0, 0, 2, 2, 2, 1, 1]


def test_asof_carries_across_buckets(spark):
    left = spark.createDataFrame([("k", f"2024-{m:02d}-15") for m in range(1, 13)], "k string, d string").withColumn("d", F.to_date("d"))
    right = spark.createDataFrame([("k", "2024-01-10", 1.0), ("k", "2024-06-15", 2.0)], "k string, d string, v double").withColumn("d", F.to_date("d"))
    got = [r["v"] for r in joins.asof(left, right, ["k"], "d", "d", ["v"]).orderBy("d").collect()]
    assert got == [1.0] * 5 + [2.0] * 7
    strict = [r["v"] for r in joins.asof(left, right, ["k"], "d", "d", ["v"], strict=True).orderBy("d").collect()]
    assert strict == [1.0] * 6 + [2.0] * 6


def test_auc_with_ties_and_hot_score(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0.2, 0.2, 0.2, rng.random()]), rng.randint(0, 1)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "s double, y int")
    got = ev.auc_from(ev.score_table(df, "s", "y")).first()["auc"]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(want)


def test_exact_quantiles(spark):
    xs = [float((i * 37) % 101) ** 1.3 for i in range(1001)]
    got = ev.exact_quantiles(spark.createDataFrame([(x,) for x in xs], "x double"), "x", [0.0, 0.1, 0.333, 0.5, 1.0]).first()["quantiles"]
    assert got == pytest.approx(list(np.quantile(xs, [0.0, 0.1, 0.333, 0.5, 1.0])))


def test_slot_cap_against_brute_force(spark):
    rng = random.Random(9)
    rows = [("X", "d1", i, rng.choice("ab"), rng.choice([1, -1])) for i in sorted(rng.sample(range(200), 80))]
    df = spark.createDataFrame(rows, "symbol string, trading_day string, bar_no int, level string, direction int")
    got = sorted((r["bar_no"], r["level"], r["direction"]) for r in sl.slot_cap(df, 4, 3, 9).collect())
    want, used, last = [], {}, None
    for _, _, m, l, d in rows:
        if len(want) < 9 and (last is None or m - last >= 4) and used.get((l, d), 0) < 3:
            want.append((m, l, d))
            used[(l, d)] = used.get((l, d), 0) + 1
            last = m
    assert got == sorted(want)


def test_running_value_area_matches_fold(make_bars):
    bars = make_bars(walk(60, 11)).withColumn("lv", F.col("close"))
    last = pf.running_profile(bars, "lv", 0.5).orderBy(F.desc("dt")).first()
    va = pf.value_area(pf.dense(pf.volume_by_price(bars, 0.5), pf.grid_bounds(bars, 0.5))).first()
    mid = lambda i: (va["lo_bin"] + i + 0.5) * 0.5
    assert (last["running_poc"], last["running_va_low"], last["running_va_high"]) == (mid(va["poc_i"]), mid(va["va_lo_i"]), mid(va["va_hi_i"]))


def test_prominent_peaks_two_humps(spark):
    v = [0.0] * 5 + [1, 4, 9, 4, 1] + [0.0] * 20 + [1, 3, 8, 3, 1] + [0.0] * 5
    df = spark.createDataFrame([([float(x) for x in v],)], "v array<double>")
    r = pf.prominent_peaks(df).first()
    assert r["n_peaks_prominent"] == 2 and r["peak_separation"] == pytest.approx(25 / len(v))


def test_norm_cdf(spark):
    xs = [-40.0, -8.0, -2.5, -0.1, 0.0, 0.7, 3.0, 9.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(op.norm_cdf("x")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], abs=1e-14)


def test_implied_vol_round_trip(spark):
    rows = [(100.0, k, s, t, c) for k in (90.0, 100.0, 115.0) for s in (0.08, 0.3, 1.2) for t in (0.05, 0.5) for c in (True, False)]
    df = spark.createDataFrame(rows, "s double, k double, sigma double, t double, c boolean")
    df = op.with_greeks(df, "s", "k", 0.03, 0.01, "sigma", "t", F.col("c")).filter("vega > 0.01")
    for r in df.select("sigma", op.implied_vol("price", "s", "k", "t", 0.03, 0.01, F.col("c")).alias("iv")).collect():
        assert r["iv"] == pytest.approx(r["sigma"], abs=1e-6)


def test_ema_is_carried_over_a_long_gap(spark):
    rng = random.Random(2)
    x = [rng.random() if i < 5 or 505 <= i < 540 or i > 1100 else None for i in range(1200)]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(x)], "symbol string, day int, x double")
    got = column(with_ema(df, {"e": ("x", 5, 1), "slow": ("x", 40, 3)}), "e", "day"), column(with_ema(df, {"slow": ("x", 40, 3)}), "slow", "day")
    s = pd.Series(x, dtype=float)
    for have, want in zip(got, (s.ewm(span=5, adjust=True, min_periods=1).mean(), s.ewm(span=40, adjust=True, min_periods=3).mean())):
        assert [None if v is None else round(v, 9) for v in have] == [None if math.isnan(v) else round(v, 9) for v in want]


@pytest.mark.parametrize("lookback", [10, 64, 120, 300])
def test_any_volume_lookback_is_exact_in_blocks(make_bars, lookback):
    rng = random.Random(lookback)
    bars = make_bars(walk(700, 4), step=5, volume=[float(rng.randrange(1, 500)) for _ in range(700)])
    a, b = ([round(x, 9) for x in column(it.temporal_interactions(bars, vol_lookback=lookback, block_rows=n), "wick_volume_interaction")] for n in (65, 65536))
    assert a == b


def test_rows_with_null_keys_stay(make_bars):
    bars = make_bars(walk(300, 6), step=5)
    some = bars.withColumn("symbol", F.when(F.col("bar_no") % 50 != 0, F.col("symbol"))).withColumn("trading_day", F.when(F.col("bar_no") % 70 != 0, F.col("trading_day")))
    assert it.bollinger(some).count() == it.temporal_interactions(some).count() == 300


def test_bounded_and_whole_day_barriers_agree(make_bars):
    bars = make_bars(walk(300, 8), step=5)
    entries = bars.filter("bar_no % 7 = 0").select("symbol", "trading_day", "bar_no", F.col("close").alias("entry_price"), F.lit(1).alias("direction"), (F.col("close") - 1).alias("stop"), (F.col("close") + 1.5).alias("target"))
    key = lambda df: sorted((r.trading_day, r.bar_no, r.exit_price, r.pnl) for r in df.collect())
    for start in (0, 1):
        assert key(lb.barrier_outcome(entries, bars, start, horizon=10_000)) == key(lb.barrier_outcome(entries, bars, start))
    assert key(lb.barrier_outcome(entries, bars, horizon=3)) != key(lb.barrier_outcome(entries, bars))


def test_intervals_by_nodes_equal_plain_joins(spark):
    """Random intervals, shorter than a leaf to longer than the tree; closed at both ends; nulls where nothing is."""
    import random
    from datetime import datetime, timedelta

    rng = random.Random(8)
    t0 = datetime(2024, 1, 2)
    ms = lambda: t0 + timedelta(milliseconds=rng.randrange(200_000))
    rows = [(rng.choice("AB"), ms(), rng.randrange(5), float(rng.randrange(100))) for _ in range(400)]
    spans = []
    for i in range(150):
        s = rng.choice([ms(), rows[rng.randrange(400)][1], t0 + timedelta(seconds=rng.randrange(200))])
        spans.append((i, rng.choice("ABC"), s, s + timedelta(milliseconds=rng.choice([0, 1, 300, 999, 1000, 7_003, 64_000, 190_000]))))
    df = spark.createDataFrame(rows, "k string, ts timestamp, v int, p double")
    iv = spark.createDataFrame(spans, "id int, k string, s timestamp, e timestamp")
    parts = {"n": (F.count(F.lit(1)), F.sum), "top": (F.max("p"), F.max)}
    final = [F.sum("n").alias("n"), F.max("top").alias("top"), F.max_by("v", F.struct("n", -F.col("v"))).alias("mode")]
    got = {r.id: (r.n, r.top, r["mode"]) for r in joins.interval_aggregate(iv, df, ["k"], "s", "e", "ts", parts, final, ["id"], by=["v"], levels=5).collect()}
    for i, k, s, e in spans:
        inside = [(v, p) for q, ts, v, p in rows if q == k and s <= ts <= e]
        values = [v for v, _ in inside]
        want = (len(inside), max(p for _, p in inside), min(set(values), key=lambda v: (-values.count(v), v))) if inside else (None, None, None)
        assert got[i] == want, (i, s, e)



def test_nodes_of_intervals_are_not_broadcast(spark, tmp_path):
    """A file of intervals is small, their nodes are thirty times as many."""
    spark.range(2000).selectExpr("id", "'A' AS k", "timestamp_seconds(1704067200 + id) AS s", "timestamp_seconds(1704088800 + id) AS e", "double(id % 3) AS p").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    parts = {"n": (F.count(F.lit(1)), F.sum)}
    out = joins.interval_aggregate(df.select("id", "k", "s", "e"), df.select("k", F.col("s").alias("ts"), "p"), ["k"], "s", "e", "ts", parts, [F.sum("n").alias("n")], ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    nodes = plan[plan.index("Union"):]
    assert "BroadcastHashJoin" not in nodes and nodes.count("SortMergeJoin") >= 2
    assert {r.id: r.n for r in out.collect()} == {i: 2000 - i for i in range(2000)}


def test_running_totals_over_many_ranges(spark):
    from tickloom.operators import evaluation as ev

    rows = [(k, float((7 * i) % 101), i % 3 + 1) for k in "ab" for i in range(101)]
    df = spark.createDataFrame(rows, "k string, x double, n int")
    got = {(r.k, r.x): (r.n_below, r.n_all) for r in ev.cumulative_by(df, "x", ["n"], ["k"], part_rows=10).collect()}
    assert got == {(k, x): (sum(m for q, y, m in rows if q == k and y < x), sum(m for q, _, m in rows if q == k)) for k, x, _ in rows}
    assert ev.cumulative_by(df.limit(0), "x", ["n"], ["k"]).collect() == []


def test_daily_table_needs_no_sorted_aggregation(spark):
    from tickloom.plans.adapters import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    t.shared = lambda name, make: make()
    plan = t.day()._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
