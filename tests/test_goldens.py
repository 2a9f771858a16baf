"""Small cases with known answers."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from conftest import BAR_SCHEMA, column
from tickloom.functions import calendar as cal
from tickloom.operators import bars, daily, intraday as it, labels as lb, levels as lv, sets


def flat(c):
    return (c, c, c, c)


def test_side_hysteresis(make_bars):
    closes = [100.2, 99.9, 99.6, 99.4, 100.4, 100.6]
    df = make_bars([flat(c) for c in closes]).withColumns({"nearest_level": F.lit("L"), "level_price": F.lit(100.0)})
    assert column(lv.level_side_hysteresis(df, 0.3, 0.5), "side") == [1, 1, 1, -1, -1, 1]


def test_side_resets_per_day(make_bars):
    a = make_bars([flat(99.4)], "2024-03-05 07:00:00")
    b = make_bars([flat(100.1)], "2024-03-06 07:00:00")
    df = a.unionByName(b).withColumns({"nearest_level": F.lit("L"), "level_price": F.lit(100.0)})
    assert column(lv.level_side_hysteresis(df, 0.3, 0.5), "side") == [-1, 1]


@pytest.mark.parametrize("ambiguous,expected", [(False, "reversal"), (True, "inconclusive")])
def test_ambiguous_label(make_bars, ambiguous, expected):
    rows = [[100.0, 100.5, 99.5, 100.0] for _ in range(21)]
    rows[1][1], rows[2][2] = 102.5, 97.5
    df = make_bars([tuple(r) for r in rows]).withColumns({"nearest_level": F.lit("L"), "level_price": F.lit(100.0), "side": F.lit(1)})
    out = lb.reversal_breakout(df, reversal=2, breakout=2, forward=5, drop_ambiguous=ambiguous).orderBy("dt").first()
    assert out["outcome"] == expected
    if ambiguous:
        assert out["p_reversal"] == 0.15


def test_rth_levels_activate_at_seven(make_bars):
    rows = [[100.0, 101.0, 99.0, 100.0] for _ in range(36)]
    rows[2][1], rows[25][2] = 110.0, 90.0
    df = it.rth_running_levels(make_bars([tuple(r) for r in rows]))
    by_minute = {r["minute"]: r for r in df.collect()}
    assert by_minute[419]["rth_hi"] is None
    assert (by_minute[420]["rth_hi"], by_minute[420]["rth_lo"]) == (110.0, 90.0)


def test_flat_order_flow_reads_zero(make_bars):
    df = it.ofi_z(make_bars([flat(100.0)] * 80, bid=500.0, ask=500.0))
    assert column(df, "ofi_z") == [0.0] * 80


def test_daily_features_are_lagged(make_bars):
    frames = [make_bars([flat(c)] * 3, f"2024-03-0{4 + i} 07:00:00") for i, c in enumerate((100.0, 110.0, 90.0, 130.0))]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    d = daily.causal_shift(bars.daily_bars(df).withColumnRenamed("trading_day", "day"), ["close"])
    assert [r["close"] for r in d.orderBy("day").collect()] == [0.0, 100.0, 110.0, 90.0]


def test_duplicate_week_key_fails(spark):
    w = spark.createDataFrame([("X", "2024_10"), ("X", "2024_10")], "symbol string, year_week string")
    with pytest.raises(Exception, match="year_week"):
        bars.require_unique_weeks(w).collect()


def test_session_roll(spark):
    df = spark.sql("SELECT timestamp_ntz'2026-02-19 15:00:00' AS ts").select(cal.trading_day("ts").alias("d"), cal.trading_day("ts", 15, "previous").alias("p"))
    assert df.first() == (dt.date(2026, 2, 20), dt.date(2026, 2, 19))


def test_session_bounds_and_weekend(spark):
    la = "America/Los_Angeles"
    df = spark.sql("SELECT date'2026-02-20' AS d, timestamp_ntz'2026-03-30 10:00:00' AS now")
    b = cal.session_bounds("d", la)
    local = lambda c: F.convert_timezone(F.lit("UTC"), F.lit(la), F.timestamp_seconds(c).cast("timestamp_ntz"))
    r = df.select(local(b["session_start"]).alias("s"), local(b["session_end"]).alias("e"), local(cal.previous_session_start("now", la)).alias("p")).first()
    assert (r["s"], r["e"]) == (dt.datetime(2026, 2, 19, 15), dt.datetime(2026, 2, 20, 14, 59, 59))
    assert r["p"] == dt.datetime(2026, 3, 27, 15)


def test_dst_gap_is_flagged(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2024-03-10 02:30:00'), (timestamp_ntz'2024-03-10 03:30:00') AS t(w)")
    assert [r[0] for r in df.orderBy("w").select(cal.nonexistent_local("w", "America/New_York")).collect()] == [True, False]


def barrier(make_bars, highs, lows, stop, take, start=0):
    b = make_bars([(h, h, l, (h + l) / 2) for h, l in zip(highs, lows)])
    e = b.filter("bar_no = 1").select("symbol", "trading_day", "bar_no", F.lit(100.0).alias("entry_price"), F.lit(1).alias("direction"), F.lit(stop).alias("stop"), F.lit(take).alias("target"))
    return lb.barrier_outcome(e, b, start, "stop", "close").first()


def test_long_target(make_bars):
    r = barrier(make_bars, [100.0, 105.0, 110.0, 115.0, 120.0], [95.0, 100.0, 105.0, 110.0, 115.0], 90.0, 110.0)
    assert (r["exit_type"], r["exit_bars"] - 1, r["exit_price"]) == ("target", 2, 110.0)


def test_long_stop(make_bars):
    r = barrier(make_bars, [100.0, 98.0, 95.0, 90.0, 85.0], [95.0, 93.0, 88.0, 85.0, 80.0], 90.0, 115.0)
    assert (r["exit_type"], r["exit_bars"] - 1, r["exit_price"]) == ("stop", 2, 90.0)


def test_no_touch_closes_at_last_bar(make_bars):
    r = barrier(make_bars, [100.0, 101.0], [99.0, 98.0], 50.0, 150.0)
    assert (r["exit_type"], r["exit_price"]) == ("timeout", 99.5)


def test_breakout_touch_counts(make_bars):
    closes = [101.0, 102.0, 103.0, 104.0, 105.0, 104.0, 103.0, 102.0, 101.0, 100.0]
    df = make_bars([flat(c) for c in closes]).withColumn("L", F.lit(103.0))
    up = lv.breakout_triggers(df, ["L"], block_rows=4).filter("direction = 1").orderBy("dt").collect()
    assert up[0]["bar_no"] == 3


def test_exact_touch_fires_both_sides(make_bars):
    df = make_bars([flat(103.0), flat(103.0)]).withColumn("L", F.lit(103.0))
    assert sorted(r["direction"] for r in lv.breakout_triggers(df, ["L"]).collect()) == [-1, 1]


def test_legacy_order_flow_names(spark):
    df = bars.normalize_orderflow(spark.createDataFrame([(1.0, 2.0)], "buys double, sells double"))
    assert df.columns == ["askvolume", "bidvolume"]


def test_volume_z_is_trailing(make_bars):
    vol = [100.0] + [1000.0] * 24
    got = column(it.volume_z(make_bars([flat(1.0)] * 25, volume=vol)), "vol_z")
    for i in (1, 5, 24):
        w = vol[max(0, i - 19): i + 1]
        mean = sum(w) / len(w)
        sd = math.sqrt(sum((x - mean) ** 2 for x in w) / (len(w) - 1))
        assert got[i] == pytest.approx((vol[i] - mean) / (sd + 1e-6))


def test_upsert_and_dedup(spark):
    old = spark.createDataFrame([("2026-02-19 15:00", 1.0)], "dt string, close double")
    new = spark.createDataFrame([("2026-02-19 15:00", 2.0), ("2026-02-19 15:01", 3.0)], "dt string, close double")
    assert sorted(tuple(r) for r in sets.upsert(old, new, ["dt"]).collect()) == [("2026-02-19 15:00", 2.0), ("2026-02-19 15:01", 3.0)]


def test_empty_and_single_row(spark, make_bars):
    empty = spark.createDataFrame([], BAR_SCHEMA)
    assert it.price_levels(empty).count() == 0
    assert lb.viable_zones(empty).count() == 0
    one = it.price_levels(make_bars([(10.0, 12.0, 9.0, 11.0)])).first()
    assert one["vwap"] == pytest.approx(10.5) and one["prev_high"] is None


def test_wall_clock_times_that_do_not_exist_or_occur_twice(spark):
    times = ["2024-03-10 02:30:00", "2024-03-10 03:30:00", "2024-11-03 00:59:00", "2024-11-03 01:30:00", "2024-11-03 02:00:00", "2024-07-01 01:30:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = [(r.a, r.b) for r in df.select(cal.nonexistent_local("t", "America/New_York").alias("a"), cal.ambiguous_local("t", "America/New_York").alias("b")).collect()]
    assert got == [(True, False), (False, False), (False, False), (False, True), (False, False), (False, False)]
