"""Streams must agree with batch over several files and batches, late rows included."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars, intraday as it
from tickloom.streaming import state, tables as st

TICK = "symbol string, ts timestamp, seq long, price double, volume double, bidvolume double, askvolume double"


def ticks(spark, n=400, seed=1):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 2, 14, 0)
    rows = [(rng.choice("AB"), t0 + dt.timedelta(seconds=20 * i), i, 100.0 + rng.randint(-20, 20) / 4, 1.0 + i % 3, 1.0, float(i % 3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, TICK)


def write_parts(spark, rows, path, n=4):
    size = len(rows) // n
    for i in range(n):
        chunk = rows[i * size: (i + 1) * size if i < n - 1 else None]
        spark.createDataFrame(chunk, TICK).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # file sources read in modification order
    return path


def as_set(df, cols):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


def test_replayed_bars_equal_batch(spark, tmp_path):
    rows, df = ticks(spark)
    path = write_parts(spark, rows, str(tmp_path / "in"))
    st.replay(spark, path, df.schema, lambda s: st.minute_bars(s), str(tmp_path / "out"), str(tmp_path / "ck"))
    cols = ["symbol", "dt", "open", "high", "low", "close", "volume", "n_ticks"]
    assert as_set(st.latest(spark, str(tmp_path / "out"), ["symbol", "dt"]), cols) == as_set(bars.build_bars(df, 1), cols)


def test_late_row_updates_within_watermark_and_is_dropped_beyond(spark, tmp_path):
    rows, df = ticks(spark, 200)
    late_ok = ("A", rows[-1][1] - dt.timedelta(seconds=60), 9001, 999.0, 1.0, 1.0, 0.0)
    too_late = ("A", rows[0][1], 9002, 999.0, 1.0, 1.0, 0.0)
    path = write_parts(spark, rows, str(tmp_path / "in"), 2)
    spark.createDataFrame([late_ok, too_late], TICK).coalesce(1).write.mode("append").parquet(path)
    st.replay(spark, path, df.schema, lambda s: st.minute_bars(s), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = st.latest(spark, str(tmp_path / "out"), ["symbol", "dt"])
    want = bars.build_bars(spark.createDataFrame(rows + [late_ok], TICK), 1)
    cols = ["symbol", "dt", "high", "n_ticks"]
    assert as_set(got, cols) == as_set(want, cols)


def test_running_levels_across_batches_and_days(spark, tmp_path):
    rows, df = ticks(spark, 600, 3)
    batch = bars.with_session(bars.build_bars(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 1))
    want = it.prev_day_levels(it.vwap_running(batch))
    staged = batch.withColumn("dt", F.col("dt").cast("timestamp"))
    path = str(tmp_path / "bars")
    for lo, hi in (("2024-01-02 00:00", "2024-01-02 15:10"), ("2024-01-02 15:10", "2024-01-03 00:00")):
        staged.filter((F.col("dt") >= lo) & (F.col("dt") < hi)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    st.run_upsert(state.running_levels(st.read_stream(spark, path, staged.schema, 1)), str(tmp_path / "out"), str(tmp_path / "ck"), "append")
    got = st.latest(spark, str(tmp_path / "out"), ["symbol", "dt"])
    g = {(r["symbol"], r["dt"]): r for r in got.collect()}
    for r in want.withColumn("dt", F.col("dt").cast("timestamp")).collect():
        s = g[(r["symbol"], r["dt"])]
        assert abs(s["vwap"] - r["vwap"]) < 1e-9
        assert (s["prev_high"] if s["prev_high"] == s["prev_high"] else None) == r["prev_high"]


def test_budget_threshold_adapts(spark, tmp_path):
    rows = [("X", "2024-01-02", dt.datetime(2024, 1, 2, 10, 0) + dt.timedelta(minutes=i), 0.9) for i in range(20)]
    df = spark.createDataFrame(rows, "symbol string, trading_day string, ts timestamp, score double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    st.run_upsert(state.budget_accept(st.read_stream(spark, str(tmp_path / "in"), df.schema), 5, 20.0, 0.5, step=0.2, tolerance=0.5), str(tmp_path / "out"), str(tmp_path / "ck"), "append")
    out = st.latest(spark, str(tmp_path / "out"), ["ts"]).orderBy("ts").collect()
    assert sum(r["accepted"] for r in out) <= 5
    assert max(r["threshold"] for r in out) > 0.5


def in_batches(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return st.read_stream(spark, path, spark.read.parquet(path).schema, 1)


def at(day, hour, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def test_late_bars_of_an_earlier_day_change_nothing(spark, tmp_path):
    bar = lambda d, h, hi, lo: ("A", f"2024-01-0{d}", at(d, h), 5.0, hi, lo, 5.0, 1.0)
    schema = "symbol string, trading_day string, dt timestamp, open double, high double, low double, close double, volume double"
    stream = in_batches(spark, str(tmp_path / "in"), [[bar(2, 10, 5.0, 1.0)], [bar(3, 10, 9.0, 2.0)], [bar(2, 11, 7.0, 1.0)], [bar(3, 11, 4.0, 3.0)]], schema)
    st.run_upsert(state.running_levels(stream, "5 days"), str(tmp_path / "out"), str(tmp_path / "ck"), "append")
    out = {r.dt: r for r in st.latest(spark, str(tmp_path / "out"), ["symbol", "dt"]).collect()}
    assert set(out) == {at(2, 10), at(3, 10), at(3, 11)}
    assert (out[at(3, 11)].prev_high, out[at(3, 11)].day_high, out[at(3, 11)].day_low) == (5.0, 9.0, 2.0)


def test_late_ticks_keep_their_place_in_time(spark, tmp_path):
    tick = lambda s, m: ("A", at(2, 10) + dt.timedelta(minutes=m), s, 1.0, 1.0, 1.0, 0.0)
    stream = in_batches(spark, str(tmp_path / "in"), [[tick(1, 0)], [tick(2, 100)], [tick(3, 1), tick(4, 95)], [tick(5, 101)]], TICK)
    st.run_upsert(state.time_retention(stream), str(tmp_path / "out"), str(tmp_path / "ck"), "append")
    got = {r.seq: r.n_recent for r in st.latest(spark, str(tmp_path / "out"), ["symbol", "seq"]).collect()}
    assert got == {1: 1, 2: 1, 4: 1, 5: 3}


def test_budget_by_session_and_none(spark, tmp_path):
    rows = [("X", s, "2024-01-02", at(2, 10) + dt.timedelta(minutes=i), 0.9) for s in ("regular", "overnight") for i in range(12)]
    stream = in_batches(spark, str(tmp_path / "in"), [rows], "symbol string, session string, trading_day string, ts timestamp, score double")
    st.run_upsert(state.budget_accept(stream, {"regular": 3, "overnight": 0}, 4.0, 0.5), str(tmp_path / "out"), str(tmp_path / "ck"), "append")
    out = spark.read.parquet(str(tmp_path / "out")).groupBy("session").agg(F.sum("accepted").alias("n"))
    assert {r.session: r.n for r in out.collect()} == {"regular": 3, "overnight": 12}


def test_idle_keys_leave_the_state(spark, tmp_path):
    touch = lambda sym, d, close: (sym, f"2024-02-{d:02d}", dt.datetime(2024, 2, d, 12), "L", close, 5.0)
    stream = in_batches(spark, str(tmp_path / "in"), [[touch("A", 1, 6.0), touch("B", 1, 6.0)], [touch("B", 20, 4.0)], [touch("B", 21, 4.0)], [touch("B", 22, 4.0)]], "symbol string, trading_day string, dt timestamp, level string, close double, level_price double")
    q = state.level_side(stream, 0.5).writeStream.format("memory").queryName("sides").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    # Of B alone: its value, and when it leaves (the timer of the store is counted apart).
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    assert spark.table("sides").count() == 5


def test_files_are_read_in_order_of_arrival_and_closed_windows_are_written(spark, tmp_path):
    """Many small files, one a batch: nothing is late, every window is written, sessions included."""
    rows, df = ticks(spark, 300, 5)
    path = str(tmp_path / "in")
    st.write_in_order(df.repartition(5), path, F.col("ts"), 40)
    st.close_input(df, path, "ts", "2 HOURS")
    seen = []
    st.read_stream(spark, path, df.schema, 1).writeStream.foreachBatch(lambda b, i: seen.append([(r.ts, r.seq) for r in b.collect()])).option("checkpointLocation", str(tmp_path / "ck0")).trigger(availableNow=True).start().awaitTermination()
    assert max(map(len, seen)) <= 40 and len(seen) >= 9
    assert [s for b in seen for _, s in sorted(b)] == [*range(300), None]
    st.run_once(st.minute_bars(st.read_stream(spark, path, df.schema, 1)), str(tmp_path / "bars"), str(tmp_path / "ck1"))
    cols = ["symbol", "dt", "open", "close", "volume", "n_ticks"]
    assert as_set(spark.read.parquet(str(tmp_path / "bars")), cols) == as_set(bars.build_bars(df, 1), cols)
    st.run_once(st.session_activity(st.read_stream(spark, path, df.schema, 1)), str(tmp_path / "sessions"), str(tmp_path / "ck2"))
    assert spark.read.parquet(str(tmp_path / "sessions")).agg(F.sum("n_ticks")).first()[0] == 300


def test_state_is_the_same_in_one_batch_and_in_many(spark, tmp_path):
    rows, df = ticks(spark, 300, 6)
    got = []
    for size in (1000, 30):
        path = str(tmp_path / f"in{size}")
        st.write_in_order(df, path, F.col("ts"), size)
        st.run_upsert(state.time_retention(st.read_stream(spark, path, df.schema, 1), 600), str(tmp_path / f"out{size}"), str(tmp_path / f"ck{size}"), "append")
        got.append(as_set(st.latest(spark, str(tmp_path / f"out{size}"), ["symbol", "seq"]), ["symbol", "seq", "n_recent", "volume_recent"]))
    assert got[0] == got[1]
    times = {(r[0], r[2]): r[1] for r in rows}
    assert all(n == sum(s == x[0] and 0 <= (times[s, q] - x[1]).total_seconds() <= 600 for x in rows) for s, q, n, _ in got[0])


def test_state_stays_in_one_store_a_core(spark, tmp_path):
    """Tasks of all batches together grow with the rows, not also with the session's shuffle partitions."""
    rows, df = ticks(spark, 60, 7)
    st.write_in_order(df, str(tmp_path / "in"), F.col("ts"), 20)
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        stream = st.minute_bars(st.read_stream(spark, str(tmp_path / "in"), df.schema, 1))
        st.run_upsert(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "61"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
    stores = [p.name for p in (tmp_path / "ck" / "state" / "0").iterdir() if p.name.isdigit()]
    assert 0 < len(stores) <= spark.sparkContext.defaultParallelism < 61


def test_a_batch_takes_several_files(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from tickloom.plans import streaming as plans

    rows, df = ticks(spark, 170, 8)
    monkeypatch.setattr(plans, "FILE_ROWS", 10)
    seen = []
    stream = plans.staged(SimpleNamespace(spark=spark), df, "ticks")[1]
    q = stream.writeStream.foreachBatch(lambda b, i: seen.append(sorted(r.seq for r in b.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) < 5 and max(map(len, seen)) <= 10 * plans.BATCH_FILES
    assert sum(seen, []) == list(range(170))


def test_budget_over_batches_equals_a_plain_walk(spark, tmp_path):
    rng = random.Random(9)
    rows = [(s, f"2024-01-{d:02d}", at(d, 10) + dt.timedelta(seconds=7 * i), rng.choice([None, *[x / 20 for x in range(20)]])) for s in "XY" for d in (2, 3) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, trading_day string, ts timestamp, score double")
    st.write_in_order(df, str(tmp_path / "in"), F.col("ts"), 25)
    stream = st.read_stream(spark, str(tmp_path / "in"), df.schema, 2)
    st.run_upsert(state.budget_accept(stream, 5, 20.0, 0.35, delay="5 days"), str(tmp_path / "out"), str(tmp_path / "ck"), "append")
    want = []
    for s in "XY":
        for d in ("2024-01-02", "2024-01-03"):
            taken, bar = 0, 0.35
            for n, (_, _, ts, score) in enumerate(sorted((r for r in rows if r[:2] == (s, d)), key=lambda r: r[2]), 1):
                lead = taken - 5 * min(n / 20, 1)
                bar = min(max(bar + 0.02 * ((lead > 1) - (lead < -1)), 0.35), 0.95)
                ok = int(taken < 5 and score is not None and score >= bar)
                taken += ok
                want.append((s, ts, round(bar, 9), ok))
    assert as_set(st.latest(spark, str(tmp_path / "out"), ["symbol", "ts"]), ["symbol", "ts", "threshold", "accepted"]) == sorted(want)


def test_a_tick_without_volume_spoils_no_other_and_one_without_time_is_not_passed_over(spark, tmp_path):
    tick = lambda s, m, v: ("A", m if m is None else at(2, 10) + dt.timedelta(minutes=m), s, 1.0, v, 1.0, 0.0)
    rows = [tick(1, 0, 1.0), tick(2, 1, None), tick(3, 2, 2.0), tick(4, 60, None)]
    run = lambda rows, n: st.run_upsert(state.time_retention(in_batches(spark, str(tmp_path / f"in{n}"), [rows], TICK)), str(tmp_path / f"out{n}"), str(tmp_path / f"ck{n}"), "append")
    run(rows, 0)
    got = {r.seq: (r.n_recent, r.volume_recent) for r in spark.read.parquet(str(tmp_path / "out0")).fillna(-1.0).replace(float("nan"), -1.0).collect()}
    assert got == {1: (1, 1.0), 2: (2, 1.0), 3: (3, 3.0), 4: (1, -1.0)}
    with pytest.raises(Exception, match="without time"):
        run([*rows, tick(5, None, 1.0)], 1)
