"""Keyed state over streams: session levels, level side, recent ticks, acceptance budget.

State per key is a typed value of a few numbers (or the last minutes of ticks) in the RocksDB store. Rows of one
key in one micro-batch are sorted before they are folded; a micro-batch has at most ``files_per_trigger`` files
(``tables.read_stream``) of a stated number of rows (``tables.write_in_order``), whatever the length of the stream.
Each stream has a watermark: rows later than ``delay`` are dropped. Rows that come within it but belong to a trading
day that the key has already left change nothing and are not emitted. An event-time timer clears a key that stays
silent for ``KEEP``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds of event time: longer than any pause between sessions.
KEEP = 10 * 86_400_000
NAN = float("nan")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark: SparkSession) -> None:
    """State in RocksDB instead of the executors' heap; processors with timers need it. A setting of the session."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _sorted(parts: Iterator[pd.DataFrame], order) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(order, ignore_index=True)


def _micros(times: pd.Series) -> np.ndarray:
    if times.isna().any():
        raise ValueError("a row without time has no place in a stream")
    return times.to_numpy("datetime64[us]").astype(np.int64)


class Folded(StatefulProcessor):
    """``fold(key, rows, state or None) -> (output rows, new state)`` per key and micro-batch. The one timer of a key
    moves on with its newest row."""

    def __init__(self, fold, order: list[str], time: str, names: list[str], kept: str):
        self.fold, self.order, self.time, self.names, self.kept = fold, order, time, names, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("folded", self.kept)
        self.leaves = handle.getValueState("leaves", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = _sorted(rows, self.order)
        # What is behind the watermark is late for good.
        mark = timerValues.getCurrentWatermarkInMs()
        millis = _micros(newest[self.time]) // 1000
        newest = newest[millis >= mark].reset_index(drop=True)
        if not len(newest):
            return
        found, state = self.fold(key, newest, self.value.get() if self.value.exists() else None)
        self.value.update(state)
        at = max(int(millis.max()), mark) + KEEP
        if self.leaves.exists():
            self.handle.deleteTimer(self.leaves.get()[0])
        self.handle.registerTimer(at)
        self.leaves.update((at,))
        yield pd.DataFrame(found, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        self.leaves.clear()
        return iter([])

    def close(self) -> None:
        pass


def _with_state(stream: DataFrame, keys, time: str, delay: str, out: str, kept: str, fold) -> DataFrame:
    """``fold`` behind a watermark on ``time``; rows of one time in order of ``seq`` or ``score``."""
    order = [time, *(c for c in ("seq", "score") if c in stream.columns)]
    names = [c.split()[0] for c in out.split(", ")]
    rocksdb(stream.sparkSession)
    return stream.withWatermark(time, delay).groupBy(*keys).transformWithStateInPandas(Folded(fold, order, time, names, kept), outputStructType=out, outputMode="Append", timeMode="EventTime")


def running_levels(bars: DataFrame, delay: str = "1 day") -> DataFrame:
    """Session VWAP and extremes of each bar, with the previous session's high, low and mid.
    Bars: symbol, trading_day, dt, open, high, low, close, volume."""
    def fold(key, rows, state):
        day, pv, v, hi, lo, phi, plo = state or ("", 0.0, 0.0, NAN, NAN, NAN, NAN)
        out = []
        for r in rows.itertuples(index=False):
            d = str(r.trading_day)
            if d < day:
                continue
            if d > day:
                if day:
                    phi, plo = hi, lo
                day, pv, v, hi, lo = d, 0.0, 0.0, r.high, r.low
            pv += (r.open + r.high + r.low + r.close) / 4 * r.volume
            v += r.volume
            hi, lo = max(hi, r.high), min(lo, r.low)
            out.append((key[0], r.dt, pv / v if v else NAN, hi, lo, phi, plo))
        return out, (day, pv, v, hi, lo, phi, plo)

    return _with_state(bars, ["symbol"], "dt", delay, "symbol string, dt timestamp, vwap double, day_high double, day_low double, prev_high double, prev_low double",
                       "day string, pv double, v double, hi double, lo double, phi double, plo double", fold)


def level_side(touches: DataFrame, flip_confirm: float, delay: str = "1 day") -> DataFrame:
    """Sticky side of each (symbol, level) touch, reset every day. Touches: symbol,
    trading_day, dt, level, close, level_price."""
    def fold(key, rows, state):
        day, side = state or ("", 0)
        out = []
        for r in rows.itertuples(index=False):
            d, dist = str(r.trading_day), r.close - r.level_price
            if d < day:
                continue
            if d > day:
                day, side = d, 1 if dist >= 0 else -1
            elif abs(dist) >= flip_confirm:
                side = 1 if dist > 0 else -1
            out.append((key[0], key[1], r.dt, side))
        return out, (day, side)

    return _with_state(touches, ["symbol", "level"], "dt", delay, "symbol string, level string, dt timestamp, side int", "day string, side int", fold)


def time_retention(ticks: DataFrame, seconds: int = 900, delay: str = "1 day") -> DataFrame:
    """Count and volume of the ticks of the ``seconds`` up to each tick. The state is the ticks of that span
    before the newest one; a tick that comes later than that is dropped, others take their place in time.
    Both numbers are differences of running totals over the sorted times; a tick without volume adds none."""
    def fold(key, rows, state):
        old_t, old_v = (np.asarray(x, float) for x in state) if state else (np.zeros(0), np.zeros(0))
        now = _micros(rows["ts"]) / 1e6
        if len(old_t):
            rows = rows[now >= old_t[-1] - seconds]
            now = now[now >= old_t[-1] - seconds]
        t, v = np.append(old_t, now), np.append(old_v, rows["volume"].to_numpy(float))
        o = np.argsort(t, kind="stable")
        t, v = t[o], v[o]
        known = ~np.isnan(v)
        total, n = np.append(0.0, np.cumsum(np.where(known, v, 0.0))), np.append(0, np.cumsum(known))
        lo, hi = np.searchsorted(t, now - seconds, side="left"), np.searchsorted(t, now, side="right")
        out = pd.DataFrame({"symbol": key[0], "ts": rows["ts"].to_numpy(), "seq": rows["seq"].to_numpy(), "n_recent": hi - lo, "volume_recent": np.where(n[hi] > n[lo], total[hi] - total[lo], NAN)})
        keep = t >= t[-1] - seconds if len(t) else np.zeros(0, bool)
        return out, (t[keep].tolist(), v[keep].tolist())

    return _with_state(ticks.select("symbol", "ts", "seq", "volume"), ["symbol"], "ts", delay, "symbol string, ts timestamp, seq long, n_recent int, volume_recent double", "times array<double>, vols array<double>", fold)


def budget_accept(signals: DataFrame, budget: int | dict, expected: float, base: float, step: float = 0.02, tolerance: float = 1.0, top: float = 0.95, delay: str = "1 day") -> DataFrame:
    """Accept scores under a daily cap. The threshold moves by ``step`` against the lead that acceptance has over an
    even pace of ``expected`` signals, once the lead exceeds ``tolerance``, between ``base`` and ``top``.

    Signals: symbol, trading_day, ts, score and, if budgets differ by session, session; ``budget`` may then be
    {session: cap}. A cap of 0 or less means no budget: everything is accepted."""
    by_session = "session" in signals.columns
    keys = ["symbol", "session"] if by_session else ["symbol"]

    def fold(key, rows, state):
        cap = budget.get(key[-1], 0) if isinstance(budget, dict) else budget
        day, seen, taken, bar = state or ("", 0, 0, base)
        kept, bars, oks = [], [], []
        low, high = float(base), float(top)
        for i, (d, score) in enumerate(zip(map(str, rows["trading_day"]), rows["score"].astype(float).tolist())):
            if d < day:
                continue
            if d > day:
                day, seen, taken, bar = d, 0, 0, base
            seen += 1
            if cap > 0:
                lead = taken - cap * min(seen / max(expected, 1.0), 1.0)
                bar = min(max(bar + step * ((lead > tolerance) - (lead < -tolerance)), low), high)
                accepted = taken < cap and score >= bar
            else:
                bar, accepted = base, True
            taken += accepted
            kept.append(i)
            bars.append(bar)
            oks.append(int(accepted))
        rows = rows.iloc[kept]
        out = dict(zip(keys, key)) | {"ts": rows["ts"].to_numpy(), "score": rows["score"].to_numpy(float), "threshold": np.array(bars, float), "accepted": np.array(oks, np.int32)}
        return pd.DataFrame(out, index=range(len(kept))), (day, seen, int(taken), float(bar))

    return _with_state(signals, keys, "ts", delay, "symbol string, " + "session string, " * by_session + "ts timestamp, score double, threshold double, accepted int", "day string, seen int, taken int, thr double", fold)
