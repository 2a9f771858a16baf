from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="tickloom-tests")
    s.sparkContext.setLogLevel("ERROR")
    return s


BAR_SCHEMA = ("symbol string, trading_day date, dt timestamp_ntz, open double, high double, low double, close double, volume double, "
              "bidvolume double, askvolume double, minute int, ovn int, bar_no int")


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars from rows of (open, high, low, close) with one-minute steps from ``start``."""
    def make(rows, start="2024-03-05 06:30:00", symbol="X", volume=10.0, bid=5.0, ask=5.0, step=1):
        t0 = dt.datetime.fromisoformat(start)
        out = []
        for i, (o, h, l, c) in enumerate(rows):
            t = t0 + dt.timedelta(minutes=step * i)
            day = (t + dt.timedelta(hours=9)).date()
            minute = t.hour * 60 + t.minute
            v = volume[i] if isinstance(volume, list) else volume
            out.append((symbol, day, t, o, h, l, c, v, bid, ask, minute, int(minute < 390 or t.hour > 13), i + 1))
        return spark.createDataFrame(out, BAR_SCHEMA)
    return make


def column(df, name, order="dt"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]
