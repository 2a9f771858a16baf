"""Window shorthands shared by the operators.

Rolling helpers take ``min_periods`` the way a time-series user expects: the result is
null until that many non-null inputs are inside the frame.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from tickloom.functions.calendar import col

DAY_KEYS = ("symbol", "trading_day")


def by(keys=DAY_KEYS, order="dt"):
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def running(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def whole(keys):
    return Window.partitionBy(*keys)


def last_rows(w, n: int, skip_current: bool = False):
    return w.rowsBetween(-n, -1) if skip_current else w.rowsBetween(-(n - 1), 0)


def next_rows(w, n: int, first: int = 1):
    return w.rowsBetween(first, n)


def rolling(fn, c, w, n: int, min_periods: int | None = None) -> Column:
    mp = n if min_periods is None else min_periods
    frame = last_rows(w, n)
    value = fn(col(c)).over(frame)
    return value if mp <= 1 else F.when(F.count(col(c)).over(frame) >= mp, value)


def safe_div(a, b) -> Column:
    """a / b, null when b is zero."""
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def clip(c, lo, hi) -> Column:
    """Bounds keep nulls null (least and greatest skip them)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(float(hi))), F.lit(float(lo))))


def diff(c, w, n: int = 1) -> Column:
    return col(c) - F.lag(c, n).over(w)


def pct_change(c, w, n: int = 1) -> Column:
    prev = F.lag(c, n).over(w)
    return safe_div(col(c), prev) - 1
