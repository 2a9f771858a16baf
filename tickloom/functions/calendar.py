"""Session calendar as column expressions.

Timestamps may be zoned (TIMESTAMP) or naive (TIMESTAMP_NTZ). ``local_ts`` turns either
into a naive wall-clock column; everything else works on wall-clock columns.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_ts(ts, tz: str, source_tz: str = "UTC") -> Column:
    """Wall-clock time in ``tz`` of a naive ``source_tz`` timestamp."""
    return F.convert_timezone(F.lit(source_tz), F.lit(tz), col(ts).cast("timestamp_ntz"))


def wall_seconds(ts) -> Column:
    """Whole seconds since 1970 of a naive timestamp, whatever the session time zone."""
    t = col(ts)
    return F.unix_date(F.to_date(t)).cast("bigint") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))


def utc_epoch(wall, tz: str) -> Column:
    """Epoch seconds of a wall-clock time in ``tz``."""
    return wall_seconds(F.convert_timezone(F.lit(tz), F.lit("UTC"), col(wall).cast("timestamp_ntz")))


def nonexistent_local(wall, tz: str) -> Column:
    """True for wall-clock times a DST jump skips (round trip through UTC moves them)."""
    w = col(wall).cast("timestamp_ntz")
    back = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.convert_timezone(F.lit(tz), F.lit("UTC"), w))
    return back != w


def ambiguous_local(wall, tz: str) -> Column:
    """True for wall-clock times that occur twice, when clocks go back by up to an hour."""
    w = col(wall).cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), w)
    again = [F.convert_timezone(F.lit("UTC"), F.lit(tz), utc + F.expr(f"INTERVAL {m} MINUTES")) == w for m in (-60, -30, 30, 60)]
    return again[0] | again[1] | again[2] | again[3]


def trading_day(ts, roll_hour: int = 15, direction: str = "next") -> Column:
    """Session date. ``next``: from ``roll_hour`` on a row belongs to the next date.
    ``previous``: before ``roll_hour`` a row belongs to the previous date."""
    hours = 24 - roll_hour if direction == "next" else -roll_hour
    return F.to_date(col(ts) + F.expr(f"INTERVAL {hours} HOURS"))


def minute_of_day(ts) -> Column:
    return (F.hour(col(ts)) * 60 + F.minute(col(ts))).cast("int")


def between_minutes(ts, start: int, end: int) -> Column:
    """Inclusive at both ends."""
    return minute_of_day(ts).between(start, end)


def overnight_flag(ts, open_minute: int = 390, last_open_hour: int = 13) -> Column:
    """1 before the open minute or after the last open hour, else 0."""
    return F.when((minute_of_day(ts) < open_minute) | (F.hour(col(ts)) > last_open_hour), 1).otherwise(0)


def tod_bucket(minute, cuts=((480, "open"), (600, "morning"), (690, "midday")), last: str = "late") -> Column:
    m = col(minute)
    out = None
    for cut, name in cuts:
        out = F.when(m < cut, name) if out is None else out.when(m < cut, name)
    return out.otherwise(last)


def weekday(day) -> Column:
    """Monday = 0."""
    return F.weekday(col(day))


def session_bounds(day, tz: str, roll_hour: int = 15) -> dict[str, Column]:
    """UTC epoch seconds of the session of a trading day, both ends included."""
    prev = F.date_sub(col(day), 1).cast("timestamp_ntz") + F.expr(f"INTERVAL {roll_hour} HOURS")
    end = prev + F.expr("INTERVAL '0 23:59:59' DAY TO SECOND")
    return {"session_start": utc_epoch(prev, tz), "session_end": utc_epoch(end, tz)}


def previous_business_date(day) -> Column:
    """The weekday before ``day``: Monday steps back to Friday."""
    back = F.when(weekday(day) == 0, 3).when(weekday(day) == 6, 2).otherwise(1)
    return F.date_sub(col(day), back)


def previous_session_start(ts, tz: str, roll_hour: int = 15) -> Column:
    """Epoch start of the session before the one holding wall-clock ``ts``; weekends are skipped."""
    start_date = F.date_sub(trading_day(ts, roll_hour), 1)
    prev = previous_business_date(start_date).cast("timestamp_ntz") + F.expr(f"INTERVAL {roll_hour} HOURS")
    return utc_epoch(prev, tz)


def business_days_between(earlier, later) -> Column:
    """Weekdays in (earlier, later], no holidays."""
    def count_to(d):
        days = F.datediff(col(d), F.lit("1970-01-05").cast("date"))
        return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(4))
    return (count_to(later) - count_to(earlier)).cast("int")


def calendar_features(day) -> dict[str, Column]:
    d = col(day)
    angle = 2 * 3.141592653589793 * F.month(d) / 12
    return {
        "dow": weekday(d),
        "dom": F.dayofmonth(d),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
        "is_monday": (weekday(d) == 0).cast("int"),
        "is_friday": (weekday(d) == 4).cast("int"),
        "is_opex_week": F.dayofmonth(d).between(15, 21).cast("int"),
        "is_quarter_end": (F.month(d).isin(3, 6, 9, 12) & (F.dayofmonth(d) >= 25)).cast("int"),
    }
