"""Predicted-range text records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.calendar import col

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# Instrument aliases, first match wins.
ALIASES = (("E-MINI", "ES"), ("E MINI", "ES"), ("S&P", "ES"), ("SPX", "SPX"), ("NASDAQ", "NQ"), ("RUSSELL", "RTY"), ("DOW", "YM"), ("CRUDE", "CL"), ("GOLD", "GC"),
           ("BONDS", "ZB"), ("NOTES", "ZN"), ("EURO", "EUR"), ("DOLLAR", "DX"))


def timeframe(section) -> Column:
    """daily, weekly, monthly or quarterly by keyword or a leading month name."""
    s = F.lower(F.trim(col(section)))
    has = lambda *w: s.rlike("|".join(w))
    first = F.split(s, r"\s+")[0]
    return F.when(has("day", "daily"), "daily").when(has("week"), "weekly").when(has("month"), "monthly").when(has("quarter"), "quarterly").when(first.isin(*MONTHS), "monthly").otherwise(s)


def symbol(text) -> Column:
    """Canonical instrument: ratings in brackets removed, aliases mapped, else the first word."""
    s = F.trim(F.regexp_replace(F.upper(F.trim(col(text))), r"\s*\([^)]*\)\s*", ""))
    out = None
    for word, name in ALIASES:
        hit = s.contains(word)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.nullif(out.otherwise(F.split(s, r"\s+")[0]), F.lit(""))


def rating(text) -> Column:
    """+, 0 or - in brackets."""
    return F.nullif(F.regexp_extract(col(text), r"\(([+\-0])\)", 1), F.lit(""))


def number(text) -> Column:
    """A number without thousands separators; bond ticks (112'17) are not numbers."""
    s = F.regexp_replace(F.trim(col(text)), "[, ]", "")
    return F.when(~s.contains("'"), s.try_cast("double"))


def mail_date(ts) -> Column:
    """From 15:00 or on weekends a mail is for its own date, before that for the day before."""
    t = col(ts)
    own = (F.hour(t) >= 15) | (F.weekday(t) >= 5)
    return F.when(own, F.to_date(t)).otherwise(F.date_sub(F.to_date(t), 1))


def normalize_range_records(df: DataFrame) -> DataFrame:
    """(mail_ts, section, name, low_text, high_text) to clean range records, low under high."""
    out = df.select(mail_date("mail_ts").alias("date"), timeframe("section").alias("timeframe"), symbol("name").alias("symbol"), rating("name").alias("rating"),
                    number("low_text").alias("_a"), number("high_text").alias("_b"))
    out = out.filter(F.col("symbol").isNotNull() & F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return out.select("date", "timeframe", "symbol", F.least("_a", "_b").alias("range_low"), F.greatest("_a", "_b").alias("range_high"), "rating")
