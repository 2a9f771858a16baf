"""The end-to-end flow: ticks to bars, sessions, levels, breakouts, outcomes, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.operators import evaluation as ev, intraday as it, labels as lb, levels as lv
from tickloom.plans.adapters import BAR, Tables, with_
from tickloom.plans.catalog import project, parse_columns, query
from tickloom.plans.evaluation import M, MS
from tickloom.plans.intraday import PREV, VWAP
from tickloom.plans.levels import barrier_sql, stack_sql

LEVELS = ("vwap", "prev_high", "prev_low", "prev_mid")
COLUMNS = "level " + M


def flagship_plan(t: Tables) -> DataFrame:
    """Outcome metrics of breakout entries by level (stop 5, target 8, 45 bars, stop first)."""
    bars = it.vwap_running(it.prev_day_levels(t.bar()))
    trig = lv.breakout_triggers(bars, LEVELS)
    d, px = F.col("direction"), F.col("close")
    entries = trig.select("symbol", "trading_day", "dt", "bar_no", "level", "direction", px.alias("entry_price"), (px - d * 5).alias("stop"), (px + d * 8).alias("target"))
    return ev.group_metrics(lb.barrier_outcome(entries, t.bar(), 1, "stop", "zero", 45), ["level"])


def flagship(t: Tables) -> DataFrame:
    return project(flagship_plan(t), parse_columns(COLUMNS))


SQL = with_(BAR, VWAP, PREV, "wide AS (SELECT v.*, prev_high, prev_low, (prev_high + prev_low) / 2 AS prev_mid, lag(close) OVER (PARTITION BY v.symbol ORDER BY v.dt) AS prev_close FROM vw v JOIN prev USING (symbol, trading_day))",
            f"lng AS ({stack_sql(LEVELS, 'wide', 'symbol, trading_day, dt, bar_no, close, prev_close, ovn')})", """
trg AS (SELECT *, 1 AS d FROM lng WHERE ovn = 0 AND prev_close <= level_price AND close >= level_price UNION ALL SELECT *, -1 FROM lng WHERE ovn = 0 AND prev_close >= level_price AND close <= level_price),
ent AS (SELECT symbol, trading_day, dt, bar_no, level, d AS direction, close AS entry_price, close - d * 5 AS stop, close + d * 8 AS target FROM trg)""", barrier_sql(1, "stop", "zero", 45)) + f"""
SELECT level, {MS} FROM (SELECT e.level, b.* FROM ent e JOIN (SELECT DISTINCT * FROM bo) b USING (symbol, dt, direction)) GROUP BY 1"""


@query("breakout_outcomes_by_level", COLUMNS, SQL)
def _(t):
    return flagship_plan(t)
