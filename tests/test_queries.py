"""Registered queries against their SQL on the smallest data set. ``TICKLOOM_ALL=1`` checks
all of them; by default a spread over every area."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ("build_minute_bars", "session_window_bounds", "asof_ffill", "interval_join_agg", "dedup_keep_last", "temporal_interactions", "level_stability", "volatility_block", "corr_regime", "cusum",
        "value_area_70", "profile_at_level", "episode_state", "reversal_breakout", "barrier_outcome", "trade_viable_zone", "greedy_cooldown", "classification_metrics", "paired_day_bootstrap", "gex_features",
        "iv_moneyness_map", "scan_bars_csv", "normalize_range_text", "stream_session_activity", "breakout_outcomes_by_level")
SQL = entry.oracle_sql()
NAMES = sorted(SQL) if os.environ.get("TICKLOOM_ALL") else SOME


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    cols = sorted(names)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=key)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    assert sorted(df.columns) == cols
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())
