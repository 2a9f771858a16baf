from __future__ import annotations

import pytest

from tickloom import registry


def test_steps_build_one_plan(make_bars):
    df = registry.build(make_bars([(1.0, 2.0, 0.5, 1.5)] * 5), ["vwap", "prev_day", "rth_levels", "vwap"])
    assert {"vwap", "prev_mid", "rth_hi"} <= set(df.columns) and df.count() == 5


def test_missing_inputs(make_bars):
    df = make_bars([(1.0, 2.0, 0.5, 1.5)]).drop("bidvolume")
    with pytest.raises(ValueError, match="bidvolume"):
        registry.build(df, ["order_flow"])
    assert "ofi_z" not in registry.build(df, ["order_flow"], optional=True).columns


def test_steps_in_order_of_need():
    base = ("symbol", "trading_day", "dt", "open", "high", "low", "close", "volume", "minute", "ovn", "bar_no")
    names = registry.steps_for(["is_reclaim_bar", "vwap_z"], base)
    assert names[-1] == "episodes" and names.index("nearest_level") < names.index("side") < names.index("episodes")
    assert set(names) == {"vwap", "prev_day", "overnight", "rth_levels", "nearest_level", "side", "episodes"}
    assert registry.steps_for(["close", "vwap"], base) == ["vwap"]
    with pytest.raises(ValueError, match="askvolume|bidvolume"):
        registry.steps_for(["ofi_z"], base)
    with pytest.raises(ValueError, match="no feature step gives nothing_such"):
        registry.steps_for(["nothing_such"], base)


def test_circular_steps(monkeypatch):
    steps = {n: registry.Step(n, lambda df: df, (need,), (give,)) for n, need, give in (("p", "b", "a"), ("q", "a", "b"), ("r", "c", "b"))}
    monkeypatch.setattr(registry, "STEPS", steps)
    assert registry.steps_for(["a"], ["c"]) == ["r", "p"]
    with pytest.raises(ValueError, match="no feature step gives c"):
        registry.steps_for(["a"], [])


def test_every_step_gives_what_it_declares(spark, make_bars):
    """Each step alone, on its declared inputs only."""
    bars = make_bars([(1.0, 2.0, 0.5, 1.5)])
    days = spark.createDataFrame([], "symbol string, day date, open double, high double, low double, close double, volume double")
    everything = {c: "double" for s in registry.STEPS.values() for c in s.gives} | {"nearest_level": "string", "side": "int"}
    for step in registry.STEPS.values():
        base = days if "day" in step.needs else bars
        schema = ", ".join(f"{c} {base.schema[c].dataType.simpleString() if c in base.columns else everything[c]}" for c in step.needs)
        out = step.fn(spark.createDataFrame([], schema))
        assert set(step.gives) <= set(out.columns), step.name
        assert set(step.needs) <= set(out.columns), step.name


def test_one_far_column_costs_its_own_steps_only(make_bars):
    bars = make_bars([(10.0 + i, 11.0 + i, 9.5 + i, 10.5 + i) for i in range(60)])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    near = registry.features(bars, ["vwap"])
    assert near.columns == ["symbol", "trading_day", "dt", "vwap"] and plan(near).count("Window ") == 1
    far = registry.features(bars, ["level_is_support"])
    assert far.columns == ["symbol", "trading_day", "dt", "level_is_support"] and far.count() == 60
    assert "bb_" not in plan(far) and "bidvolume" not in plan(far).split("LogicalRDD")[0]
    by_hand = registry.build(bars, ["vwap", "prev_day", "overnight", "rth_levels", "nearest_level", "side", "level_encoding"])
    want = {(r["dt"], r["level_is_support"]) for r in by_hand.collect()}
    assert {(r["dt"], r["level_is_support"]) for r in far.collect()} == want
