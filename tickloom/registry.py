"""Named feature steps: DataFrame -> DataFrame functions with declared inputs and outputs.

``build`` applies steps by name, in the order given. ``features`` takes the columns wanted and
finds the steps itself: the declared columns make a graph, only steps that lead to a wanted
column are applied, each after those it needs, and all other columns are dropped, so Catalyst
prunes what a step computes beside. Both give one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Step:
    name: str
    fn: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...]
    gives: tuple[str, ...]


STEPS: dict[str, Step] = {}


def register(name: str, needs=(), gives=()):
    def add(fn):
        if name in STEPS:
            raise ValueError(f"feature step {name} exists")
        STEPS[name] = Step(name, fn, tuple(needs), tuple(gives))
        return fn
    return add


def build(df: DataFrame, names, optional: bool = False) -> DataFrame:
    """Apply steps in order. ``optional`` skips steps whose inputs are missing."""
    for n in names:
        step = STEPS[n]
        missing = [c for c in step.needs if c not in df.columns]
        if missing and optional:
            continue
        if missing:
            raise ValueError(f"feature step {n} needs {missing}")
        if not step.gives or any(c not in df.columns for c in step.gives):
            df = step.fn(df)
    return df


def steps_for(columns, available) -> list[str]:
    """Names of the steps that lead from the ``available`` columns to ``columns``, each once and
    after the steps it needs. A column that several steps give comes from the first registered
    step that can be reached. ValueError names a column that none can give."""
    order: list[str] = []
    have = set(available)

    def reach(column: str, trail: tuple[str, ...]) -> str | None:
        """None when the column is there, else why it can't be."""
        if column in have:
            return None
        why = f"no feature step gives {column}"
        for step in STEPS.values():
            if column not in step.gives or step.name in trail:
                continue
            kept, known = list(order), set(have)
            faults = [w for w in (reach(c, (*trail, step.name)) for c in step.needs) if w]
            if not faults:
                order.append(step.name)
                have.update(step.gives)
                return None
            order[:] = kept
            have.clear()
            have.update(known)
            why = f"{column} by {step.name}: {faults[0]}"
        return why

    for column in columns:
        why = reach(column, ())
        if why:
            raise ValueError(why)
    return order


def features(df: DataFrame, columns, keep=("symbol", "trading_day", "dt", "day")) -> DataFrame:
    """The ``keep`` columns that exist and the wanted ``columns``, by the steps they need."""
    names = steps_for(columns, df.columns)
    kept = [c for c in keep if c in df.columns]
    for i, n in enumerate(names):
        # a column that no later step needs and nobody wants goes no further
        later = {c for m in names[i:] for c in STEPS[m].needs} | set(columns) | set(kept)
        df = STEPS[n].fn(df.select(*[c for c in df.columns if c in later]))
    return df.select(*kept, *[c for c in columns if c not in kept])


def _defaults():
    from tickloom.operators import daily as dl, intraday as it, levels as lv
    key = ("symbol", "trading_day", "dt")
    bar = (*key, "open", "high", "low", "close", "volume")
    flow = (*bar, "bidvolume", "askvolume")
    near = (*key, "close", "nearest_level", "level_price", "level_distance")
    sided = (*bar, "bar_no", "nearest_level", "level_price", "level_distance", "side")
    sma = [(f"sma{n}", f"close_vs_sma{n}_z", f"sma{n}_slope_5d") for n in (20, 50, 100, 200)]
    daily = ("symbol", "day", "open", "high", "low", "close", "volume")
    for name, fn, needs, gives in (
        # bars
        ("vwap", it.vwap_running, bar, ("vwap", "vwap_std", "vwap_z")),
        ("prev_day", it.prev_day_levels, bar, ("prev_high", "prev_low", "prev_mid")),
        ("overnight", it.overnight_running_levels, (*bar, "ovn"), ("ovn_hi", "ovn_lo")),
        ("initial_balance", it.initial_balance_levels, (*bar, "minute"), ("ib_hi", "ib_lo")),
        ("ib_extensions", it.ib_extensions, (*bar, "minute", "ib_hi", "ib_lo"), ("ib_mid", "ib_hi_ext_025", "ib_lo_ext_025", "ib_hi_ext_050", "ib_lo_ext_050", "ib_hi_ext_100", "ib_lo_ext_100")),
        ("rth_levels", it.rth_running_levels, (*bar, "minute"), ("rth_hi", "rth_lo")),
        ("level_stability", it.level_stability, (*bar, "bar_no", "rth_hi", "rth_lo"), ("rth_hi_age_bars", "rth_hi_updates_30", "rth_lo_age_bars", "rth_lo_updates_30", "rth_level_firmness")),
        ("prior_rth", it.prior_rth_open_close, (*bar, "minute"), ("prior_rth_open", "prior_rth_close")),
        ("opening_range", it.opening_range_levels, (*bar, "minute"), ("or5_hi", "or5_lo", "or5_mid", "or15_hi", "or15_lo", "or15_mid")),
        ("close_z", it.zscore_rolling, bar, ("close_z20",)), ("volume_z", it.volume_z, bar, ("vol_z",)), ("order_flow", it.ofi_z, flow, ("ofi", "ofi_z")),
        ("bollinger", it.bollinger, bar, ("bb_sma", "bb_std", "bb_upper", "bb_lower", "bb_pct_b", "bb_width", "bb_upper_dist", "bb_lower_dist", "bb_width_z")),
        ("opening_drive", it.opening_drive_regime, (*bar, "minute"), ("opening_drive_regime_dir", "opening_drive_net_pts", "opening_drive_frac")),
        ("gap_filled", it.gap_filled, (*bar, "minute"), ("gap_filled",)),
        ("range_percentile", it.range_percentile_prior, (*bar, "bar_no"), ("running_range", "session_range_percentile")),
        ("bars_since_extreme", it.bars_since_extreme, (*bar, "bar_no"), ("bars_since_session_extreme",)),
        ("bars_since_open", it.bars_since_open, (*bar, "ovn", "bar_no"), ("bars_since_rth_open",)),
        ("approach", it.approach_velocity, (*bar, "bar_no"), ("approach_velocity_10bar", "approach_deceleration")),
        ("same_direction", it.consecutive_same_dir, (*bar, "bar_no"), ("consecutive_same_dir",)),
        ("cum_delta", it.cum_delta_z, (*flow, "bar_no"), ("approach_cum_delta_z",)),
        ("vap_concentration", it.vap_concentration, (*bar, "bar_no"), ("seq_vap_concentration",)),
        ("sequence", it.sequence_features, (*flow, "bar_no"), ("seq_price_trend", "seq_volume_trend", "seq_delta_final", "seq_delta_trend")),
        # candles
        ("candle_quality", it.candle_quality, (*bar, "bar_no"), ("wick_to_body_ratio", "rejection_wick_pct", "close_position", "bar_momentum", "rejection_penetration", "bar_range_z")),
        ("rejections", it.rejection_counts, (*bar, "bar_no"), ("max_wick_ratio_3bar", "bar_momentum_reversal", "rejection_bar_count_3", "rejection_bar_count_5", "rejection_momentum")),
        # levels
        ("nearest_level", lambda df: lv.nearest_level(df, proximity=None), (*key, "close", *lv.LEVELS), ("nearest_level", "level_price", "level_distance")),
        ("side", lv.level_side, near, ("side",)),
        ("confluence", lv.level_confluence, (*near, *lv.LEVELS), ("level_distance_norm", "n_levels_within_3pt", "n_levels_within_5pt", "level_cluster_score", "level_type_strength")),
        ("episodes", lv.episode_state, sided, ("level_side_touch_count_day", "bars_since_last_level_side_touch", "level_side_touch_density_30", "level_touch_count_any_side_day",
                                               "bars_since_last_level_touch_any_side", "level_touch_density_any_30", "level_side_flip_count_day", "current_run_max_penetration_pts", "current_run_bars",
                                               "is_reclaim_bar", "level_reclaim_count_day", "bars_since_last_reclaim", "last_reclaim_dwell_bars", "last_reclaim_penetration_pts")),
        ("direction_stability", lv.direction_stability, sided, ("same_level_side_run_bars", "bars_since_same_level_side_flip", "same_level_side_flip_count_10", "same_level_cross_count_10", "aligned_return_frac_5", "same_level_side_stability_10")),
        ("level_encoding", lv.level_encoding, (*sided, *lv.LEVELS), (*[f"is_{c}" for c in lv.LEVELS], "level_is_support", "approach_dir_vs_level")),
        # days
        ("daily_returns", dl.returns_momentum, daily, ("return_1d", "return_5d", "return_20d", "return_60d", "rsi_5", "rsi_14")),
        ("daily_averages", dl.sma_z_slope_alignment, daily, (*[c for names in sma for c in names], "ma_alignment")),
        ("daily_volatility", dl.volatility_block, daily, ("log_ret", "atr_5", "atr_14", "atr_20", "rvol_10d", "rvol_20d", "rvol_21d", "atr_ratio_5_20", "vol_of_vol", "atr_pct_14",
                                                          "atr_pctile_252d", "atr_momentum_5d", "atr_momentum_10d", "sq_ret_lag1", "sq_ret_ewm5", "sq_ret_ewm20")),
        ("daily_shape", dl.bar_shape_daily, daily, ("range_pct", "upper_wick_ratio", "lower_wick_ratio", "gap_pct", "body_range_ratio")),
        ("daily_runs", dl.consec_days, daily, ("consec_up", "consec_down")), ("daily_drawdown", dl.drawdown, daily, ("drawdown_20d", "drawdown_60d")),
        ("daily_exhaustion", dl.trend_exhaustion, daily, ("trend_exhaustion",)),
        ("daily_extension", dl.price_extension, daily, ("price_extension_20d", "price_extension_50d", "return_vs_range_20d")),
        ("daily_changes", dl.cusum_columns, daily, ("cusum_pos", "cusum_neg", "cusum_score")),
    ):
        register(name, needs, gives)(fn)


_defaults()
