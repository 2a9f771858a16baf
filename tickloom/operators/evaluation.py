"""Evaluation aggregates.

Statistics that need a global order (AUC, precision-recall, KS, drawdown) never sort a
table in one task: scores are first collapsed to distinct values, cut at approximate
quantiles, and running totals are the in-bucket running sums plus the totals of earlier
buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.options import norm_cdf
from tickloom.functions.scratch import stage_dir
from tickloom.functions.windows import by, safe_div, whole
from tickloom.operators.sets import hash_order


def ratio(a, b) -> Column:
    return safe_div(a, b)


# --- trades ---------------------------------------------------------------------------------------

def trade_aggs(pnl: str = "pnl", exit_type: str | None = "exit_type") -> list[Column]:
    p = F.col(pnl)
    win, loss = F.when(p > 0, p), F.when(p < 0, p)
    out = [
        F.count(p).alias("n_trades"), F.avg((p > 0).cast("int")).alias("win_rate"), F.avg(p).alias("avg_pnl"), F.sum(p).alias("total_pnl"),
        F.max(p).alias("max_pnl"), F.min(p).alias("min_pnl"), F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        ratio(F.sum(win), -F.sum(loss)).alias("profit_factor"), ratio(F.avg(win), -F.avg(loss)).alias("payoff_ratio"),
    ]
    if exit_type:
        share = lambda names: F.avg(F.col(exit_type).isin(*names).cast("int"))
        out += [share(["stop", "stop_tie"]).alias("pct_stop"), share(["target", "take"]).alias("pct_take"), share(["timeout", "close", "timed"]).alias("pct_close")]
    return out


def group_metrics(trades: DataFrame, keys, pnl: str = "pnl", exit_type: str | None = "exit_type") -> DataFrame:
    return trades.groupBy(*keys).agg(*trade_aggs(pnl, exit_type))


def max_drawdown(trades: DataFrame, keys, day: str, order, pnl: str = "pnl") -> DataFrame:
    """Largest fall of the running P&L from its running peak, per group. Each day is reduced
    to its total, peak, trough and own drawdown; days are then chained."""
    w = by((*keys, day), order).rowsBetween(Window.unboundedPreceding, 0)
    df = trades.withColumn("_c", F.sum(pnl).over(w))
    df = df.withColumn("_dd", F.max("_c").over(w) - F.col("_c"))
    d = df.groupBy(*keys, day).agg(F.sum(pnl).alias("t"), F.max("_c").alias("hi"), F.min("_c").alias("lo"), F.max("_dd").alias("dd"))
    before = by(keys, day).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("base", F.coalesce(F.sum("t").over(before), F.lit(0.0)))
    d = d.withColumn("peak", F.max(F.col("base") + F.col("hi")).over(before))
    return d.groupBy(*keys).agg(F.max(F.greatest("dd", F.coalesce(F.col("peak") - (F.col("base") + F.col("lo")), F.lit(0.0)))).alias("max_drawdown"))


def trade_metrics(trades: DataFrame, keys=("symbol",), day: str = "trading_day", order="dt", pnl: str = "pnl") -> DataFrame:
    """Group metrics with drawdown, the busiest day's share and the days traded."""
    per_day = trades.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("_n"))
    days = per_day.groupBy(*keys).agg((F.max("_n") / F.sum("_n")).alias("max_day_share"), F.count(F.lit(1)).alias("n_days_traded"))
    return group_metrics(trades, keys, pnl).join(days, list(keys)).join(max_drawdown(trades, keys, day, order, pnl), list(keys))


def daily_sharpe_metrics(trades: DataFrame, calendar: DataFrame, keys=("symbol",), day: str = "trading_day") -> DataFrame:
    """Metrics over every calendar day, traded or not, and shares by time of day."""
    m = F.col("minute")
    inside = lambda a, b: F.sum(((m >= a) & (m < b)).cast("int"))
    per = trades.groupBy(*keys, day).agg(
        F.sum("pnl").alias("p"), F.count(F.lit(1)).alias("n"), F.sum((F.col("exit_type") == "target").cast("int")).alias("tg"),
        inside(390, 450).alias("w1"), inside(450, 510).alias("w2"), inside(510, 630).alias("w3"), inside(630, 780).alias("w4"))
    d = calendar.join(per, [*keys, day], "left").fillna(0, subset=["p", "n", "tg", "w1", "w2", "w3", "w4"])
    total = F.sum("n")
    sd = F.stddev_samp("p")
    return d.groupBy(*keys).agg(
        total.alias("n_trades"), F.avg("n").alias("mean_trades_per_day"), F.avg("p").alias("mean_pnl_per_day"),
        F.when(sd > 1e-9, safe_div(F.avg("p"), sd) * 252 ** 0.5).alias("annualized_daily_sharpe"), F.avg((F.col("p") == 0).cast("int")).alias("zero_trade_day_rate"),
        F.avg((F.col("tg") == 0).cast("int")).alias("zero_target_day_rate"), ratio(F.sum("w1"), total).alias("open_60_share"), ratio(F.sum("w2"), total).alias("post_open_60_share"),
        ratio(F.sum("w3"), total).alias("late_morning_120_share"), ratio(F.sum("w4"), total).alias("afternoon_150_share"),
        F.avg((F.col("w2") == 0).cast("int")).alias("zero_post_open_60_day_rate"), F.avg((F.col("w3") + F.col("w4") == 0).cast("int")).alias("zero_after_510_day_rate"))


def selection_metrics(rows: DataFrame, calendar: DataFrame, chosen: Column, positive: Column, keys=("symbol",), day: str = "trading_day") -> DataFrame:
    """Precision, recall and the share of days without a chosen positive."""
    c, p = chosen.cast("int"), (chosen & positive).cast("int")
    per = rows.groupBy(*keys, day).agg(F.sum(c).alias("ns"), F.sum(p).alias("tp"), F.sum(positive.cast("int")).alias("pos"))
    d = calendar.join(per, [*keys, day], "left").fillna(0, subset=["ns", "tp", "pos"])
    return d.groupBy(*keys).agg(F.sum("ns").alias("n_selected"), F.avg("ns").alias("mean_selected_per_day"), ratio(F.sum("tp"), F.sum("ns")).alias("precision"),
                                ratio(F.sum("tp"), F.sum("pos")).alias("recall"), F.avg((F.col("tp") == 0).cast("int")).alias("no_hit_day_rate"))


def subset_baselines(trades: DataFrame, subset, level: str = "level") -> DataFrame:
    """Outcome metrics of all candidates, of a level subset, and of each level."""
    tag = F.explode(F.concat(F.array(F.lit("all")), F.when(F.col(level).isin(*subset), F.array(F.lit("subset"))).otherwise(F.array().cast("array<string>")),
                             F.array(F.concat(F.lit("level:"), F.col(level)))))
    return group_metrics(trades.withColumn("slice", tag), ["slice"])


def signal_diversity(signals: DataFrame, keys=("symbol",)) -> DataFrame:
    """Distinct levels, concentration over levels, side and time-of-day shares."""
    m = F.col("minute")
    per = signals.groupBy(*keys, "level").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("direction") > 0).cast("int")).alias("up"), F.sum((m < 480).cast("int")).alias("early"), F.sum((m >= 690).cast("int")).alias("late"))
    tot = F.sum("n").over(whole(keys))
    per = per.withColumn("_sq", F.pow(F.col("n") / tot, 2))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_levels"), F.sum("_sq").alias("level_hhi"), (F.sum("up") / F.sum("n")).alias("long_share"),
                                  (1 - F.sum("up") / F.sum("n")).alias("short_share"), (F.sum("early") / F.sum("n")).alias("early_share"), (F.sum("late") / F.sum("n")).alias("late_share"))


def pnl_proxy(daily: DataFrame, prediction: str, keys=("symbol",), day: str = "day") -> DataFrame:
    """Position from yesterday's class (2 long, 0 short, else flat) times today's return."""
    w = by(keys, day)
    pos = F.when(F.col(prediction) == 2, 1).when(F.col(prediction) == 0, -1).otherwise(0)
    df = daily.withColumns({"position": F.coalesce(F.lag(pos).over(w), F.lit(0)), "ret": F.coalesce(safe_div("close", F.lag("close").over(w)) - 1, F.lit(0.0))})
    df = df.withColumn("strategy_ret", F.col("position") * F.col("ret"))
    return df.withColumn("cum_ret", F.sum("strategy_ret").over(w.rowsBetween(Window.unboundedPreceding, 0)))


# --- ranges ---------------------------------------------------------------------------------------

def containment_metrics(df: DataFrame, keys=("symbol",)) -> DataFrame:
    """Predicted (pred_low, pred_high) against realised (low, high)."""
    pl, ph, lo, hi = (F.col(c) for c in ("pred_low", "pred_high", "low", "high"))
    share = lambda c: F.avg(c.cast("int"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), share((pl <= lo) & (ph >= hi)).alias("full_containment"), share(hi <= ph).alias("high_contained"), share(lo >= pl).alias("low_contained"),
        share((pl <= hi) & (ph >= lo)).alias("any_overlap"), F.avg(ph - pl).alias("avg_pred_width"), F.avg(hi - lo).alias("avg_realized_width"),
        ratio(F.avg(ph - pl), F.avg(hi - lo)).alias("width_ratio"), F.avg(F.abs((ph - pl) - (hi - lo))).alias("width_mae"), F.avg((ph - pl) - (hi - lo)).alias("width_bias"))


def fade_opportunity(df: DataFrame, keys=("symbol",)) -> DataFrame:
    """How often the predicted bounds are touched, and the close comes back inside."""
    up, dn = F.col("high") >= F.col("pred_high"), F.col("low") <= F.col("pred_low")
    n = lambda c: F.sum(c.cast("int"))
    return df.groupBy(*keys).agg(
        F.avg(up.cast("int")).alias("pct_touch_high"), ratio(n(up & (F.col("close") < F.col("pred_high"))), n(up)).alias("fade_high_win_rate"), n(up).alias("n_touched_high"),
        F.avg(dn.cast("int")).alias("pct_touch_low"), ratio(n(dn & (F.col("close") > F.col("pred_low"))), n(dn)).alias("fade_low_win_rate"), n(dn).alias("n_touched_low"))


def horizon_baseline(daily: DataFrame, horizons: dict[str, int], atr: str, k: float = 0.7, min_days: int = 10, keys=("symbol",), day: str = "day") -> DataFrame:
    """Previous close plus and minus k * ATR * sqrt(h) against the realised forward range."""
    w = by(keys, day)
    out = None
    for name, h in horizons.items():
        f = w.rowsBetween(0, h - 1)
        pc, a = F.lag("close").over(w), F.lag(atr).over(w)
        half = k * a * h ** 0.5
        df = daily.select(*keys, F.lit(name).alias("timeframe"), (pc - half).alias("pred_low"), (pc + half).alias("pred_high"),
                          F.max("high").over(f).alias("high"), F.min("low").over(f).alias("low"))
        out = df if out is None else out.unionByName(df)
    m = containment_metrics(out.dropna(), (*keys, "timeframe"))
    return m.filter(F.col("n") >= min_days)


#: Rows of a range of values that one task sorts.
PART_ROWS = 1 << 20

# --- scores ---------------------------------------------------------------------------------------

def cumulative_by(table: DataFrame, order: str, sums, keys=(), part_rows: int = PART_ROWS) -> DataFrame:
    """``table`` (one row per distinct order value) with ``<c>_below``: the total of c over
    strictly smaller order values, and ``<c>_all``.

    Two levels: the table is written once, cut into ranges of (keys, order) of about ``part_rows`` rows, however many
    values there are; running sums inside a range add to the totals of the ranges before it, one row each."""
    keys = list(keys)
    spark = table.sparkSession
    rough = stage_dir(spark, "values")
    table.write.parquet(rough)
    table = spark.read.schema(table.schema).parquet(rough)
    parts = max(1, -(-table.count() // part_rows))
    path = stage_dir(spark, "ranges")
    table.repartitionByRange(parts, *keys, order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    df = spark.read.parquet(path)
    per = df.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*(keys or [F.lit(1)]))
    per = per.select(*keys, "_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums], *[F.sum(f"_{c}").over(every).alias(f"{c}_all") for c in sums])
    w = by((*keys, "_part"), order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(per, [*keys, "_part"])
    return df.withColumns({f"{c}_below": F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums}).drop("_part", *[f"_b_{c}" for c in sums])


def score_table(df: DataFrame, score: str, label: str, keys=()) -> DataFrame:
    """Rows and positives per distinct score, with running totals."""
    t = df.groupBy(*keys, F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    return cumulative_by(t, "score", ["n", "pos"], keys)


def auc_from(table: DataFrame, keys=()) -> DataFrame:
    """Rank-sum AUC (ties count half) and average precision."""
    neg = F.col("n") - F.col("pos")
    neg_below = F.col("n_below") - F.col("pos_below")
    ge_n, ge_pos = F.col("n_all") - F.col("n_below"), F.col("pos_all") - F.col("pos_below")
    return table.groupBy(*keys).agg(
        ratio(F.sum(F.col("pos") * (neg_below + neg / 2)), F.max("pos_all") * (F.max("n_all") - F.max("pos_all"))).alias("auc"),
        ratio(F.sum(F.col("pos") * ge_pos / ge_n), F.max("pos_all")).alias("pr_auc"))


def classification_metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5, keys=()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 and AUC."""
    p, y = F.col(score) >= threshold, F.col(label) == 1
    n = lambda c: F.sum(c.cast("int"))
    m = df.groupBy(*keys).agg(n(p & y).alias("tp"), n(p & ~y).alias("fp"), n(~p & y).alias("fn"), n(~p & ~y).alias("tn"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    m = m.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), "precision": z(ratio("tp", F.col("tp") + F.col("fp"))), "recall": z(ratio("tp", F.col("tp") + F.col("fn"))),
                       "f1": z(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))})
    auc = auc_from(score_table(df, score, label, keys), keys)
    return m.join(auc, list(keys)) if keys else m.crossJoin(auc)  # one row each


def precision_constrained_threshold(df: DataFrame, score: str, label: str, min_precision: float, keys=()) -> DataFrame:
    """Score threshold with the best recall whose precision is at least ``min_precision``;
    the lowest such threshold wins a tie."""
    t = score_table(df, score, label, keys)
    n, tp = F.col("n_all") - F.col("n_below"), F.col("pos_all") - F.col("pos_below")
    t = t.withColumns({"precision": tp / n, "recall": safe_div(tp, "pos_all")}).filter(F.col("precision") >= min_precision)
    best = F.max_by(F.struct("score", "precision", "recall"), F.struct(F.col("recall"), -F.col("score")))
    return t.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.score").alias("threshold"), F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"))


def threshold_for_recall(df: DataFrame, score: str, label: str, target: float, keys=()) -> DataFrame:
    """Highest threshold reaching the target recall, with precision and F1 there."""
    t = score_table(df, score, label, keys)
    n, tp = F.col("n_all") - F.col("n_below"), F.col("pos_all") - F.col("pos_below")
    t = t.withColumns({"precision": tp / n, "recall": safe_div(tp, "pos_all")}).filter(F.col("recall") >= target)
    out = t.groupBy(*keys).agg(F.max("score").alias("threshold"), F.max_by("precision", "score").alias("precision"))
    return out.withColumn("f1", F.coalesce(safe_div(2 * F.col("precision") * target, F.col("precision") + target), F.lit(0.0)))


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds, pnl: str = "pnl") -> DataFrame:
    """Per threshold: predictions, TP, FP, FN, precision, recall and outcome metrics. The
    thresholds are a literal list of a few values, expanded on the row."""
    t = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    p, y = F.col(score) >= F.col("threshold"), F.col(label) == 1
    n = lambda c: F.sum(c.cast("int"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    g = F.when(p, F.col(pnl))
    m = t.groupBy("threshold").agg(n(p).alias("n_predicted"), n(p & y).alias("tp"), n(p & ~y).alias("fp"), n(~p & y).alias("fn"),
                                   z(F.avg((g > 0).cast("int"))).alias("win_rate"), z(F.avg(g)).alias("mean_pnl"), z(F.sum(g)).alias("total_pnl"))
    return m.withColumns({"precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))})


def calibration_metrics(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Brier score, expected calibration error, separation of the classes and PR-AUC."""
    p, y = F.col(score), F.col(label).cast("double")
    b = df.withColumn("_b", F.least(F.floor(p * bins), F.lit(bins - 1))).groupBy("_b").agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum(F.pow(p - y, 2)).alias("se"))
    ece = b.agg((F.sum("se") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("sy") - F.col("sp"))) / F.sum("n")).alias("ece"))
    pos, neg = F.when(y >= 0.5, p), F.when(y < 0.5, p)
    sep = df.agg(F.avg(pos).alias("pos_mean_prob"), F.avg(neg).alias("neg_mean_prob"),
                 ((F.avg(pos) - F.avg(neg)) / F.sqrt(F.greatest((F.var_samp(pos) + F.var_samp(neg)) / 2, F.lit(1e-12)))).alias("prob_cohens_d"))
    ap = auc_from(score_table(df, score, label)).select("pr_auc")
    return sep.crossJoin(ece).crossJoin(ap)  # one row each


def effect_size(df: DataFrame, value: str, group: Column, keys=()) -> DataFrame:
    """Cohen's d of the rows in ``group`` against the rest."""
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    na, nb = F.count(a), F.count(b)
    pooled = F.sqrt(safe_div((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b), na + nb - 2))
    return df.groupBy(*keys).agg(na.alias("n_a"), nb.alias("n_b"), F.coalesce(safe_div(F.avg(a) - F.avg(b), pooled), F.lit(0.0)).alias("cohens_d"))


def ks_stat(df: DataFrame, value: str, group: Column, keys=()) -> DataFrame:
    """Largest gap of the two distribution functions, with the asymptotic p-value series."""
    t = score_table(df.withColumn("_g", group.cast("int")), value, "_g", keys)
    a = (F.col("pos_below") + F.col("pos")) / F.col("pos_all")
    b = (F.col("n_below") + F.col("n") - F.col("pos_below") - F.col("pos")) / (F.col("n_all") - F.col("pos_all"))
    out = t.groupBy(*keys).agg(F.max(F.abs(a - b)).alias("ks"), F.max("pos_all").alias("_na"), (F.max("n_all") - F.max("pos_all")).alias("_nb"))
    z = F.sqrt(F.col("_na") * F.col("_nb") / (F.col("_na") + F.col("_nb"))) * F.col("ks")
    series = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * z * z) for k in range(1, 21)), F.lit(0.0))
    return out.withColumn("p_asymptotic", F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0))).drop("_na", "_nb")


def two_sided(score: str) -> Column:
    """Two-sided p-value of a score under the normal distribution."""
    return 2.0 * (1.0 - norm_cdf(F.abs(score)))


def welch_t(df: DataFrame, value: str, group: Column, keys=()) -> DataFrame:
    """Welch's t of two groups; ``p_value`` by the normal approximation."""
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    se = F.sqrt(F.var_samp(a) / F.nullif(F.count(a), F.lit(0)) + F.var_samp(b) / F.nullif(F.count(b), F.lit(0)))
    return df.groupBy(*keys).agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), safe_div(F.avg(a) - F.avg(b), se).alias("t_stat")).withColumn("p_value", two_sided("t_stat"))


def binom_vs_half(df: DataFrame, hit: Column, keys=()) -> DataFrame:
    """Share of hits, its normal score against one half and the p-value of that."""
    n, k = F.count(hit), F.sum(hit.cast("int"))
    return df.groupBy(*keys).agg(n.alias("n"), k.alias("hits"), (k / n).alias("share"), ((k - n / 2) / F.sqrt(n / 4)).alias("z_score")).withColumn("p_value", two_sided("z_score"))


def exact_quantiles(df: DataFrame, value: str, fractions, keys=()) -> DataFrame:
    """Exact linear-interpolated quantiles as an array. The two neighbouring ranks of every
    fraction are found in the running counts of distinct values, so no task holds them all."""
    t = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    c = cumulative_by(t, "v", ["n"], keys)
    def at(rank):
        return F.max(F.when((F.col("n_below") <= rank) & (rank < F.col("n_below") + F.col("n")), F.col("v")))
    aggs, out = [F.max("n_all").alias("_n")], []
    for i, p in enumerate(fractions):
        pos = F.lit(float(p)) * (F.col("n_all") - 1)
        aggs += [at(F.floor(pos)).alias(f"_a{i}"), at(F.ceil(pos)).alias(f"_b{i}")]
        frac = F.lit(float(p)) * (F.col("_n") - 1)
        out.append(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (frac - F.floor(frac)))
    return c.groupBy(*keys).agg(*aggs).select(*keys, F.array(*out).alias("quantiles"))


# --- bins -----------------------------------------------------------------------------------------

def quantile_bins(df: DataFrame, value: str, n_bins: int, out: str = "bin") -> DataFrame:
    """Equal-frequency bins by exact linear quantiles, duplicate edges dropped; bin 0 holds
    the minimum. The edges are one row of ``n_bins + 1`` numbers."""
    edges = exact_quantiles(df, value, [i / n_bins for i in range(n_bins + 1)]).select(F.array_distinct("quantiles").alias("_edges"))
    d = df.crossJoin(F.broadcast(edges))
    below = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return d.withColumn(out, F.greatest(below - 1, F.lit(0))).drop("_edges")


def mutual_info_binned(df: DataFrame, value: str, label: str, n_bins: int = 10) -> DataFrame:
    """Mutual information (nats) of the binned value and a 0/1 label."""
    c = quantile_bins(df, value, n_bins).groupBy("bin", label).agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy().agg(F.sum("n").alias("_t"))
    # the contingency table has at most n_bins * 2 rows
    c = c.withColumns({"_r": F.sum("n").over(whole(["bin"])), "_c": F.sum("n").over(whole([label]))}).crossJoin(F.broadcast(tot))
    term = F.col("n") / F.col("_t") * F.ln(F.col("n") * F.col("_t") / (F.col("_r") * F.col("_c")))
    return c.agg(F.sum(term).alias("mutual_info"), F.max("_t").alias("n"))


def conditional_rate(df: DataFrame, value: str, label: str, n_bins: int = 5, min_rows: int = 10) -> DataFrame:
    return quantile_bins(df, value, n_bins).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate")).filter(F.col("n") >= min_rows)


def conditioned_rates(df: DataFrame, label: str, conditions: dict[str, Column], min_rows: int = 50) -> DataFrame:
    """Rate of the label under each named condition, and its lift over all rows, in one pass."""
    aggs = [F.avg(label).alias("base_rate")]
    for name, c in conditions.items():
        aggs += [F.sum(c.cast("int")).alias(f"n|{name}"), F.avg(F.when(c, F.col(label))).alias(f"rate|{name}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("condition"), F.col(f"`n|{n}`").alias("n"), F.col(f"`rate|{n}`").alias("rate")) for n in conditions])
    return one.select("base_rate", F.explode(rows).alias("r")).select("r.*", "base_rate", (F.col("r.rate") - F.col("base_rate")).alias("lift")).filter(F.col("n") >= min_rows)


def vol_regime_bucket(daily: DataFrame, column: str, keys=("symbol",), low: float = 0.2, high: float = 0.8) -> DataFrame:
    """low, mid or high by the series' own quantiles."""
    q = daily.groupBy(*keys).agg(F.percentile(column, low).alias("_lo"), F.percentile(column, high).alias("_hi"))
    c = F.col(column)
    return daily.join(q, list(keys)).withColumn("vol_regime", F.when(c <= F.col("_lo"), "low").when(c >= F.col("_hi"), "high").otherwise("mid")).drop("_lo", "_hi")


def range_asymmetry(daily: DataFrame, column: str, predicted: DataFrame | None = None, keys=("symbol",), day: str = "day", low: float = 0.2, high: float = 0.8, least: int = 10, least_predicted: int = 5) -> DataFrame:
    """Room above and below the previous close, realized and, where ``predicted`` (keys, day,
    pred_high, pred_low) is given, predicted: one row per series, source and regime with n,
    avg_upside, avg_downside and bias = avg_downside - avg_upside.

    Regimes are low_vol and high_vol strictly beyond the series' quantiles of ``column``, normal
    otherwise (also where it is missing), and all. Regimes of fewer than ``least`` (or
    ``least_predicted``) days are left out, all is not. n counts days, the averages those with a
    previous close.
    """
    keys = list(keys)
    q = daily.groupBy(*keys).agg(F.percentile(column, low).alias("_lo"), F.percentile(column, high).alias("_hi"))
    c = F.col(column)
    regime = F.when(c < F.col("_lo"), "low_vol").when(c > F.col("_hi"), "high_vol").otherwise("normal")
    df = daily.withColumn("_pc", F.lag("close").over(by(keys, day))).join(q, keys).withColumn("_regime", regime)
    sides = lambda source, top, bottom: F.struct(F.lit(source).alias("source"), (F.col(top) - F.col("_pc")).alias("up"), (F.col("_pc") - F.col(bottom)).alias("down"))
    sources = [sides("realized", "high", "low")]
    if predicted is not None:
        df = df.join(predicted.select(*keys, day, F.lit(True).alias("_given"), "pred_high", "pred_low"), [*keys, day], "left")
        sources.append(F.when(F.col("_given"), sides("predicted", "pred_high", "pred_low")))
    # two sources and two regimes a day at most, summed where they arise
    long = df.select(*keys, "_regime", F.explode(F.array(*sources)).alias("_s")).filter(F.col("_s").isNotNull())
    long = long.select(*keys, "_s.*", F.explode(F.array(F.lit("all"), F.col("_regime"))).alias("regime"))
    out = long.groupBy(*keys, "source", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("up").alias("avg_upside"), F.avg("down").alias("avg_downside"))
    enough = F.col("n") >= F.when(F.col("source") == "realized", least).otherwise(least_predicted)
    return out.filter((F.col("regime") == "all") | enough).withColumn("bias", F.col("avg_downside") - F.col("avg_upside"))


def feature_correlations(df: DataFrame, features, target: str) -> DataFrame:
    """Pearson correlation of each feature with the target, in one aggregate."""
    one = df.agg(*[_corr(f, target).alias(f) for f in features])
    return one.unpivot([], list(features), "feature", "corr")


def _corr(a: str, b: str) -> Column:
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return safe_div(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def redundancy_matrix(df: DataFrame, new, existing, redundant: float = 0.9, high: float = 0.7, min_rows: int = 100) -> DataFrame:
    """For each new feature the existing one it resembles most. All pairs of feature columns
    are aggregates of one pass over the rows."""
    aggs = [_corr(a, b).alias(f"{a}|{b}") for a in new for b in existing] + [F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n|{a}|{b}") for a in new for b in existing]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("feature"), F.lit(b).alias("match"), F.col(f"`{a}|{b}`").alias("corr"), F.col(f"`n|{a}|{b}`").alias("n")) for a in new for b in existing])
    long = one.select(F.explode(rows).alias("r")).select("r.*").filter((F.col("n") >= min_rows) & F.col("corr").isNotNull())
    best = long.groupBy("feature").agg(F.max_by(F.struct("match", "corr"), F.struct(F.abs("corr"), F.col("match"))).alias("b"))
    c = F.abs("b.corr")
    return best.select("feature", F.col("b.match").alias("match"), F.col("b.corr").alias("corr"), F.when(c >= redundant, "redundant").when(c >= high, "high").otherwise("ok").alias("verdict"))


# --- resampling and gates -------------------------------------------------------------------------

def paired_day_bootstrap(days: DataFrame, n_boot: int = 200, keys=("symbol",)) -> DataFrame:
    """Confidence bounds of the win-rate and mean-P&L difference of two runs by resampling
    days. ``days`` has index 0..n-1, n_days, and per run n, wins and pnl (b_*, e_*).

    Draw k of replicate r is an md5 hash of (r, k): reproducible, and each replicate is a
    hash-partitioned equi-join of draws with days. Days are bounded by the calendar.
    """
    draws = days.select(*keys, "n_days", F.col("index").alias("k")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    draws = draws.withColumn("index", F.pmod(hash_order(F.col("rep").cast("string"), F.col("k").cast("string")), F.col("n_days").cast("bigint")))
    vals = ["b_n", "b_wins", "b_pnl", "e_n", "e_wins", "e_pnl"]
    s = draws.join(days.select(*keys, F.col("index").cast("bigint").alias("index"), *vals), [*keys, "index"]).groupBy(*keys, "rep").agg(*[F.sum(v).alias(v) for v in vals])
    s = s.filter((F.col("b_n") > 0) & (F.col("e_n") > 0)).select(
        *keys, (F.col("e_wins") / F.col("e_n") - F.col("b_wins") / F.col("b_n")).alias("wr"), (F.col("e_pnl") / F.col("e_n") - F.col("b_pnl") / F.col("b_n")).alias("pn"))
    stats = lambda c, tag: [F.avg(c).alias(f"delta_{tag}_mean"), F.percentile(c, 0.025).alias(f"delta_{tag}_ci_low"), F.percentile(c, 0.975).alias(f"delta_{tag}_ci_high")]
    return s.groupBy(*keys).agg(*stats("wr", "wr"), *stats("pn", "pnl"))


def paired_auc_bootstrap(days: DataFrame, scored: DataFrame, label: str, base: str, enhanced: str, n_boot: int = 200, keys=("symbol",)) -> DataFrame:
    """``delta_auc``, its 2.5th and 97.5th percentile over replicates that resample days, as ``paired_day_bootstrap`` does.

    ``days``: keys, trading_day, index, n_days. ``scored``: keys, trading_day, the label and both scores. Scores are
    collapsed to (day, score) counts; a replicate weighs them by how often it drew the day, so rows are never copied,
    and its AUC comes from weighted running counts. Replicates of one class only are left out."""
    keys = list(keys)
    draws = days.select(*keys, "n_days", F.col("index").alias("k")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    draws = draws.withColumn("index", F.pmod(hash_order(F.col("rep").cast("string"), F.col("k").cast("string")), F.col("n_days").cast("bigint")))
    times = draws.groupBy(*keys, "rep", "index").agg(F.count(F.lit(1)).alias("times"))
    # Replicate -1 is the sample itself.
    times = times.unionByName(days.select(*keys, F.lit(-1).alias("rep"), F.col("index").cast("bigint").alias("index"), F.lit(1).cast("bigint").alias("times")))
    run = F.explode(F.array(*[F.struct(F.lit(n).alias("run"), F.col(c).cast("double").alias("score")) for n, c in (("b", base), ("e", enhanced))])).alias("_r")
    on = days.select(*keys, "trading_day", F.col("index").cast("bigint").alias("index"))
    counts = scored.join(on, [*keys, "trading_day"]).select(*keys, "index", F.col(label).cast("bigint").alias("_y"), run).groupBy(*keys, "index", "_r.run", "_r.score").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"))
    weighted = times.join(counts, [*keys, "index"]).groupBy(*keys, "rep", "run", "score").agg(F.sum(F.col("n") * F.col("times")).alias("n"), F.sum(F.col("pos") * F.col("times")).alias("pos"))
    auc = auc_from(cumulative_by(weighted, "score", ["n", "pos"], [*keys, "rep", "run"]), [*keys, "rep", "run"])
    delta = auc.groupBy(*keys, "rep").agg((F.max(F.when(F.col("run") == "e", F.col("auc"))) - F.max(F.when(F.col("run") == "b", F.col("auc")))).alias("d"))
    drawn = F.when(F.col("rep") >= 0, F.col("d"))
    return delta.groupBy(*keys).agg(F.max(F.when(F.col("rep") < 0, F.col("d"))).alias("delta_auc"), F.percentile(drawn, 0.025).alias("delta_auc_ci_low"), F.percentile(drawn, 0.975).alias("delta_auc_ci_high"))


def acceptance_gate(metrics: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One 0/1 column per rule and their conjunction."""
    df = metrics.withColumns({f"pass_{k}": F.coalesce(c, F.lit(False)).cast("int") for k, c in rules.items()})
    return df.withColumn("pass_all", F.least(*[F.col(f"pass_{k}") for k in rules]) if len(rules) > 1 else F.col(f"pass_{next(iter(rules))}"))


def accuracy_by_minute(df: DataFrame, predicted: Column, actual: Column, minute: str = "minute") -> DataFrame:
    return df.groupBy(minute).agg(F.count(F.lit(1)).alias("n"), F.avg((predicted == actual).cast("int")).alias("accuracy"))


def label_crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of every pair of labels, with each pair's share of its row and the overall
    agreement rate on every row."""
    c = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy().agg((F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement"))
    return c.withColumn("row_share", F.col("n") / F.sum("n").over(whole([a]))).crossJoin(F.broadcast(tot))  # one row


def sample_weights(df: DataFrame, label: str, progress: str, early: float = 2.0, rules: dict[str, tuple[Column, float]] | None = None) -> DataFrame:
    """Inverse class frequency times a weight that decays with progress, times the factors of
    the rules that apply."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    tot = n.groupBy().agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    freq = n.crossJoin(F.broadcast(tot)).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("class_weight"))
    w = F.col("class_weight") * (1 + (early - 1) * F.pow(1 - F.col(progress), 2))
    for cond, k in (rules or {}).values():
        w = w * F.when(cond, k).otherwise(1.0)
    return df.join(freq, label).withColumn("weight", w)


def augment_mirror(df: DataFrame, direction: str = "direction", outcome: str = "outcome") -> DataFrame:
    """Positives once more with direction and outcome flipped."""
    mirrored = df.filter(F.col(outcome) == 1).withColumns({direction: -F.col(direction), outcome: F.lit(0), "mirrored": F.lit(1)})
    return df.withColumn("mirrored", F.lit(0)).unionByName(mirrored)


def parity_check(a: DataFrame, b: DataFrame, tolerance: float = 1e-6, metric: str = "metric", value: str = "value") -> DataFrame:
    """Metrics of two runs side by side; missing on one side fails."""
    j = a.select(metric, F.col(value).alias("left_value")).join(b.select(metric, F.col(value).alias("right_value")), metric, "full")
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    return j.withColumns({"gap": gap, "ok": F.coalesce((gap <= tolerance).cast("int"), F.lit(0))})


def state_table(base: DataFrame, parts, probs: DataFrame, days: int, classes=("p0", "p1", "p2"), default=(0.33, 0.34, 0.33), keys=("symbol",), day: str = "day") -> DataFrame:
    """The last ``days`` days with joined state, class probabilities and the likeliest class."""
    rank = F.row_number().over(by(keys, F.col(day).desc()))
    df = base.withColumn("_r", rank).filter(F.col("_r") <= days).drop("_r")
    for p in parts:
        df = df.join(p, [*keys, day], "left")
    df = df.join(probs, [*keys, day], "left").withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in zip(classes, default)})
    arr = F.array(*[F.col(c) for c in classes])
    return df.withColumn("predicted", F.array_position(arr, F.array_max(arr)) - 1)


def macro_f1(df: DataFrame, predicted: str, actual: str, classes) -> DataFrame:
    """Accuracy and the mean F1 of the classes over labelled rows (actual >= 0)."""
    d = df.filter(F.col(actual) >= 0)
    n = lambda c: F.sum(c.cast("int"))
    p, y = F.col(predicted), F.col(actual)
    f1 = [F.coalesce(safe_div(2 * n((p == k) & (y == k)), n(p == k) + n(y == k)), F.lit(0.0)) for k in classes]
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg((p == y).cast("int")).alias("accuracy"), (sum(f1, F.lit(0.0)) / len(classes)).alias("macro_f1"))
