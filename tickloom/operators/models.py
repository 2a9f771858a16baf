"""Feature scaling, ranges and simple models fitted by Spark."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.windows import by, clip, diff, safe_div
from tickloom.operators import folds, scans, selection as sl
from tickloom.operators.blocks import over_blocks


def fit_stats(df: DataFrame, columns, keys=()) -> DataFrame:
    """One row of mean and population deviation per column (and key)."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns])


def normalize_bounded(c: str, kind: str) -> Column:
    """rsi: 0-100 to 0-1; pct_b: clipped to [-0.5, 1.5] and scaled to 0-1."""
    return F.col(c) / 100.0 if kind == "rsi" else (clip(c, -0.5, 1.5) + 0.5) / 2.0


def normalize_log(c: str, clip_at: float = 5.0) -> Column:
    """Log value against the log of the fitted mean, scaled by the relative deviation."""
    x = F.ln(F.when(F.col(c) > 0, F.col(c)).otherwise(1e-6))
    mean = F.greatest(f"{c}_mean", F.lit(1e-6))
    return clip((x - F.ln(mean)) / F.greatest(F.col(f"{c}_std") / mean, F.lit(1e-6)), -clip_at, clip_at)


def normalize_zscore(c: str, clip_at: float = 5.0) -> Column:
    return clip((F.col(c) - F.col(f"{c}_mean")) / F.greatest(f"{c}_std", F.lit(1e-6)), -clip_at, clip_at)


def apply_stats(df: DataFrame, stats: DataFrame, keys=()) -> DataFrame:
    return df.join(stats, list(keys)) if keys else df.crossJoin(F.broadcast(stats))  # one row


def range_record_features(records: DataFrame, daily: DataFrame, keys=("symbol",), day: str = "day") -> DataFrame:
    """Predicted ranges against the previous close, with lags by record order."""
    w = by(keys, day)
    prev = daily.select(*keys, day, F.lag("close").over(w).alias("prev_close"))
    df = records.join(prev, [*keys, day]).dropna(subset=["prev_close"])
    pc = F.col("prev_close")
    df = df.withColumns({"width": F.col("range_high") - F.col("range_low"), "high_pct": (F.col("range_high") - pc) / pc, "low_pct": (pc - F.col("range_low")) / pc})
    df = df.withColumn("width_pct", F.col("width") / pc)
    lags = {f"width_pct_lag{k}": F.lag("width_pct", k).over(w) for k in range(1, 6)}
    lags |= {f"{c}_lag{k}": F.lag(c, k).over(w) for c in ("high_pct", "low_pct") for k in range(1, 4)}
    return df.withColumns(lags)


def width_formula(df: DataFrame, x: str, y: str, n_folds: int = 5, min_train: int = 100, keys=("symbol",), day: str = "day") -> DataFrame:
    """Walk-forward one-feature least squares: each test day predicted by the line through
    its fold's training days. All folds are one aggregate over (key, fold)."""
    folds = sl.walk_forward_folds(df.select(*keys, day), n_folds, min_train, keys, day)
    j = df.select(*keys, day, x, y).join(folds, [*keys, day])
    train = j.filter(F.col("role") == "train").groupBy(*keys, "fold").agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))
    return j.filter(F.col("role") == "test").join(train, [*keys, "fold"]).withColumn("pred", F.greatest(F.col("intercept") + F.col("slope") * F.col(x), F.lit(0.0)))


def formula_quality(pred: DataFrame, y: str, keys=("symbol",)) -> DataFrame:
    """Out-of-sample R2 against the test mean, and mean absolute error."""
    err = F.col(y) - F.col("pred")
    return pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), (1 - safe_div(F.sum(err * err), F.var_pop(y) * F.count(F.lit(1)))).alias("r2"))


def width_formula_multi(df: DataFrame, features, y: str, n_folds: int = 5, min_train: int = 100, keys=("symbol",), day: str = "day") -> DataFrame:
    """Walk-forward least squares on several features. Spark sums the cross products per
    (key, fold); only those small symmetric systems are solved, in Arrow batches."""
    folds = sl.walk_forward_folds(df.select(*keys, day), n_folds, min_train, keys, day)
    cols = ["_one", *features]
    j = df.select(*keys, day, *features, y).dropna().join(folds, [*keys, day]).withColumn("_one", F.lit(1.0))
    k = len(cols)
    xx = F.array(*[F.sum(F.col(a) * F.col(b)) for a in cols for b in cols])
    xy = F.array(*[F.sum(F.col(a) * F.col(y)) for a in cols])
    sums = j.filter(F.col("role") == "train").groupBy(*keys, "fold").agg(xx.alias("xx"), xy.alias("xy"))

    @F.pandas_udf("array<double>")
    def solve(a, b):
        import numpy as np
        import pandas as pd
        return pd.Series([np.linalg.lstsq(np.reshape(m, (k, k)), np.asarray(v), rcond=None)[0].tolist() for m, v in zip(a, b)])

    beta = sums.select(*keys, "fold", solve("xx", "xy").alias("beta"))
    fit = sum((F.col("beta")[i] * F.col(c) for i, c in enumerate(cols)), F.lit(0.0))
    return j.filter(F.col("role") == "test").join(beta, [*keys, "fold"]).withColumn("pred", F.greatest(fit, F.lit(0.0))).drop("_one", "beta")


def fold_models(df: DataFrame, features, label: str, n_folds: int = 3, min_train: int = 500, keys=("symbol",), day: str = "day", trees: int = 20, depth: int = 4) -> DataFrame:
    """Walk-forward random forests: class and probabilities of every test row. Each fit is a
    distributed MLlib job over all series (``folds.fold_fit``)."""
    cut = sl.walk_forward_folds(df.select(*keys, day), n_folds, min_train, keys, day)
    data = df.select(*keys, day, *features, F.col(label).cast("double").alias("_y"))
    vector = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip")

    def fit(train):
        model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=42).fit(vector.transform(train))
        return lambda test: model.transform(vector.transform(test)).select(
            *keys, day, "fold", F.col("_y").cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability").alias("probability"))

    return folds.fold_fit(data, cut, n_folds, fit, keys, day)


def day_clusters(df: DataFrame, features, k: int = 4, seed: int = 42) -> DataFrame:
    """Gaussian-mixture clusters of standardised features."""
    v = VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip").transform(df)
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(v).transform(v)
    model = GaussianMixture(featuresCol="_x", k=k, seed=seed, predictionCol="cluster").fit(scaled)
    return model.transform(scaled).drop("_raw", "_x", "probability")


def wilder_rsi_adx(daily: DataFrame, period: int = 14, keys=("symbol",), day: str = "day", block_rows: int = scans.BLOCK) -> DataFrame:
    """Wilder's RSI and ADX. Both smoothings are y = a y + b, where a is 1 while the first
    ``period`` values are summed and (period - 1) / period from then on, so they run as scans over
    blocks (``scans.affine``). RSI is 50 and ADX 0 until enough rows; missing prices add nothing."""
    decay = (period - 1) / period
    smooth = lambda since: F.when(F.col("_at") < since, 1.0).otherwise(decay)

    def moves(w):
        up, down = diff("high", w), -diff("low", w)
        change, before = diff("close", w), F.lag("close").over(w)
        ranges = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
        return [{
            "_at": F.col("_pos"), "_u": F.greatest(change, F.lit(0.0)) / period, "_d": F.greatest(-change, F.lit(0.0)) / period,
            "_r": F.when(F.col("_pos") > 0, ranges), "_p": F.when((up > down) & (up > 0), up), "_n": F.when((down > up) & (down > 0), down),
        }]

    src = daily.select(*keys, day, *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")], F.year(day).alias("_year"))
    df = over_blocks(src, keys, "_year", day, 1, moves).drop("_year").withColumn("_a", smooth(period + 1))
    df = scans.affine(df, keys, "_at", "_a", {"_g": "_u", "_s": "_d", "_tr": "_r", "_pm": "_p", "_nm": "_n"}, block_rows)
    plus, minus = (F.coalesce(F.when(F.col("_tr") > 0, F.col(c) / F.col("_tr")), F.lit(0.0)) for c in ("_pm", "_nm"))
    dx = F.coalesce(100.0 * safe_div(F.abs(plus - minus), plus + minus), F.lit(0.0))
    ready = F.col("_at") >= period
    df = df.select(*keys, day, "high", "low", "close", "_at", F.when(ready, 100.0 * safe_div(F.col("_g"), F.col("_g") + F.col("_s"))).alias("_rsi"),
                   F.when(ready, dx / period).alias("_dx"), smooth(2 * period).alias("_a"))
    df = scans.affine(df, keys, "_at", "_a", {"_adx": "_dx"}, block_rows)
    return df.select(*keys, day, "high", "low", "close", F.coalesce("_rsi", F.lit(50.0)).alias("rsi"),
                     F.when(F.col("_at") >= 2 * period - 1, F.col("_adx")).otherwise(0.0).alias("adx"))
