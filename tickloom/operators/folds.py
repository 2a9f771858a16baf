"""Walk-forward callbacks: a function of (training rows, test rows) for every fold.

Folds are rows (keys, day, fold, role) as ``selection.walk_forward_folds`` gives them. A
callback sees the rows before its fold as training rows and nothing later than its test rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.scratch import stage_dir
from tickloom.operators.blocks import join_keys


def fold_rows(df: DataFrame, folds: DataFrame, keys=("symbol",), day: str = "day") -> DataFrame:
    """Rows with fold and role, a training row once per fold that it trains."""
    return join_keys(df, folds.select(*keys, day, "fold", "role"), [*keys, day])


def fold_apply(df: DataFrame, folds: DataFrame, fn: Callable, schema: str, keys=("symbol",), day: str = "day", max_rows: int = 1_000_000) -> DataFrame:
    """``fn(training rows, test rows)`` of every series and fold, both pandas frames in order of
    ``day``; it returns rows of ``schema``.

    For models without a distributed fit. A series and fold is one task, so a fold of more than
    ``max_rows`` rows ends the job with an error before any is sent to Python; use ``fold_fit``
    there. Folds without test rows give nothing; one without training rows gets an empty frame.
    """
    keys = list(keys)
    rows = fold_rows(df, folds, keys, day)
    sizes = rows.groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("_n"))
    refuse = F.raise_error(F.concat(F.lit(f"a fold has more than {max_rows} rows: "), F.col("_n").cast("string"))).cast("boolean")
    sizes = sizes.filter(F.when(F.col("_n") > max_rows, refuse).otherwise(True)).drop("_n")
    rows = join_keys(rows, sizes, [*keys, "fold"])
    # aliases make the two sides different columns, as cogroup wants them
    part = lambda role: rows.filter(F.col("role") == role).select(*[F.col(c).alias(c) for c in rows.columns if c != "role"]).groupBy(*keys, "fold")

    def run(train, test):
        import pandas as pd
        if test.empty:
            return pd.DataFrame({n: pd.Series(dtype=object) for n in names})
        return fn(train.sort_values(day, ignore_index=True), test.sort_values(day, ignore_index=True))

    names = [f.split()[0] for f in schema.split(",")]
    return part("train").cogroup(part("test")).applyInPandas(run, schema)


def fold_fit(df: DataFrame, folds: DataFrame, n_folds: int, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], keys=("symbol",), day: str = "day") -> DataFrame:
    """``fit(training rows)`` of every fold over all series together; what it returns is applied to
    the fold's test rows. For estimators that Spark fits itself, of any size.

    Fits run at once, fold by fold. The rows are written once, by fold and role, and every fold
    reads its own folders only. Folds that lack training or test rows give nothing.
    """
    spark, path = df.sparkSession, stage_dir(df.sparkSession, "folds")
    rows = fold_rows(df, folds, keys, day)
    rows.write.partitionBy("fold", "role").parquet(path)
    # the column types of the folders are stated, not guessed from their names
    rows = spark.read.schema(rows.schema).parquet(path)
    have = {(r["fold"], r["role"]) for r in rows.select("fold", "role").distinct().collect()}
    out = None
    for f in range(n_folds):
        if not {(f, "train"), (f, "test")} <= have:
            continue
        part = lambda role: rows.filter((F.col("fold") == f) & (F.col("role") == role)).drop("role")
        done = fit(part("train"))(part("test"))
        out = done if out is None else out.unionByName(done)
    if out is None:
        raise ValueError("no fold has training and test rows")
    return out
