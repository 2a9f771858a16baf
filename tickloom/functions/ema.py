"""Exponentially weighted means with adjusted weights, as a distributed scan.

ema_t = sum_i r^(t-i) x_i / sum_i r^(t-i) over the non-null x_i, r = 1 - 2 / (span + 1).
Positions are cut into short blocks. Inside a block both sums are a scaled running sum;
what earlier blocks add is a short weighted sum over their totals, cut where the weight
falls under 1e-16 of the row's own. That holds for rows with a value; a row without one
leaves the mean as it is, however long the gap, so the last one is carried on. Work per row
is constant, not proportional to the span.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tickloom.functions.windows import by, running, safe_div

BLOCK = 32


def with_ema(df: DataFrame, specs: dict, keys=("symbol",), order="day") -> DataFrame:
    """Add ``{out: (column, span, min_periods)}``; null until ``min_periods`` non-null inputs."""
    series = by(keys, order)
    df = df.withColumn("_rn", F.row_number().over(series) - 1)
    df = df.withColumns({"_b": F.floor(F.col("_rn") / BLOCK), "_p": F.col("_rn") % BLOCK})
    inside = by((*keys, "_b"), "_p").rowsBetween(Window.unboundedPreceding, 0)
    local, carry, mean, final, scratch = {}, {}, {}, {}, ["_rn", "_b", "_p"]
    for i, (out, (x, span, mp)) in enumerate(specs.items()):
        r = 1.0 - 2.0 / (span + 1.0)
        x = F.col(x) if isinstance(x, str) else x
        up, down = F.pow(F.lit(1.0 / r), F.col("_p")), F.pow(F.lit(r), F.col("_p"))
        local[f"_s{i}"] = down * F.sum(F.coalesce(x.cast("double"), F.lit(0.0)) * up).over(inside)
        local[f"_w{i}"] = down * F.sum(F.when(x.isNotNull(), up).otherwise(0.0)).over(inside)
        local[f"_n{i}"] = F.count(x).over(series.rowsBetween(Window.unboundedPreceding, 0))
        reach = math.ceil(math.log(1e-16) / math.log(r) / BLOCK) + 1
        back = by(keys, "_b").rangeBetween(-reach, -1)
        ends = F.collect_list(F.when(F.col("_p") == BLOCK - 1, F.struct("_b", F.col(f"_s{i}").alias("s"), F.col(f"_w{i}").alias("w"))))
        carry[f"_c{i}"] = ends.over(back)
        weigh = lambda f, i=i, r=r: F.aggregate(
            f"_c{i}", F.lit(0.0), lambda acc, e: acc + e[f] * F.pow(F.lit(r), (F.col("_b") - 1 - e["_b"]) * BLOCK + F.col("_p") + 1))
        mean[f"_m{i}"] = F.when(x.isNotNull(), safe_div(F.col(f"_s{i}") + weigh("s"), F.col(f"_w{i}") + weigh("w")))
        final[out] = F.when(F.col(f"_n{i}") >= max(mp, 1), F.last(f"_m{i}", ignorenulls=True).over(running(series)))
        scratch += [f"_s{i}", f"_w{i}", f"_n{i}", f"_c{i}", f"_m{i}"]
    return df.withColumns(local).withColumns(carry).withColumns(mean).withColumns(final).drop(*scratch)
