"""Mixing sources to target weights by entropy balancing.

Every word of the corpus starts with the same weight. The mix is the least relative entropy away from it among
those that give each source its target of words; its convex dual has one variable per source and is solved by
distributed Newton steps over the table of (source, size) cells. The solution tilts each document's rate by
exp(dual of its source), clipped at ``MOST`` copies. Rates become whole copies by carrying the rounding error
from large to small documents inside chunks of bounded size, so a source ends within a few words a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.llm.staging import staged

WEIGHTS = (5, 2, 1)
MOST = 3
CHUNK = 20_000
TOLERANCE, STEPS = 1e-9, 60


def with_size(docs: DataFrame, name: str = "size") -> DataFrame:
    """All columns and the number of words of ``text``; null has none. A column of that name is replaced."""
    return docs.withColumn(name, F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def targets(sources: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source. Sources in code point
    order, null last, have the weights in turn. Raising one level of words per unit of weight until the targets,
    each stopped at ``most`` times its source, use up the total is the same as resharing the excess."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(rank, F.lit(len(weights))) + 1)).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    s = staged(s, "sources")
    level = 0.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        r = s.agg(F.sum("source_size").alias("t"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("c"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        now = (r.t - r.c) / r.w if r.t and r.w else level
        if not now > level:
            break
        level = now
    return s.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def rates(cells: DataFrame, goal: DataFrame, most: float = MOST) -> DataFrame:
    """``(source, source_size, target, rate)``: Newton steps on the dual  sum(n * size * exp(x)) - x * target  of each
    source, with the rate clipped at ``most``. Every step is one aggregation over the cells; the steps end when
    all sources are within TOLERANCE of their targets. A source without words or target has rate 0. Rates are rounded
    to nine places, so the order in which sums are added up does not show."""
    x = goal.withColumn("dual", F.lit(0.0))
    same = lambda a, b: a.eqNullSafe(b)
    for _ in range(STEPS):
        d = x.withColumnRenamed("source", "s")
        tilt = F.exp("dual")
        value = F.col("n") * F.col("size") * F.least(tilt, F.lit(float(most)))
        slope = F.when(tilt < most, F.col("n") * F.col("size") * tilt).otherwise(0.0)
        step = cells.join(d, same(F.col("source"), F.col("s"))).groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("dual").alias("dual"), F.sum(value).alias("mass"), F.sum(slope).alias("slope"))
        gap = F.col("mass") - F.col("target")
        # A clipped source has no slope left; it is brought back to the clip.
        move = F.when(F.col("slope") > 0, gap / F.col("slope")).when(gap > 0, F.col("dual") - F.log(F.lit(float(most)))).otherwise(0.0)
        move = F.when(F.col("target") > 0, F.greatest(F.least(move, F.lit(2.0)), F.lit(-2.0))).otherwise(0.0)
        x = staged(step.withColumn("off", F.when(F.col("target") > 0, F.abs(gap) / F.col("target")).otherwise(0.0)).withColumn("next", F.col("dual") - move), "dual")
        worst = x.agg(F.max("off").alias("w")).first().w
        x = x.select("source", "source_size", "target", F.col("next").alias("dual"))
        if worst is None or worst <= TOLERANCE:
            break
    return x.select("source", "source_size", "target", F.when(F.col("target") > 0, F.round(F.least(F.exp("dual"), F.lit(float(most))), 9)).otherwise(0.0).alias("rate"))


def _copies(t: pa.Table) -> pa.Table:
    """Whole copies of one chunk: large documents first, each taking on the words its predecessors are off by."""
    most = MOST
    size, n, rate = (t.column(c).to_numpy() for c in ("size", "n", "rate"))
    # Ties by id, nulls last; a chunk has one source, and its rows differ in (id, size).
    ids = t.column("doc_id")
    o = np.lexsort((-size, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), -size * n))
    out, carry = np.zeros(len(size), np.int64), 0.0
    for i in o:
        unit = int(size[i] * n[i])
        if unit:
            want = rate[i] * unit + carry
            c = min(max(int(want / unit + 0.5), 0), most)
            out[i], carry = c, want - c * unit
    return t.append_column("copies", pa.array(out))


def mix(sized: DataFrame, weights=WEIGHTS) -> DataFrame:
    """``(doc_id, source, size, n, source_size, target, rate, copies)``, one row per distinct (doc_id, source, size);
    ``n`` counts the rows that repeat it, which share its copies. ``sized`` needs ``doc_id`` (an integer), ``source``
    and ``size``. Documents without words are taken 0 times. The result depends on the rows alone, not on how they
    are partitioned; rows without ``doc_id`` are told apart by source and size only."""
    units = staged(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "units")
    cells = staged(units.groupBy("source", "size").agg(F.sum("n").alias("n")), "cells")
    per_source = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    solved = staged(rates(cells, targets(per_source, weights)), "rates")
    chunks = units.groupBy("source").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    about = solved.withColumnRenamed("source", "s").join(chunks.withColumnRenamed("source", "s2"), same("s", "s2")).drop("s2")
    rows = units.join(about, same("source", "s")).drop("s").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.col("chunks")).cast("int")).drop("chunks")
    schema = rows.withColumn("copies", F.lit(0).cast("long")).schema
    return rows.groupBy("source", "chunk").applyInArrow(_copies, schema).drop("chunk")
