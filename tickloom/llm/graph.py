"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are a grouped minimum (partial sums per map task, so a node with a third of all edges
is no hot spot) and a join back, which adaptive execution splits when it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.llm.staging import staged


def _large_star(e: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node around it."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of an edge: the smallest node reachable.

    Edges have any direction and may repeat; nulls and self links are dropped. The steps stop
    when the edge table no longer changes: all edges then lead from a node to its component.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = staged(e, "edges")
    before = None
    while True:
        e = staged(_small_star(_large_star(e)).where("u > v").distinct(), "edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(known: DataFrame, more: DataFrame) -> DataFrame:
    """Components after some more links (a, b): only the components that the links touch are worked on."""
    if not more.take(1):
        return known
    name = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    links = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = staged(components(links, "a", "b"), "moved")
    old = known.join(moved.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left").select("node", F.coalesce("c", "component").alias("component"))
    return staged(old.unionByName(moved).groupBy("node").agg(F.min("component").alias("component")), "components")
