"""Exact k-means over whole-number vectors by Shallot search.

Every vector remembers its nearest and second-nearest centroid and bounds on both distances. When centroids have
moved, the bounds are widened by how far; while the upper one stays below the lower one, nothing is looked at. For
the others both remembered centroids are measured first and the scan starts from the closer one, over its
neighbours in order of their distance from it. A centroid farther from it than  (distance to the closer one) +
(distance to the second-best so far)  cannot be among the two nearest, nor can those behind it; as better seconds
turn up that ball shrinks. Distances that decide are compared as whole numbers; bounds only spare work.

Centroids are few and broadcast in the closures. Sums of clusters are added up per batch before they are shuffled.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.staging import staged
from tickloom.llm.vectors import finite, matrix, whole

SCALE, WIDTH, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Bounds are widened by this share (and amount), far more than the rounding of square roots can be off.
SLACK = 1e-9
_STATE = "near int, second int, upper double, lower double"


@dataclass(frozen=True)
class Centroids:
    at: np.ndarray  # (k, width) whole numbers
    moved: np.ndarray  # how far each went in the last update

    @property
    def between(self) -> np.ndarray:
        d = self.at[:, None, :] - self.at[None, :, :]
        return np.sqrt((d * d).sum(2).astype(float))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def first_search(x: np.ndarray, c: Centroids):
    """Nearest and second-nearest of all centroids: (near, second, upper, lower)."""
    n, k = len(x), len(c.at)
    d = np.empty((n, k), np.int64)
    for j in range(k):
        d[:, j] = squared(x, c.at[j])
    near = d.argmin(1)
    at = np.arange(n)
    best = d[at, near]
    d[at, near] = np.iinfo(np.int64).max
    second = d.argmin(1) if k > 1 else near
    return near, second, np.sqrt(best.astype(float)), np.sqrt(d[at, second].astype(float)) if k > 1 else np.full(n, np.inf)


def search(x: np.ndarray, c: Centroids, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """The same after the centroids have moved; also the number of exact distances that were needed."""
    k = len(c.at)
    if k < 2:
        return near, second, upper, lower, 0
    near, second, upper, lower = near.copy(), second.copy(), upper.copy(), lower.copy()
    between = c.between
    # Another centroid can have come closer by as much as the fastest of the others went.
    fastest = np.sort(c.moved)[::-1]
    others = np.where(c.moved == fastest[0], fastest[0] if (c.moved == fastest[0]).sum() > 1 else fastest[1], fastest[0])
    upper = upper + c.moved[near]
    lower = np.maximum(lower - others[near], 0)
    half = np.where(np.eye(k, dtype=bool), np.inf, between).min(1) / 2
    safe = lambda u, i: u * (1 + SLACK) + SLACK < np.maximum(lower[i], half[near[i]])
    left = np.flatnonzero(~safe(upper, slice(None)))
    counted = len(left)
    best = squared(x[left], c.at[near[left]])
    upper[left] = np.sqrt(best.astype(float))
    open_ = ~safe(upper[left], left)
    left, best = left[open_], best[open_]
    if not len(left):
        return near, second, upper, lower, counted
    counted += len(left)
    a, b = near[left], second[left]
    next_ = squared(x[left], c.at[b])
    swap = (next_ < best) | ((next_ == best) & (b < a))
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    best, next_ = np.where(swap, next_, best), np.where(swap, best, next_)
    start, from_start = a.copy(), np.sqrt(best.astype(float))
    asked = b.copy()
    order = np.argsort(between, 1, kind="stable")
    scan = np.arange(len(left))
    for rank in range(k):
        j = order[start[scan], rank]
        # Neighbours come in order of distance: outside the ball the scan of this vector is over.
        ball = from_start[scan] + np.sqrt(next_[scan].astype(float))
        inside = between[start[scan], j] <= ball * (1 + SLACK) + SLACK
        scan, j = scan[inside], j[inside]
        new = (j != start[scan]) & (j != asked[scan])
        i, j = scan[new], j[new]
        if not len(i):
            continue
        counted += len(i)
        d = squared(x[left[i]], c.at[j])
        first = (d < best[i]) | ((d == best[i]) & (j < a[i]))
        later = ~first & ((d < next_[i]) | ((d == next_[i]) & (j < b[i])))
        p = i[first]
        b[p], next_[p] = a[p], best[p]
        a[p], best[p] = j[first], d[first]
        p = i[later]
        b[p], next_[p] = j[later], d[later]
    near[left], second[left] = a, b
    upper[left], lower[left] = np.sqrt(best.astype(float)), np.sqrt(next_.astype(float))
    return near, second, upper, lower, counted


def _assign(c: Centroids, width: int, first: bool):
    def run(batches):
        for b in batches:
            x = matrix(b.column("v"), width)
            state = first_search(x, c) if first else search(x, c, *(b.column(s).to_numpy() for s in ("near", "second", "upper", "lower")))[:4]
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), *(pa.array(s, t) for s, t in zip(state, kinds))], names=["vec_id", "v", "near", "second", "upper", "lower"])

    return run


def _sums(width: int):
    """Sum and number of a batch's vectors per cluster."""
    def run(batches):
        for b in batches:
            x, near = matrix(b.column("v"), width), b.column("near").to_numpy()
            found = np.unique(near)
            total = np.stack([x[near == j].sum(0) for j in found]) if len(found) else np.zeros((0, width), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(found, width), pa.int32()), pa.array(np.tile(np.arange(width), len(found)), pa.int32()), pa.array(total.ravel()), pa.array(np.repeat([(near == j).sum() for j in found], width), pa.int64())], names=["cluster", "place", "total", "n"])

    return run


def moved(assigned: DataFrame, c: Centroids, width: int) -> Centroids:
    """Every non-empty centroid becomes floor(sum / count) of its vectors; clusters x width rows reach the driver."""
    at = c.at.copy()
    parts = assigned.select("v", "near").mapInArrow(_sums(width), "cluster int, place int, total long, n long")
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        at[r.cluster, r.place] = r.total // r.n
    return Centroids(at, np.sqrt(squared(at, c.at).astype(float)))


def first_centroids(kept: DataFrame, k: int, width: int) -> Centroids:
    """The vectors with the k smallest sha256 of ``1:<vec_id>``, ties by components, rows without id last."""
    rows = kept.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).select("v").collect()
    at = np.array([r.v for r in rows], np.int64).reshape(-1, width)
    return Centroids(at, np.zeros(len(at)))


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, v, cluster, distance)`` of every kept vector, and the final centroids.

    Kept are vectors of exactly ``width`` finite components, each turned into floor(scale * component) (clamped at 2^27);
    rows without id are kept, repeated rows each. Every round assigns each vector to its nearest centroid (squared
    distance, ties to the smaller number) and moves the centroids; then vectors are assigned once more. With fewer than
    ``k`` vectors there are fewer centroids; an empty table has no rows. A cluster's sum must fit in 64 bits."""
    kept = vectors.where(finite() & (F.size("embedding") == width)).select(F.col("vec_id").cast("long").alias("vec_id"), whole(scale).alias("v"))
    now = staged(kept, "kept-vectors")
    c = first_centroids(now, k, width)
    if not len(c.at):
        return now.withColumn("cluster", F.lit(0)).withColumn("distance", F.lit(0).cast("long")), c.at
    schema = "vec_id long, v array<int>, " + _STATE
    for r in range(rounds + 1):
        now = staged(now.mapInArrow(_assign(c, width, r == 0), schema), f"assigned-{r}")
        c = moved(now, c, width) if r < rounds else c

    def measure(batches):
        for b in batches:
            near = b.column("near").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("near"), pa.array(squared(matrix(b.column("v"), width), c.at[near]))], names=["vec_id", "v", "cluster", "distance"])

    return now.select("vec_id", "v", "near").mapInArrow(measure, "vec_id long, v array<int>, cluster int, distance long"), c.at


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``: one row a cluster is broadcast."""
    found = staged(found.select("vec_id", "cluster", "distance"), "clusters")
    per = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(j, per.get(j, 0), digest(row)) for j, row in enumerate(centroids)]
    about = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(per.values())).cast("long").alias("inertia"), "centroid_sha256")
