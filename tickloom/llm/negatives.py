"""Hard negatives by exact inner products of Kronecker-packed integers.

Components are made non-negative by a bias and several candidates' components are put into separated fields of
one wide integer, one integer a dimension. Multiplying an anchor's (biased) component with it once multiplies all
fields; summed over the dimensions every field holds one candidate's product, as no field can reach into the
next: fields are as wide as the largest possible sum. Taking the bias off again gives exact scores. The integers
have 64 bits; where a single sum needs more they are Python's, which have any width.

Anchors are a stated query set. Blocks of anchors meet blocks of candidates one after the other in a task that
keeps running bests only: first the positives, then, as their scores set the limits, the negatives.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.staging import staged
from tickloom.llm.vectors import finite, matrix, whole

SCALE, EVERY = 256, 50
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LEAST, MOST = 50, 95
CANDIDATES = 4096
#: Anchors are dealt to about so many blocks, of ANCHORS[0] to ANCHORS[1] each; every block reads all candidates.
TASKS, ANCHORS = 64, (128, 1024)
_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Fields:
    """How components are laid out: the bias that makes them non-negative, a field's bits, the fields of a word."""

    bias: int
    bits: int
    count: int
    wide: bool

    @classmethod
    def of(cls, low: int, high: int, width: int) -> Fields:
        bits = max(1, ((high - low) ** 2 * max(width, 1)).bit_length())
        return cls(-low, bits, 64 // bits if bits < 64 else 16, bits >= 64)

    @property
    def kind(self):
        return object if self.wide else np.uint64

    def shift(self, field: int):
        return self.bits * field if self.wide else np.uint64(self.bits * field)

    def pack(self, x: np.ndarray) -> np.ndarray:
        """(candidates, width) components to (words, width): candidate i is field i % count of word i // count."""
        n = -(-len(x) // self.count)
        u = np.zeros((n * self.count, x.shape[1]), self.kind)
        u[: len(x)] = (x + self.bias).astype(self.kind)
        u = u.reshape(n, self.count, x.shape[1])
        out = np.zeros((n, x.shape[1]), self.kind)
        for j in range(self.count):
            out |= u[:, j] << self.shift(j)
        return out

    def products(self, anchors: np.ndarray, words: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """(anchors, candidates) inner products; ``sums`` are the candidates' sums of components."""
        a = anchors + self.bias
        both = a.astype(object) @ words.T if self.wide else np.einsum("ad,wd->aw", a.astype(np.uint64), words)
        out = np.empty((len(a), both.shape[1], self.count), object if self.wide else np.int64)
        mask = (1 << self.bits) - 1
        for j in range(self.count):
            out[:, :, j] = (both >> self.shift(j)) & (mask if self.wide else np.uint64(mask))
        out = out.reshape(len(a), -1)[:, : len(sums)]
        # (a + b)(c + b) = ac + b * c + b * (a + b) over all dimensions
        if not self.wide:
            return out - self.bias * sums[None, :] - self.bias * a.sum(1)[:, None]
        exact = out - self.bias * sums.astype(object)[None, :] - self.bias * a.sum(1).astype(object)[:, None]
        return np.clip(exact, _NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


class Best:
    """The k best (score, id) per row, by score descending, then id ascending."""

    def __init__(self, rows: int, k: int):
        self.score, self.id = np.full((rows, k), _NONE), np.full((rows, k), np.iinfo(np.int64).max)

    def take(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray):
        """Ids ascend. Only rows with an allowed score above their worst so far are looked at (an equal one with a
        smaller id counts)."""
        k = self.score.shape[1]
        s = np.where(allowed, scores, _NONE)
        rows = np.flatnonzero((s.max(1, initial=_NONE) >= self.score[:, -1]) & allowed.any(1))
        if not len(rows):
            return
        s = s[rows]
        # The block's own k best: all above its k-th best value, and of that value the smallest ids.
        m = min(k, s.shape[1])
        edge = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
        above, equal = s > edge[:, None], s == edge[:, None]
        equal &= np.cumsum(equal, 1) <= (m - above.sum(1))[:, None]
        r, c = np.nonzero(above | equal)
        at = c.reshape(len(rows), m)
        scores = np.concatenate([self.score[rows], np.take_along_axis(s, at, 1)], 1)
        ids = np.concatenate([self.id[rows], np.where(np.take_along_axis(s, at, 1) > _NONE, ids[at], np.iinfo(np.int64).max)], 1)
        o = np.lexsort((ids, ~scores), axis=1)[:, :k]  # ~s falls as s rises, without overflow
        self.score[rows], self.id[rows] = np.take_along_axis(scores, o, 1), np.take_along_axis(ids, o, 1)


def _blocks(rows: DataFrame, count: int, make, name: str) -> DataFrame:
    """``(block, blob)``: rows dealt to ``count`` blocks by hash, each packed by ``make(ids, labels, table)``."""
    def pack(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("vec_id").to_numpy(), kind="stable")))
        return pa.table({"block": t.column("block").slice(0, 1), "blob": pa.array([pickle.dumps(make(t))], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("long"))
    return staged(dealt.groupBy("block").applyInArrow(pack, "block long, blob binary"), name)


def _met(anchors: DataFrame, candidates: DataFrame, blocks: int) -> DataFrame:
    """Every anchor block followed by all candidate blocks, in one task: the anchors come first."""
    first = anchors.select("block", F.lit(-1).cast("long").alias("of"), "blob")
    then = candidates.select(F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"), F.col("block").alias("of"), "blob")
    return first.unionByName(then).repartition(F.col("block")).sortWithinPartitions("block", "of")


def _runs(batches):
    """(anchors, candidate blocks one by one) per anchor block of a partition; candidates without anchors are skipped."""
    now = None
    for b in batches:
        for block, of, blob in zip(b.column("block").to_pylist(), b.column("of").to_pylist(), b.column("blob")):
            if of < 0:
                if now is not None:
                    yield now, None
                now = pickle.loads(blob.as_buffer())
            elif now is not None:
                yield now, pickle.loads(blob.as_buffer())
    if now is not None:
        yield now, None


def hard_negatives(vectors: DataFrame, every: int = EVERY, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, per_block: int = CANDIDATES) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from ``vec_id, embedding, label``.

    Anchors have an id divisible by ``every``. Their positives are the best ``positives`` other rows of their label; for
    each positive, its negatives are the best ``negatives`` rows of other labels with  least * positive_score <= 100 *
    negative_score <= most * positive_score.  Best: higher score, then smaller id.

    Rows without id, label or vector, or with a null or non-finite component, take no part; empty vectors do, with
    score 0. Shorter vectors count as padded with zeros. Rows that repeat an id are candidates each, except for the
    anchor of that id, which is asked once (with its largest vector, then label). Components are whole numbers,
    clamped at 2^27; scores are exact, and clamped to 64 bits. An empty table gives no rows."""
    known = finite() & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = staged(vectors.where(known).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole(scale).alias("v")), "labelled")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max(F.struct("v", "label")).alias("x")).select("vec_id", "x.label", "x.v")
    asked = staged(asked, "anchors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.min(F.coalesce(F.array_min("v"), F.lit(0))).alias("low"), F.max(F.coalesce(F.array_max("v"), F.lit(0))).alias("high")).first()
    n, width = asked.count(), max(size.width or 0, 1)
    fields = Fields.of(min(size.low or 0, 0), max(size.high or 0, 0), width)
    blocks = max(1, -(-n // min(max(n // TASKS, ANCHORS[0]), ANCHORS[1])))

    def columns(t: pa.Table):
        return t.column("vec_id").to_numpy(), t.column("label").to_numpy(), matrix(t.column("v"), width)

    def candidate(t: pa.Table):
        ids, labels, x = columns(t)
        return ids, labels, fields.pack(x), x.sum(1)

    candidates = _blocks(rows, max(1, -(-size.n // per_block)), candidate, "candidates")

    def find_positives(batches):
        """The anchors of a block with their positives, as the blob of the second pass."""
        best = None
        for (block, ids, labels, x), found in _runs(batches):
            best = best or Best(len(ids), positives)
            if found is not None:
                c_ids, c_labels, words, sums = found
                best.take(fields.products(x, words, sums), (labels[:, None] == c_labels[None, :]) & (ids[:, None] != c_ids[None, :]), c_ids)
                continue
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pickle.dumps((block, ids, labels, x, best.score, best.id))], pa.binary())], names=["block", "blob"])
            best = None

    def find_negatives(batches):
        best = None
        for (_, ids, labels, x, p_score, p_ids), found in _runs(batches):
            k = p_score.shape[1]
            best = best or [Best(len(ids), negatives) for _ in range(k)]
            if found is not None:
                c_ids, c_labels, words, sums = found
                s = fields.products(x, words, sums)
                other = labels[:, None] != c_labels[None, :]
                for j in range(k):
                    p = p_score[:, j].astype(object)
                    # Whole limits of the negative's score; an absent positive allows none.
                    low, high = (np.where(p_score[:, j] > _NONE, v, w).astype(np.int64) for v, w in ((-(-least * p // 100), 1), (most * p // 100, 0)))
                    best[j].take(s, other & (s >= low[:, None]) & (s <= high[:, None]), c_ids)
                continue
            out = [(ids[r], p_ids[r, j], i + 1, best[j].id[r, i], p_score[r, j], best[j].score[r, i]) for j in range(k) for r, i in zip(*np.nonzero(best[j].score > _NONE))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])
            best = None

    def anchor(t: pa.Table):
        return (t.column("block")[0].as_py(), *columns(t))

    anchors = _blocks(asked, blocks, anchor, "anchor-blocks")
    with_positives = staged(_met(anchors, candidates, blocks).mapInArrow(find_positives, "block long, blob binary"), "positives")
    return _met(with_positives, candidates, blocks).mapInArrow(find_negatives, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
