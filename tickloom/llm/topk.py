"""Exact top-k inner products by a dual-tree search over cover trees.

Vectors are packed into blocks of bounded size, a cover tree each: the children of a node with covering radius
r lie at least r / SHRINK apart and cover its points within their own radii; the node's own centre is its first
child. Queries are packed and indexed the same way. There a group of queries descends the data tree as a whole: a
pair of nodes is pruned when  <cq, cx> + |cq| rx + |cx| rq + rq rx  cannot reach the worst k-th score in the group.
Where few points lie close to each other, a node stays a leaf: one matrix product scores it at less cost than the
bounds of as many children.

Every query meets every data block once. Only queries are copied: data blocks travel once, into groups of about
GROUP_BYTES that a task holds with their trees, and each group is sent all queries. A block of queries takes its worst
scores along from tree to tree of a group, so a group answers with k rows a query.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.llm.staging import staged
from tickloom.llm.words import segments

SCALE, K, EVERY = 256, 5, 50
DATA_BLOCK, QUERY_BLOCK = 8192, 1024
#: Nodes of up to LEAF points are not split, nor nodes whose children would own fewer than FEWEST points on average.
SHRINK, LEAF, FEWEST = 1.5, 256, 32
#: Vectors that travel as one row; bytes of vectors that a task holds (4 a component); groups made as soon as there are blocks.
PACK, GROUP_BYTES, GROUPS = 1024, 96 << 20, 24
#: Products of a row are looked through in this many strides; rows whose products are made at a time.
STRIDES, ROWS = 64, 128


class CoverTree:
    """Points in tree order (``order``); node i owns [lo, hi), has a centre, a radius and children [first, last)."""

    def __init__(self, x: np.ndarray):
        x = np.asarray(x, float)
        self.order = np.arange(len(x))
        lo, hi, centre, radius, first, last = [], [], [], [], [], []

        def add(a, b, c, r):
            for column, v in zip((lo, hi, centre, radius, first, last), (a, b, c, r, 0, 0)):
                column.append(v)

        root = x.mean(0) if len(x) else np.zeros(x.shape[1])
        add(0, len(x), root, float(np.sqrt(((x - root) ** 2).sum(1).max())) if len(x) else 0.0)
        i = 0
        while i < len(lo):
            a, b, r = lo[i], hi[i], radius[i]
            if b - a > LEAF and r > 0:
                own = self.order[a:b]
                p = x[own]
                square = (p**2).sum(1)
                cover = r / SHRINK
                near, which, centres = np.full(len(p), np.inf), np.zeros(len(p), int), []
                at = int(((p - centre[i]) ** 2).sum(1).argmin())
                # Farthest-first: each new centre is more than ``cover`` from all before it.
                while len(centres) <= len(p) // FEWEST:
                    d = square - 2 * (p @ p[at]) + square[at]
                    closer = d < near
                    near[closer], which[closer] = d[closer], len(centres)
                    centres.append(at)
                    at = int(near.argmax())
                    if near[at] <= cover**2:
                        break
                if 1 < len(centres) <= len(p) // FEWEST:
                    o = np.argsort(which, kind="stable")
                    self.order[a:b] = own[o]
                    far = np.sqrt(((p - p[np.array(centres)[which]]) ** 2).sum(1))[o]
                    bounds = np.searchsorted(which[o], np.arange(len(centres) + 1))
                    first[i], last[i] = len(lo), len(lo) + len(centres)
                    for c, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])):
                        add(a + s, a + e, p[centres[c]], float(far[s:e].max(initial=0)))
            i += 1
        self.lo, self.hi, self.first, self.last = (np.array(v, np.int64) for v in (lo, hi, first, last))
        self.centre, self.radius = np.array(centre).reshape(-1, x.shape[1]), np.array(radius)
        self.norm = np.sqrt((self.centre**2).sum(1))


class Indexed:
    """Vectors and ids in the order of their tree, inside a leaf by id; rows of zeros follow. Products of vectors shorter
    than 2^12 stay below 2^24 at every step, where 4-byte floats are exact."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        o = np.argsort(ids, kind="stable")
        x, ids = x[o], ids[o]
        self.tree = CoverTree(x)
        self.ids = ids[self.tree.order]
        kind = np.float32 if (np.square(x, dtype=float).sum(1) < 2.0**24).all() else np.float64
        self.x = np.zeros((len(x) + STRIDES, x.shape[1]), kind)
        self.x[: len(x)] = x[self.tree.order]
        self.by_id = np.argsort(self.ids, kind="stable")
        self.sorted_ids = self.ids[self.by_id]


class Best:
    """The k best (score, id) of each query so far, by (score descending, id ascending)."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, rows: slice) -> float:
        return self.score[rows, -1].min()

    def take(self, a: int, s: np.ndarray, ids: np.ndarray):
        """``s``: scores of queries a, a + 1, ... against ``ids``, which ascend; columns beyond them are -inf, and there
        are STRIDES times as many columns as there are strides' columns."""
        m, k = len(s), self.k
        strides = s.reshape(m, STRIDES, -1)
        most = strides.max(1)
        least = self.score[a: a + m, -1].astype(s.dtype)
        if (most >= least[:, None]).sum() > 2 * k * m and most.shape[1] >= k:
            # The k-th largest of the strides' maxima: as many scores are at least that.
            least = np.maximum(least, np.partition(most, -k, axis=1)[:, -k])
        open_ = np.isneginf(least)
        r, j = np.nonzero(most > least[:, None])
        v = strides[r, :, j]
        h, i = np.nonzero(v > least[r][:, None])
        row, column = r[h], i * most.shape[1] + j[h]
        r, j = np.nonzero((most == least[:, None]) & ~open_[:, None])
        if len(r) <= 2 * k * m:
            h, i = np.nonzero(strides[r, :, j] == least[r][:, None])
            ties, column_ = r[h], i * most.shape[1] + j[h]
        else:  # of many ties the first ones, which have the smallest ids
            some = np.unique(r)
            h, column_ = np.nonzero(s[some] == least[some][:, None])
            early = np.arange(len(h)) - np.searchsorted(h, h) < k
            ties, column_ = some[h[early]], column_[early]
        row, column = np.append(row, ties), np.append(column, column_)
        if not len(row):
            return
        score, row, which = s[row, column].astype(float), row + a, ids[column]
        fits = (score > self.score[row, -1]) | (which < self.id[row, -1])
        score, row, which = score[fits], row[fits], which[fits]
        again = np.unique(row)
        row = np.append(row, np.repeat(again, k))
        score, which = np.append(score, self.score[again].ravel()), np.append(which, self.id[again].ravel())
        o = np.lexsort((which, -score, row))
        row, score, which = row[o], score[o], which[o]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        o = rank < k
        self.score[row[o], rank[o]], self.id[row[o], rank[o]] = score[o], which[o]


def bounds(qt: CoverTree, i: int, xt: CoverTree, nodes: np.ndarray) -> np.ndarray:
    b = xt.centre[nodes] @ qt.centre[i] + qt.norm[i] * xt.radius[nodes] + xt.norm[nodes] * qt.radius[i] + qt.radius[i] * xt.radius[nodes]
    return b + 1e-9 * (np.abs(b) + 1) + 1e-6


class Buffer:
    """Memory for one product after the other: fresh arrays of this size cost as much as filling them."""

    def __init__(self):
        self.bytes = np.zeros(0, np.uint8)

    def __call__(self, m: int, n: int, kind: np.dtype) -> np.ndarray:
        size = m * n * kind.itemsize
        if len(self.bytes) < size:
            self.bytes = np.empty(size, np.uint8)
        return self.bytes[:size].view(kind).reshape(m, n)


def search(q: Indexed, x: Indexed, best: Best, buffer: Buffer):
    """``best`` (in the order of ``q``'s tree) takes the vectors of ``x`` in; a query's own id is left out."""
    qt, xt, n = q.tree, x.tree, len(q.ids)
    at = np.searchsorted(x.sorted_ids, q.ids)
    count = np.searchsorted(x.sorted_ids, q.ids, side="right") - at
    own_row, own_column = np.repeat(np.arange(n), count), x.by_id[segments(at, count)]

    def take(a: int, b: int, leaves: np.ndarray):
        if len(leaves) == 1:
            lo, hi = int(xt.lo[leaves[0]]), int(xt.hi[leaves[0]])
            columns, mine = slice(lo, hi + -(hi - lo) % STRIDES), (own_column >= lo) & (own_column < hi)
            ids, place = x.ids[lo:hi], own_column[mine] - lo
        else:
            columns = segments(xt.lo[leaves], xt.hi[leaves] - xt.lo[leaves])
            columns = columns[np.argsort(x.ids[columns], kind="stable")]
            ids = x.ids[columns]
            places = np.full(len(x.ids), -1)
            places[columns] = np.arange(len(columns))
            mine = places[own_column] >= 0
            place = places[own_column[mine]]
            columns = np.append(columns, np.full(-len(columns) % STRIDES, len(x.ids)))
        right, row = x.x[columns].T, own_row[mine]
        for i in range(a, b, ROWS):
            left = q.x[i: min(i + ROWS, b)]
            s = np.matmul(left, right, out=buffer(len(left), right.shape[1], np.result_type(left, right)))
            s[:, len(ids):] = -np.inf
            here = (row >= i) & (row < i + len(left))
            s[row[here] - i, place[here]] = -np.inf
            best.take(i, s, ids)

    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        i, nodes = stack.pop()
        a, b = int(qt.lo[i]), int(qt.hi[i])
        if a == b:
            continue
        nodes = nodes[bounds(qt, i, xt, nodes) >= best.worst(slice(a, b))]
        inner = xt.first[nodes] < xt.last[nodes]
        if qt.first[i] < qt.last[i]:
            # Both sides split: the group's children against the surviving nodes' children.
            open_, closed = nodes[inner], nodes[~inner]
            below = np.concatenate([np.arange(xt.first[v], xt.last[v]) for v in open_] + [closed]).astype(np.int64)
            stack += [(c, below) for c in range(qt.last[i] - 1, qt.first[i] - 1, -1)]
            continue
        while len(nodes):
            # Best bounds first, a few nodes at a time; what is left is held against the scores found.
            bound = bounds(qt, i, xt, nodes)
            alive = bound >= best.worst(slice(a, b))
            nodes, bound = nodes[alive], bound[alive]
            o = np.argsort(-bound, kind="stable")
            now, nodes = nodes[o[:16]], nodes[o[16:]]
            inner = xt.first[now] < xt.last[now]
            leaves = now[~inner]
            if len(leaves):
                take(a, b, leaves)
            nodes = np.concatenate([nodes, *(np.arange(xt.first[v], xt.last[v]) for v in now[inner])]).astype(np.int64)


def _stacked(parts: list[tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of several packs, shorter ones padded with zeros, and their ids."""
    kind = np.result_type(*(v.dtype for v, _ in parts))
    x = np.zeros((sum(len(v) for v, _ in parts), width), kind)
    at = 0
    for v, _ in parts:
        x[at: at + len(v), : v.shape[1]] = v
        at += len(v)
    return x, np.concatenate([ids for _, ids in parts])


def _padded(x: Indexed, width: int) -> Indexed:
    if x.x.shape[1] < width:
        more = ((0, 0), (0, width - x.x.shape[1]))
        x.x, x.tree.centre = np.pad(x.x, more), np.pad(x.tree.centre, more)
    return x


def _packs(rows: DataFrame, per_pack: int, scale: int, name: str) -> DataFrame:
    """``(at, n, width, blob)``: floor(scale * component) of up to ``per_pack`` vectors of a batch each, in the smallest
    type that holds them; vectors with null or non-finite components are left out, as by ``integer_vectors``."""
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, per_pack):
                part = b.slice(i, per_pack)
                v, ids = part.column("v"), part.column("vec_id").to_numpy(zero_copy_only=False)
                n = np.diff(v.offsets.to_numpy()).astype(np.int64)
                flat = v.flatten().to_numpy(zero_copy_only=False).astype(float)
                row = np.repeat(np.arange(len(n)), n)
                bad = np.bincount(row[~np.isfinite(flat)], minlength=len(n)) > 0
                flat, n, ids = flat[~bad[row]], n[~bad], ids[~bad]
                flat = np.clip(np.floor(flat * scale), -(2.0**63), 2.0**63)
                x = np.zeros((len(n), max(1, n.max(initial=1))))
                x[np.repeat(np.arange(len(n)), n), segments(np.zeros(len(n), np.int64), n)] = flat
                most = np.abs(flat).max(initial=0)
                kind = next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), float)
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in ((len(n), pa.int64()), (x.shape[1], pa.int64()), (pickle.dumps((x.astype(kind), ids)), pa.binary()))], names=["n", "width", "blob"])

    return staged(rows.where("vec_id IS NOT NULL AND v IS NOT NULL").mapInArrow(run, "n long, width long, blob binary").withColumn("at", F.monotonically_increasing_id()), name)


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)``: floor(scale * component) of vectors without null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    whole = F.transform(x, lambda c: F.floor(c * scale))
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), whole.cast("array<double>").alias("v"))


def _answers(k: int, data_block: int, query_block: int):
    """Rows sorted by (group, kind), a group's data before its queries."""
    def run(batches):
        group, data, forest, asked, buffer = None, [], [], [], Buffer()

        def answer():
            held = sum(len(ids) for _, ids in asked)
            if not held:
                return
            if data:  # the group's data is complete
                x, ids = _stacked(data, max(v.shape[1] for v, _ in data))
                data.clear()
                o = np.argsort(ids, kind="stable")
                # Neighbours in id order are dealt to different blocks, so each block is like the whole.
                n = -(-len(ids) // data_block)
                forest.extend(Indexed(x[o[i::n]], ids[o[i::n]]) for i in range(n))
            q = Indexed(*_stacked(asked, max(v.shape[1] for v, _ in asked)))
            asked.clear()
            width = max([q.x.shape[1], *(t.x.shape[1] for t in forest)])
            q, best = _padded(q, width), Best(held, k)
            for t in forest:
                search(q, _padded(t, width), best, buffer)
            r, j = np.nonzero(best.score > -np.inf)
            if (np.abs(best.score[r, j]) >= 2.0**63).any():
                raise OverflowError("a score does not fit 64 bits")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (q.ids[r], best.id[r, j], best.score[r, j].astype(np.int64))], names=["query_id", "vec_id", "score"])

        for b in batches:
            for g, kind, blob in zip(b.column("g").to_pylist(), b.column("kind").to_pylist(), b.column("blob")):
                if g != group:
                    yield from answer()
                    group, data, forest = g, [], []
                v, ids = pickle.loads(blob.as_buffer())
                if not kind:
                    data.append((v, ids))
                    continue
                for i in range(0, len(ids), query_block):
                    part = v[i: i + query_block], ids[i: i + query_block]
                    if sum(len(x) for _, x in asked) + len(part[1]) > query_block:
                        yield from answer()
                    asked.append(part)
        yield from answer()

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of every query (``vec_id`` divisible by ``every``): its k best other rows,
    ties to the smaller id. Vectors that are null, hold a null or a non-finite component, or lack an id take no
    part; a shorter vector counts as padded with zeros; rows that repeat an id are candidates each, but the query
    is asked once (for its largest vector in array order). Scores are exact while they stay below 2^53."""
    some = vectors.where(F.col("vec_id").cast("long") % every == 0)
    queries = integer_vectors(some, scale).groupBy("vec_id").agg(F.max("v").alias("v"))
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    data, asked = _packs(raw, min(PACK, data_block), scale, "data"), _packs(queries, query_block, 1, "queries")
    n, size = data.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("width") * 4), F.lit(0))).first()
    groups = max(1, -(-size // GROUP_BYTES), min(-(-n // data_block), GROUPS))
    held = data.select(F.pmod(F.xxhash64("at"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "blob")
    sent = asked.select(F.explode(F.expr(f"sequence(0, {groups - 1})")).alias("g"), F.lit(1).alias("kind"), "blob")
    dealt = held.unionByName(sent).repartitionById(groups, F.col("g")).sortWithinPartitions("g", "kind")
    found = dealt.mapInArrow(_answers(k, data_block, query_block), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
