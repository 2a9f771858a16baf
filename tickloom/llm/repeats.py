"""Exact repeats of 50 bytes across documents, found in suffix order.

Every 50-byte string of a document lies in one segment: the run of strings that share the same smallest hash of
their ``CORE``-byte pieces (the core). Equal strings have equal cores, so repeats meet by core.

1. Segments travel as (core, segment hash, doc_id). Equal segments need no look at their bytes: all but those
   of the smallest doc_id are repeated throughout.
2. Of a core with several different segments, one representative each (of its smallest doc_id) is cut out of its
   document and sent to the core's shard.
3. Of a shard's segments only the pieces go on whose 50-byte strings have the hash of another document's; most segments
   share their core alone, the more so the more text there is. The pieces are put in suffix order with common
   prefixes by external induced sorting (``suffixes.suffix_order``), within memory for ordinary cores, with the arrays
   of the order in files for a large core, whose text and names must still fit in memory. Runs of suffixes that share
   50 bytes are the repeats; those above the smallest doc_id of a run are removed.
4. Removed intervals meet per document and are cut out of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.near_dedup import only
from tickloom.llm.staging import staged
from tickloom.llm.suffixes import IN_MEMORY, suffix_order
from tickloom.llm.words import pieces as pieces_of, prefix_hashes, segments as spread, small_batches, span_hashes, window_hashes

LENGTH, CORE = 50, 18
#: Bytes of segments that are sorted together; whole cores, so one large core can exceed it.
SHARD_BYTES = 8 << 20
#: Bytes of texts whose segments are held, sorted and written at a time, and those of a slice: its arrays of 8 bytes
#: a place stay near the processor.
BATCH_BYTES, SLICE_BYTES = 2 << 20, 128 << 10
#: Rows of segments that are judged at a time.
HELD_ROWS = 1 << 16
pieces = partial(pieces_of, limit=SLICE_BYTES)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have:]) if width > have else x


def segments(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: index of its first row, and per segment its row in the slice, start and end in the text, core
    and hash of the whole segment. A text of several slices is cut into pieces that share ``LENGTH`` - 1 bytes, which
    may cut a segment in two of the same core: every string is still in one."""
    for at, before, part in pieces(texts, LENGTH - 1):
        none = np.zeros(0, np.int64)
        if len(part.data) < LENGTH:
            yield at, none, none, none, none, none
            continue
        run = prefix_hashes(part.data)
        core = _sliding_min(window_hashes(run, CORE), LENGTH - CORE + 1)
        inside = np.ones(len(core) + 1, bool)  # the string from here on lies in one text
        for s, e in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist()):
            inside[max(s, e - LENGTH + 1): e] = False
        inside[-1] = False
        new = np.ones(len(core) + 1, bool)
        new[1:-1] = (core[1:] != core[:-1]) | ~inside[:-2]
        first = np.flatnonzero(new & inside)
        last = np.flatnonzero(inside[:-1] & (new[1:] | ~inside[1:]))
        a, b, row = first, last + LENGTH, np.searchsorted(part.offsets, first, side="right") - 1
        yield at, row, a - part.offsets[row] + before, b - part.offsets[row] + before, core[first].view(np.int64), span_hashes(run, a, b).view(np.int64)


_SEGMENTS = "core long, segment long, doc_id long"
_FATES = "doc_id long, segment long, repeated boolean"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _batch(ddl: str, *arrays) -> pa.RecordBatch:
    s = _schema(ddl)
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, s)], schema=s)


def _cut(batches):
    """Distinct (core, segment, doc_id) rows of a batch."""
    for b in small_batches(batches, BATCH_BYTES):
        docs = b.column("doc_id").to_numpy(zero_copy_only=False)
        parts = [(core, seg, docs[at + row]) for at, row, _, _, core, seg in segments(b.column("text"))]
        if not parts:
            continue
        core, seg, doc = _distinct(*(np.concatenate(x) for x in zip(*parts)))
        for i in range(0, len(core), 1 << 18):
            k = slice(i, i + (1 << 18))
            yield _batch(_SEGMENTS, core[k], seg[k], doc[k])


def _distinct(core: np.ndarray, seg: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted rows without repeats."""
    o = np.lexsort((doc, seg, core))
    core, seg, doc = core[o], seg[o], doc[o]
    keep = np.append(True, (core[1:] != core[:-1]) | (seg[1:] != seg[:-1]) | (doc[1:] != doc[:-1]))[: len(core)]
    return core[keep], seg[keep], doc[keep]


def _judge(batches):
    """Rows sorted by core, in any order inside: fates of segments. Of a segment the smallest document so far is held,
    all others are repeated. The core that a batch leaves open goes on with what is held. A core with several segments
    makes representatives of what it holds in the end."""
    none = np.zeros(0, np.int64)
    held, waiting, size = (none, none, none), [], 0

    def fates(last: bool):
        nonlocal held, waiting, size
        core, seg, doc = _distinct(*(np.concatenate(x) for x in zip(held, *waiting)))
        waiting, size = [], 0
        first = np.append(True, (core[1:] != core[:-1]) | (seg[1:] != seg[:-1]))[: len(core)]
        copies = doc[~first], seg[~first]
        core, seg, doc = core[first], seg[first], doc[first]
        head = np.flatnonzero(np.append(True, core[1:] != core[:-1])[: len(core)])
        done = len(core) if last or not len(core) else head[-1]
        several = np.repeat(np.diff(np.append(head, len(core))) > 1, np.diff(np.append(head, len(core))))[:done]
        held = core[done:], seg[done:], doc[done:]
        sent = doc[:done][several], seg[:done][several]
        return _batch(_FATES, *(np.append(x, y) for x, y in zip(copies, sent)), np.append(np.ones(len(copies[0]), bool), np.zeros(len(sent[0]), bool)))

    for b in batches:
        waiting.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("core", "segment", "doc_id")))
        size += b.num_rows
        if size >= max(HELD_ROWS, len(held[0])):  # what is held is not sorted again for a few rows
            yield fates(False)
    yield fates(True)


_SPANS = "doc_id long, text_hash long, a long, b long, core long, bytes binary"


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals; touching ones are one."""
    if not len(a):
        return a, b
    o = np.argsort(a, kind="stable")
    a, b = a[o], np.maximum.accumulate(b[o])
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(new[1:], True)]


class _Asked:
    """The segments that each row of a batch lists."""

    def __init__(self, lists: pa.Array):
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.known = np.unique(values)
        self.keys = np.sort(np.repeat(np.arange(len(n)), n) * len(self.known) + np.searchsorted(self.known, values))

    def has(self, row: np.ndarray, segment: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(row), bool)
        i = np.minimum(np.searchsorted(self.known, segment), len(self.known) - 1)
        key = row * len(self.known) + i
        j = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.known[i] == segment) & (self.keys[j] == key)


def _spans(batches):
    """Repeated intervals of a document (bytes null), and its representatives (with bytes)."""
    for b in small_batches(batches, BATCH_BYTES):
        docs, marks = b.column("doc_id"), b.column("text_hash")
        texts = b.column("text")
        gone, sent = _Asked(b.column("gone")), _Asked(b.column("sent"))
        raw = texts.cast(pa.large_binary())
        parts, data = [(np.zeros(0, np.int64),) * 4], []
        for at, row, s, t, c, seg in segments(texts):
            row = row + at
            dead = gone.has(row, seg)
            k, x, y = row[dead], s[dead], t[dead]
            # A row's segments come in order, and so do their ends.
            new = np.append(True, (k[1:] != k[:-1]) | (x[1:] > y[:-1])) if len(k) else np.zeros(0, bool)
            asked = sent.has(row, seg)
            parts += [(k[new], x[new], y[np.append(new[1:], True)] if len(k) else y, np.zeros(new.sum(), np.int64)), (row[asked], s[asked], t[asked], c[asked])]
            data += [None] * int(new.sum())
            body, last = b"", -1
            for i, m, n in zip(*(v.tolist() for v in parts[-1][:3])):
                if i != last:
                    body, last = raw[i].as_py(), i
                data.append(body[m:n])
        rows, a, e, core = (np.concatenate(x) for x in zip(*parts))
        i = pa.array(rows)
        yield _batch(_SPANS, docs.take(i), marks.take(i), a, e, core, data)


_FOUND = "doc_id long, text_hash long, a long, b long"


def _shared(docs: np.ndarray, bodies: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """``(segment, place in it, bytes)`` of the pieces whose 50-byte strings could be another document's, too: those
    with equal hashes, for equal strings have them. What is in no such piece is repeated nowhere."""
    _, where, body = bodies.buffers()
    bounds = np.frombuffer(where, np.int64)[bodies.offset: bodies.offset + len(bodies) + 1]
    data, bounds = np.frombuffer(body, np.uint8)[bounds[0]: bounds[-1]], bounds - bounds[0]
    begin, ends, count = bounds[:-1], bounds[1:], np.diff(bounds) - LENGTH + 1
    place, hashes = spread(begin, count), []
    for i in range(0, len(data), SLICE_BYTES):
        run = prefix_hashes(data[i: i + SLICE_BYTES + LENGTH - 1])
        p = place[slice(*np.searchsorted(place, (i, i + SLICE_BYTES)))] - i
        hashes.append(span_hashes(run, p, p + LENGTH))
    hashes, owner = np.concatenate(hashes), np.repeat(docs, count)
    o = np.argsort(hashes)
    hashes, owner = hashes[o], owner[o]
    head = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    several = np.minimum.reduceat(owner, head) < np.maximum.reduceat(owner, head)
    del hashes, owner
    p = np.sort(place[o[np.repeat(several, np.diff(np.append(head, len(o))))]])
    # Pieces end with their segment.
    seg = np.searchsorted(ends, p, side="right")
    new = np.append(True, (seg[1:] != seg[:-1]) | (p[1:] > p[:-1] + LENGTH)) if len(p) else np.zeros(0, bool)
    x, y, seg = p[new], p[np.append(new[1:], True)] + LENGTH if len(p) else p, seg[new]
    text = data.tobytes()
    return seg, x - begin[seg], [text[i:j] for i, j in zip(x.tolist(), y.tolist())]


def _repeated(docs: np.ndarray, hashes: np.ndarray, starts: np.ndarray, segments: pa.LargeBinaryArray, in_memory: int):
    """Intervals of one shard's segments that start a 50-byte string which a smaller doc_id has as well. Only pieces
    that can hold one are sorted, and of equal pieces those of the smallest doc_id: the others are repeated throughout."""
    seg, at, bodies = _shared(docs, segments)
    docs, hashes, starts = docs[seg], hashes[seg], starts[seg] + at
    least: dict[bytes, int] = {}
    for body, doc in zip(bodies, docs.tolist()):
        if doc < least.get(body, doc + 1):
            least[body] = doc
    copy = docs > np.array([least[x] for x in bodies], np.int64)
    ends = starts + np.array([len(x) for x in bodies], np.int64)
    found = [(docs[copy], hashes[copy], starts[copy], ends[copy])]
    if not copy.all():
        found.append(_sorted_shard(docs[~copy], hashes[~copy], starts[~copy], [x for x, c in zip(bodies, copy.tolist()) if not c], in_memory))
    return [np.concatenate(x) for x in zip(*found)]


def _sorted_shard(docs: np.ndarray, hashes: np.ndarray, starts: np.ndarray, bodies: list[bytes], in_memory: int):
    """Intervals of pieces that start a 50-byte string which a smaller doc_id has as well, by the order of their suffixes."""
    lengths = np.array([len(x) + 1 for x in bodies])
    ends = np.cumsum(lengths)
    begin = ends - lengths
    symbols = np.zeros(int(ends[-1]), np.uint16)
    symbols[:] = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    symbols += 1
    symbols[ends - 1] = 0
    hit: list[np.ndarray] = []
    run_p: list[np.ndarray] = []  # members of the run that a block's end leaves open

    def settle(p):
        if len(p) > 1:
            d = docs[np.searchsorted(ends, p, side="right")]
            hit.append(p[d > d.min()])

    for p, c in suffix_order(symbols, LENGTH, in_memory):
        seg = np.searchsorted(ends, p, side="right")
        whole = p + LENGTH < ends[seg]  # the last symbol of a segment is its separator
        new = np.flatnonzero(c < LENGTH)
        if not len(new):
            run_p.append(p[whole])
            continue
        settle(np.concatenate([*run_p, p[: new[0]][whole[: new[0]]]]))
        # Runs that lie inside the block, all at once.
        lo, hi = new[0], new[-1]
        inner = slice(lo, hi)
        d = np.where(whole[inner], docs[seg[inner]], np.iinfo(np.int64).max)
        if hi > lo:
            heads = new[:-1] - lo
            least = np.minimum.reduceat(d, heads)
            low = np.repeat(least, np.diff(np.append(heads, hi - lo)))
            hit.append(p[inner][whole[inner] & (d > low)])
        run_p = [p[hi:][whole[hi:]]]
    settle(np.concatenate(run_p) if run_p else np.zeros(0, np.int64))
    p = np.sort(np.concatenate(hit)) if hit else np.zeros(0, np.int64)
    x, y = _merged(p, p + LENGTH)
    # Intervals of neighbouring segments never touch: a separator lies between.
    seg = np.searchsorted(ends, x, side="right")
    return docs[seg], hashes[seg], starts[seg] + x - begin[seg], starts[seg] + y - begin[seg]


def _sort_shards(in_memory: int):
    def run(batches):
        held, size, last = [], 0, None

        def flush():
            numbers = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("doc_id", "text_hash", "a"))
            return _batch(_FOUND, *_repeated(*numbers, pa.concat_arrays([b.column("bytes").cast(pa.large_binary()) for b in held]), in_memory))

        for b in batches:
            if not b.num_rows:
                continue
            core = b.column("core").to_numpy(zero_copy_only=False)
            before = np.append(0, np.cumsum(pc.binary_length(b.column("bytes")).to_numpy(zero_copy_only=False).astype(np.int64) + 1))
            new = np.flatnonzero(np.append(core[0] != last, core[1:] != core[:-1]))
            at = 0
            while len(full := new[size + before[new] - before[at] >= SHARD_BYTES]):
                held.append(b.slice(at, full[0] - at))
                yield flush()
                held, size, at = [], 0, full[0]
            held.append(b.slice(at))
            size, last = size + before[-1] - before[at], core[-1]
        if held:
            yield flush()

    return run


def _apply(batches):
    for b in batches:
        out = []
        for t, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            raw = (t or "").encode()
            x, y = _merged(*(np.array([s[k] for s in spans], np.int64) for k in ("a", "b")))
            kept = [raw[i:j] for i, j in zip([0, *y], [*x, len(raw)])]
            out.append((int((y - x).sum()), len(x), b"".join(kept)))
        gone, n, kept = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "text_hash", "n_removed", "n_spans", "kept"])


def repeated_spans(docs: DataFrame, in_memory: int = IN_MEMORY) -> DataFrame:
    """``(doc_id, text_hash, a, b)``: byte intervals whose 50-byte strings also start in a smaller doc_id; they may
    overlap. ``docs``: doc_id, text_hash, text. Rows with a null doc_id take no part."""
    docs = docs.where("doc_id IS NOT NULL AND octet_length(text) >= 50")
    rows = docs.select("doc_id", "text").mapInArrow(_cut, _SEGMENTS)
    fates = staged(rows.repartition(F.col("core")).sortWithinPartitions("core").mapInArrow(_judge, _FATES), "fates")
    per_doc = fates.groupBy("doc_id").agg(F.collect_set(F.when(F.col("repeated"), F.col("segment"))).alias("gone"), F.collect_set(F.when(~F.col("repeated"), F.col("segment"))).alias("sent"))
    touched = fates.select("doc_id").distinct()
    spans = staged(only(docs, touched, "doc_id").join(per_doc, "doc_id").select("doc_id", "text_hash", "text", "gone", "sent").mapInArrow(_spans, _SPANS), "spans")
    sent = spans.where("bytes IS NOT NULL").select("core", "doc_id", "text_hash", "a", "bytes")
    found = sent.repartition(F.col("core")).sortWithinPartitions("core").mapInArrow(_sort_shards(in_memory), _FOUND)
    return staged(found.unionByName(spans.where("bytes IS NULL").select("doc_id", "text_hash", "a", "b")), "found")


def remove_repeats(docs: DataFrame, in_memory: int = IN_MEMORY) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per row. A null text is empty. Rows that repeat a doc_id
    remove nothing from each other; a row without doc_id neither removes nor loses anything."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = repeated_spans(docs, in_memory).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    found = staged(found, "removed")
    losers = only(docs, found.select("doc_id").distinct(), "doc_id").dropDuplicates(["doc_id", "text_hash"])
    cut = losers.join(found, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "spans").mapInArrow(_apply, "doc_id long, text_hash long, n_removed long, n_spans long, kept binary")
    cut = cut.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    plain = docs.select("doc_id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    out = plain.join(cut, (F.col("doc_id") == F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
