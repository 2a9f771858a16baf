"""Benchmark decontamination by a broadcast set of hashed windows of words.

Benchmark items are cut into windows of ``WINDOW`` words (an item of fewer words is one window). Their hashes, their
bytes and the items they stand in are broadcast; a block of the benchmark has a bounded number of windows, and more
windows make more blocks, each broadcast in a scan of its own. A scan hashes all windows of all documents, looks
them up through a bit table, then compares the words of every hit with those of the item.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tickloom.llm.staging import staged
from tickloom.llm.words import LOWER, Texts, mix, per_text, prefix_hashes, segments, slices, small_batches, span_hashes

WINDOW = 10
#: Windows of a block of the benchmark: a set of them takes some 50 MB on the driver and 20 MB in a worker.
WINDOWS = 1 << 18
#: Windows of a row of the staged benchmark; a longer item is several rows.
PIECE = 4096
BITS = 22
#: Texts of a batch while it is scanned.
BATCH_BYTES = 4 << 20

# Words are runs of ASCII letters and digits and of all bytes beyond ASCII; anything else becomes a space.
_FOLD = LOWER.copy()
_FOLD[[i for i in range(128) if not chr(i).isalnum()]] = 0x20
#: One odd factor per place in a window.
_PLACE = np.random.Generator(np.random.PCG64(77)).integers(1, 2**62, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """Lower-case words of some texts, joined by single spaces, with the places they have in the texts."""

    def __init__(self, part: Texts):
        low = Texts(_FOLD[part.data], part.offsets)
        self.starts, self.ends, self.at = low.words()
        self.hashes = span_hashes(prefix_hashes(low.data), self.starts, self.ends)
        self.low, self.text = low.data, np.repeat(np.arange(len(part.offsets) - 1), np.diff(self.at))

    def windows(self, width: int):
        """(first word, hash) of all windows of 1 to ``width`` words inside one text, shortest first."""
        n = len(self.hashes)
        run = np.zeros(n, np.uint64)
        for k in range(1, min(width, n) + 1):
            run = run[: n - k + 1] + self.hashes[k - 1:] * _PLACE[k - 1]
            inside = self.text[: n - k + 1] == self.text[k - 1:]
            yield k, inside, mix(run + np.uint64(k))

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The words joined by spaces, and where each begins (one more for the end)."""
        n = self.ends - self.starts + 1
        place = segments(self.starts, n)
        at = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=at[1:])
        out = self.low[np.minimum(place, max(len(self.low) - 1, 0))] if len(place) else np.zeros(0, np.uint8)
        out[at[1:] - 1] = 0x20
        return out, at


def pieces(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, words, n)``: the joined words of each item, in rows of at most ``PIECE`` windows that share
    ``window`` - 1 words with the next; items without words have none."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches):
        for b in small_batches(batches, BATCH_BYTES):
            rows, out, count = [], [], []
            for first, part in slices(b.column("text")):
                words = Words(part)
                data, at = words.joined()
                for t, (i, j) in enumerate(zip(words.at[:-1], words.at[1:])):
                    for p in range(i, max(j - window + 1, min(i + 1, j)), PIECE):
                        q = min(p + PIECE + window - 1, j)
                        rows.append(first + t)
                        out.append(data[at[p]: at[q] - 1].tobytes())
                        count.append(max(q - p - window + 1, 1))
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(rows, pa.int64())), pa.array(out, pa.binary()), pa.array(count, pa.int64())], names=["item_id", "words", "n"])

    return staged(benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, words binary, n long"), "benchmark")


@dataclass(frozen=True)
class WindowSet:
    """Distinct windows in order of their hashes: bytes, length in words, and the items of each (null left out)."""

    hashes: np.ndarray
    lengths: np.ndarray
    data: np.ndarray
    at: np.ndarray
    items: np.ndarray
    items_at: np.ndarray
    names: list

    @classmethod
    def of(cls, rows, window: int = WINDOW) -> WindowSet:
        names = sorted({r.item_id for r in rows if r.item_id is not None})
        number = {x: i for i, x in enumerate(names)}
        found: dict[bytes, set] = {}
        hashes, lengths = [], []
        for r in rows:
            body = bytes(r.words)
            words = Words(Texts(np.frombuffer(body, np.uint8), np.array([0, len(body)])))
            width = min(window, len(words.hashes))
            h = next(h for k, _, h in words.windows(width) if k == width)
            for i in range(len(h)):
                w = body[words.starts[i]: words.ends[i + width - 1]]
                if w not in found:
                    found[w] = set()
                    hashes.append(h[i])
                    lengths.append(width)
                if r.item_id is not None:
                    found[w].add(number[r.item_id])
        o = np.argsort(np.array(hashes, np.uint64), kind="stable")
        keys = list(found)
        keys = [keys[i] for i in o]
        size = lambda xs: np.concatenate([[0], np.cumsum(xs)]).astype(np.int64)
        return cls(np.array(hashes, np.uint64)[o], np.array(lengths, np.int64)[o], np.frombuffer(b"".join(keys), np.uint8), size([len(k) for k in keys]),
                   np.array([i for k in keys for i in sorted(found[k])], np.int64), size([len(found[k]) for k in keys]), names)

    def bits(self) -> np.ndarray:
        table = np.zeros(1 << BITS, bool)
        table[self.hashes >> np.uint64(64 - BITS)] = True
        return table

    def scan(self, words: Words, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every verified occurrence."""
        firsts, wins = [], []
        present = set(self.lengths.tolist())
        for k, inside, h in words.windows(max(present, default=0)):
            if k not in present:
                continue
            i = np.flatnonzero(bits[h >> np.uint64(64 - BITS)] & inside)
            w = np.searchsorted(self.hashes, h[i])
            # Windows with equal hashes stand side by side; almost always there is one.
            while len(i):
                there = w < len(self.hashes)
                i, w = i[there], w[there]
                there = self.hashes[w] == h[i]
                i, w = i[there], w[there]
                same = self.lengths[w] == k
                firsts.append(i[same])
                wins.append(w[same])
                w = w + 1
        i, w = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (firsts, wins))
        if not len(i):
            return i, w
        data, at = words.joined()
        a, n = at[i], at[i + self.lengths[w]] - 1 - at[i]
        fits = n == self.at[w + 1] - self.at[w]
        i, w, a, n = i[fits], w[fits], a[fits], n[fits]
        keep = np.ones(len(i), bool)
        # The words themselves, some hits at a time.
        for s in range(0, len(i), 1 << 14):
            z = slice(s, s + (1 << 14))
            differ = data[segments(a[z], n[z])] != self.data[segments(self.at[w[z]], n[z])]
            keep[z] = per_text(differ, np.concatenate([[0], np.cumsum(n[z])])) == 0
        return i[keep], w[keep]


_HITS = "n_words long, hits array<struct<a:int,b:int>>, items array<{kind}>"


def _scanner(found: WindowSet, kind: pa.DataType):
    """Adds a block's hits (maximal runs of hit words, as first and last + 1) and items to what rows have already."""
    def run(batches):
        bits = found.bits()
        hit_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for b in small_batches(batches, BATCH_BYTES):
            counts, hits, items = [], [], []
            for _, part in slices(b.column("text")):
                words = Words(part)
                i, w = found.scan(words, bits)
                n = len(part.offsets) - 1
                counts += np.diff(words.at).tolist()
                edge = np.zeros(len(words.hashes) + 1, np.int64)
                np.add.at(edge, i, 1)
                np.add.at(edge, i + found.lengths[w], -1)
                hit = np.cumsum(edge)[:-1] > 0
                # Runs of neighbouring texts are apart.
                begin = hit & ~(np.append(False, hit[:-1]) & np.append(False, words.text[1:] == words.text[:-1]))[: len(hit)]
                end = hit & ~(np.append(hit[1:], False) & np.append(words.text[1:] == words.text[:-1], False))[: len(hit)]
                a, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
                own, mine = [[] for _ in range(n)], [[] for _ in range(n)]
                for x, y in zip(a.tolist(), e.tolist()):
                    t = words.text[x]
                    own[t].append({"a": x - int(words.at[t]), "b": y - int(words.at[t])})
                size = found.items_at[w + 1] - found.items_at[w]
                pair = np.unique(np.repeat(words.text[i], size) * max(len(found.names), 1) + found.items[segments(found.items_at[w], size)]) if len(i) else np.zeros(0, np.int64)
                for p in pair.tolist():
                    mine[p // len(found.names)].append(found.names[p % len(found.names)])
                hits += own
                items += mine
            if "hits" in b.schema.names:
                hits = [x + y for x, y in zip(b.column("hits").to_pylist(), hits)]
                items = [sorted({*x, *y}) for x, y in zip(b.column("items").to_pylist(), items)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("text"), pa.array(counts, pa.int64()), pa.array(hits, hit_type), pa.array(items, pa.list_(kind))], names=["doc", "text", "n_words", "hits", "items"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, windows: int = WINDOWS) -> DataFrame:
    """``(doc, n_words, hits, items)``: ``doc`` is the row of ``docs`` as a struct, ``hits`` the runs of hit words (by
    number in the text, end exclusive; of several blocks they may overlap), ``items`` the ids whose windows occur.

    Lower-cased ASCII; words are runs of ASCII letters and digits and of anything beyond ASCII. A null or empty text
    has no words; repeated rows are judged each; an item without id hits words but is not listed; an empty benchmark
    hits nothing. Texts are scanned whole; a text longer than a slice is held on its own."""
    rows = pieces(benchmark, window)
    total = rows.agg(F.sum("n")).first()[0] or 0
    # Blocks are dealt by hash, so they are planned half full.
    blocks = 1 if total <= windows else -(-2 * total // windows)
    kind = benchmark.schema["item_id"].dataType
    out = docs.select(F.struct("*").alias("doc"), "text")
    schema = T.StructType([*out.schema.fields, *T.StructType.fromDDL(_HITS.format(kind=kind.simpleString())).fields])
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block) if blocks > 1 else rows
        found = WindowSet.of(own.collect(), window)
        out = out.mapInArrow(_scanner(found, to_arrow_type(kind)), schema)
        if block < blocks - 1:
            out = staged(out, "scanned").drop("n_words")
    return out.drop("text")


def n_hit() -> F.Column:
    """Words covered by ``hits``, whose runs may overlap."""
    last = F.aggregate(F.array_sort("hits"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["b"]).alias("to")))
    return last["n"].cast("long")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, windows: int = WINDOWS) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` per document."""
    found = find(docs.select("doc_id", "text"), benchmark, window, windows)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc.doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def _without(text: bytes, hits: list[dict]) -> bytes:
    words = Words(Texts(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
    out, at = [], 0
    for h in sorted(hits, key=lambda h: h["a"]):
        s, e = int(words.starts[h["a"]]), int(words.ends[h["b"] - 1])
        out.append(text[at:max(s, at)])
        at = max(at, e)
    return b"".join(out) + text[at:]


def clean(docs: DataFrame, benchmark: DataFrame, drop_documents: bool = False, window: int = WINDOW, windows: int = WINDOWS) -> DataFrame:
    """``docs`` without what the benchmark shares: runs of hit words are cut out of the texts (what separates words
    stays), or with ``drop_documents`` the documents that have any are left out. All other columns stay."""
    found = find(docs, benchmark, window, windows)
    if drop_documents:
        return found.where(F.size("hits") == 0).select("doc.*")

    def cut(batches):
        for b in batches:
            texts = [t if not h else _without(t.encode(), h).decode() for t, h in zip(b.column("text").to_pylist(), b.column("hits").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(texts, b.schema.field("text").type)], names=["doc", "cut"])

    shown = found.select("doc", F.col("doc.text").alias("text"), "hits")
    schema = T.StructType([found.schema["doc"], T.StructField("cut", T.StringType())])
    return shown.mapInArrow(cut, schema).select(F.col("doc").withField("text", F.col("cut")).alias("doc")).select("doc.*")
