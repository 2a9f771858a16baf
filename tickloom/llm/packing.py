"""Packing: concatenate all documents' tokens and cut the stream into fixed windows.

Pass 1 tokenizes each document once and writes ids with the number of tokens before it in its partition.
The totals of the partitions (one number each) are summed up in order; they give every document its place in
one global stream. Pass 2 cuts each document at the window borders on its own: no task needs its neighbours.
Only the last window can be short; it is padded unless its length is a power of two.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.staging import staged
from tickloom.llm.words import small_batches

WINDOW = 1024
END = 0

#: Bytes of text, or of ids, of which a worker has Python objects at a time; an Arrow batch may hold all rows of a task.
PART_BYTES = 1 << 20


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a tokenizers file as a faster encoder with the same ids. In such files a token's
    id is its merge rank, and each byte is written as a printable character: itself, or the next one from 256 on."""
    import public_tokenizers
    import tiktoken

    with open(path) as f:
        data = json.load(f)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def plain_encoder(path: str):
    """The tokenizers library itself: slower, same ids, no limit on runs."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenize(path: str, end: int = END):
    """A function from texts to one uint32 array each, ended by ``end``; null is empty."""
    enc = encoder(path)
    allowed = set(enc.special_tokens_set)

    def encoded(text: str) -> np.ndarray:
        try:
            return enc.encode_to_numpy(text, allowed_special=allowed)
        except ValueError:  # its pattern engine gives up on very long runs of white space
            return np.array(plain_encoder(path).encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(text: str | None) -> np.ndarray:
        out = encoded(text) if text else np.zeros(0, np.uint32)
        return np.append(out, np.uint32(end)).astype("<u4")

    return ids


TOKENS = "part int, before long, n_tokens long, ids binary"


def _tokenized(batches, path: str, part: int):
    ids, before = tokenize(path), 0
    for b in small_batches(batches, PART_BYTES):
        lengths, packed = [], []
        for t in b.column("text").to_pylist():
            x = ids(t)
            lengths.append(len(x))
            packed.append((b"\2" + x.astype("<u2").tobytes()) if x.max() < 1 << 16 else (b"\4" + x.tobytes()))
        n = np.array(lengths, np.int64)
        starts = before + np.cumsum(n) - n
        before += int(n.sum())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), pa.array(packed, pa.binary())], names=["doc_id", "part", "before", "n_tokens", "ids"])


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """Pass 1: ``(doc_id, part, before, n_tokens, ids)``, written to a stage table. Ids are 2 bytes wide where they fit."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        return _tokenized(batches, path, TaskContext.get().partitionId())

    return staged(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {TOKENS}"), "tokens")


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[0] == 2 else "<u4", offset=1)


def _cut(batches, base: dict[int, int], window: int, with_ids: bool):
    """Rows of pass 1 at the window borders; ``base``: the tokens before each partition."""
    for b in small_batches(batches, PART_BYTES, "ids"):
        cols = {c: [] for c in ("row", "start", "length", "crc", "total", "seq", "offset", "ids")}
        for i, (part, before, n, ids) in enumerate(zip(*(b.column(c).to_pylist() for c in ("part", "before", "n_tokens", "ids")))):
            at, x = base[part] + before, unpacked(ids).astype("<u4")
            s = 0
            while s < n:
                seq, offset = divmod(at + s, window)
                length = min(window - offset, n - s)
                piece = x[s: s + length]
                for c, v in zip(cols, (i, s, length, zlib.crc32(piece.tobytes()), n, seq, offset, piece if with_ids else None)):
                    cols[c].append(v)
                s += length
        arrays = [b.column("doc_id").take(pa.array(cols["row"], pa.int64())), *(pa.array(cols[c], pa.int64()) for c in ("start", "length", "crc", "total", "seq", "offset"))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            arrays, names = [*arrays, pa.array(cols["ids"], pa.list_(pa.int32()))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def pack(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked
    for, ``ids``. Every document has at least its end token; repeated rows are packed each; an empty table has
    no pieces. The driver holds one number per input partition."""
    staged_tokens = tokens(docs, path)
    totals = {r.part: r.n for r in staged_tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(totals):
        base[part] = total
        total += totals[part]

    def cut(batches):
        return _cut(batches, base, window, with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return staged_tokens.mapInArrow(cut, out)


def sequences(pieces: DataFrame, window: int = WINDOW, pad: int = END) -> DataFrame:
    """``(sequence_id, ids, n_tokens)`` from pieces with ids; a short window is padded unless it is a power of two."""
    joined = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    fill = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(F.lit(window) - n)
    return joined.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad), fill)).alias("ids"), n.alias("n_tokens"))
