"""Words, lines and rolling hashes of many texts at once, as numpy arrays.

A batch of texts is one byte string plus offsets (the layout of an Arrow string column).
Work per byte is a few vector operations; a ``Texts`` slice holds about ``SLICE_BYTES`` bytes
(or one longer text), so the memory of a task does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10

# Word separators: space and the controls 9 to 13.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
#: One random 64-bit value per byte, and the odd base of the rolling hash with its inverse.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and its inverse, grown on demand and kept for the worker up to ``KEPT`` of them. A longer
    text has its own, which go with it."""

    KEPT = 2 * SLICE_BYTES
    up = powers(BASE, 1024)
    down = powers(INVERSE, 1024)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.KEPT:
            return powers(BASE, n), powers(INVERSE, n)
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = powers(BASE, size), powers(INVERSE, size)
        return cls.up[:n], cls.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hashes`` takes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * _Powers.upto(len(data))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal bytes give equal hashes wherever they stand."""
    down = _Powers.upto(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def window_hashes(prefix: np.ndarray, width: int) -> np.ndarray:
    """``span_hashes`` of the spans of ``width`` bytes from every place on."""
    down = _Powers.upto(len(prefix))[1]
    return mix((prefix[width:] - prefix[:-width]) * down[: len(prefix) - width] + np.uint64(width))


def segments(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... (counts[i] numbers) for every i, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


class Texts:
    """Some texts as one byte array; ``offsets`` has their bounds, nulls are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and the index of its first word per text (n + 1)."""
        sep = SEPARATOR[self.data]
        inside = np.zeros(len(sep) + 1, bool)
        inside[:-1] = ~sep
        first = inside[:-1].copy()
        first[1:] &= sep[:-1]
        last = inside[:-1].copy()
        last[:-1] &= sep[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(sep))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """(index of the first row, ``Texts``) for consecutive rows of about ``limit`` bytes."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    _, where, body = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset: texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, Texts(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
        i = j


def pieces(texts: pa.Array, overlap: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(index of the first row, bytes of that row before the piece, ``Texts``): as ``slices``, but a text of more than
    two limits comes in pieces of its own, each of which has ``overlap`` bytes of the next."""
    for at, part in slices(texts, limit):
        if len(part.offsets) > 2 or len(part.data) <= 2 * limit:
            yield at, 0, part
            continue
        for i in range(0, len(part.data) - overlap, limit):
            body = part.data[i: i + limit + overlap]
            yield at, i, Texts(body, np.array([0, len(body)]))


def small_batches(batches, limit: int, column: str = "text"):
    """Batches cut so that ``column`` has about ``limit`` bytes in each (one row at least)."""
    for b in batches:
        texts = b.column(column)
        n = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(n, (n[i - 1] if i else 0) + limit, side="right")))
            yield b.slice(i, j - i)
            i = j


def per_text(counts_at: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Sums of ``counts_at`` over [where[i], where[i+1])."""
    run = np.zeros(len(counts_at) + 1, np.int64)
    np.cumsum(counts_at, out=run[1:])
    return run[where[1:]] - run[where[:-1]]
