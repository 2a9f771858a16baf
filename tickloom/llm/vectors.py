"""Vectors of whole numbers: columns and Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Whole components are clamped to +- this, so that sums of products of some hundred components fit in 64 bits.
LARGEST = 1 << 27


def finite(name: str = "embedding") -> F.Column:
    """The vector is there and has neither null nor non-finite components."""
    x = F.col(name).cast("array<double>")
    return x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))


def whole(scale: int, name: str = "embedding") -> F.Column:
    """floor(scale * component) of a finite vector, as array<int>."""
    clamped = lambda c: F.least(F.greatest(c * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
    return F.transform(F.col(name).cast("array<double>"), lambda c: F.floor(clamped(c)).cast("int"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as int64 rows; shorter vectors are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.diff(column.offsets.to_numpy()).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), width), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out
