"""Vectors as integers, shared by the operators over embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components are below this in magnitude, so that squared distances and inner products of up to 128 of them fit 64 bits.
MOST = float(1 << 18)


def usable(vector: Column) -> Column:
    """No component is null, not finite, or MOST or more in magnitude; false for a null vector."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(MOST))), F.lit(False))


def whole_numbers(vector: Column) -> Column:
    """floor(256 * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("int"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of lists as int64, shorter ones filled with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out
