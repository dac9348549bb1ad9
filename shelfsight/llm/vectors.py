"""Vectors from array columns: which ones are usable, and matrices of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """True for an array without null, NaN or infinite components; false for a null array."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """The arrays of ``column`` as rows of doubles, filled up with zeros to ``width`` or to the longest."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy()
    sizes = np.diff(at)
    values = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.float64)
    width = max(int(sizes.max(initial=0)), width or 0)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their length, without overflow; rows of zeros stay."""
    most = np.abs(vectors).max(axis=1, initial=0, keepdims=True)
    scaled = vectors / np.where(most > 0, most, 1)
    size = np.linalg.norm(scaled, axis=1, keepdims=True)
    return scaled / np.where(size > 0, size, 1)
