"""Vectors of whole numbers: what the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a component is multiplied by before it is rounded down.
SCALE = 256


def sound(vector: Column) -> Column:
    """True for vectors that are there and hold finite numbers only; an empty vector is sound."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.coalesce(~F.exists(vector.cast("array<double>"), odd), F.lit(False))


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each component, as longs; what no long holds becomes the nearest one."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.lit(float(scale)) * c))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as a matrix of ``width`` columns; shorter lists are filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(lists) * width and (not len(lists) or set(np.diff(lists.offsets.to_numpy())) <= {width}):
        return flat.reshape(len(lists), width)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), flat.dtype)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def widths(table: DataFrame, vector: str = "x") -> tuple[int, int, int]:
    """Rows of a table of vectors, their greatest length, and the greatest size of a component (a power of two above it, at least one)."""
    size = F.array_max(F.transform(vector, lambda c: F.abs(c.cast("double"))))
    n, width, most = table.agg(F.count(F.lit(1)), F.max(F.size(vector)), F.max(size)).first()
    return n, width or 0, 1 << int(most or 0).bit_length()
