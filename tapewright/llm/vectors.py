"""Vectors of whole numbers: cleaning, and passing them between Spark and numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """True where the vector is there and all its entries are finite numbers. An empty vector is."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def scaled(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * c) + shift of every entry, as array<long>."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(shift))


def padded(vector: Column, size: int, fill: int) -> Column:
    """The vector with `fill` behind its last entry up to `size`; one of that size stays as it is."""
    return F.when(F.size(vector) < size, F.concat(vector, F.array_repeat(F.lit(fill).cast("long"), F.lit(size) - F.size(vector)))).otherwise(vector)


def longest(df: DataFrame, vector: str) -> int:
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """The rows of a list column, each of `size` entries."""
    arrays = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(arrays.flatten()).reshape(len(arrays), size)
