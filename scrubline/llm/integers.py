"""Vectors of integers: each component x of an embedding becomes floor(1024 x), exactly, in Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a component is multiplied by.
SCALE = 1024
#: Components are held as 64-bit integers, and sums of their products as numbers of 38 digits: those at or over this size count as not finite.
LARGEST = float(1 << 48)
#: Doubles hold integers up to here exactly, and so sums of products that stay under it.
EXACT = 1 << 53
MOST = (1 << 63) - 1


def usable(column: str = "embedding") -> Column:
    """Is the vector there, and is each of its components there and finite (of a size under LARGEST)?"""
    fine = F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False)))  # NaN is larger than all numbers
    return F.coalesce(fine, F.lit(False))


def kept(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """(vec_id, embedding) of the usable vectors, those of ``size`` components if it is given; other columns are ignored."""
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable())
    return out if size is None else out.where(F.size("embedding") == size)


def rows_of(column: pa.ListArray) -> list[np.ndarray]:
    """Each vector as 64-bit integers."""
    ends = column.offsets.to_numpy()
    flat = np.floor(SCALE * column.values.to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def matrix(column: pa.ListArray, size: int) -> np.ndarray:
    """Vectors as rows of 64-bit integers; what a shorter vector lacks is zero."""
    rows = rows_of(column)
    out = np.zeros((len(rows), size), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def kind_of(*tables: np.ndarray) -> type:
    """What holds sums of products of these integers' differences exactly: doubles, or else Python's integers."""
    most = 2 * max((int(np.abs(t).max()) for t in tables if t.size), default=0)
    return np.float64 if max(1, tables[0].shape[-1]) * most * most < EXACT else object


def numbers(*tables: np.ndarray) -> list[np.ndarray]:
    """Integers as their ``kind_of``."""
    kind = kind_of(*tables)
    return [t.astype(kind) for t in tables]


def longs(values) -> list[int]:
    """Exact numbers as longs; beyond the largest or smallest long, that."""
    return [max(-MOST - 1, min(MOST, int(v))) for v in values]
