"""Vectors in Arrow batches, and what counts as usable."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str, size: int) -> Column:
    """Not null, of full length, all values finite, and not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == size) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column, size: int) -> np.ndarray:
    """The rows of an Arrow list column of ``size`` floats each, as a float32 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype=np.float32).reshape(-1, size)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest value is divided out first so that squares cannot overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def lists(x: np.ndarray):
    """A float matrix as an Arrow list column."""
    import pyarrow as pa

    x = np.ascontiguousarray(x, np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def one_per_key(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(key, vec): the usable vectors, the smallest of each key; null keys are left out."""
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vec"))
    return rows.where(F.col("key").isNotNull() & usable("vec", size)).groupBy("key").agg(F.min("vec").alias("vec"))
