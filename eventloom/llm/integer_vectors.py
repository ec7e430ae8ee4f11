"""Embeddings as vectors of exact integers, for operators whose sums must be exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and x, the array of floor(scale * component), of the rows whose vector is whole; beyond a long, the nearest long."""
    v = F.col("embedding")
    x = F.transform(v.cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))))
    return vectors.filter(finite(v)).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<long>").alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of an array column of one width."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
