"""Vectors in Arrow batches as matrices of doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether an array column holds a vector: not null or empty, not all zero, without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, as doubles; their lengths must agree."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(flat) % len(column):
        raise ValueError("vectors must have the same number of components")
    return flat.reshape(len(column), -1)


def from_binary(values: object) -> np.ndarray:
    """A matrix from little-endian doubles, one binary value for each row."""
    parts = [bytes(v) for v in values]
    return np.frombuffer(b"".join(parts), dtype="<f8").reshape(len(parts), -1)
