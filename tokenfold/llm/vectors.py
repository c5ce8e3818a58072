"""Embedding rows as whole numbers: which vectors count, and their components in numpy."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers; null counts as no."""
    held = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return F.coalesce(held, F.lit(False))


def widest(dims: int) -> int:
    """The largest absolute component for which squared distances of ``dims`` components fit a long."""
    return math.isqrt((1 << 62) // max(1, dims)) // 2


def whole(column: pa.Array, scale: int, dims: int, limit: int):
    """A batch's vectors as int64 of ``floor(scale * x)``, padded with zeros to ``dims`` components.

    A component beyond ``limit`` raises, as sums of its squares would not fit the result's long.
    """
    import numpy as np

    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) and not np.abs(flat).max() <= limit:
        raise ValueError(f"a component's absolute value exceeds {limit} after scaling by {scale}")
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat.astype(np.int64)
    return out


def unpacked(blob: pa.Scalar | bytes, kind: str, width: int = 0):
    """A binary column's value as an array of ``kind``, in rows of ``width`` if given."""
    import numpy as np

    held = np.frombuffer(blob.as_buffer() if isinstance(blob, pa.Scalar) else blob, kind)
    return held.reshape(-1, width) if width else held
