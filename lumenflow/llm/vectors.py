"""Arrays of vectors between Spark's rows and numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter ones are filled up with zeros, longer ones must not occur."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    at = 0
    for i, n in enumerate(lengths):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
