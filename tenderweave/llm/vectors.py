"""Vectors as whole numbers, and how rows of them are dealt into shards."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Scaled components beyond this count as this, so that every sum over a vector fits 64 bits.
BOUND = 1 << 28
#: Whole numbers below this are exact as doubles.
EXACT = float(1 << 53)


def finite(df: DataFrame, vector: str) -> Column:
    """Whether a row's vector is there, has components, and all of them are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def whole(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long vectors as a matrix of floor(SCALE * x)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * flat), -BOUND, BOUND).astype(np.int64).reshape(len(column), -1)


def shard(shards: Column, *by: str) -> Column:
    """The shard of a row: by hash, so that copies of a vector under many ids spread over all shards."""
    return F.pmod(F.xxhash64(*by), shards).cast("int")


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as found:
        return dict(found)


def small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in 32 bits: scaled components always fit."""
    return np.ascontiguousarray(x, dtype=np.int32)
