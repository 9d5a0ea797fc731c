"""Vectors in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare


def usable(row: list | None) -> np.ndarray | None:
    """The vector in double precision, or None if it takes no part: null, empty, zero, or
    with a null or non-finite component."""
    if not row or any(x is None for x in row):
        return None
    v = np.array(row, np.float64)
    return v if np.isfinite(v).all() and v.any() and np.isfinite(v @ v) and v @ v > 0 else None


def _bytes(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [usable(r) for r in b.column(1).to_pylist()]
            # adding zero makes -0.0 and 0.0 the same bytes
            data = [None if r is None else (r.astype(kind) + 0).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["vec_id", "vector"])

    return run


def element(df: DataFrame, column: str = "embedding") -> str:
    """numpy's name of the type that holds the column's components exactly."""
    kind = df.schema[column].dataType
    return "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"


def as_bytes(df: DataFrame) -> DataFrame:
    """(vec_id, vector): the components' bytes, null for vectors that take no part."""
    prepare(df.sparkSession)
    kind = element(df)
    rows = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>"))
    return rows.mapInArrow(_bytes(kind), "vec_id long, vector binary")


def matrix(data: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(data), kind).astype(np.float64).reshape(len(data), -1)


def unit(x: np.ndarray) -> np.ndarray:
    # the largest component first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
