"""Vectors as blocks of integers, for the operators on embeddings.

Rows whose vector is null or holds a null or a non-finite component are left out. A component x becomes
floor(scale * x), x as double, held within `limit` of zero, so that no sum or product overflows. Vectors shorter
than the longest end in zeros.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Integers of a block.
BLOCK_INTS = 1 << 18


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def integers(values: np.ndarray, scale: int, limit: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -limit, limit).astype(np.int32)


def _matrix(column: pa.Array, dims: int, scale: int, limit: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    values = integers(column.flatten().to_numpy(zero_copy_only=False), scale, limit)
    out = np.zeros((len(sizes), dims), np.int32)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def _block_batches(batches: Iterator[pa.RecordBatch], dims: int, scale: int, limit: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    most = max(1, BLOCK_INTS // dims)
    held, n = [], 0

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        columns = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), c.combine_chunks()) for c in rows.columns[:-1]]
        matrix = np.concatenate([_matrix(b.column(b.num_columns - 1), dims, scale, limit) for b in held])
        return pa.RecordBatch.from_arrays([*columns, pa.array([matrix.tobytes()], pa.binary())], names=names)

    for b in batches:
        at = 0
        while at < len(b):
            part = b.slice(at, most - n)
            held.append(part)
            n, at = n + len(part), at + len(part)
            if n == most:
                yield block()
                held, n = [], 0
    if held:
        yield block()


def longest(rows: DataFrame, vec_col: str) -> int:
    """The components of the longest vector."""
    return rows.agg(F.max(F.size(vec_col))).first()[0] or 0


def blocks(rows: DataFrame, keep: list[str], vec_col: str, dims: int, scale: int, limit: int) -> DataFrame:
    """Blocks of rows: an array of each column of `keep`, and `ints`, the rows' integers (int32, `dims` a row) after one another."""
    bounded_batches()
    rows = rows.select(*keep, F.col(vec_col))
    kinds = [f"`{c}` array<{rows.schema[c].dataType.simpleString()}>" for c in keep]
    return rows.mapInArrow(partial(_block_batches, dims=dims, scale=scale, limit=limit, names=[*keep, "ints"]), ", ".join([*kinds, "ints binary"]))


def matrix_of(ints: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(ints, np.int32).reshape(-1, dims)
