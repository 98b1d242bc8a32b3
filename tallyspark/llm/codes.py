"""Vector code compression: product codes whose nearest entries are found by segment-mean lower bounds.

A vector is cut into equal parts; each part has a codebook, refined in rounds of exact integer arithmetic, and its code
is the nearest entry's number. For a part x and an entry c of width w, cut into s segments of b components with sums S and
residual norms r (what is left of a vector without its segments' means),

    |x - c|^2  >=  sum (S_x - S_c)^2 / b  +  (r_x - r_c)^2

so an entry whose bound exceeds the distance to some known entry can't be the nearest. Bounds of one segment are
taken for all entries, those of two and four only for what is left, and the survivors have their exact
integer distance. A bound is lowered by more than its rounding, so no nearest entry and no tie is ever filtered.

The vectors are packed once as blocks of integers; a round reads them, sums each entry's parts inside the tasks
(256 entries and their sums a part and task are shuffled) and brings the entries to the driver, whose number the parameters bound.

Defined cases: rows whose vector is null or holds null or non-finite components are left out; a component is held within 2^22
(2^31 divided by a part's width, where that is less) after scaling; shorter vectors end in zeros, and so does a length that the parts don't
divide (empty vectors are one zero). Null ids come last among the first entries, equal ids by their vectors; repeated rows count each. Nearest ties
go to the lower entry. Null labels are one label. With fewer rows than entries codebooks are smaller; an empty table gives no codes and empty codebooks.
Columns beside the three named ones are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written
from .vectors import blocks, finite, integers, longest, matrix_of

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Segments of each level; a part's width is padded to a multiple of the last.
LEVELS = (1, 2, 4)
#: Components of pairs whose distances are taken at a time.
PAIR_INTS = 1 << 21


class Parts:
    """Parts (rows of integers) and what their bounds need."""

    def __init__(self, x: np.ndarray):
        self.x = np.pad(x, ((0, 0), (0, -x.shape[1] % LEVELS[-1]))).astype(np.int64)
        self.width = self.x.shape[1]
        self.square = (self.x * self.x).sum(axis=1)
        self.sums, self.rest = {}, {}
        for s in LEVELS:
            b = self.width // s
            sums = self.x.reshape(len(x), s, b).sum(axis=2)
            # b times the square of the residual is a whole number, so the root has no error but its own.
            self.rest[s] = np.sqrt((b * self.square - (sums * sums).sum(axis=1)).astype(np.float64))
            self.sums[s] = sums.astype(np.float64)

    def far(self, other: Parts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact squared distances of pairs."""
        out, step = np.empty(len(i), np.int64), max(1, PAIR_INTS // self.width)
        for k in range(0, len(i), step):
            d = self.x[i[k : k + step]] - other.x[j[k : k + step]]
            out[k : k + step] = np.einsum("ij,ij->i", d, d)
        return out


def lower_bounds(x: Parts, c: Parts, s: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bounds of pairs at a level, lowered by more than their rounding errors; i and j broadcast."""
    total = (x.rest[s][i] - c.rest[s][j]) ** 2
    for k in range(s):
        total += (x.sums[s][i, k] - c.sums[s][j, k]) ** 2
    total *= s / x.width
    total -= 1e-12 * (x.square[i] + c.square[j])
    return total


def nearest(x: Parts, c: Parts) -> tuple[np.ndarray, np.ndarray, int]:
    """For each part the nearest entry, the lower at ties, and its distance; and how many exact distances were taken."""
    rows = np.arange(len(x.x))
    coarse = lower_bounds(x, c, LEVELS[0], rows[:, None], np.arange(len(c.x))[None, :])
    best = x.far(c, rows, coarse.argmin(axis=1))
    i, j = np.nonzero(coarse <= best[:, None])
    taken = len(rows)
    for s in LEVELS[1:]:
        bound = lower_bounds(x, c, s, i, j)
        # The least bound of each row names an entry that is likely near; each row has a pair left, its nearest entry.
        edges = np.searchsorted(i, rows)
        least = np.minimum.reduceat(bound, edges)
        at = np.flatnonzero(bound == least[i])
        at = at[np.concatenate(([True], i[at][1:] != i[at][:-1]))]
        best = np.minimum(best, x.far(c, rows, j[at]))
        taken += len(rows)
        left = bound <= best[i]
        i, j = i[left], j[left]
    far = x.far(c, i, j)
    edges = np.searchsorted(i, rows)
    best = np.minimum.reduceat(far, edges)
    entry = np.minimum.reduceat(np.where(far == best[i], j, len(c.x)), edges)
    return entry, best, taken + len(far)


def _parts_of(matrix: np.ndarray, n: int) -> list[Parts]:
    return [Parts(p) for p in np.split(matrix, n, axis=1)]


def _assigned(ints: bytes, dims: int, books: list[Parts]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The integers of a block, the entry of each part and the error of each row."""
    matrix = matrix_of(ints, dims)
    found = [nearest(x, c) for x, c in zip(_parts_of(matrix, len(books)), books)]
    return matrix, np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)


def _sum_batches(batches: Iterator[pa.RecordBatch], dims: int, codebooks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What the task's rows add to each entry: (entry, n, sums)."""
    parts, entries, width = codebooks.shape
    books, n, sums = [Parts(c) for c in codebooks], np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
    for b in batches:
        for ints in b.column(0).to_pylist():
            matrix, found, _ = _assigned(ints, dims, books)
            slots = found + np.arange(parts) * entries
            n += np.bincount(slots.ravel(), minlength=len(n))
            np.add.at(sums, slots.ravel(), matrix.reshape(-1, width).astype(np.int64))
    used = np.flatnonzero(n)
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["slot", "n", "sums"])


def _code_batches(batches: Iterator[pa.RecordBatch], dims: int, codebooks: np.ndarray) -> Iterator[pa.RecordBatch]:
    books, digits = [Parts(c) for c in codebooks], 2 * max(1, -(-(codebooks.shape[1] - 1).bit_length() // 8))
    for b in batches:
        for k, ints in enumerate(b.column(2).to_pylist()):
            _, found, error = _assigned(ints, dims, books)
            code = ["".join(f"{e:0{digits}x}" for e in row) for row in found.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0)[k].values, b.column(1)[k].values, pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error, label_error) of each row, and the codebooks by part, entry and position.

    `code` holds an entry's number for each part, in hex digits; `error` the squared distances summed over the parts; `label_error` those summed over the label.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vector")).where(finite(F.col("vector")))
    dims = -(-max(longest(rows, "vector"), 1) // parts) * parts
    width = dims // parts
    limit = min(1 << 22, (1 << 31) // width)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = np.zeros((len(first), dims), np.int32)
    for k, row in enumerate(first):
        start[k, : len(row.vector)] = integers(np.array(row.vector), scale, limit)
    codebooks = start.reshape(len(first), parts, width).transpose(1, 0, 2).astype(np.int64)
    held = Written(blocks(rows, ["id", "label"], "vector", dims, scale, limit), "codes-blocks").df
    for _ in range(rounds if len(first) else 0):
        sums = held.select("ints").mapInArrow(partial(_sum_batches, dims=dims, codebooks=codebooks), "slot long, n long, sums array<long>")
        each = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)]
        found = sums.groupBy("slot").agg(F.sum("n").alias("n"), *each).select("slot", "n", F.array(*(f"s{k}" for k in range(width))).alias("sums")).collect()
        flat = codebooks.reshape(-1, width).copy()
        for row in found:
            flat[row.slot] = np.array(row.sums, np.int64) // row.n
        codebooks = flat.reshape(codebooks.shape)
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label")]
    coded = held.mapInArrow(partial(_code_batches, dims=dims, codebooks=codebooks), ", ".join([*kinds, "code string", "error long"]))
    coded = Written(coded, "codes").df
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("id", "label", "code", "error", "label_error"), codebooks
