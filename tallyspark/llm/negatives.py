"""Hard-negative mining by distributed radix selection.

Anchors are a stated set of rows; each is scored against all rows, in blocks, by the inner product of integer vectors. The best
rows of an anchor's label are its positives; a positive opens a *window* of scores, and the best rows of other labels in
it are its hard negatives. Both are one selection: the k best rows of a window [low, high] of scores. A window's rows are counted by the
digits of ``high - score``: one histogram a window and round, `DIGIT` bits at a time from the highest, names the
bucket that holds the k-th row, and the next round counts inside that bucket only, until the k-th score is known. Only rows that
score as much or more are then gathered, at most k a window and task, as ties go to the smaller id.

Rows are packed once as blocks of integers. Each round meets blocks of rows with parts of some `PART` windows' anchors by an equi-join
on the part (a stated query set against all rows: the scores are as many as rows times anchors, but no row of theirs leaves a task
other than counts and the k best). Tasks return a count for each window and used digit, summed by Spark, so neither a window nor a hot label is ever gathered in one task.

Defined cases: rows with a null id, a null label, a null vector or a null or non-finite component take no part. An anchor's
other rows are those of another id. Repeated rows count each, as anchors, positives and negatives; ties in both score and id give equal
results in either order. A component is held within 2^22 after scaling; shorter vectors end in zeros. A
positive score below zero has no negatives; one of zero those that score zero. An empty table gives an empty result; columns beside the three named ones are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written
from .vectors import blocks, finite, matrix_of

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative scores at least this part of the positive, in hundredths, and at most as much.
LEAST = 80
#: Bits of a digit, and anchors of a part.
DIGIT, PART = 8, 512
#: Blocks of rows that meet a part under one key.
SLICE_BLOCKS = 4
LIMIT = 1 << 22


class _Anchors:
    """The anchors of a part: ids, labels, vectors and windows."""

    def __init__(self, row: dict, dims: int):
        self.ids, self.labels = (np.array([a[c] for a in row["anchors"]], np.int64) for c in ("id", "label"))
        self.matrix = matrix_of(b"".join(a["ints"] for a in row["anchors"]), dims).astype(np.int64)
        own = [len(a["windows"]) for a in row["anchors"]]
        self.of = np.repeat(np.arange(len(own)), own)
        self.window, self.high, self.low = (np.array([w[c] for a in row["anchors"] for w in a["windows"]], np.int64) for c in ("window", "high", "low"))

    def scores(self, matrix: np.ndarray) -> np.ndarray:
        """Exact inner products; as floats where all sums of products are whole there."""
        if not len(matrix) or int(np.abs(self.matrix).max(initial=0)) * int(np.abs(matrix).max(initial=0)) * matrix.shape[1] < 1 << 53:
            return (self.matrix.astype(np.float64) @ matrix.T.astype(np.float64)).astype(np.int64)
        return self.matrix @ matrix.T.astype(np.int64)

    def inside(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(windows, rows, scores) of the rows that stand in windows, a window's number being its place in the part."""
        scores = self.scores(matrix)
        fit = (self.labels[:, None] == labels[None, :]) if same else (self.labels[:, None] != labels[None, :])
        fit &= self.ids[:, None] != ids[None, :]
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.of, self.low)
        anchor, row = np.nonzero(fit & (scores >= least[:, None]))
        score = scores[anchor, row]
        first = np.searchsorted(self.of, anchor)
        count = np.bincount(self.of, minlength=len(self.ids))[anchor]
        for n in range(int(count.max(initial=0))):
            there = count > n
            w, r, s = first[there] + n, row[there], score[there]
            fits = (s >= self.low[w]) & (s <= self.high[w])
            yield w[fits], r[fits], s[fits]


def _met(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[int, _Anchors, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, anchors, ids, labels, matrix) of each block of rows that meets a part."""
    part, anchors = None, None
    for b in batches:
        for k in range(len(b)):
            row = b.slice(k, 1)
            number = row.column("part")[0].as_py()
            if number != part:
                part, anchors = number, _Anchors(row.select(["anchors"]).to_pylist()[0], dims)
            ids, labels = (row.column(c)[0].values.to_numpy().astype(np.int64) for c in ("id", "label"))
            yield part, anchors, ids, labels, matrix_of(row.column("ints")[0].as_py(), dims)


def _count_batches(batches: Iterator[pa.RecordBatch], dims: int, same: bool, shift: int) -> Iterator[pa.RecordBatch]:
    """(window, digit, n) of a task's rows; counts of a part are held until the next one comes."""
    held, counts, now = None, None, None

    def told() -> pa.RecordBatch:
        w, d = np.nonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(held.window[w]), pa.array(d.astype(np.int32)), pa.array(counts[w, d])], names=["window", "digit", "n"])

    for part, anchors, ids, labels, matrix in _met(batches, dims):
        if part != now:
            if held is not None:
                yield told()
            now, held, counts = part, anchors, np.zeros((len(anchors.window), 1 << DIGIT), np.int64)
        for w, _, s in anchors.inside(ids, labels, matrix, same):
            counts += np.bincount((w << DIGIT) + ((anchors.high[w] - s) >> shift), minlength=counts.size).reshape(counts.shape)
    if held is not None:
        yield told()


def _best_batches(batches: Iterator[pa.RecordBatch], dims: int, same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """(window, id, score) of the k best rows of each window and block; windows hold no row below the k-th score."""
    for _, anchors, ids, labels, matrix in _met(batches, dims):
        for w, r, s in anchors.inside(ids, labels, matrix, same):
            order = np.lexsort((ids[r], -s, w))
            w, r, s = w[order], r[order], s[order]
            edges = np.searchsorted(w, w)
            kept = np.arange(len(w)) - edges < k
            if kept.any():
                yield pa.RecordBatch.from_arrays([pa.array(anchors.window[w[kept]]), pa.array(ids[r[kept]]), pa.array(s[kept])], names=["window", "id", "score"])


def _meeting(held: DataFrame, anchors: DataFrame, windows: DataFrame, parts: int, slices: int) -> DataFrame:
    """Each block of rows with each part of the anchors that have windows; of either side a few lie under one key."""
    own = windows.groupBy("anchor").agg(F.collect_list(F.struct("window", "high", "low")).alias("windows"))
    rows = anchors.join(own, "anchor").groupBy("part").agg(F.collect_list(F.struct("id", "label", "ints", "windows")).alias("anchors"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("slice", each(slices))
    mine = held.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")).withColumn("part", each(parts))
    return mine.join(rows, ["part", "slice"]).select("part", "anchors", "id", "label", "ints")


def _selected(windows: DataFrame, k: int, meeting: partial, dims: int, same: bool) -> DataFrame:
    """(window, id, score, rank) of the k best rows of each window (window, anchor, high, low), higher scores and then smaller ids first."""
    widest = windows.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    rounds = -(-max(int(widest or 0).bit_length(), 1) // DIGIT)
    # `goal`: which of the rows in the window's present bucket is the k-th of the window.
    state = windows.withColumn("goal", F.lit(k).cast("long"))
    for n in range(rounds - 1, -1, -1):
        shift, mine = n * DIGIT, Window.partitionBy("window")
        counts = meeting(windows=state).mapInArrow(partial(_count_batches, dims=dims, same=same, shift=shift), "window long, digit int, n long")
        counts = counts.groupBy("window", "digit").agg(F.sum("n").alias("n"))
        counts = counts.select("window", "digit", "n", F.sum("n").over(mine.orderBy("digit")).alias("upto"), F.sum("n").over(mine).alias("every"))
        # The bucket of the k-th row, or of the last where the window has fewer.
        found = counts.join(state.select("window", "goal"), "window").withColumn("goal", F.least("goal", "every")).where("upto >= goal and upto - n < goal")
        found = found.select("window", "digit", F.expr("goal - upto + n").alias("goal"))
        top = F.col("high") - F.shiftleft(F.col("digit").cast("long"), shift)
        state = state.drop("goal").join(found, "window").select("window", "anchor", top.alias("high"), F.greatest(F.col("low"), top - ((1 << shift) - 1)).alias("low"), "goal")
        state = Written(state, "negatives-windows").df
    # Down to the score of the k-th row; windows without any row have gone.
    wanted = windows.drop("low").join(state.select("window", "low"), "window")
    best = meeting(windows=wanted).mapInArrow(partial(_best_batches, dims=dims, same=same, k=k), "window long, id long, score long")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, scale: int = SCALE, part: int = PART, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row where `anchor` holds.

    Scores are inner products of floor(scale * component). An anchor's positives are its best `positives` other rows of the same label; a
    positive's negatives the best `negatives` rows of other labels whose score is between `least` hundredths of the positive's and all of it.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("id is not null and label is not null").where(finite(F.col("vector")))
    n, most = rows.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))).first()
    dims, most = max(n or 0, 1), min(int((most or 0) * scale) + 1, LIMIT)
    held = Written(blocks(rows, ["id", "label", "anchor"], "vector", dims, scale, LIMIT).withColumn("block", F.monotonically_increasing_id()), "negatives-blocks").df
    n_blocks, n_anchors = held.agg(F.count("*"), F.sum(F.size(F.filter("anchor", lambda a: a)))).first()
    parts, slices = -(-max(n_anchors or 0, 1) // part), -(-max(n_blocks, 1) // slice_blocks)
    chosen = held.select(F.posexplode(F.arrays_zip("id", "label", "anchor")).alias("at", "row"), "ints").where("row.anchor")
    chosen = chosen.select("row.id", "row.label", F.expr(f"substring(ints, at * {4 * dims} + 1, {4 * dims})").alias("ints")).withColumn("anchor", F.monotonically_increasing_id())
    anchors = Written(chosen.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int")), "negatives-anchors").df
    meeting = partial(_meeting, held.select("block", "id", "label", "ints"), anchors, parts=parts, slices=slices)
    # No score is beyond this.
    bound = dims * most * most
    all_scores = anchors.select(F.col("anchor").alias("window"), "anchor", F.lit(bound).cast("long").alias("high"), F.lit(-bound).cast("long").alias("low"))
    found = _selected(all_scores, positives, meeting, dims, True).select(F.col("window").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = Written(found.where("positive_score >= 0").withColumn("window", F.monotonically_increasing_id()), "negatives-positives").df
    low = F.expr(f"({least} * positive_score + 99) div 100")
    windows = found.select("window", "anchor", F.col("positive_score").alias("high"), low.alias("low"))
    best = _selected(windows, negatives, meeting, dims, False).select("window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return best.join(named, "window").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
