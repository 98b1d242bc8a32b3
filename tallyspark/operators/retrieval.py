"""Retrieval: BM25, dense similarity, rank fusion, boosts, packing and evaluation, as joins and grouped sums."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, estimate_tokens, expanded, stem, words
from .lineage import written

# Saturation and length weight of BM25, constant of the rank fusion, pools.
K1, B = 1.2, 0.75
RRF = 60
POOL = 20
HEADING_WEIGHT = 2
#: Vectors of a block of queries, and of items.
QUERY_BLOCK, ITEM_BLOCK = 512, 4096
#: The weightiest terms of a query that bound its k-th score.
BOUND_TERMS = 3
#: Bytes of text whose words one task counts.
DEALT_BYTES = 4 << 20


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", headings: tuple[str, ...] = ()) -> DataFrame:
    """(chunk, term, tf, length): term counts of each chunk; words of its `headings` (title, heading) count `HEADING_WEIGHT` times.

    Words are counted before they are stemmed, so each is stemmed once for a chunk. Only the texts are shuffled, by chunk, into as many parts
    as their size asks for, which is summed first; all counts are made where they then lie, so a task's memory doesn't grow with the table.
    """
    every = words(F.col(text_col))
    if headings:
        every = F.concat(F.coalesce(every, F.array().cast("array<string>")), F.flatten(F.array_repeat(words(F.concat_ws(" ", *headings)), HEADING_WEIGHT)))
    dealt = chunks.select(F.col(id_col).alias("chunk"), *{text_col, *headings})
    size = dealt.agg(F.sum(F.octet_length(F.concat_ws(" ", text_col, *headings)))).first()[0] or 0
    dealt = dealt.repartition(max(chunks.sparkSession.sparkContext.defaultParallelism, math.ceil(size / DEALT_BYTES)), "chunk")
    counted = dealt.select("chunk", F.explode(every).alias("word")).groupBy("chunk", "word").agg(F.count("*").alias("n"))
    wider = counted.select("chunk", "n", F.explode(expanded(F.col("word"))).alias("word")).where(~F.col("word").isin(*STOP_WORDS))
    each = wider.select("chunk", "n", stem(F.col("word")).alias("term"))
    found = each.groupBy("chunk", "term").agg(F.sum("n").alias("tf"))
    return found.withColumn("length", F.sum("tf").over(Window.partitionBy("chunk")))


def bm25(queries: DataFrame, index: DataFrame, n_chunks: Column, average: Column) -> DataFrame:
    """(query, chunk, score) of all pairs that share a term.

    queries: (query, term, qtf). The document frequency is a grouped count; terms meet postings by
    an equi-join, so a pair costs as many rows as it shares terms.
    """
    frequency = index.groupBy("term").agg(F.count("*").alias("df"))
    weighted = queries.join(frequency, "term").withColumn("idf", F.log(1 + (n_chunks - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    norm = K1 * (1 - B + B * F.col("length") / average)
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return weighted.join(index, "term").groupBy("query", "chunk").agg(F.sum(part).alias("score"))


def bm25_search(queries: DataFrame, chunks: DataFrame, query_col: str = "query", query_text: str = "query_text", id_col: str = "chunk_id", text_col: str = "text", headings: tuple[str, ...] = ()) -> DataFrame:
    """`bm25` of all chunks. The postings are written once, as frequencies, lengths and scores read them."""
    index = written(postings(chunks, id_col, text_col, headings), "bm25-postings")
    n, length = chunks.count(), index.agg(F.sum("tf")).first()[0]
    return bm25(_asked(queries, query_col, query_text), index, F.lit(float(n)), F.lit(float(length or 1) / max(n, 1)))


def _asked(queries: DataFrame, query_col: str, query_text: str) -> DataFrame:
    return postings(queries, query_col, query_text).select(F.col("chunk").alias("query"), "term", F.col("tf").alias("qtf"))


def bm25_top(queries: DataFrame, chunks: DataFrame, k: int, query_col: str = "query", query_text: str = "query_text", id_col: str = "chunk_id", text_col: str = "text", headings: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """(query, chunk, score, rank): the first k of `bm25_search`, by rounded score and then chunk, with most pairs left out before scores are summed.

    Each term has a largest impact: its weight times the greatest share that any chunk's count and length give. By it a query's terms are ordered; a
    lower bound of the k-th score is that of the k best chunks by the query's weightiest term alone. Terms at the end of the order whose impacts together
    don't reach that bound can't bring a chunk in by themselves: candidates are the chunks that hold one of the others, and only candidates meet those terms.
    """
    index = written(postings(chunks, id_col, text_col, headings), "bm25-postings")
    n, length = chunks.count(), index.agg(F.sum("tf")).first()[0]
    n, average = float(n), float(length or 1) / max(n, 1)
    norm = K1 * (1 - B + B * F.col("length") / average)
    share = (F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("share")
    terms = index.select("term", share).groupBy("term").agg(F.count("*").alias("df"), F.max("share").alias("most"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = _asked(queries, query_col, query_text).join(terms, "term").select("query", "term", "df", (F.col("qtf") * idf).alias("weight"), (F.col("qtf") * idf * F.col("most")).alias("impact"))
    by_impact = Window.partitionBy("query").orderBy(F.desc("impact"), "term")
    asked = asked.withColumn("turn", F.row_number().over(by_impact)).withColumn("rest", F.sum("impact").over(by_impact.rowsBetween(0, Window.unboundedFollowing)))
    asked = written(asked, "bm25-asked")
    scored = index.select("term", "chunk", share)
    # Of each query's first terms the one that most chunks share among those few whose k-th best is known to bound the k-th score.
    firsts = asked.where(F.col("turn") <= BOUND_TERMS).join(scored, "term").select("query", "turn", "chunk", (F.col("weight") * F.col("share")).alias("score"))
    bound = firsts.groupBy("query", "chunk").agg(F.sum("score").alias("score")).withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "chunk")))
    bound = bound.where(F.col("n") <= k).groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
    # A thousandth of rounding is kept clear.
    told = asked.join(bound, "query", "left").withColumn("leads", F.coalesce(F.col("rest") >= F.col("bound") - 10.0 ** (1 - digits), F.lit(True)))
    told = written(told.select("query", "term", "weight", "leads"), "bm25-leads")
    part = (F.col("weight") * F.col("share")).alias("part")
    lead = told.where("leads").join(scored, "term").select("query", "chunk", part).groupBy("query", "chunk").agg(F.sum("part").alias("part"))
    lead = written(lead, "bm25-candidates")
    follow = told.where("not leads").join(scored, "term").select("query", "chunk", part).join(lead.select("query", "chunk"), ["query", "chunk"], "left_semi")
    every = lead.unionByName(follow).groupBy("query", "chunk").agg(F.round(F.sum("part"), digits).alias("score"))
    return ranked(every, k)


def ranked(scores: DataFrame, limit: int = POOL, by: str = "query", item: str = "chunk") -> DataFrame:
    """Adds `rank` from 1 by falling score, ties by item, and keeps the first `limit`."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc(item))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def normalised(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    size = F.sqrt(dot(a, a))
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def _vector_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of ids and vectors of length 1 (a zero vector stays), as arrays of one row each."""
    for b in batches:
        for k in range(0, len(b), rows):
            part = b.slice(k, rows)
            ids, column = part.column(0), part.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            matrix = np.zeros((len(part), int(sizes.max(initial=0))))
            matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
            lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
            matrix /= np.where(lengths > 0, lengths, 1)
            packed = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids), pa.array([matrix.shape[1]], pa.int32()), pa.array([matrix.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(packed, names=["ids", "dims", "vectors"])


def _best_of_blocks(batches: Iterator[pa.RecordBatch], k: int, digits: int) -> Iterator[pa.RecordBatch]:
    """The k best of a block of vectors for each query of a block; equal scores by id."""

    def block(b: pa.RecordBatch, i: int, side: str) -> tuple[np.ndarray, np.ndarray]:
        dims, ids = b.column(f"{side}dims")[i].as_py(), b.column(f"{side}ids")[i].values
        return ids, np.frombuffer(b.column(f"{side}vectors")[i].as_py(), np.float64).reshape(len(ids), dims)

    for b in batches:
        for i in range(len(b)):
            (asked, q), (found, x) = block(b, i, "q_"), block(b, i, "")
            d = min(q.shape[1], x.shape[1])
            scores = np.round(q[:, :d] @ x[:, :d].T, digits)
            queries, chunks = asked.to_numpy(zero_copy_only=False), found.to_numpy(zero_copy_only=False)
            scores[queries[:, None] == chunks[None, :]] = -np.inf
            order = np.argsort(chunks, kind="stable")
            scores = scores[:, order]
            n = min(k, scores.shape[1])
            # Columns go by id, so a stable sort of what reaches the n-th score leaves ties in their order.
            least = -np.partition(-scores, n - 1, axis=1)[:, n - 1 : n]
            row, col = np.nonzero((scores >= least) & np.isfinite(scores))
            best = np.lexsort((col, -scores[row, col], row))
            row, col = row[best], col[best]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < n
            row, col = row[kept], col[kept]
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(row)), found.take(pa.array(order[col])), pa.array(scores[row, col])], names=["query", "chunk", "score"])


def nearest(queries: DataFrame, items: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(query, chunk, score, rank): the k items of the greatest cosine similarity (rounded) to each query, itself aside; ties by chunk.

    queries: (query, vector), a stated set; items: (chunk, vector). Rows with a null id or vector take no part. Vectors are brought to length 1 once, while they are packed in
    blocks; each block of queries meets each block of items under a key of their own, and a pair of blocks yields at most k rows a query, so
    that what is shuffled are k rows for each query and block, not pairs.
    """

    def blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
        rows = rows.select(F.col(key).alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id is not null and vector is not null and forall(vector, x -> x is not null)")
        packed = rows.mapInArrow(partial(_vector_blocks, rows=size), f"ids array<{rows.schema['id'].dataType.simpleString()}>, dims int, vectors binary")
        return written(packed.withColumn("block", F.monotonically_increasing_id()), "nearest-blocks")

    q, x = blocks(queries, "query", QUERY_BLOCK), blocks(items, "chunk", ITEM_BLOCK)
    n = max(1, q.count())
    numbered = q.withColumn("part", F.row_number().over(Window.orderBy("block")) - 1)
    q = numbered.select("part", *(F.col(c).alias(f"q_{c}") for c in ("ids", "dims", "vectors")))
    met = x.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(q, "part").drop("part", "block")
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, chunk {items.schema['chunk'].dataType.simpleString()}, score double"
    return ranked(met.mapInArrow(partial(_best_of_blocks, k=k, digits=digits), kinds), k)


def fuse(*rankings: tuple[DataFrame, float]) -> DataFrame:
    """Reciprocal rank fusion of (query, chunk, rank) tables, each with a weight."""
    parts = [r.select("query", "chunk", (F.lit(float(w)) / (RRF + F.col("rank"))).alias("part")) for r, w in rankings]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("query", "chunk").agg(F.sum("part").alias("score"))


def boosted(scores: DataFrame, boosts: DataFrame) -> DataFrame:
    """Scores times 1 + boost of their chunk."""
    return scores.join(boosts, "chunk", "left").withColumn("score", F.round(F.col("score") * (1 + F.coalesce("boost", F.lit(0.0))), 6)).drop("boost")


def allowed(column: str, value: str) -> Column:
    """A facet without entries allows everything."""
    return (F.size(column) == 0) | F.array_contains(column, value)


def pack(hits: DataFrame, budget: int, by: str = "query", text_col: str = "text") -> DataFrame:
    """The hits in rank order until their tokens exceed the budget; the first is always kept."""
    so_far = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(estimate_tokens(F.col(text_col))).over(so_far)).where((F.col("used") <= budget) | (F.col("rank") == 1))


def evaluate(hits: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Recall at each k and mean reciprocal rank. expected: (query, chunk); a query's best expected hit counts."""
    best = hits.join(expected, ["query", "chunk"]).groupBy("query").agg(F.min("rank").alias("best"))
    every = expected.select("query").distinct().join(best, "query", "left")
    return every.agg(F.count("*").alias("queries"), *(F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks), F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("mrr"))


def rerank(hits: DataFrame, scorer, pool: int = 8, weight: float = 2.0) -> DataFrame:
    """Fuses the ranking with that of `scorer` (a column of the query's and the chunk's text) over its first `pool` hits.

    hits: (query, query_text, chunk, text, rank).
    """
    head = hits.where(F.col("rank") <= pool).withColumn("score", scorer(F.col("query_text"), F.col("text")).cast("double"))
    return fuse((hits, 1.0), (ranked(head.drop("rank"), pool), weight))
