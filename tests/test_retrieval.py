import random
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.operators import lineage, retrieval


def vectors(seed, n):
    r = random.Random(seed)
    rows = [(k, [r.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(4)]) for k in range(n)]
    return rows + [(n, [0.0] * 4), (n + 1, [1.0, 2.0]), (n + 2, [])]


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 7), (3, 500)])
def test_nearest_equals_all_pairs(spark, monkeypatch, seed, k):
    """Many ties, a zero vector, shorter ones, nulls; several blocks of either side."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    monkeypatch.setattr(retrieval, "ITEM_BLOCK", 16)
    rows = vectors(seed, 90)
    items = spark.createDataFrame([*rows, (1000, None), (None, [1.0] * 4), (1001, [1.0, None])], "chunk long, vector array<float>").repartition(3)
    asked = spark.createDataFrame([r for r in rows if r[0] % 7 == 0], "query long, vector array<double>")
    got = {}
    for r in retrieval.nearest(asked, items, k).collect():
        got.setdefault(r.query, []).append((r.rank, r.chunk, r.score))

    def unit(v):
        v = np.array([*v, *[0.0] * (4 - len(v))])
        return v / np.linalg.norm(v) if v.any() else v

    for query, v in rows:
        if query % 7 == 0:
            want = sorted((-round(float(unit(v) @ unit(w)), 9) or 0.0, c) for c, w in rows if c != query)[:k]
            assert [(n, c) for n, c, _ in sorted(got[query])] == [(n, c) for n, (_, c) in enumerate(want, 1)]
            assert [s for _, _, s in sorted(got[query])] == pytest.approx([-s for s, _ in want])
    assert retrieval.nearest(asked, items.limit(0), k).collect() == [] and retrieval.nearest(asked.limit(0), items, k).collect() == []


def test_a_pair_of_blocks_yields_k_rows_a_query():
    r = np.random.default_rng(1)
    block = lambda n, side: {f"{side}ids": [list(range(n))], f"{side}dims": [8], f"{side}vectors": [r.normal(size=(n, 8)).tobytes()]}
    batch = pa.RecordBatch.from_pydict(block(50, "q_") | block(2000, ""))
    out = list(partial(retrieval._best_of_blocks, k=5, digits=9)(iter([batch])))
    assert [len(b) for b in out] == [250]


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 5), (3, 10), (4, 400)])
def test_bounded_bm25_equals_the_whole(spark, seed, k):
    r = random.Random(seed)
    words = [f"word{n}x" for n in range(300)]
    text = lambda least, most: " ".join(words[min(int(r.expovariate(1 / 40)), 299)] for _ in range(r.randrange(least, most)))
    chunks = spark.createDataFrame([(n, text(0, 60)) for n in range(250)] + [(900, None)], "chunk_id long, text string").repartition(4)
    asked = spark.createDataFrame([(n, text(1, 25)) for n in range(30)] + [(77, ""), (78, "unheard"), (79, words[250] + " " + words[0] * 1)], "query long, query_text string")
    whole = retrieval.bm25_search(asked, chunks)
    whole = retrieval.ranked(whole.withColumn("score", retrieval.F.round("score", 6)), k)
    rows = lambda df: sorted((x.query, x.rank, x.chunk, round(x.score, 5)) for x in df.collect())
    assert rows(retrieval.bm25_top(asked, chunks, k)) == rows(whole) != []


def test_bounds_leave_pairs_out(spark):
    """A rare word and frequent ones: the frequent ones alone bring no chunk in."""
    r = random.Random(9)
    common = [f"common{n}y" for n in range(8)]
    chunks = spark.createDataFrame([(n, " ".join(r.sample(common, 5)) + (f" rare{n % 300}z special{n % 300}q" if n % 2 else "")) for n in range(3000)], "chunk_id long, text string")
    asked = spark.createDataFrame([(n, " ".join(common) + f" rare{2 * n + 1}z special{2 * n + 1}q") for n in range(20)], "query long, query_text string")
    found = retrieval.bm25_top(asked, chunks, 5)
    assert found.count() == 100 and {x.chunk % 300 for x in found.where("query = 0").collect()} == {1}
    written = [path for _, path in lineage._PATHS if "bm25-candidates" in path]
    assert spark.read.parquet(written[-1]).count() <= 0.05 * 20 * 3000


def test_words_are_counted_in_parts_of_bounded_text(spark, monkeypatch):
    """Twice the text has twice the parts, each as large as before; rows of one chunk stay together and short tables use all cores."""
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(retrieval, "DEALT_BYTES", 1000)
    rows = [(k, "receivables grew " * 30, "Note") for k in range(40)] + [(0, "grew", None)]
    docs = spark.createDataFrame(rows, "chunk_id int, text string, title string")
    parts = lambda df: retrieval.postings(df, headings=("title",)).rdd.getNumPartitions()
    once, twice = parts(docs), parts(docs.unionByName(docs))
    assert once == -(-(40 * (17 * 30 + 5) + 4) // 1000) and abs(twice - 2 * once) <= 1 and parts(docs.limit(1)) == cores
    got = {(r.chunk, r.term): (r.tf, r.length) for r in retrieval.postings(docs, headings=("title",)).collect()}
    assert got[0, "grew"] == (31, 63) and got[1, "grew"] == (30, 62) and len(got) == 120
