import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import simhash
from tallyspark.llm.components import connected_components
from tallyspark.llm.queries import op1_simhash_near_dedup

SF = "/root/testdata/sf0.001"


def brute_components(ids, fps, bits=3):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (int(fps[i]) ^ int(fps[j])).bit_count() <= bits:
            parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(least.get(root(i), x), x)
    return {x: least[root(i)] for i, x in enumerate(ids)}


def test_golay_keys_meet_at_one_bit():
    table = simhash.golay_table()
    assert table.shape == (1 << 23,) and np.bincount(table, minlength=4096).tolist() == [2048] * 4096
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for segment in simhash.SEGMENTS:
        key, rows, near = simhash.segment_keys(fps, segment)
        sets = {k: set(near[rows == k].tolist()) for k in range(len(fps))}
        assert max(map(len, sets.values())) <= 6
        low, bits = segment
        for bit in range(low, low + bits):
            moved = simhash.segment_keys(fps ^ np.uint64(1 << bit), segment)[0]
            assert all(int(m) in sets[k] for k, m in enumerate(moved))


@pytest.mark.parametrize("block", [4, 2048])
def test_links_find_every_pair_of_three_bits(spark, block):
    rng = np.random.default_rng(1)
    fps = set(rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist())
    for f in list(fps)[:12]:
        for _ in range(6):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            fps.add(f ^ int(sum(1 << int(b) for b in flips)))
    fps = sorted(fps)
    rows = [(int(np.uint64(f).astype(np.int64)), k) for k, f in enumerate(fps)]
    links = simhash.links(spark.createDataFrame(rows, "fp long, node long"), block=block)
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = brute_components(range(len(fps)), fps)
    assert {k: got.get(k, k) for k in want} == want


def test_query_equals_brute_force(spark):
    got = op1_simhash_near_dedup(spark, SF).toPandas()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {k: simhash.fingerprint((t or "").encode()) for k, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got.itertuples()} == fps
    assert dict(zip(got.doc_id, got.component_id)) == brute_components(list(fps), list(fps.values()))


def slow_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n\t", "One", "one TWO", "a b c d a b c d", "É é x y\x0bz", "w " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_awkward_rows(spark):
    rows = [(1, "a b c d", 9), (1, "a b c d", 9), (None, "A B c d", 9), (None, "zz yy", 2), (None, "zz yy", 2), (3, None, 1), (4, "", 1), (5, "q", None), (6, "long " * 40000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id, r.text and r.text[:7], r.fp) for r in simhash.deduplicate(docs).collect() if r.doc_id is not None)
    assert got == [(1, "a b c d", 9), (3, None, 1), (5, "q", None), (6, "long lo", 1)]
    assert [r.text for r in simhash.deduplicate(docs).where("doc_id is null").collect()] == ["zz yy"]
    assert simhash.deduplicate(docs.limit(0)).count() == 0 and simhash.deduplicate(docs).columns == docs.columns


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert {k for k, v in got.items() if v == 0} == set(range(1, 31)) and {k for k, v in got.items() if v == 100} == set(range(101, 160))
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert F is not None
