import hashlib
import math
import random

import numpy as np
import pytest

from tallyspark.llm import codes
from tallyspark.llm.queries import op12_vector_codes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed,width,spread", [(1, 16, 40), (2, 16, 3), (3, 5, 1000), (4, 1, 2), (5, 32, 1 << 22), (6, 3, 1)])
def test_nearest_equals_all_distances(seed, width, spread):
    r = np.random.default_rng(seed)
    x, c = r.integers(-spread, spread + 1, (300, width)), r.integers(-spread, spread + 1, (200, width))
    x[:40], c[100:] = c[:40], c[:100]  # exact hits and ties
    entry, far, _ = codes.nearest(codes.Parts(x), codes.Parts(c))
    every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert entry.tolist() == every.argmin(axis=1).tolist() and far.tolist() == every.min(axis=1).tolist()


def test_bounds_filter_most_entries():
    r = np.random.default_rng(9)
    centres = r.normal(0, 300, (256, 16)).astype(int)
    x = centres[r.integers(0, 256, 2000)] + r.integers(-20, 21, (2000, 16))
    entry, _, taken = codes.nearest(codes.Parts(x), codes.Parts(centres))
    assert taken < 0.1 * 2000 * 256


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(k, [math.floor(scale * float(np.float32(a))) for a in v], label) for k, v, label in rows if v is not None and all(a is not None and math.isfinite(a) for a in v)]
    dims = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    w = dims // parts
    kept = [(k, v + [0] * (dims - len(v)), label) for k, v, label in kept]
    first = [v for _, v, _ in sorted(kept, key=lambda t: (t[0] is None, t[0] or 0, t[1]))[:entries]]
    books = [[f[p * w : p * w + w] for f in first] for p in range(parts)]

    def assign(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * w : p * w + w], c)), j) for j, c in enumerate(books[p]))

    for _ in range(rounds):
        found = [[assign(p, v)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [v[p * w : p * w + w] for (_, v, _), f in zip(kept, found) if f[p] == j]
                if mine:
                    books[p][j] = [sum(col) // len(mine) for col in zip(*mine)]
    out, totals = [], {}
    for k, v, label in kept:
        found = [assign(p, v) for p in range(parts)]
        out.append((k, label, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
        totals[label] = totals.get(label, 0) + out[-1][3]
    return sorted(map(repr, [(*row, totals[row[1]]) for row in out])), books


def rows_of(seed, n, dims, clusters=6):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    return [(k, [float(np.float32(c + r.gauss(0, 0.1))) for c in r.choice(centres)], r.choice([None, 1, 2, 3])) for k in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed,n,dims,entries", [(1, 120, 16, 32), (2, 90, 6, 256), (3, 60, 4, 7)])
def test_equals_brute_force(spark, seed, n, dims, entries):
    rows = rows_of(seed, n, dims)
    rows += rows[:5] + [(1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")] * dims, 1), (1003, [float("inf")] * dims, 2), (None, [0.5] * dims, None), (1004, [0.25], 3), (1005, [], 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found, books = codes.compress(df, entries=entries)
    expected, slow = brute(rows, entries=entries)
    assert sorted(map(repr, map(tuple, found.collect()))) == expected and books.tolist() == slow


def test_cases(spark):
    df = spark.createDataFrame([(1, [1e30, -1e30, 0.0, 1.0], 1, 2)], "vec_id long, embedding array<float>, id long, vector long").withColumnRenamed("id", "label")
    found, books = codes.compress(df)
    assert [tuple(r) for r in found.collect()] == [(1, 1, "00000000", 0, 0)] and books.ravel().tolist() == [1 << 22, -(1 << 22), 0, 1024]
    bare = spark.createDataFrame([(1, [], 1), (2, [], None)], SCHEMA)
    assert sorted(tuple(r) for r in codes.compress(bare)[0].select("id", "code", "error").collect()) == [(1, "00000000", 0), (2, "00000000", 0)]
    empty, books = codes.compress(df.limit(0))
    assert empty.collect() == [] and books.size == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").limit(10**9).collect()]
    every = {r.vec_id: r for r in op12_vector_codes(spark, SF).collect()}
    kept = np.array([[math.floor(1024 * a) for a in v] for _, v, _ in sorted(rows, key=lambda t: t[0])])
    books = [kept[:256, 16 * p : 16 * p + 16].copy() for p in range(4)]
    far = lambda p: ((kept[:, None, 16 * p : 16 * p + 16] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(4):
        for p in range(4):
            found = far(p).argmin(axis=1)
            for j in set(found.tolist()):
                books[p][j] = kept[found == j, 16 * p : 16 * p + 16].sum(axis=0) // (found == j).sum()
    digest = hashlib.sha256(",".join(str(a) for b in books for e in b for a in e.tolist()).encode()).hexdigest()
    found = np.stack([far(p).argmin(axis=1) for p in range(4)], axis=1)
    error = sum(far(p).min(axis=1) for p in range(4))
    order = sorted(r[0] for r in rows)
    assert len(every) == len(rows)
    for k, code, e in zip(order, found.tolist(), error.tolist()):
        assert (every[k].code, every[k].error, every[k].codebooks_sha256) == (bytes(code).hex(), e, digest)
