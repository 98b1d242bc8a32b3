import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import negatives
from tallyspark.llm.queries import op11_hard_negatives

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"
EVERY = 10


def brute(rows, every=EVERY, positives=5, k=5, least=80, scale=256):
    kept = [(i, [math.floor(scale * float(np.float32(a))) for a in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(a is not None and math.isfinite(a) for a in v)]
    out = []
    for i, v, label in kept:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in kept if j != i)
        for s, j, _ in [t for t in scored if t[2] == label][:positives]:
            found = [(n, t) for n, t, m in scored if m != label and least * -s <= 100 * -n <= 100 * -s]
            out += [(i, j, r, t, -s, -n) for r, (n, t) in enumerate(found[:k], 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % EVERY == 0, F.col("label"), **options).collect()))


def rows_of(seed, n, dims, spread, labels=4):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(3)]
    return [(k, [float(np.float32(c + r.gauss(0, spread))) for c in r.choice(centres)], r.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize("seed,spread,part,slice_blocks", [(1, 0.3, 512, 4), (2, 0.0, 3, 1), (3, 1.0, 4, 2), (4, 0.02, 7, 1)])
def test_equals_brute_force(spark, seed, spread, part, slice_blocks):
    """Spread 0 makes three groups of equal vectors: nothing but ties."""
    rows = rows_of(seed, 150, 6, spread)
    assert brute(rows) and mined(spark.createDataFrame(rows, SCHEMA).repartition(6), part=part, slice_blocks=slice_blocks) == brute(rows)


def test_cases(spark):
    rows = rows_of(5, 60, 4, 0.3)
    rows += rows[:12] + rows[:3] + [(None, [1.0] * 4, 1), (100, None, 1), (110, [1.0, None, 1.0, 1.0], 1), (120, [float("nan")] * 4, 1), (130, [float("-inf")] * 4, 1), (140, [1.0] * 4, None), (150, [0.5], 1), (160, [], 1), (170, [1e30, 1.0, 1.0, 1.0], 2), (171, [1e30, 1.0, 1.0, 1.0], 2), (172, [1e30, 1.0, 1.0, 1.0], 3)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", part int, block string").repartition(3)
    found = mined(df, part=5)
    clear = [t for t in found if t[0] < 170 and t[1] < 170 and t[3] < 170]
    assert {t[0] for t in found} <= {t[0] for t in rows if t[0] is not None and t[0] % EVERY == 0 and t[2] is not None}
    # A component beyond the limit counts as the limit.
    held = [(i, [min(a, (1 << 22) / 256) if a is not None and math.isfinite(a) else a for a in v] if v is not None else v, m) for i, v, m in rows]
    assert found == brute(held) and clear
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id % 10 <> 0")) == [] and mined(df.where("label = 1")) == []


def test_scores_beyond_whole_floats(spark):
    big = [(k, [16383.0 - (k % 3), 16383.0 - (k % 5) / 8, -(k % 7) / 16, 0.125 * k], k % 2) for k in range(60)]
    assert mined(spark.createDataFrame(big, SCHEMA)) == brute(big) != []


def test_query(spark):
    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op11_hard_negatives(spark, SF).collect())) == brute(rows, every=100) != []
