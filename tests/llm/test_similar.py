import itertools
import random

import corpus_pipeline
from tallyspark.llm import similar, simhash

SF = "/root/testdata/sf0.001"


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Components over all pairs of similarity 0.8 or more; the smallest id of each."""
    found, least = {k: sets(t) for k, t in rows}, {k: k for k, _ in rows}
    for a, b in itertools.combinations(sorted(found), 2):
        x, y = found[a], found[b]
        if len(x & y) >= 0.8 * len(x | y) and least[a] != least[b]:
            low, high = sorted((least[a], least[b]))
            least = {k: low if v == high else v for k, v in least.items()}
    return set(least.values())


def corpus(seed=3, bases=12, copies=14):
    """Bases with changed copies at similarities around 0.8, chains among them, and texts that share a passage only."""
    r = random.Random(seed)
    word = lambda: "w" + str(r.randrange(5000))
    shared = [word() for _ in range(40)]
    texts = [" ".join(shared + [word() for _ in range(160)]) for _ in range(20)]
    for _ in range(bases):
        last = [word() for _ in range(r.randrange(60, 300))]
        base = list(last)
        for k in range(copies):
            last = list(last if k % 2 else base)
            for _ in range(r.randrange(1, 2 + len(last) // 40)):
                last[r.randrange(len(last))] = word()
            texts.append(" ".join(last))
    r.shuffle(texts)
    return list(enumerate(texts))


def test_stage_equals_brute_force_on_near_copies(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len(want) < len(rows) - 60
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()} == want
    assert {r.doc_id for r in similar.deduplicate(docs, block=3).collect()} == want


def test_fingerprints_that_agree_by_chance_are_no_copies(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "c b c d e f g h i j k"), (3, None), (4, " "), (5, "A  b c\nd e f")], "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.deduplicate(docs).collect()) == [1, 2, 3]


def test_stage_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()} == want


def test_stage_asks_simhash_for_candidates(spark, monkeypatch):
    texts = [" ".join(f"w{(k * 37 + n * n) % 4001}" for n in range(400)) for k in range(5)]
    texts += [t + " more" for t in texts] + ["a b c d e f", "c b c d e f g h i j k"]
    fps = [simhash.fingerprint(t.encode()) for t in texts]
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3}
    assert len(want) >= 5
    nodes = spark.createDataFrame([(n, fp - (1 << 64 if fp >> 63 else 0)) for n, fp in enumerate(fps)], "node long, fp long")
    assert {tuple(sorted((r.src, r.dst))) for r in similar.fingerprint_pairs(nodes).collect()} == want
    asked, real = [], similar.fingerprint_pairs
    monkeypatch.setattr(similar, "fingerprint_pairs", lambda given: asked.append(given.columns) or real(given))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()} == brute(list(enumerate(texts)))
    assert asked == [["node", "fp"]]
