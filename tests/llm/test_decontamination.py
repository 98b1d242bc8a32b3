import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import decontamination as d
from tallyspark.llm.queries import op9_decontamination

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w, hit, who = words(text), set(), set()
    for k, item in items:
        x = words(item)
        for i in range(max(1, len(x) - window + 1) if x else 0):
            p = x[i : i + window]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit |= set(range(j, j + len(p)))
                    who.add(str(k))
    return len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)


ITEMS = [(10, "One two three four five six seven eight nine ten eleven"), (2, "short item"), (3, ""), (4, None), (5, "Ünïcode wörd"), (6, "short item"), (None, "nobody owns this")]
TEXTS = [
    "x one TWO, three-four five six seven eight nine ten eleven y", "two three four five six seven eight nine ten eleven twelve", "one two three four five six seven eight nine", "Short ITEM short item", "shorts item", "",
    None, "ünïcode wörd!  ünïcode wörd", "nobody owns this", "short " * 20000 + "item", "Ünïcode wörd K short\x7fitem",
]


def columns(spark, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id int, text string")
    found = d.contaminated(docs, bench, name="c", **options).select("doc_id", "c.*")
    return {r.doc_id: (r.n_words, sum(x.end_word - x.first_word for x in r.runs), len(r.items), hashlib.sha256(",".join(r.items).encode()).hexdigest(), bool(r.runs)) for r in found.collect()}


@pytest.mark.parametrize("most_bytes", [0, d.MOST_BYTES])
def test_against_brute_force(spark, most_bytes):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = columns(spark, docs, ITEMS, most_bytes=most_bytes)
    owned = [i for i in ITEMS if i[0] is not None]
    for k, t in enumerate(TEXTS):
        want = brute(t, owned)
        assert got[k] == want or (k == 8 and got[k][1] == 3), (k, got[k], want)


def test_offsets_point_at_the_original(spark):
    docs = spark.createDataFrame([(1, TEXTS[0])], "doc_id int, text string")
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    run = docs.select(d.contamination(F.col("text"), bench).alias("c")).first().c.runs[0]
    assert TEXTS[0][run.start : run.end] == "one TWO, three-four five six seven eight nine ten eleven"


def test_query_equals_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op9_decontamination(spark, SF).collect()}
    hit = [k for k, v in got.items() if v[4]]
    assert hit and set(got) == set(texts)
    for k in hit[:4] + [k for k in got if k not in hit][:4]:
        assert got[k] == brute(texts[k], items)


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([(1, "short item", 5, "x"), (1, "short item", 5, "x"), (2, "clean", 5, "x"), (None, None, None, None)], "doc_id int, text string, n_words int, items string")
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    kept = d.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]
    assert d.decontaminate(docs, bench.limit(0)).count() == 4 and d.decontaminate(docs.limit(0), bench).count() == 0


def test_one_and_several_automata_equal_brute_force_on_random_texts(spark):
    """Few words, so that windows start anywhere, overlap, repeat in items and end with them."""
    r = random.Random(7)
    text = lambda n, words=5: " ".join("abcdefgh"[r.randrange(words)] for _ in range(n))
    items = [(k, text(r.choice([1, 3, 4, 9, 10, 11, 13, 24, 40]))) for k in range(60)]
    texts = [text(r.randrange(80), 6) for _ in range(40)] + [text(20, 8) + " " + items[k][1] + " " + text(20, 8) for k in range(0, 60, 3)]
    texts += [" ".join(items[k][1].split()[3:13]) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = {k: brute(t, items) for k, t in enumerate(texts)}
    assert columns(spark, docs, items) == want and columns(spark, docs, items, most_bytes=700) == want
    assert {w[1] for w in want.values()} > {0, 10}


def test_a_larger_benchmark_costs_little_more():
    """The automaton takes one step a letter whatever it holds; what it meets, and the windows looked up around that, are counted: with 5 MB of benchmark less than one window for each word."""
    r = random.Random(1)
    made = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(30_000)]
    draw = lambda n: " ".join(made[min(int(r.expovariate(1 / 2000)), 29_999)] for _ in range(n)).encode()
    items = [(str(k), draw(60)) for k in range(15_000)]
    texts = [d.words(draw(400)) for _ in range(300)]
    large, n = d.Automaton(items, 10), sum(map(len, texts))
    met = sum(1 for t in texts for _ in large.built.iter(d.line(t)))
    assert sum(len(t) for _, t in items) > 4_500_000 and met < 0.02 * n
    assert all(large.scan(t) == ([], set()) for t in texts)
    assert all(large.scan(d.words(items[k][1]))[1] == {str(k)} for k in range(0, 15_000, 500))


def test_parts_are_bounded(spark):
    items = spark.createDataFrame([(str(k), "x" * (k % 50), k % 50 + 1) for k in range(500)], "item string, text string, size int").repartition(7)
    found, n = d.parts_of(items, 1000)
    sizes = [r.size for r in found.groupBy("part").agg(F.sum("size").alias("size")).collect()]
    assert sum(sizes) == 12_750 and max(sizes) <= 1000 and 13 <= n <= 100
    found, n = d.parts_of(items.limit(0), 1000)
    assert n == 1 and found.count() == 0


def test_the_size_is_checked_before_the_broadcast(spark):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    with pytest.raises(ValueError):
        d.contamination(F.col("text"), bench, most_bytes=10)
    docs = spark.createDataFrame([(1, "short item", 5)], "doc_id int, text string, `a.b` int")
    assert d.decontaminate(docs, bench, most_bytes=0).columns == ["doc_id", "text", "a.b"] and d.decontaminate(docs.limit(0), bench, most_bytes=0).count() == 0
