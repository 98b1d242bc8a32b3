import hashlib
import random

import pytest

from tallyspark.llm import repeats
from tallyspark.llm.queries import op13_substring_dedup

SF = "/root/testdata/sf0.001"


def brute(rows, window):
    """(n_words, n_removed, kept) of each row, rows in the order that says what stands earlier."""
    seen, found = set(), []
    for text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            run = tuple(words[k : k + window])
            if run in seen:
                gone[k : k + window] = [True] * window
            seen.add(run)
        found.append((len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return found


def texts(seed, n, longest, shared):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "ä", "word", "x.y", "Z"]) + str(r.randrange(40))
    passages = [[word() for _ in range(r.randrange(5, 90))] for _ in range(shared)]
    out = []
    for _ in range(n):
        words = []
        while len(words) < r.randrange(longest):
            kind = r.random()
            words += r.choice(passages) if kind < 0.4 else ["again"] * r.randrange(40) if kind < 0.45 else [word() for _ in range(r.randrange(30))]
        out.append(r.choice([" ", "\t", " \n "]).join(words))
    return out


def result(df):
    return {r.id: r for r in df.collect()}


@pytest.mark.parametrize("seed,window,pack", [(1, 20, 1 << 18), (2, 20, 300), (3, 5, 100), (4, 8, 50)])
def test_equals_brute_force(spark, seed, window, pack):
    rows = texts(seed, 120, 400, 12)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string").repartition(5)
    found = result(repeats.substring_dedup(df, window=window, pack=pack))
    assert [(found[k].n_words, found[k].n_removed, found[k].kept) for k in range(len(rows))] == brute(rows, window)
    for k, text in enumerate(rows):
        words, spans = text.split(), [(s.start, s.end) for s in found[k].removed]
        assert sum(e - s for s, e in spans) == found[k].n_removed and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        assert " ".join(w for i, w in enumerate(words) if not any(s <= i < e for s, e in spans)) == found[k].kept


@pytest.mark.parametrize("size", [60, 200, 1000])
def test_long_texts_are_cut(spark, size):
    """Pieces of a few bytes; repeats over their edges, within a text and between texts."""
    rows = texts(7, 40, 600, 6)
    rows[3] = rows[2] + " " + rows[2]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id int, text string").repartition(3)
    found = result(repeats.substring_dedup(df, piece_bytes=size, pack=500))
    assert [(found[k].n_words, found[k].n_removed, found[k].kept) for k in range(len(rows))] == brute(rows, 20)
    whole = result(repeats.substring_dedup(df))
    assert all(found[k].removed == whole[k].removed for k in found)


def test_cases(spark):
    """Null and empty texts, null ids, rows that share an id, clashing columns, an empty table."""
    run = " ".join(f"w{k}" for k in range(25))
    rows = [(5, run, "x"), (5, run, "y"), (None, run, None), (7, None, "z"), (8, "", "z"), (9, " \t\n", "z"), (10, "one", "z")]
    df = spark.createDataFrame([(a, b, c, 1, 2) for a, b, c in rows], "doc_id long, text string, id string, row long, pack long")
    found = sorted(((r.id is None, r.id or 0, r.n_words, r.n_removed, r.kept) for r in repeats.substring_dedup(df).collect()))
    assert found == [(False, 5, 25, 0, run), (False, 5, 25, 25, ""), (False, 7, 0, 0, ""), (False, 8, 0, 0, ""), (False, 9, 0, 0, ""), (False, 10, 1, 0, "one"), (True, 0, 25, 25, "")]
    assert repeats.substring_dedup(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        repeats.substring_dedup(df, id_col="id")


def test_a_run_of_one_word(spark):
    rows = ["a " * 5000, "b " + "a " * 30, "a " * 19]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = result(repeats.substring_dedup(df))
    assert [(found[k].n_words, found[k].n_removed, found[k].kept) for k in range(3)] == brute(rows, 20)


def test_a_very_long_text(spark):
    r = random.Random(5)
    words = [f"w{r.randrange(1 << 30)}" for _ in range(400_000)]
    rows = [" ".join(words), " ".join(words[1000:1100] + ["end"]), " ".join(words[200_000:200_015])]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = result(repeats.substring_dedup(df))
    assert [(found[k].n_removed, found[k].kept) for k in range(3)] == [(0, rows[0]), (100, "end"), (0, rows[2])]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(docs)
    expected = {k: (n, m, hashlib.sha256(t.encode()).hexdigest()) for k, (n, m, t) in zip(order, brute([docs[k] for k in order], 20))}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op13_substring_dedup(spark, SF).collect()} == expected
    assert sum(m for _, m, _ in expected.values()) > 0
