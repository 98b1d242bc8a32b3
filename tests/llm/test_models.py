import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import common, features, language, quality, toxicity
from tallyspark.llm.queries import op7_quality, op8_toxicity, op10_language_id

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    y = np.asarray(y)
    return (order[y == 1].mean() - ((y == 1).sum() + 1) / 2) / (y == 0).sum()


def test_toxicity_on_the_held_out_fold(spark):
    got = op8_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(got.toxic, got.score) > 0.9 and got[got.toxic == 0].predicted.mean() < 0.05
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()


def test_quality_on_the_held_out_fold(spark):
    got = op7_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(got.quality, got.score) > 0.95 and (got.predicted == (got.score >= 0.7)).all()


def test_noisy_or_finds_the_sentence():
    rng = np.random.default_rng(0)
    plain = lambda: " ".join(rng.choice(list("abcdefghijklm"), 8)) + "x. "
    texts, labels = [], []
    for k in range(300):
        parts = [plain() for _ in range(5)]
        if k % 3 == 0:
            parts[k % 5] = f"you are a vile{k % 4} thing. "
        texts.append("".join(parts).encode())
        labels.append(int(k % 3 == 0))
    model = toxicity.fit(texts, np.array(labels))
    text = "é fine words here. You VILE2 one! all good".encode()
    quiet, spots = toxicity.silence([text, b"", b"a b c. d e"], model)
    assert toxicity.calibrated(quiet, model)[0] > 0.5 > toxicity.calibrated(quiet, model)[1:].max()
    (s, e, _), *rest = spots[0]
    assert text[s:e].decode() == "You VILE2 one" and not rest and not spots[1]
    once, twice = (toxicity.silence([part], model)[0][0] for part in (b"fine words. you are a vile2 thing!", b"you are a vile2 thing! fine words. You are a VILE2 thing."))
    assert once == twice > 0.3
    assert toxicity.logit(np.array([1e-6, 1.0, 50.0])) == pytest.approx([np.log(1e-6), np.log(np.e - 1), 50], rel=1e-4)


def word_hash(word):
    return features.Words([word]).hash[0]


def slow_noisy_or(text, weights, bias):
    """(-log of the chance that no sentence offends, the sentences that count) by sets of words."""
    quiet, top, found, known = 0.0, None, [], set()
    for sentence in re.split(rb"[.!?\n]", text):
        said = re.sub(rb"[^0-9a-z\x80-\xff]", b" ", sentence.lower()).split()
        held = {word_hash(w) for w in said} | {("first", n, w[:n]) for w in said for n in (4, 5, 6) if len(w) > n}
        z = bias + sum(weights.get(f, 0.0) for f in held)
        if said:
            top = z if top is None else max(z, top)
        if said and 1 / (1 + math.exp(-z)) >= toxicity.HEARD:
            found.append(sentence)
            key = tuple(re.sub(rb"[^0-9a-z\x80-\xff]", b" ", sentence.lower()).strip().split(b" "))
            quiet += 0 if key in known else math.log1p(math.exp(z))
            known.add(key)
    return quiet or math.log1p(math.exp(bias if top is None else top)), found


def test_noisy_or_equals_a_slow_computation(monkeypatch):
    r = random.Random(5)
    vocabulary = [("w" * r.randrange(1, 4) + str(r.randrange(10**6)) + "é" * r.randrange(2)).encode() for _ in range(60)]
    weights = {word_hash(w): r.uniform(-2, 6) for w in vocabulary[:40]}
    model = toxicity.Model(np.array(sorted(weights)), np.array([weights[h] for h in sorted(weights)]), -4.0, 1.0, 0.0)
    texts = [b"".join(r.choice(vocabulary) + r.choice([b" ", b", ", b" ", b". ", b"!", b"\n"]) for _ in range(r.randrange(0, 200))) for _ in range(60)] + [b"", b"..!"]
    for limit in (None, 300):
        if limit:  # long texts are cut at the ends of sentences
            monkeypatch.setattr(toxicity, "pieces", lambda t: features.pieces(t, limit))
        quiet, located = toxicity.silence(texts, model)
        for text, q, spots in zip(texts, quiet, located):
            want, found = slow_noisy_or(text, weights, -4.0)
            assert q == pytest.approx(want)
            assert bool(spots) == bool(toxicity.calibrated(np.array([want]), model)[0] >= 0.5) or found
            assert all(any(text[a:b] in s for s in found) for a, b, _ in spots)


def test_long_texts_are_cut_at_sentences():
    text = b"One two. Three four! " * 50 + b"w" * 500 + b" end"
    for limit in (20, 64, 100):
        parts = list(features.pieces(text, limit))
        assert b"".join(p for _, p in parts) == text and all(len(p) <= limit and text[a : a + len(p)] == p for a, p in parts)
        assert all(p.endswith((b".", b"!", b"w", b" ")) for _, p in parts[:-1])


def test_length_makes_no_text_toxic(spark):
    """Clean texts joined to 10 MB stay clean; one sentence of a toxic text in their middle is found."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(~toxicity.held_out("doc_id", 5, 0)))
    rows = docs.join(labels.where(toxicity.held_out("doc_id", 5, 0)), "doc_id").select("text", "toxic").collect()
    texts, toxic = [(r.text or "").encode() for r in rows], np.array([r.toxic for r in rows])
    quiet, located = toxicity.silence(texts, model)
    score = toxicity.calibrated(quiet, model)
    assert auc(toxic, score) > 0.9 and ((score >= 0.5) == toxic).mean() > 0.96
    assert all(spots for s, spots in zip(score, located) if s >= 0.5)
    joined = b"\n".join(t for t, s, y in zip(texts, score, toxic) if s < 0.5 and not y)
    for size in (100_000, 1_000_000, 10_000_000):
        long = (joined * (size // len(joined) + 1))[:size]
        assert toxicity.calibrated(toxicity.silence([long], model)[0], model)[0] < 0.5
    worst = int(np.argmax(score))
    start, end, _ = max(located[worst], key=lambda s: s[2])
    offence = texts[worst][start:end]
    quiet, located = toxicity.silence([long[:5_000_000] + b".\n" + offence + b".\n" + long[5_000_000:]], model)
    assert toxicity.calibrated(quiet, model)[0] >= 0.5 and located[0]


def test_the_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, "x" * (10 * k + 1), k % 2) for k in range(40)] + [(3, "y", 1), (50, None, 0), (51, "long " * 10_000, 0)], "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").unionByName(spark.createDataFrame([(3, 0), (None, 1), (7, None)], "doc_id long, toxic int"))
    texts, y = common.labelled_sample(docs, labels, "toxic", (100, 100), (2000, 900))
    assert sum(len(t) for t, k in zip(texts, y) if k == 0) <= 2000 and sum(len(t) for t, k in zip(texts, y) if k == 1) <= 900
    assert b"" in texts and len(texts) == len(y) > 10 and not any(b"long" in t for t in texts)
    assert b"y" in texts and y[texts.index(b"y")] == 0  # the lowest of two labels, the shortest of two texts
    whole, _ = common.labelled_sample(docs, labels, "toxic", (100, 100), (10**6, 10**6))
    assert len(whole) == 42 and any(len(t) == 50_000 for t in whole)


def test_gradients_of_attention():
    """The fitted direction lowers the loss, and attention sums to one in each document."""
    texts = [(b"good words of prose. " * 30 if k % 2 else b"### $$$ ### junk " * 30) + b" tail" * (k % 7) for k in range(40)]
    model = quality.fit(texts, np.arange(40) % 2, steps=60)
    score, n, most = quality.scores(texts, model)
    assert auc(np.arange(40) % 2, score) == 1 and (n >= 1).all() and ((most > 0) & (most <= 1 + 1e-9)).all()
    x, doc = quality.passages(texts)
    f = quality._forward((x - model.mean) / model.spread, doc, 40, model.layers)
    assert np.allclose(np.bincount(doc, f["a"], 40), 1)


def slow_attention(rows, model):
    """The score of one document's passages, a number at a time."""
    p = model.layers
    encoded, energies = [], []
    for row in rows:
        x = [min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(row, model.mean, model.spread)]
        h = [math.tanh(sum(a * p["encode"][i][j] for i, a in enumerate(x)) + p["encode0"][j]) for j in range(quality.HIDDEN)]
        gated = []
        for k in range(quality.GATE):
            t, g = (sum(a * p[name][j][k] for j, a in enumerate(h)) for name in ("tanh", "gate"))
            gated.append(math.tanh(t) / (1 + math.exp(-g)))
        encoded.append(h)
        energies.append(sum(a * b for a, b in zip(gated, p["weigh"])))
    weights = [math.exp(e - max(energies)) for e in energies]
    z = [sum(w * h[j] for w, h in zip(weights, encoded)) / sum(weights) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["out"])) + p["out0"][0]))), max(weights) / sum(weights)


def slow_passages(text):
    """A few features of each passage from its words: characters a word, share of words new to the passage and to the text, number of words."""
    words = re.sub(rb"[^0-9a-z\x80-\xff]", b" ", text.lower()).split()
    found = []
    for k in range(0, max(len(words), 1), quality.PASSAGE):
        own = words[k : k + quality.PASSAGE]
        n = max(len(own), 1)
        fresh = len({w for w in own} - set(words[:k]))
        found.append((math.log1p(sum(map(len, own)) / n), len(set(own)) / n, fresh / n, math.log1p(len(own))))
    return found


def test_attention_equals_a_slow_computation(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 18))) for _ in range(80)]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "!! ", "\n", " ### "]) for _ in range(n)).encode()
    texts = [text(n) for n in (0, 1, 63, 64, 65, 128, 500)] + [text(r.randrange(300)) for _ in range(20)]
    model = quality.fit(texts, np.array([k % 2 for k in range(len(texts))]), steps=40)
    x, doc = quality.passages(texts)
    score, n, top = quality.scores(texts, model)
    at = len(quality.CLASSES)
    for k, t in enumerate(texts):
        want = slow_passages(t)
        assert n[k] == len(want) and x[doc == k][:, [at, at + 1, at + 2, at + 5]] == pytest.approx(np.array(want))
        assert (score[k], top[k]) == pytest.approx(slow_attention(x[doc == k], model), rel=1e-6)


def test_long_texts_in_pieces_score_as_whole_ones(monkeypatch):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    text = " ".join(r.choice(words) + r.choice(["", "", ".", "!"]) for _ in range(30_000)).encode()
    x, doc = quality.passages([text, b"short"])
    likely = language.likelihoods([text, b"short"], np.log(np.random.default_rng(1).dirichlet(np.ones(language.BUCKETS), 3)))
    monkeypatch.setattr(quality, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(quality, "chunks", lambda texts: features.chunks(texts, 20_000))
    monkeypatch.setattr(language, "pieces", lambda t: features.pieces(t, 20_000))
    cut, cut_doc = quality.passages([text, b"short"])
    assert cut.shape == x.shape and (cut_doc == doc).all() and np.abs(cut - x).max() < 0.04 and np.abs(cut[:, : len(quality.CLASSES) + 6] - x[:, : len(quality.CLASSES) + 6]).max() < 1e-9 + 2 / 64
    again = language.likelihoods([text, b"short"], np.log(np.random.default_rng(1).dirichlet(np.ones(language.BUCKETS), 3)))
    assert again == pytest.approx(likely)
    assert quality.passages([b"w" * 50_000])[0].shape[0] == 1 and quality.passages([b"w" * 25_000 + b" x" * 100])[0].shape[0] == 2


def slow_fusion(rows, languages):
    """Posteriors by loops over a table of (logs, declared, suffix, host)."""
    n = len(languages)
    soft = lambda logs: [math.exp(v - max(logs)) / sum(math.exp(w - max(logs)) for w in logs) for v in logs]
    own = [soft(r[0]) for r in rows]
    add = lambda keep: [sum(p[k] for p, r in zip(own, rows) if keep(r)) for k in range(n)]
    domain, top = (lambda h: ".".join(h.split(".")[-2:]), lambda h: h.split(".")[-1])
    smooth = lambda sums, above: [(s + language.LEVEL_WEIGHT * p) / (sum(sums) + language.LEVEL_WEIGHT) for s, p in zip(sums, above)]
    found = []
    for p, r in zip(own, rows):
        logs, host = list(r[0]), r[3]
        if host is not None:
            prior = smooth(add(lambda q: q[3] is not None), [1 / n] * n)
            prior = smooth(add(lambda q: q[3] is not None and top(q[3]) == top(host)), prior)
            prior = smooth(add(lambda q: q[3] is not None and domain(q[3]) == domain(host)), prior)
            prior = smooth([max(s - a, 0.0) for s, a in zip(add(lambda q: q[3] == host), p)], prior)
            logs = [a + math.log(b) for a, b in zip(logs, prior)]
        for column in (1, 2):
            if r[column] is not None:
                values = len({q[column] for q in rows if q[column] is not None})
                whole, here = add(lambda q: q[column] is not None), add(lambda q: q[column] == r[column])
                logs = [a + math.log((h + language.EVIDENCE_SMOOTHING) / (w + language.EVIDENCE_SMOOTHING * values)) for a, h, w in zip(logs, here, whole)]
        found.append(soft(logs))
    return found


def test_fusion_equals_a_slow_bayes(spark):
    r = random.Random(6)
    hosts = ["www.a.org", "blog.a.org", "b.org", "x.b.de", "c.de", None]
    rows = [([r.uniform(-5, 0) for _ in range(3)], r.choice(["aa", "bb", None]), r.choice(["/aa", ".org", None]), r.choice(hosts)) for _ in range(60)]
    frame = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "id int, logs array<double>, declared string, suffix string, host string")
    got = {x.id: x for x in language.fuse(frame, ["aa", "bb", "cc"]).collect()}
    for k, want in enumerate(slow_fusion(rows, ["aa", "bb", "cc"])):
        assert list(got[k].posterior) == pytest.approx(want) and got[k].language == ["aa", "bb", "cc"][int(np.argmax(want))]


def test_hidden_declarations_are_found(spark):
    """A fold of the pages is scored without what it declares, by a model of documents of which none is scored."""
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages"))
    names, table = language.train(docs)
    hidden = F.crc32(F.col("page_id").cast("string")) % 3 == 0
    declared = language.declared_of(F.col("html"))
    rows = pages.select("page_id", hidden.alias("hidden"), declared.alias("truth"), language.text_likelihood(F.col("html"), table, True).alias("logs"), F.when(~hidden, declared).alias("declared"), language.suffix_of(F.col("url")).alias("suffix"), language.host_of(F.col("url")).alias("host"))
    got = language.fuse(rows, names).where("hidden and truth is not null").toPandas()
    assert len(got) > 50 and (got.truth == got.language).mean() > 0.95


AWKWARD = [(1, None, "x"), (2, "", "x"), (3, "word " * 60000, "x"), (3, "word " * 60000, "x"), (4, "...\n\n!?", "x"), (None, "é", None)]


@pytest.mark.parametrize("column", ["toxicity", "quality"])
def test_awkward_rows(spark, column):
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, score string")
    for model in ({"toxicity": toxicity.fit([], np.array([])), "quality": quality.fit([], np.array([]))}[column], {"toxicity": toxicity.fit, "quality": quality.fit}[column]([b"a b", b"c d", b"### !!", b"e f"] * 8, np.array([0, 0, 1, 0] * 8))):
        score = {"toxicity": toxicity.toxicity, "quality": quality.quality}[column](F.col("text"), model)
        got = docs.withColumn("s", score["score"]).collect()
        assert len(got) == 6 and all(0 <= r.s <= 1 for r in got) and got[0].s == got[1].s and got[2].s == got[3].s
        assert docs.limit(0).withColumn("s", score["score"]).count() == 0


def test_training_needs_no_labels(spark):
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert not toxicity.train(docs, none).weights.any() and quality.train(docs, none).layers is None


def test_languages(spark):
    got = op10_language_id(spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars").toPandas().merge(got, on="doc_id")
    assert (truth.lang == truth.language).mean() > 0.99 and len(got) == len(truth) + 250
    pages = got[got.page_id.notna()]
    assert (pages.language == pages.declared).mean() > 0.97


def test_language_is_learned_from_other_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    names, table = language.train(docs.where("doc_id % 2 = 0"))
    got = docs.where("doc_id % 2 = 1").select("lang", language.text_likelihood(F.col("text"), table, False).alias("l")).toPandas()
    assert (got.lang == got.l.map(lambda x: names[int(np.argmax(x))])).mean() > 0.99


def test_evidence_is_fused(spark):
    rows = [(k, [0.0, -4.0], "aa", "/aa", "www.site.org") for k in range(30)] + [(100, [0.0, 0.0], None, None, "www.site.org"), (101, [0.0, 0.0], None, None, "new.site.org"), (102, [0.0, 0.0], "bb", None, None), (103, [-4.0, 0.0], "bb", "/bb", "b.net"), (104, [0.0, 0.0], None, None, None)]
    frame = spark.createDataFrame(rows, "id int, logs array<double>, declared string, suffix string, host string")
    got = {r.id: (r.language, r.score) for r in language.fuse(frame, ["aa", "bb"]).collect()}
    assert len(got) == 35 and got[100][0] == "aa" and got[100][1] > 0.8 and got[101][0] == "aa" and got[101][1] < got[100][1]
    assert got[102][0] == "bb" and got[103][0] == "bb" and got[104][1] == pytest.approx(0.5)
    assert language.fuse(frame.limit(0), ["aa", "bb"]).count() == 0 and {r.language for r in language.fuse(frame, []).collect()} == {None}


def test_addresses(spark):
    rows = [("http://U@Blog.Site.example.COM:80/en/1?x", "blog.site.example.com", "/en"), ("https://a.de", "a.de", ".de"), ("https://a.fr/pt-BR/x", "a.fr", "/pt"), ("https://a.fr/eng/", "a.fr", ".fr"), ("nonsense", None, None), (None, None, None)]
    frame = spark.createDataFrame(rows, "url string, host string, suffix string")
    for r in frame.select("*", language.host_of(F.col("url")).alias("h"), language.suffix_of(F.col("url")).alias("s")).collect():
        assert (r.h, r.s) == (r.host, r.suffix), r
    html = spark.createDataFrame([("<!DOCTYPE html><HTML class=x lang='EN-us'>",), ("<html>lang=fr",), (None,)], "html string")
    assert [r[0] for r in html.select(language.declared_of(F.col("html"))).collect()] == ["en", None, None]


def test_pages_of_unclosed_tags_are_read_in_linear_time():
    """1 MB each; a pattern that looks for the end of every tag takes minutes."""
    began = time.process_time()
    for tag in (b"<script ", b"<!--", b"<style>", b"<a ", b"<script></script ", b"&amp"):
        language.plain(tag * (1_000_000 // len(tag)))
    assert time.process_time() - began < 5
    assert language.plain(b"a<script>b</style></SCRIPT >c<!-- <p> -->d<p>e<script x>f") == b"a c d e f"


def test_fusion_carries_columns_of_any_name(spark):
    """Columns named as fuse's own results or steps; ties go to the first language; many languages."""
    names = [f"l{k:02d}" for k in range(40)]
    flat, third = [0.0] * 40, [-5.0] * 2 + [0.0] + [-5.0] * 37
    rows = [(1, flat, None, None, None, "d", "t", "p", 7), (2, third, "l2", ".x", "a.b.x", "d", None, "p", 8), (2, third, "l2", ".x", "a.b.x", "d", None, "p", 8)]
    frame = spark.createDataFrame(rows, "id int, logs array<double>, declared string, suffix string, host string, domain string, top string, posterior string, score int")
    got = language.fuse(frame, names)
    assert got.columns == ["id", "logs", "declared", "suffix", "host", "domain", "top", "language", "score", "posterior"]
    found = [(r.id, r.domain, r.top, r.language, len(r.posterior)) for r in got.orderBy("id").collect()]
    assert found == [(1, "d", "t", "l00", 40), (2, "d", None, "l02", 40), (2, "d", None, "l02", 40)]
