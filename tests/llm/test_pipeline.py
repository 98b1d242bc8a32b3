import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import common, decontamination, secrets, simhash
from tallyspark.llm.common import Written
from tallyspark.llm.queries import op8_toxicity, op9_decontamination

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "secret_scan", "source_mix"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, Written(stage(spark, docs, SF), "test").df
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert set(docs.columns) >= set(columns) and set(kept[name]) <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != "source_mix":
            assert docs.columns == columns
    prints = collections.Counter(simhash.fingerprint((r.text or "").encode()) for r in kept["simhash_near_dedup"].values())
    assert max(prints.values()) == 1
    hit = {r.doc_id for r in op9_decontamination(spark, SF).where("contaminated").collect()}
    assert set(kept["decontamination"]) == set(kept["simhash_near_dedup"]) - hit
    assert set(kept["secret_scan"]) == set(kept["decontamination"]) == set(kept["source_mix"])
    assert all(r.n_chars == len(r.text) for r in kept["secret_scan"].values())
    run = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == {k: r.taken for k, r in kept["source_mix"].items()} and decontamination is not None


def alike(a, b):
    """Whether the sets of five-word shingles are similar by 0.8."""
    return len(a & b) >= 0.8 * len(a | b)


def test_run_equals_brute_force(spark, tmp_path):
    """All stages over whole texts with loops in place of searches, joins and counts; the model's scores are those of the query. Credentials are planted, of one, two and many owners."""
    sf = str(tmp_path)
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{sf}/{t}.parquet")
    given = spark.read.parquet(f"{SF}/documents.parquet")
    own, text = "password: owned1234x", "quiet river walks under morning light number {} with {} and more words to follow {}"
    planted = [(10**6 + k, text.format(k, f"token=shared{k % 2}99 AKIA{'Z' * 16}{k % 4}" if k % 2 else own, k * 7), "en", f"owner{k}", 0) for k in range(8)]
    given.unionByName(spark.createDataFrame(planted, given.schema)).write.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    toxic = {r.doc_id for r in op8_toxicity(spark, sf).where("predicted = 1").collect()}
    kept = [k for k in sorted(docs) if k not in toxic]
    assert 0 < len(toxic) < len(docs) / 2

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[n : n + 5]) for n in range(max(1, len(words) - 4))} if words else set()

    sets, group = {k: shingles(docs[k].text) for k in kept}, {k: k for k in kept}
    for n, a in enumerate(kept):
        for b in kept[:n]:
            if group[a] != group[b] and alike(sets[a], sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert len(set(group.values())) < len(kept)
    kept = sorted(set(group.values()))

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [word.findall((r.text or "").lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[n : n + 10]) for w in items if w for n in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    held = {k: word.findall((docs[k].text or "").lower()) for k in kept}
    clean = [k for k in kept if not any(tuple(held[k][n : n + size]) in windows for size in sizes for n in range(len(held[k]) - size + 1))]
    assert 0 < len(clean) < len(kept)

    found = {k: secrets.candidates(docs[k].text) for k in clean}
    owners = collections.defaultdict(set)
    for k in clean:
        for *_, value in found[k]:
            owners[value].add(docs[k].source)
    texts = {k: secrets.mask_text(docs[k].text or "", [(s, e) for _, s, e, v in found[k] if len(owners[v]) < secrets.COPIED_OWNERS], "[SECRET]") for k in clean}

    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(rows) == clean and {k: r.text or "" for k, r in rows.items()} == texts
    assert any("[SECRET]" in t for t in texts.values())
    words = {k: len(t.split()) for k, t in texts.items()}
    by_source = collections.Counter()
    for k in clean:
        by_source[docs[k].source] += words[k]
    assert {k: (r.size, r.source_size) for k, r in rows.items()} == {k: (words[k], by_source[docs[k].source]) for k in clean}
    taken = collections.Counter()
    for k, r in rows.items():
        taken[docs[k].source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[docs[k].source] - r.target) <= max(2, 0.02 * r.target) for k, r in rows.items())


def test_stages_on_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clashing = ("id", "_id", "_digest", "_spans", "_n", "row", "size", "taken", "target", "k", "key", "shard", "spans", "fp", "component", "score", "a.b")
    odd = docs.limit(20).unionByName(docs.limit(2)).unionByName(spark.createDataFrame([(None,) * 5, (None,) * 5, (10**6, "", "en", "src0", 0), (10**6 + 1, "word " * 200_000, "en", None, 10), (10**6 + 2, "secret = abcdefgh1234", None, "src0", 21)], docs.schema))
    for c in clashing:
        odd = odd.withColumn(c, F.lit(c))
    odd, empty = Written(odd, "test").df, docs.where("false")
    rows = odd.count()
    for name, stage in corpus_pipeline.STAGES:
        found = Written(stage(spark, odd, SF), "test").df
        assert len(set(found.columns)) == len(found.columns) and set(found.columns) >= set(odd.columns)
        assert all(r.key == "key" and r._spans == "_spans" for r in found.select("key", "_spans").collect())
        assert name in ("toxicity", "simhash_near_dedup", "decontamination") or found.count() == rows
        if name == "secret_scan":
            assert found.where("doc_id = 1000002").first().text == "[SECRET]"
        assert stage(spark, empty, SF).count() == 0


def test_run_leaves_no_table_of_a_stage_behind(spark):
    common.release()
    run = corpus_pipeline.run(spark, SF)
    labels = sorted(w.path.rsplit("/", 1)[1].rsplit("-", 1)[0] for w in common._WRITTEN)
    assert labels == ["apportion-plan", "mix-shards", "mix-sizes", "pipeline-secret_scan"]
    assert run.count() > 0
    common.release()
    assert not common._WRITTEN


def test_a_cluster_needs_a_shared_folder(spark):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "local-cluster[3,2,1000]"})

    with pytest.raises(ValueError):
        common.shared_dir(Session)
