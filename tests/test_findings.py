from datetime import date

from tallyspark.operators import evidence, report
from tallyspark.sources import knowledge

LATEST = "document_id string, rule_id string, pack string, outcome string, severity string, severity_rank int, period string, evidence array<struct<name:string,value:string>>, missing array<string>, fired_periods array<string>"


def outcomes(spark):
    rows = [
        ("d", "R1", "core", "fired", "high", 3, "FY25", [("dso", "98"), ("gap", None)], [], ["FY24", "FY25"]), ("d", "R2", "core", "fired", "high", 3, "FY25", [], [], ["FY25"]), ("d", "R3", "core", "insufficient_data", "low", 1, "FY25", [], ["x"], []),
        ("d", "I1", "integrity", "passed", "critical", 4, None, [], [], []), ("e", "R1", "core", "passed", "high", 3, "FY25", [("dso", "1")], [], ["FY23"]),
    ]
    return spark.createDataFrame(rows, LATEST)


def test_rule_findings(spark):
    scores = spark.createDataFrame([("R2", 0.9)], "rule_id string, score double")
    titles = spark.createDataFrame([("R1", "Slow payers", "They pay late.")], "rule_id string, title string, rationale string")
    found = {r.finding_id: r for r in report.findings(outcomes(spark), scores, titles).collect()}
    assert set(found) == {"R-R1", "R-R2"}
    assert found["R-R1"].summary == "Slow payers (FY25): dso {{x:dso@FY25}}." and found["R-R1"].analysis == "They pay late. The rule also fired in FY24." and found["R-R1"].confidence == 0.6
    assert found["R-R2"].summary == "R2 (FY25)." and found["R-R2"].analysis == "" and found["R-R2"].confidence == 0.9
    index = spark.createDataFrame([("d", "x:dso@FY25", "98 days")], "document_id string, ref string, display string")
    texts = report.findings(outcomes(spark), None, titles).selectExpr("document_id", "finding_id as text_id", "summary as text")
    assert {r.rendered for r in evidence.render(texts, index).collect()} == {"Slow payers (FY25): dso 98 days.", "R2 (FY25)."}


def test_report(spark):
    latest = outcomes(spark)
    found = report.findings(latest, spark.createDataFrame([("R2", 0.9)], "rule_id string, score double"))
    reports = {r.document_id: r for r in report.assembled(latest, found).collect()}
    d, e = reports["d"], reports["e"]
    assert d.risk == "elevated" and d.concerns == ["R2", "R1"] and [f.finding_id for f in d.findings] == ["R-R2", "R-R1"]
    assert (d.integrity.passed, d.integrity.failed) == (1, 0) and [g.rule_id for g in d.gaps] == ["R3"] and len(d.scorecard) == 2
    assert e.risk == "low" and e.findings is None and e.gaps is None
    assert report.assembled(latest.where("false"), found.where("false")).count() == 0


def test_histories(spark):
    metrics = spark.createDataFrame([("d", "dso", "FY25", date(2025, 3, 31), "98", "days"), ("d", "dso", "FY24", date(2024, 3, 31), "97", "days"), ("d", "x", "FY25", date(2025, 3, 31), "1", "times")], "document_id string, metric string, period string, end_date date, value string, unit string").selectExpr("document_id", "metric", "period", "end_date", "cast(value as decimal(24,12)) value", "unit")
    assert [(h.ref, h.display) for h in report.metric_history(metrics, "dso").first().history] == [("m:dso@FY24", "97 days"), ("m:dso@FY25", "98 days")]
    rows = spark.createDataFrame([("d", "R1", date(2025, 3, 31), True, "FY25", "fired"), ("d", "R1", date(2025, 3, 31), False, "Q4FY25", "passed"), ("d", "R1", date(2024, 3, 31), False, "FY24", "passed")], "document_id string, rule_id string, end_date date, is_anchor boolean, period string, outcome string")
    assert [h.period for h in report.rule_history(rows).first().history] == ["FY24", "Q4FY25", "FY25"]


def test_knowledge_links(spark, tmp_path):
    references = spark.createDataFrame([("rule", "R2", "dso"), ("rule", "R1", "dso"), ("metric", "m", "dso"), ("rule", "R9", "gone"), ("rule", "R0", None)], "kind string, name string, doc_id string")
    assert {r.doc_id: (r.rules, r.metrics) for r in knowledge.links(references).collect()} == {"dso": (["R1", "R2"], ["m"]), "gone": (["R9"], [])}
    rows = spark.createDataFrame([("dso#a", "dso", "Red flags"), ("dso#b", "dso", "Definition"), ("z#a", "z", "Red flags")], "chunk_id string, doc_id string, heading string")
    assert [r.doc_id for r in knowledge.missing_documents(references, rows).collect()] == ["gone"]
    assert [r.chunk_id for r in knowledge.sections_of(rows, references, ("red flags",)).collect()] == ["dso#a"] and knowledge.sections_of(rows, references).count() == 2
    (tmp_path / "q.jsonl").write_text('{"query": "b", "expect": ["x"]}\n{"query": "a", "expect": ["y"], "kinds": ["k"]}\n')
    assert [(r["query"], r.query_text, r.expect, r.kinds) for r in knowledge.read_questions(spark, str(tmp_path / "q.jsonl")).orderBy("query").collect()] == [("a", "a", ["y"], ["k"]), ("b", "b", ["x"], [])]
