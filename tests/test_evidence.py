from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import printed
from tallyspark.operators import evidence, retrieval, store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def shown(spark):
    return spark.createDataFrame([("d", "m:dso@FY25", "98 days"), ("d", "m:ebitda@FY25", "₹237.00 cr"), ("d", "m:fcf@FY25", "-₹80.00 cr"), ("d", "m:a@FY25", "12.5%"), ("d", "m:b@FY25", "12.5%")], "document_id string, ref string, display string")


def texts(spark, *rows):
    return spark.createDataFrame([("d", k, t) for k, t in enumerate(rows)], "document_id string, text_id int, text string")


def test_render(spark, shown):
    got = evidence.render(texts(spark, "DSO is {{m:dso@FY25}} days; {{ m:ebitda@FY25 }} ₹237.00 cr, {{m:none}}", "none"), shown).collect()
    assert {r.text_id: r.rendered for r in got} == {0: "DSO is 98 days; ₹237.00 cr, {{m:none}}", 1: "none"}


def test_check_prose(spark, shown):
    got = {r.text_id: r.problems for r in evidence.check_prose(texts(spark, "{{m:dso@FY25}} and {{m:zzz}} and {{kb#1}}, up 9.5%", "fine {{m:dso@FY25}}", "25% cap"), shown, F.array(F.lit("25%"))).collect()}
    assert got == {0: ["unknown reference m:zzz", "no evidence reference: kb#1", "figure without citation: 9.5%"], 1: [], 2: []}


def test_figures_find_their_reference(spark, shown):
    got = {(r.figure, r.ref) for r in evidence.link_figures(texts(spark, "cash of ₹-80 crore, 98 days, 12.5% and 7 lakh"), shown).collect()}
    assert got == {("₹-80 crore", "m:fcf@FY25"), ("98 days", "m:dso@FY25")}
    key = lambda t: (lambda r: r and (r.kind, r.value))(one(spark, evidence.figure_key(F.lit(t))))
    assert key("-₹80.00 cr") == ("inr", Decimal(-80)) and key("0.49x") == ("times", Decimal("0.49")) and key("₹5 lakh") is None and key("7") is None


def test_plan_and_summary(spark):
    rows = [("d", f"R{k}", f"T{k % 7}", k % 4) for k in range(12)]
    got = evidence.plan(spark.createDataFrame(rows, "document_id string, rule_id string, category string, severity_rank int")).orderBy("position").collect()
    assert [r.position for r in got] == [1, 2, 3, 4, 5] and got[0].rule_ids[0] == "R11"
    f = spark.createDataFrame([("d", 2, "B", "two."), ("d", 1, "A Title", "one.")], "document_id string, position int, title string, summary string")
    assert evidence.summary(f).first().headline == "2 findings; most severe: a title" and evidence.summary(f).first().summary == "one. two."


def test_coverage(spark):
    rule = lambda *ids: spark.createDataFrame([("d", i) for i in ids], "document_id string, rule_id string")
    assert [r.rule_id for r in evidence.uncovered(rule("a", "b", "c"), rule("a"), rule("c")).collect()] == ["b"]
    drafts, verdicts = spark.createDataFrame([(1,), (2,), (3,)], "draft_id int"), spark.createDataFrame([(1, "reject"), (2, "revise")], "draft_id int, decision string")
    assert sorted(r.draft_id for r in evidence.accepted(drafts, verdicts).collect()) == [2, 3]


@pytest.mark.parametrize(("text", "want"), [("as at 31st March, 2025 and Mar 1, 2024", [date(2025, 3, 31), date(2024, 3, 1)]), ("30.09.2024", [date(2024, 9, 30)]), ("31/02/2024", []), ("Sept 30, 2024", [date(2024, 9, 30)]), ("none", [])])
def test_dates(spark, text, want):
    assert one(spark, printed.find_dates(F.lit(text))) == want


def test_covers_and_hints(spark):
    cover = "BSE LIMITED\nDraft Red Herring Prospectus\n  EXAMPLE   MOTORS LIMITED \nCIN: U12345MH2010PLC123456"
    assert one(spark, printed.document_type(F.lit(cover))) == "drhp" and one(spark, printed.company_name(F.lit(cover))) == "EXAMPLE MOTORS LIMITED" and one(spark, printed.registration_number(F.lit(cover))) == "U12345MH2010PLC123456"
    hints = {"Three months ended": "quarter", "half year ended": "half_year", "9 months": "nine_months", "Year ended": "year", "As at": "instant", "x": "unknown"}
    assert {k: one(spark, printed.period_hint(F.lit(k))) for k in hints} == hints
    opinions = {"Unmodified opinion": "unmodified", "modified": "qualified", "with qualification": "qualified", "Not applicable": None}
    assert {k: one(spark, printed.opinion(F.lit(k))) for k in opinions} == opinions
    assert one(spark, printed.face_value(F.lit("face value of ₹10 each; Face value of ₹10"))) == 10 and one(spark, printed.face_value(F.lit("face value of ₹10, face value of ₹2"))) is None
    durations = {"1m26.4s": 86.4, "450ms": 0.45, "7": 7, "3.074s": 3.074, "": None, "soon": None}
    assert {k: one(spark, printed.duration_seconds(F.lit(k))) for k in durations} == {k: v if v is None else pytest.approx(v) for k, v in durations.items()}
    months = spark.createDataFrame([(date(2024, 9, 30),), (date(2024, 3, 31),), (date(2023, 3, 31),), (date(2023, 9, 30),)], "d date")
    assert months.agg(printed.modal_month(F.col("d"))).first()[0] == 3 and months.limit(0).agg(printed.modal_month(F.col("d"))).first()[0] == 3


def test_store(spark, tmp_path):
    path = str(tmp_path / "samples")
    sample = lambda d, v: spark.createDataFrame([(d, "s", v)], "document_id string, sector string, value double")
    for d, v in (("a", 1.0), ("b", 2.0), ("a", 3.0)):
        store.record_samples(sample(d, v), path)
    assert [r.value for r in store.load_samples(spark, path, "s", "b").collect()] == [3.0]
    findings = spark.createDataFrame([("x", "1"), ("x", "2")], "analysis_id string, finding_id string")
    feedback = spark.createDataFrame([("x", "1", "confirm", 1, 1), ("x", "1", "dismiss", 2, 2)], "analysis_id string, finding_id string, verdict string, created_at int, id int")
    assert sorted((r.finding_id, r.status) for r in store.statuses(findings, feedback).collect()) == [("1", "dismissed"), ("2", "open")]
    jobs = spark.createDataFrame([("queued",), ("completed",)], "status string")
    assert sorted(r.status for r in store.interrupted(jobs).collect()) == ["completed", "failed"]
    candidates = spark.createDataFrame([("R1", ["a"]), ("N", ["a", "zz"])], "rule_id string, needs array<string>")
    got = store.candidate_issues(candidates, spark.createDataFrame([("R1",)], "rule_id string"), spark.createDataFrame([("a",)], "name string")).collect()
    assert {(r.rule_id, r.reason) for r in got} == {("R1", "the id is taken"), ("N", "unknown name zz")}


def test_rerank(spark):
    hits = spark.createDataFrame([(1, "q", "a", "long text", 1), (1, "q", "b", "q", 2)], "query int, query_text string, chunk string, text string, rank int")
    got = {r.chunk: r.score for r in retrieval.rerank(hits, lambda q, t: -F.abs(F.length(q) - F.length(t))).collect()}
    assert got["b"] > got["a"]
