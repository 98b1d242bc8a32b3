from datetime import date
from decimal import Decimal

import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__
from tallyspark.functions import periods, statistics, text, timeseries
from tallyspark.functions.timeseries import Grid
from tallyspark.operators import labels, layout, learning, reconcile, report, retrieval
from tallyspark.sources import filings, knowledge
from tallyspark.streaming import state


def one(spark, column, **values):
    frame = spark.range(1)
    for k, v in values.items():
        frame = frame.withColumn(k, v if not isinstance(v, (str, int, float)) else F.lit(v))
    return frame.select(column.alias("x")).first().x


def test_period_labels(spark):
    rows = [("FY25", "year", 2025, None), (" q1 fy 25", "quarter", 2025, 1), ("H2FY2024", "half_year", 2024, 2), ("9mfy24", "nine_months", 2024, None), ("Q5FY25", None, None, None), ("2025", None, None, None)]
    frame = spark.createDataFrame(rows, "t string, k string, y int, p int").withColumn("p2", periods.parse(F.col("t")))
    for r in frame.collect():
        assert (r.p2 and (r.p2.kind, r.p2.fiscal_year, r.p2.part)) == (r.k and (r.k, r.y, r.p)), r


def test_fiscal_calendar(spark):
    rows = [("year", 2025, None, 3, date(2024, 4, 1), date(2025, 3, 31), 365), ("year", 2024, None, 3, date(2023, 4, 1), date(2024, 3, 31), 366), ("quarter", 2025, 1, 3, date(2024, 4, 1), date(2024, 6, 30), 91),
            ("half_year", 2025, 2, 3, date(2024, 10, 1), date(2025, 3, 31), 182), ("nine_months", 2025, None, 3, date(2024, 4, 1), date(2024, 12, 31), 275), ("year", 2024, None, 12, date(2024, 1, 1), date(2024, 12, 31), 366), ("quarter", 2024, 4, 12, date(2024, 10, 1), date(2024, 12, 31), 92)]
    frame = spark.createDataFrame(rows, "kind string, fiscal_year int, part int, fye int, s date, e date, d int")
    args = [F.col(c) for c in ("kind", "fiscal_year", "part", "fye")]
    for r in frame.select("*", periods.start_date(*args).alias("s2"), periods.end_date(*args).alias("e2"), periods.from_dates(F.col("s"), F.col("e"), F.col("fye")).alias("p")).collect():
        assert (r.s, r.e) == (r.s2, r.e2) and (r.e - r.s).days + 1 == r.d and (r.p.kind, r.p.fiscal_year, r.p.part) == (r.kind, r.fiscal_year, r.part)
    for s, e in ((date(2024, 4, 2), date(2024, 6, 30)), (date(2024, 5, 1), date(2024, 7, 31)), (date(2024, 4, 1), date(2024, 5, 31))):
        assert spark.createDataFrame([(s, e)], "s date, e date").select(periods.from_dates(F.col("s"), F.col("e"), F.lit(3)).alias("p")).first().p is None


def series(spark, values, kind="year"):
    rows = [("d", kind, y, None, y, v) for y, v in values.items()]
    return spark.createDataFrame(rows, "document_id string, kind string, fiscal_year int, part int, seq_index int, x double")


def at(frame, column, year):
    return frame.select("fiscal_year", column.alias("v")).where(F.col("fiscal_year") == year).first().v


def test_look_backs_are_by_calendar(spark):
    g, s = Grid(), series(spark, {2021: -10.0, 2022: 50.0, 2024: 90.0})
    x = F.col("x")
    assert at(s, g.prior(x), 2024) is None and at(s, g.prior(x), 2022) == -10 and at(s, g.growth(x), 2022) == 6
    assert at(s, g.avg(x), 2022) == 20 and at(s, g.avg(x), 2024) == 90
    three = series(spark, {2022: -10.0, 2023: 50.0, 2024: 90.0})
    assert at(three, g.trailing_sum(x, 3), 2024) == 130 and at(three, g.trailing_sum(x, 4), 2024) is None
    assert at(three, g.streak(x > 0, 2), 2024) is True and at(three, g.streak(x > 0, 3), 2024) is False and at(three, g.streak(x > 0, 4), 2024) is False
    assert at(series(spark, {2023: 5.0, 2024: 6.0}), g.streak(x > 0, 3), 2024) is None
    zero = series(spark, {2023: 0.0, 2024: 6.0})
    assert at(zero, g.growth(x), 2024) is None


def test_ttm_and_nine_months(spark):
    rows = [("d", "quarter", 2024, p, 2024 * 4 + p - 1, v) for p, v in enumerate((40.0, 10.0, 20.0, 30.0), 1)] + [("d", "nine_months", 2025, None, 2025, 7.0), ("d", "year", 2024, None, 2024, 5.0)]
    s = spark.createDataFrame(rows, "document_id string, kind string, fiscal_year int, part int, seq_index int, x double")
    got = {(r.kind, r.part): (r.t, r.o) for r in s.select("kind", "part", Grid().ttm(F.col("x")).alias("t"), Grid().opening(F.col("x")).alias("o")).collect()}
    assert got["quarter", 4] == (100, 20) and got["quarter", 3][0] is None and got["year", None][0] == 5 and got["nine_months", None] == (None, 5)


def test_missing_operands(spark):
    null = F.lit(None).cast("double")
    two = F.lit(2.0)
    assert one(spark, timeseries.strict_least(two, null)) is None and one(spark, timeseries.strict_greatest(two, F.lit(3.0))) == 3
    assert one(spark, timeseries.rel_diff(F.lit(0.0), F.lit(0.0))) == 0 and one(spark, timeseries.rel_diff(two, F.lit(-2.0))) == 2
    assert one(spark, timeseries.chain(F.lit(3.0) < two, two < null, operands=(two, null))) is None
    assert one(spark, timeseries.divide(two, F.lit(0.0))) is None and one(spark, (two < null) & F.lit(False)) is False


def test_statistics(spark):
    arr = lambda *v: F.array(*map(F.lit, map(float, v))) if v else F.array().cast("array<double>")
    ten = arr(10, 20, 30, 40, 50)
    assert [one(spark, statistics.percentile(ten, p)) for p in (0, 50, 90)] == [10, 30, 46]
    assert one(spark, statistics.mad(arr(1, 2, 3, 4, 100))) == 1 and one(spark, statistics.mid_rank(arr(1, 2, 3, 4), F.lit(3.0))) == 0.625
    assert one(spark, statistics.modified_z(F.lit(20.0), arr(10, 10, 10, 12))) is not None and one(spark, statistics.modified_z(F.lit(20.0), arr(10, 10, 10))) is None
    assert one(spark, statistics.median(arr())) is None
    frame = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 4.0, None)], "k string, v double")
    assert sorted((r.v or 0, r.mid_rank) for r in statistics.group_mid_rank(frame, ["k"], "v").collect()) == [(0, None), (1, 0.125), (2, 0.5), (2, 0.5), (4, 0.875)]


@pytest.mark.parametrize(("token", "value"), [("(1,602.15)", "-1602.15"), ("-", "0"), ("abc", None), ("12,34,567", "1234567"), ("- 5", "-5"), ("nil", "0"), ("1,2", None), ("", None)])
def test_amounts(spark, token, value):
    assert one(spark, text.parse_amount(F.lit(token))) == (value and Decimal(value))


def test_scales_and_displays(spark):
    for line, scale in (("x\n(₹ in million)", "0.1"), ("Rs. in lakhs", "0.01"), ("INR crore", "1"), ("amounts in '000", None), ("millions of things", None), ("Amount in thousands", "0.0001")):
        assert one(spark, text.detect_scale(F.lit(line))) == (scale and Decimal(scale)), line
    show = lambda v, u: one(spark, text.format_value(F.lit(v).cast("decimal(24,12)"), F.lit(u)))
    assert show("12345678.9", "inr_crore") == "₹1,23,45,678.90 cr" and show("97.6", "days") == "98 days" and show("16.755", "inr") == "₹16.76" and show("-80", "inr_crore") == "-₹80.00 cr"
    assert show("0.192", "ratio") == "19.2%" and show("0.49", "times") == "0.49x" and show(None, "times") == "n/a" and show("1234", "count") == "1,234"


def test_words(spark):
    stems = {"companies": "company", "classes": "class", "profits": "profit", "growing": "grow", "increased": "increas", "sales": "sale", "used": "used", "2024": "2024", "basis": "basis"}
    for word, want in stems.items():
        assert one(spark, text.stem(F.lit(word))) == want, word
    assert one(spark, text.tokens(F.lit("The DSO of firms"))) == ["dso", "day", "sale", "outstand", "receivabl", "firm"]
    assert one(spark, text.bare_figures(F.lit("EBITDA {{m:ebitda@FY25}} rose 12.5% to ₹1,232 cr in FY25, 98 days"))) == ["12.5%", "₹1,232 cr", "98 days"]
    assert one(spark, text.references(F.lit("a {{ f:x@FY25 }} b {{m:y}}"))) == ["f:x@FY25", "m:y"] and one(spark, text.slug(F.lit("How it's Done!"))) == "how-it-s-done"


def test_reconciliation(spark):
    columns = "total_income, total_expenses, finance_costs, depreciation_amortisation, exceptional_items, profit_before_exceptional_items, profit_before_tax, total_tax_expense, profit_after_tax".split(", ")
    rows = [(100, 70, 5, 10, 0, None, 15, 4, 19), (100, 85, 5, 10, 3, 15, 12, 4, 8), (100, 85, 5, 10, 0, 15, 15, 4, 11)]
    got = [(r.total_expenses, r.exceptional_items, r.total_tax_expense, len(r.issues)) for r in reconcile.profit_and_loss(spark.createDataFrame(rows, ", ".join(f"{c} int" for c in columns))).collect()]
    assert got == [(85, 0, -4, 2), (85, -3, 4, 1), (85, 0, 4, 0)]


def test_merge_and_identity(spark):
    rows = [("c", "k", "FY24", 1, "a", 100.0), ("c", "k", "FY24", 2, "b", 101.0), ("c", "k", "FY25", 2, "b", 5.0), ("c", "j", "FY24", 1, "a", 100.0), ("c", "j", "FY24", 1, "b", 100.1)]
    got = {(r.key, r.period): (r.value, r.restated, r.filings) for r in reconcile.merge_restated(spark.createDataFrame(rows, "company string, key string, period string, filed int, document_id string, value double")).collect()}
    assert got == {("k", "FY24"): (101, True, 2), ("k", "FY25"): (5, False, 1), ("j", "FY24"): (100.1, False, 2)}
    people = spark.createDataFrame([("X", None, "A"), (None, "1", "a"), ("Y", "1", "A")], "isin string, bse_code string, name string").withColumn("nse_symbol", F.lit(None).cast("string"))
    pairs = people.alias("a").crossJoin(people.alias("b")).select(F.col("a.isin").alias("x"), F.col("b.isin").alias("y"), reconcile.same_company("a", "b").alias("same")).collect()
    assert {(p.x, p.y): p.same for p in pairs}[("X", "Y")] is False and {(p.x, p.y): p.same for p in pairs}[(None, "Y")] is True and {(p.x, p.y): p.same for p in pairs}[("X", None)] is True


def test_label_matching(spark):
    names = spark.createDataFrame([("pl", "revenue", "Revenue from operations", 0), ("pl", "pbt", "Profit before tax", 1), ("pl", "pat", "Profit after tax", 2), ("bs", "debt", "Non-current borrowings", 3)], "statement string, key string, name string, rank int")
    rows = [(1, "pl", "(i) Revenue from operations (refer note 5)"), (2, "pl", "Profit/(loss) before tax (III-IV)"), (3, "pl", "Something else"), (4, "bs", "Borrowings (non - current)"), (5, "pl", "")]
    got = {r.label_id: (r.key, r.score) for r in labels.match(spark.createDataFrame(rows, "label_id int, statement string, label string"), names).collect()}
    assert got == {1: ("revenue", 1.0), 2: ("pbt", 1.0), 4: ("debt", 1.0)}


def test_layout(spark):
    words = spark.createDataFrame([(1, "a", 0.0, 5.0, 10.0), (1, "b", 6.0, 9.0, 11.0), (1, "c", 0.0, 5.0, 12.4), (1, "d", 0.0, 5.0, 13.0)], "page int, text string, x0 double, x1 double, top double")
    assert sorted((r.line, r.text) for r in layout.rows_of(words).collect()) == [(0, "a c b"), (1, "d")]
    two = words.selectExpr("'x' AS document_id", "*").unionByName(words.where("text = 'd'").selectExpr("'y' AS document_id", "*"))
    assert sorted((r.document_id, r.line, r.text) for r in layout.rows_of(two, ("document_id", "page")).collect()) == [("x", 0, "a c b"), ("x", 1, "d"), ("y", 0, "d")]
    columns = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 5.0, 9.0)], "page int, column int, left double, right double")
    assert sorted((r.text, r.column) for r in layout.assign_columns(words, columns).collect()) == [("a", 0), ("b", 1), ("c", 0), ("d", 0)]


def test_learning(spark):
    feedback = spark.createDataFrame([("a", "f", "confirm", 1, 1), ("a", "f", "confirm", 2, 2), ("a", "f", "confirm", 3, 3), ("a", "f", "dismiss", 3, 4), ("b", "g", "confirm", 1, 5)], "analysis_id string, finding_id string, verdict string, created_at int, id int")
    findings = spark.createDataFrame([("a", "f", ["R1", "R2"], ["c1"]), ("b", "g", ["R1"], ["c2"])], "analysis_id string, finding_id string, rule_ids array<string>, chunk_ids array<string>")
    got = {r.rule_id: (r.confirms, r.dismisses, r.score) for r in learning.rule_reliability(feedback, findings).collect()}
    assert got == {"R1": (1, 1, pytest.approx(4 / 7)), "R2": (0, 1, 0.5)}
    assert {r.chunk: r.boost for r in learning.chunk_boosts(feedback, findings).collect()} == {"c1": pytest.approx(-0.1), "c2": pytest.approx(0.2)}
    assert one(spark, learning.boost(F.lit(10), F.lit(0))) == 1


def test_retrieval(spark):
    chunks = spark.createDataFrame([("a", "cash flow from operations"), ("b", "promoter holding pledge"), ("c", "cash cash cash")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "operating cash"), (2, "pledged shares")], "query int, query_text string")
    hits = retrieval.ranked(retrieval.bm25_search(asked, chunks))
    assert {(r["query"], r.rank): r.chunk for r in hits.collect()}[2, 1] == "b" and hits.count() == 3
    report_ = retrieval.evaluate(hits, spark.createDataFrame([(1, "c"), (2, "a")], "query int, chunk string")).first()
    assert (report_.queries, report_.recall_3) == (2, 0.5)
    fused = {r.chunk: r.score for r in retrieval.fuse((spark.createDataFrame([(1, "a", 1)], "query int, chunk string, rank int"), 1), (spark.createDataFrame([(1, "a", 3), (1, "b", 1)], "query int, chunk string, rank int"), 2)).collect()}
    assert fused == {"a": pytest.approx(1 / 61 + 2 / 63), "b": pytest.approx(2 / 61)}


XML = """<?xml version="1.0"?><xbrl xmlns:in="x"><context id="Q"><period><startDate>2024-07-01</startDate><endDate>2024-09-30</endDate></period></context>
<context id="I"><period><instant>2024-09-30</instant></period></context><context id="D"><scenario><explicitMember>x</explicitMember></scenario><period><startDate>2024-07-01</startDate><endDate>2024-09-30</endDate></period></context>
<in:RevenueFromOperations contextRef="Q">3627000000</in:RevenueFromOperations><in:RevenueFromOperations contextRef="D">1</in:RevenueFromOperations><in:Assets contextRef="I">20730100000</in:Assets>
<in:TradeReceivablesCurrent contextRef="I">10000000</in:TradeReceivablesCurrent><in:TradeReceivablesNoncurrent contextRef="I">20000000</in:TradeReceivablesNoncurrent>
<in:CashAndCashEquivalentsCashFlowStatement contextRef="Q">50000000</in:CashAndCashEquivalentsCashFlowStatement><in:CashAndCashEquivalentsCashFlowStatement contextRef="Q">90000000</in:CashAndCashEquivalentsCashFlowStatement>
<in:PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities contextRef="Q">218400000</in:PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities></xbrl>"""


def test_tagged_filings(spark):
    bad = [b"not xml", b"<other/>", b"<xbrl></xbrl>", b'<!DOCTYPE x [<!ENTITY a "b">]><xbrl>&a;</xbrl>']
    files = spark.createDataFrame([("good", bytearray(XML.encode()))] + [(f"bad{k}", bytearray(b)) for k, b in enumerate(bad)], "path string, content binary")
    elements = filings.read_instances(files)
    assert {r.path for r in elements.where("error is not null").collect()} == {"bad0", "bad1", "bad2", "bad3"}
    got = {r.key: (r.kind, r.fiscal_year, r.part, float(r.value)) for r in filings.to_facts(elements).collect()}
    assert got["revenue_from_operations"] == ("quarter", 2025, 2, 362.7) and got["total_assets"] == ("quarter", 2025, 2, 2073.01) and got["trade_receivables"][3] == 3
    assert got["opening_cash_and_equivalents"][3] == 5 and got["closing_cash_and_equivalents"][3] == 9 and got["purchase_of_property_plant_equipment"][3] == -21.84
    kinds = spark.createDataFrame([("a.bin", bytearray(b"  %PDF-1")), ("b.xml", bytearray(b"x")), ("c", bytearray(b" <x")), ("d", bytearray(b"zz"))], "path string, content binary")
    assert [r.k for r in kinds.select(filings.kind_of(F.col("content"), F.col("path")).alias("k")).collect()] == ["offer_document", "tagged_filing", "tagged_filing", None]


def test_knowledge(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "dso.md").write_text("---\ntitle: \"Days sales\"\n---\n# Top\n\n## What it is\n\nText one.\n\n## How\n\n" + "\n\n".join(f"Block {k} " + "word " * 40 for k in range(20)))
    got = knowledge.chunks(knowledge.read_markdown(spark, str(tmp_path))).collect()
    assert got[0].chunk_id == "dso#what-it-is" and got[0].title == "Days sales" and {"dso#how", "dso#how-2"} <= {r.chunk_id for r in got}
    assert all(len(r.text) // 4 + 1 <= knowledge.MAX_TOKENS for r in got)


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "b", "2024-01-01 05:00:00"), (2, "c", "2024-01-01 01:00:00")], "k int, v string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(source)
    events = spark.readStream.schema("k int, v string, ts timestamp").parquet(source)
    for name, frame in (("latest", state.latest_by_key(events, ["k"], "v", "ts")), ("counts", state.windowed_counts(events, "ts", ["k"]))):
        frame.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r.k, r.v) for r in spark.table("latest").collect()} == {(1, "b"), (2, "c")} and spark.table("counts").count() == 3
    samples = str(tmp_path / "samples")
    for k, value in enumerate((1.0, 2.0)):
        spark.createDataFrame([("d", "m", value)], "document_id string, metric string, value double").write.mode("append").parquet(samples)
        stream = spark.readStream.schema("document_id string, metric string, value double").parquet(samples)
        state.upsert_cohort_samples(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2.0]


def test_report_tables(spark):
    rows = [("d", "R1", "core", "fired", 3, []), ("d", "R2", "core", "insufficient_data", 2, ["b", "a", "c", "d", "e"]), ("d", "I1", "integrity", "fired", 4, []), ("e", "R1", "core", "passed", 3, [])]
    latest = spark.createDataFrame(rows, "document_id string, rule_id string, pack string, outcome string, severity_rank int, missing array<string>")
    assert {r.document_id: r.risk for r in report.overall_risk(latest).collect()} == {"d": "elevated", "e": "low"}
    card = {(r.document_id, r.pack): (r.fired, r.passed, r.insufficient_data, r.worst_rank) for r in report.scorecard(latest).collect()}
    assert card["d", "core"] == (1, 0, 1, 3) and card["e", "core"] == (0, 1, 0, None)
    assert report.data_gaps(latest).first().missing == ["b", "a", "c", "d"] and report.missing_inputs(latest).first().missing == list("abcde")


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known) and len(known) > 50


@pytest.mark.parametrize("name", ["engine_rules", "engine_metrics", "engine_anomalies", "bm25_topk", "rule_outcomes"])
def test_queries_run(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0
