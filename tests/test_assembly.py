"""Filings put together, printed columns, figures linked in prose, peers without pairs, whole lists."""

import random
from datetime import date
from decimal import Decimal

import numpy as np
import pytest
from filings import annual_facts, frames
from pyspark.sql import functions as F

from tallyspark.catalog.rules import RULES, Rule
from tallyspark.functions import printed, statistics, text
from tallyspark.operators import engine, evidence, labels, layout, learning, reconcile, report, retrieval, statements, store
from tallyspark.operators import facts as facts_
from tallyspark.sources import filings as tagged


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


HEAD = '<xbrl xmlns:in="x"><context id="OneD"><period><startDate>2024-07-01</startDate><endDate>2024-09-29</endDate></period></context><context id="I"><period><instant>2024-09-30</instant></period></context><context id="J"><period><instant>2020-01-01</instant></period></context>'
SAID = {
    "NameOfTheCompany": "Example Ltd", "ScripCode": "500001", "Symbol": "NOTLISTED", "NatureOfReportStandaloneConsolidated": "Consolidated", "WhetherResultsAreAuditedOrUnaudited": "Audited", "DateOfEndOfFinancialYear": "2025-03-31",
    "DateOfStartOfReportingPeriod": "2024-07-01", "DateOfEndOfReportingPeriod": "2024-09-30", "DateOfBoardMeetingWhenFinancialResultsWereApproved": "2024-11-02", "DeclarationOfUnmodifiedOpinionOrStatementOnImpactOfAuditQualification": "unmodified opinion",
    "RevenueFromOperations": "3627000000", "ProfitBeforeExceptionalItemsAndTax": "1000000000", "ExceptionalItemsBeforeTax": "100000000", "ProfitBeforeTax": "900000000", "SomethingNobodyMaps": "7", "DescriptionOfNothing": "8",
}


def filing(said):
    return (HEAD + "".join(f'<in:{k} contextRef="OneD">{v}</in:{k}>' for k, v in said.items()) + '<in:Assets contextRef="I">20730100000</in:Assets><in:Assets contextRef="J">1</in:Assets></xbrl>').encode()


def test_whole_filings(spark):
    bare = {k: v for k, v in SAID.items() if k not in ("DateOfEndOfFinancialYear", "DateOfStartOfReportingPeriod", "NameOfTheCompany")}
    files = spark.createDataFrame([("a", bytearray(filing(SAID))), ("b", bytearray(filing(bare))), ("c", bytearray(b"no"))], "path string, content binary")
    found = tagged.parse_filings(tagged.read_instances(files))
    documents = {r.path: r for r in found["documents"].collect()}
    a = documents["a"]
    assert (a.company, a.bse_code, a.nse_symbol, a.basis, a.audited, a.filed, a.fye_month, a.opinion) == ("Example Ltd", "500001", None, "consolidated", True, date(2024, 11, 2), 3, "unmodified") and set(documents) == {"a", "b"}
    facts = {(r.path, r.key): r for r in found["facts"].collect()}
    revenue = facts["a", "revenue_from_operations"]
    assert (revenue.kind, revenue.fiscal_year, revenue.part, revenue.value) == ("quarter", 2025, 2, Decimal("362.7"))
    assert facts["a", "exceptional_items"].value == -10 and facts["a", "auditor_opinion"].text == "unmodified" and facts["a", "total_assets"].value == Decimal("2073.01")
    issues = {(r.path, r.message.split(" ")[0]) for r in found["issues"].collect()}
    assert {("a", "context"), ("a", "exceptional"), ("a", "balance"), ("b", "fiscal"), ("b", "the"), ("c", "not")} <= issues
    unmapped = {r.path: r.elements for r in found["unmapped"].collect()}
    assert unmapped["a"] == ["ScripCode", "SomethingNobodyMaps"]
    assert tagged.unmapped(tagged.read_instances(files), ()).first().elements == ["ScripCode", "SomethingNobodyMaps"]


def test_filings_that_merge(spark):
    rows = [(1, 1, "X", None, None, "A Ltd", "standalone", 3), (1, 2, "X", "5", None, "A Limited", "standalone", 3), (1, 3, None, None, None, "a ltd", "consolidated", 3), (1, 4, "Y", None, None, "A Ltd", "standalone", 3), (1, 5, "X", None, None, "A", "standalone", 12)]
    frame = spark.createDataFrame(rows, "company int, n int, isin string, bse_code string, nse_symbol string, name string, basis string, fye_month int")
    assert {r.n: r.reason for r in reconcile.compatible(frame, ("company",), ("n",)).collect()} == {3: "standalone and consolidated figures", 4: "another company", 5: "another fiscal year end"}


def test_dates_and_faces(spark):
    assert one(spark, printed.find_dates(F.lit("31.03.2024 then March 31, 2023 and 30 June 2022; 31/31/2020"))) == [date(2024, 3, 31), date(2023, 3, 31), date(2022, 6, 30)]
    faces = {"nominal value of Rs. 10 each": 10, "Equity shares of ₹2 and ₹2/- each": 2, "face value of ₹10; ₹5 each": None, "₹5 each": None}
    assert {k: one(spark, printed.face_value(F.lit(k))) for k in faces} == faces
    ends = [("quarter", ("quarter", 2025, 2)), ("half_year", ("half_year", 2025, 1)), ("nine_months", None), ("unknown", None)]
    for hint, want in ends:
        got = one(spark, printed.period_ending(F.lit(date(2024, 9, 30)), F.lit(hint), F.lit(3)))
        assert (got and tuple(got)) == want
    words = F.array(*map(F.lit, ("Revenue", "1,234", "(5.0)", "-", "note")))
    assert one(spark, printed.value_count(words)) == 2
    heads = {"Revenue from operations": True, "Liabilities": True, "As at March 31, 2024": False, "Particulars": False, "(₹ in crore)": True, "FY 2024": False, "Note": False, "": True}
    assert {k: one(spark, printed.is_row_label(F.lit(k))) for k in heads} == heads
    assert one(spark, printed.is_line_item(F.lit("Revenue"))) and not one(spark, printed.is_line_item(F.lit("DateOfX")))


def test_periods_of_printed_columns(spark):
    d = date
    rows = [
        ("d", "profit_and_loss", 0, None, d(2024, 9, 30), "half_year"), ("d", "profit_and_loss", 1, d(2023, 4, 1), d(2024, 3, 31), "unknown"), ("d", "cash_flow", 0, None, d(2024, 9, 30), "quarter"),
        ("d", "balance_sheet", 0, None, d(2024, 9, 30), "instant"), ("d", "balance_sheet", 1, None, d(2023, 3, 31), "instant"), ("d", "balance_sheet", 2, None, d(2022, 12, 31), "instant"), ("d", "cash_flow", 1, None, d(2024, 3, 31), "unknown"),
    ]
    frame = spark.createDataFrame(rows, "document_id string, statement string, n int, start_date date, end_date date, hint string")
    got = {(r.statement, r.n): r.period and tuple(r.period) for r in statements.column_periods(frame, F.lit(3)).collect()}
    assert got["profit_and_loss", 0] == got["balance_sheet", 0] == ("half_year", 2025, 1) and got["cash_flow", 0] == ("quarter", 2025, 2)
    assert got["profit_and_loss", 1] == got["cash_flow", 1] == ("year", 2024, None) and got["balance_sheet", 1] == ("year", 2023, None) and got["balance_sheet", 2] is None


def test_columns_and_pages(spark):
    words = [(1, "Revenue", 10.0, 60.0, 50.0)] + [(1, h, x, x + 40, 10.0) for h, x in (("March", 180.0), ("2024", 222.0), ("June", 330.0))]
    for k in range(4):
        words += [(1, f"{k}1", 230.0, 250.0 + k % 2, 50.0 + 10 * k), (1, f"{k}2", 355.0, 370.0, 50.0 + 10 * k)]
    frame = spark.createDataFrame(words, "page int, text string, x0 double, x1 double, top double")
    got = {r.column: r for r in layout.find_columns(frame, F.col("text").rlike("^[0-9]+$") & (F.col("top") > 20)).collect()}
    assert {k: r.header for k, r in got.items()} == {1: "March 2024", 2: "June"} and got[2].left >= got[1].right
    pages = spark.createDataFrame([("d", "bs", 1, None, 1), ("d", "bs", 2, [1], 10), ("d", "bs", 3, None, None), ("e", "bs", 1, [1], None)], "document_id string, statement string, page int, columns array<int>, scale int")
    kept, issues = layout.continued(pages)
    assert {(r.document_id, r.page): (r.columns, r.scale) for r in kept.collect()} == {("d", 2): ([1], 10), ("d", 3): ([1], 10)}
    assert {(r.document_id, r.page): r.reason for r in issues.collect()} == {("d", 1): "no period columns found", ("e", 1): "currency unit not stated"}
    same = spark.createDataFrame([(1, "a", 10.0), (1, "a", 10.0)], "page int, text string, x1 double")
    columns = spark.createDataFrame([(1, 0, 5.0, 15.0)], "page int, column int, left double, right double")
    assert [r.column for r in layout.assign_columns(same, columns).collect()] == [0, 0]


def test_figures_are_linked_in_the_text(spark):
    shown = spark.createDataFrame([("d", "m:margin@FY25", "19.2%"), ("d", "m:dso@FY25", "98 days"), ("d", "f:cash@FY25", "₹80.00 cr"), ("d", "f:loan@FY25", "₹80.00 cr"), ("d", "m:other@FY25", "98 days")], "document_id string, ref string, display string")
    texts = spark.createDataFrame([("d", 1, "Margin 19.2% with {{m:dso@FY25}} and 98 days; cash ₹80 crore, 7%."), ("d", 2, None), ("e", 3, "19.2%")], "document_id string, text_id int, text string")
    got = {r.text_id: r.linked for r in evidence.linked(texts, shown).collect()}
    assert got == {1: "Margin {{m:margin@FY25}} with {{m:dso@FY25}} and 98 days; cash ₹80 crore, 7%.", 2: None, 3: "19.2%"}
    prefer = spark.createDataFrame([("d", "m:dso@FY25"), ("d", "f:loan@FY25")], "document_id string, ref string")
    got = {r.text_id: r.linked for r in evidence.linked(texts, shown, preferred=prefer, skip=F.array(F.lit("19.2%"))).collect()}
    assert got[1] == "Margin 19.2% with {{m:dso@FY25}} and {{m:dso@FY25}}; cash {{f:loan@FY25}}, 7%."
    got = {r.text_id: r.linked for r in evidence.linked(texts, shown, scope=prefer).collect()}
    assert got[1] == "Margin 19.2% with {{m:dso@FY25}} and {{m:dso@FY25}}; cash {{f:loan@FY25}}, 7%."


def test_peers_equal_a_slow_loop(spark):
    r = random.Random(4)
    rows = [(d, "AB"[d % 2], float(r.randrange(8) if d % 3 else r.uniform(0, 9))) for d in range(40) for _ in range(r.randrange(0, 4))] + [(99, "C", 1.0)]
    frame = spark.createDataFrame(rows, "who int, cohort string, value double")
    units = spark.createDataFrame([(d, "AB"[d % 2], float(d % 9)) for d in range(45)] + [(99, "C", 2.0)], "who int, cohort string, value double")
    for p in (10, 50, 90):
        got = {x.who: x for x in statistics.peer_percentile(units, frame, ["cohort"], "who", "value", p).collect()}
        for who, cohort, _ in ((u.who, u.cohort, u.value) for u in units.collect()):
            peers = [v for d, c, v in rows if c == cohort and d != who]
            assert (who in got) == bool(peers) and (not peers or (got[who].n == len(peers) and got[who].percentile == pytest.approx(np.percentile(peers, p))))
    for x in statistics.peer_mid_rank(units, frame, ["cohort"], "who", "value").collect():
        peers = [v for d, c, v in rows if c == x.cohort and d != x.who]
        assert x.n == len(peers) and (x.mid_rank is None if not peers else x.mid_rank == pytest.approx((sum(v < x.value for v in peers) + sum(v == x.value for v in peers) / 2) / len(peers)))


def test_statistics_sort_an_array_once(spark):
    values = [float(x) for x in np.random.default_rng(0).normal(size=400)]
    frame = spark.createDataFrame([(float(k), values) for k in range(200)], "x double, v array<double>")
    got = [z.z for z in frame.select(statistics.modified_z(F.col("x"), F.col("v")).alias("z")).collect()]
    middle = np.median(values)
    assert got == pytest.approx([0.6745 * (k - middle) / np.median(np.abs(np.array(values) - middle)) for k in range(200)])
    short = spark.createDataFrame([(1.0, [2.0]), (5.0, [2.0, 2.0]), (5.0, [2.0, 2.0, 2.0, 8.0])], "x double, v array<double>")
    assert [r.z for r in short.select(statistics.modified_z(F.col("x"), F.col("v")).alias("z")).collect()] == [None, None, pytest.approx(3 / (1.253314 * 1.5))]


def test_lists_are_whole(spark):
    assert len(text.EXPANSIONS) == 49 and list(text.EXPANSIONS)[:2] == ["dso", "dio"] and len(labels.SPELLINGS) == 9
    words = {"EBITDA rose": {"ebitda", "earn", "interest", "tax", "depreciation", "amortisation", "operat", "profit", "rose"}, "npa yoy": {"npa", "non", "perform", "asset", "yoy", "year"}}
    for given, want in words.items():
        assert set(one(spark, text.tokens(F.lit(given)))) == want, given
    spelled = {
        "Total comprehensive (loss)/(income)": "Total comprehensive income", "Net cash (used in) / generated from operating activities": "Net cash / operating activities", "(Decrease) / increase in payables": "increase decrease in payables",
        "Net cash generated by investing": "Net cash investing", "Non - current assets": "noncurrent assets",
    }
    assert {k: one(spark, labels.normalise(F.lit(k))) for k in spelled} == spelled


def test_headings_weigh_twice(spark):
    chunks = spark.createDataFrame([("a", "cash flow", "Cash", "Flow of cash")], "chunk_id string, text string, title string, heading string")
    got = {r.term: (r.tf, r.length) for r in retrieval.postings(chunks, headings=("title", "heading")).collect()}
    assert got == {"cash": (5, 8), "flow": (3, 8)}


def test_store_keeps_what_belongs(spark, tmp_path):
    path = str(tmp_path / "samples")
    rows = lambda *r: spark.createDataFrame(list(r), "document_id string, sector string, value double")
    store.record_samples(rows(("a", "s", 1.0), ("b", "s", 2.0)), path)
    store.record_samples(rows(("c", "s", 3.0)).where("false"), path, spark.createDataFrame([("a",)], "document_id string"))
    store.record_samples(rows(("b", "s", 5.0), ("d", "s", 6.0)), path)
    assert sorted((r.document_id, r.value) for r in store.load_samples(spark, path, "s", "x").collect()) == [("b", 5.0), ("d", 6.0)]
    found = spark.createDataFrame([("x", "1")], "analysis_id string, finding_id string")
    store.save_findings(found, spark.createDataFrame([("x", "N1")], "analysis_id string, rule_id string"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "findings")).count() == 1 and spark.read.parquet(str(tmp_path / "t" / "rule_versions")).first().status == "proposed"


def test_evidence_and_sheet(spark):
    facts, documents = frames(spark, annual_facts())
    found = engine.analyse(facts, documents)
    shown = {r.ref: r.display for r in evidence.index(facts, found["metrics"], found["outcomes"]).collect()}
    assert shown["f:revenue_from_operations@FY25"] == "₹1,232.00 cr" and shown["f:promoter_holding"] == "62.0%" and shown["f:auditor_opinion"] == "unmodified"
    sheet = report.fact_sheet(found["latest"], found["metrics"], documents, engine.ordered(found["anomalies"]), facts).first().sheet
    assert sheet.startswith("Company: Test Co | sector manufacturing | annual_report") and "- Promoter holding 62.0%" in sheet and sheet.index("Integrity:") < sheet.index("- Promoter holding")
    assert one(spark, report.describe_missing(F.lit("f:trade_receivables@FY24"))) == "Trade receivables (FY24)" and one(spark, report.describe_missing(F.lit("m:x@FY24"))) == "m:x@FY24"


def test_candidates_and_unsound_rules(spark):
    facts, documents = frames(spark, annual_facts())
    grow = Rule("N-1", "core", "low", lambda t: t.revenue_from_operations > 1200, ("revenue_from_operations",), status="proposed")
    got = learning.run_candidate(facts, documents, grow).first()
    assert (got.rule_id, got.documents, got.fired) == ("N-1", 1, 1)
    grid = engine.with_cohort_bounds(engine.with_metrics(facts_.grid(facts, documents)))
    bad = {"B1": Rule("B1", "core", "low", lambda t: t.nobody_has_this > 1, ("nobody_has_this",)), "B2": Rule("B2", "core", "low", lambda t: t.total_assets + 1, ("total_assets",))}
    good, reasons = engine.sound_rules(grid, {"R": RULES[next(iter(RULES))], "N": grow} | bad)
    assert set(good) == {"R", "N"} and set(reasons) == {"B1", "B2"}
    order = spark.createDataFrame([("b", 1, 1), ("a", 1, 1), ("c", 5, 0)], "rule_id string, confirms int, dismisses int")
    assert [r.rule_id for r in learning.in_order(order).collect()] == ["c", "a", "b"]


def test_columns_are_assigned_by_slots(spark):
    """Against all pairs: nested, overlapping, equal and empty columns, edges met exactly, nulls; rows of the plan's joins meet by equality only."""
    r = random.Random(5)
    edges = [float(r.randrange(60)) for _ in range(40)]
    columns = [(n % 2, n, *r.sample(edges, 2)) for n in r.sample(range(90), 90)] + [(0, 100, -5.0, 70.0), (None, 1, 0.0, 60.0), (2, 7, 1.0, 2.0), (1, 8, None, 9.0)]
    words = [(r.choice((0, 1, 1, 2, 3, None)), str(n), r.choice((None, float(r.randrange(-9, 80)), r.randrange(140) / 2))) for n in range(300)]
    want = {}
    for page, text, x in words:
        want[text] = min((c for p, c, a, b in columns if None not in (p, page, a, x) and p == page and a < x <= b), default=None)
    assert len(set(want.values())) > 8
    found = layout.assign_columns(spark.createDataFrame(words, "page int, text string, x1 double"), spark.createDataFrame(columns, "page int, column int, left double, right double"))
    assert found.columns == ["page", "text", "x1", "column"]
    assert sorted((r.text, -1 if r.column is None else r.column) for r in found.collect()) == sorted((k, -1 if v is None else v) for k, v in want.items())
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not [line for line in joins if "<" in line or ">" in line]
