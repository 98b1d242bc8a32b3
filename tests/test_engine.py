from decimal import Decimal

import pytest
from filings import OFFER, YEARS, annual_facts, fact, frames
from pyspark.sql import functions as F

from tallyspark.catalog.items import ITEMS
from tallyspark.catalog.metrics import METRICS
from tallyspark.catalog.rules import RULES
from tallyspark.functions.timeseries import Grid
from tallyspark.operators import engine, facts


@pytest.fixture(scope="module")
def annual(spark):
    found = engine.analyse(*frames(spark, annual_facts()))
    return {k: v.collect() for k, v in found.items() if k != "grid"} | {"grid": found["grid"]}


def test_catalog_is_whole():
    assert (len(ITEMS), len(METRICS), len(RULES)) == (97, 59, 55)


def test_rules_fire_as_planted(annual):
    fired = {r.rule_id: r.severity for r in annual["latest"] if r.outcome == "fired"}
    assert fired == {
        "WC_RECEIVABLES_OUTPACE_REVENUE": "critical", "EQ_CFO_PAT_DIVERGENCE": "high", "EQ_PROFIT_UP_CASH_DOWN": "high",
        "GOV_CONTINGENT_LIABILITIES_LARGE": "high", "EQ_OTHER_INCOME_DEPENDENCE": "medium",
    }
    assert not annual["issues"]
    integrity = [r for r in annual["latest"] if r.pack == "integrity"]
    assert integrity and all(r.outcome == "passed" for r in integrity), [(r.rule_id, r.missing) for r in integrity if r.outcome != "passed"]


def test_outcomes_by_year(annual):
    by_year = {r.period: r.outcome for r in annual["outcomes"] if r.rule_id == "WC_RECEIVABLES_OUTPACE_REVENUE"}
    assert by_year == {"FY23": "insufficient_data", "FY24": "passed", "FY25": "fired"}
    cash = next(r for r in annual["latest"] if r.rule_id == "EQ_PROFIT_UP_CASH_DOWN")
    assert cash.fired_periods == ["FY24", "FY25"]


def test_metrics_at_the_anchor(annual):
    got = {r.metric: float(r.value) for r in annual["metrics"] if r.period == "FY25"}
    want = {"ebitda": 237, "ebitda_margin": 0.192, "dso": 98.2, "debt_to_equity": 0.49, "interest_coverage": 4.92, "free_cash_flow": -80, "cumulative_cfo_to_pat_3y": 0.62, "cfo_to_pat": 0.30, "roe": 0.189}
    assert {k: got[k] for k in want} == pytest.approx(want, rel=6e-3, abs=3e-3)


def test_missing_inputs_are_named(annual):
    rule = next(r for r in annual["latest"] if r.rule_id == "WC_UNBILLED_REVENUE_HIGH")
    assert rule.outcome == "insufficient_data" and rule.missing == ["unbilled_revenue_share"]


def test_unbalanced_sheet_fires_integrity(spark):
    rows = [fact("d", "total_assets", 1700, "year", 2025) if r[1] == "total_assets" and r[3] == 2025 else r for r in annual_facts()]
    found = engine.analyse(*frames(spark, rows))["latest"].where("rule_id = 'INT_BALANCE_SHEET_DOES_NOT_BALANCE'").first()
    assert (found.outcome, found.fired_periods) == ("fired", ["FY25"])


def test_offer_document(spark):
    rows = annual_facts() + [fact("d", k, v) for k, v in OFFER.items()]
    got = engine.analyse(*frames(spark, rows, [("d", "Test Co", "manufacturing", "rhp", 3)]))
    fired = {r.rule_id: r.severity for r in got["latest"].where("pack = 'offer_document' and outcome = 'fired'").collect()}
    assert fired == {"IPO_GCP_EXCEEDS_REGULATORY_CAP": "critical", "IPO_OFS_HEAVY": "medium", "IPO_VALUATION_PREMIUM_TO_PEERS": "medium", "IPO_PROMOTER_ACQUISITION_COST_LOW": "medium"}
    pe = {r.metric: (float(r.value), r.period) for r in got["metrics"].where("metric like 'issue_pe%'").collect()}
    assert pe["issue_pe"] == (pytest.approx(29.85, abs=0.01), None) and pe["issue_pe_premium_to_peers"][0] == pytest.approx(0.658, abs=1e-3)


def test_invalid_facts_become_issues(spark):
    rows = annual_facts() + [fact("d", "made_up_item", 1, "year", 2025), fact("d", "total_issue_size", "large"), fact("d", "other_income", 1), fact("d", "inventories", 9, "year", 2025)]
    kept, issues = facts.validate(frames(spark, rows)[0])
    got = {(r.key, r.reason, r.level) for r in issues.collect()}
    assert {("made_up_item", "unknown item", "warning"), ("total_issue_size", "a number is needed", "error"), ("other_income", "a period is needed", "error"), ("inventories", "repeated fact", "error")} <= got
    assert kept.where("key = 'inventories'").count() == 2


def grid_of(spark, rows):
    return facts.grid(*frames(spark, rows))


def test_balance_is_found_under_another_label(spark):
    rows = [fact("d", "trade_receivables", 7, "year", 2024), fact("d", "revenue_from_operations", 5, "half_year", 2025, 2), fact("d", "revenue_from_operations", 9, "year", 2025)]
    g = grid_of(spark, rows)
    got = g.withColumn("p", Grid().prior(F.col("trade_receivables"))).where("kind = 'half_year' and fiscal_year = 2025 and part = 2").first()
    assert got.p == Decimal(7) and got.observed


def test_nil_needs_its_statement(spark):
    rows = [fact("d", "revenue_from_operations", 5, "year", 2025), fact("d", "total_assets", 5, "year", 2024)]
    got = {r.fiscal_year: (r.exceptional_items, r.inventories) for r in grid_of(spark, rows).where("observed").collect()}
    assert got == {2025: (Decimal(0), None), 2024: (None, Decimal(0))}


def test_quarterly_anchor_and_flags(spark):
    periods = {"Q3FY24": ("quarter", 2024, 3), "Q2FY25": ("quarter", 2025, 2), "Q3FY25": ("quarter", 2025, 3), "9MFY25": ("nine_months", 2025, None)}
    rows = []
    for p, revenue, expenses, pat in (("Q3FY24", 500, 400, 60), ("Q2FY25", 480, 400, 40), ("Q3FY25", 430, 440, -5), ("9MFY25", 1400, 1300, 60)):
        for k, v in (("revenue_from_operations", revenue), ("total_expenses", expenses), ("finance_costs", 10), ("depreciation_amortisation", 10), ("profit_after_tax", pat)):
            rows.append(fact("d", k, v, *periods[p]))
    got = engine.analyse(*frames(spark, rows, [("d", "Test Co", "manufacturing", "quarterly_result", 3)]))
    assert [(r.kind, r.part) for r in got["grid"].where("is_anchor").select("kind", "part").collect()] == [("quarter", 3)]
    fired = {r.rule_id for r in got["latest"].where("outcome = 'fired'").collect()}
    assert {"QTR_REVENUE_DECLINE_YOY", "QTR_MARGIN_COLLAPSE_QOQ", "QTR_SWING_TO_LOSS"} <= fired


def test_history_anomaly(spark):
    pats = (150, 155, 148, 152, 151, 40)
    rows = [fact("d", k, v, "year", 2020 + n) for n, pat in enumerate(pats) for k, v in (("profit_after_tax", pat), ("revenue_from_operations", 1000))]
    got = {r.metric: r for r in engine.analyse(*frames(spark, rows))["anomalies"].collect()}
    assert (got["pat_margin"].direction, got["pat_margin"].adverse, got["pat_margin"].basis) == ("low", True, "history")
    assert got["pat_margin"].score < -3 and got["pat_margin"].reference == pytest.approx(0.151)


def test_cohort_anomaly_leaves_the_document_out(spark):
    def peers(values):
        return spark.createDataFrame([("dso", "manufacturing", "mid", "year", Decimal(v), f"p{n}") for n, v in enumerate(values)] + [("dso", "manufacturing", "mid", "year", Decimal(999), "d")], "metric string, sector string, size_bucket string, kind string, value decimal(24,12), document_id string")

    def flagged(values):
        got = engine.analyse(*frames(spark, annual_facts()), samples=peers(values))["anomalies"].where("basis = 'cohort' and metric = 'dso'").collect()
        return [r.direction for r in got]

    assert flagged([45, 48, 50, 55, 60, 65, 70, 72]) == ["high"]
    assert flagged([80, 90, 100, 110, 120, 130, 140, 160]) == []
    assert flagged([45, 48, 50]) == []


def test_excluded_sector_is_insufficient(spark):
    got = engine.analyse(*frames(spark, annual_facts(), [("d", "Bank", "banking", "annual_report", 3)]))
    assert got["grid"].where("dso is not null").count() == 0
    assert got["outcomes"].where("rule_id = 'WC_DSO_ELEVATED'").count() == 0


def test_empty_tables(spark):
    got = engine.analyse(*frames(spark, annual_facts()[:0] or [], ()))
    assert got["latest"].count() == 0 and got["metrics"].count() == 0
    assert len(YEARS) == 43


def test_a_broken_rule_costs_only_itself(spark):
    """One reads a column that isn't there, one has a number for a condition: both are issues, the others' outcomes stand."""


    from tallyspark.catalog.rules import Rule

    facts, documents = frames(spark, annual_facts())
    some = dict(list(RULES.items())[:6])
    broken = {"BAD-1": Rule("BAD-1", "own", "low", lambda t: F.col("no_such_column") > 0, ()), "BAD-2": Rule("BAD-2", "own", "low", lambda t: F.col("revenue_from_operations") + 1, ())}
    found = engine.analyse(facts, documents, rules=some | broken)
    whole = engine.analyse(facts, documents, rules=some)
    rows = lambda f: sorted((r.document_id, r.rule_id, str(r.period), r.outcome) for r in f["outcomes"].collect())
    assert rows(found) == rows(whole) != []
    issues = {(r.key, r.level) for r in found["issues"].where("key like 'BAD%'").collect()}
    assert issues == {("BAD-1", "error"), ("BAD-2", "error")} and found["issues"].where("key not like 'BAD%'").count() == whole["issues"].count()
    assert engine.analyse(facts, documents, rules={})["outcomes"].count() == 0
