import pytest
from filings import annual_facts, frames

from tallyspark.operators import engine
from tallyspark.operators.lineage import written


@pytest.fixture(scope="module")
def traced(spark):
    """Three years of one filing; FY25 without depreciation and receivables, FY24 with a profit before tax of nil, no associates' share, no unbilled revenue."""
    rows = [r for r in annual_facts() if (r[1], r[3]) not in (("depreciation_amortisation", 2025), ("trade_receivables", 2025))]
    rows = [(*r[:5], 0 * r[5], r[6]) if (r[1], r[3]) == ("profit_before_tax", 2024) else r for r in rows]
    found = engine.analyse(*frames(spark, rows))
    grid = written(engine.with_provenance(found["grid"]), "traced")
    metrics = {(r.metric, r.fiscal_year): r for r in engine.metric_provenance(grid).collect()}
    rules = {(r.rule_id, r.fiscal_year): r for r in engine.rule_provenance(grid).collect()}
    outcomes = {(r.rule_id, r.fiscal_year): r for r in found["outcomes"].collect()}
    return metrics, rules, outcomes


def test_gaps_name_facts(traced):
    metrics, rules, _ = traced
    assert metrics["ebitda", 2025].missing == ["f:depreciation_amortisation@FY25"]
    assert metrics["net_debt_to_ebitda", 2025].missing == ["f:depreciation_amortisation@FY25"]
    assert metrics["interest_coverage", 2025].missing == ["f:depreciation_amortisation@FY25"]
    assert metrics["receivables_growth", 2025].missing == ["f:trade_receivables@FY25"]
    assert metrics["receivables_growth", 2023].missing == ["f:trade_receivables@FY22"]
    assert metrics["ebitda_growth", 2025].missing == ["f:depreciation_amortisation@FY25"]
    assert metrics["cumulative_cfo_to_pat_3y", 2023].missing == sorted(f"f:{k}@FY{y}" for k in ("net_cash_from_operating_activities", "profit_after_tax") for y in (21, 22))
    assert metrics["net_working_capital", 2025].missing == ["f:trade_receivables@FY25"]
    assert metrics["ebitda", 2024].missing == [] and metrics["cash_conversion_cycle", 2025].missing == ["f:trade_receivables@FY25"]
    assert metrics["issue_pe", 2025].missing == ["f:price_band_upper"]
    assert metrics["issue_pe_premium_to_peers", 2025].missing == ["f:peer_median_pe", "f:price_band_upper"]
    assert rules["WC_UNBILLED_REVENUE_HIGH", 2025].missing == ["f:trade_receivables@FY25", "f:unbilled_revenue@FY24", "f:unbilled_revenue@FY25"]
    assert rules["LEV_WEAK_INTEREST_COVERAGE", 2025].missing == ["f:depreciation_amortisation@FY25"]
    assert rules["GOV_CUSTOMER_CONCENTRATION", 2025].missing == ["f:top_10_customer_revenue_share@FY25", "f:top_customer_revenue_share@FY25"]


def test_divisions_by_zero_are_reasons(traced):
    metrics, rules, _ = traced
    assert metrics["effective_tax_rate", 2024].missing == ["division by zero: profit_before_tax is 0 in FY24"]
    assert rules["EQ_OTHER_INCOME_DEPENDENCE", 2024].missing == []  # one false side decides


def test_inputs_and_notes(traced):
    metrics, rules, _ = traced
    assert metrics["ebitda", 2024].inputs == ["f:depreciation_amortisation@FY24", "f:finance_costs@FY24", "f:revenue_from_operations@FY24", "f:total_expenses@FY24"]
    assert metrics["ebitda_margin", 2024].inputs == ["f:revenue_from_operations@FY24", "m:ebitda@FY24"]
    assert metrics["effective_tax_rate", 2023].inputs == ["f:profit_before_tax@FY23", "f:total_tax_expense@FY23"]
    assert metrics["dso", 2024].inputs == ["f:revenue_from_operations@FY24", "f:trade_receivables@FY23", "f:trade_receivables@FY24"]
    assert metrics["dso", 2023].notes == ["trade_receivables: no opening balance before FY23, closing balance used"]
    # Notes of what a metric is made of, each once, in the order in which it is read.
    debt = metrics["net_debt", 2024].notes
    assert debt == ["other_bank_balances not reported for FY24; read as nil", "current_investments not reported for FY24; read as nil"]
    assert metrics["net_debt_to_ebitda", 2024].notes == debt
    assert metrics["roce", 2023].notes == ["capital_employed: no opening balance before FY23, closing balance used"]
    assert "instruments_entirely_equity_in_nature not reported for FY24; read as nil" in rules["INT_EQUITY_COMPONENTS", 2024].notes


def test_missing_goes_with_the_outcome(traced):
    """What lacks is told for all outcomes without data, and for no others."""
    _, rules, outcomes = traced
    assert set(rules) == set(outcomes)
    for key, r in rules.items():
        assert bool(r.missing) == (outcomes[key].outcome == "insufficient_data"), key
