"""Metrics: derived columns of the grid, each with unit, direction and the sectors it does not suit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.timeseries import Grid, amount, divide, rel_diff
from .items import CRORE, DAYS, DOCUMENT, PERIOD, RATIO, RUPEES, TIMES

# Sectors.
FINANCIALS = frozenset({"banking", "nbfc", "insurance"})
NO_STOCK = FINANCIALS | {"it_services", "consumer_internet"}


class Terms:
    """Columns of the grid by name, the window functions, and division that keeps the amount's scale."""

    def __init__(self, grid: Grid):
        self.grid = grid

    def __getattr__(self, name: str) -> Column:
        return F.col(name)

    @staticmethod
    def ratio(a: Column, b: Column) -> Column:
        # Sums are wider than amounts, and a wide dividend leaves a quotient few digits.
        return amount(divide(amount(a), amount(b)))

    amount, abs, rel_diff, coalesce = map(staticmethod, (amount, F.abs, rel_diff, F.coalesce))

    def yearly(self, x: Column) -> Column:
        # 365 times an amount may have more digits than an amount; the quotient fits again.
        return amount(divide(x * 365, F.col("days")))


Formula = Callable[[Terms], Column]


@dataclass(frozen=True)
class Metric:
    key: str
    category: str
    unit: str
    better: str
    formula: Formula
    exclude: frozenset[str] = frozenset()
    headline: bool = False
    scope: str = PERIOD
    #: Metrics the formula reads.
    uses: tuple[str, ...] = ()


def _ratio(top: str, bottom: str) -> Formula:
    return lambda t: t.ratio(getattr(t, top), getattr(t, bottom))


def _growth(name: str) -> Formula:
    return lambda t: t.grid.growth(getattr(t, name))


F_, NS = FINANCIALS, NO_STOCK
HIGHER, LOWER, NEUTRAL = "higher", "lower", "neutral"

METRICS: dict[str, Metric] = {
    m.key: m
    for m in [
        # profitability
        Metric("ebitda", "profitability", CRORE, HIGHER, lambda t: t.revenue_from_operations - (t.total_expenses - t.finance_costs - t.depreciation_amortisation), headline=True),
        Metric("ebit", "profitability", CRORE, HIGHER, lambda t: t.ebitda - t.depreciation_amortisation, uses=("ebitda",)),
        Metric("cost_of_goods_sold", "profitability", CRORE, NEUTRAL, lambda t: t.cost_of_materials_consumed + t.purchases_of_stock_in_trade + t.changes_in_inventories),
        Metric("gross_margin", "profitability", RATIO, HIGHER, lambda t: t.ratio(t.revenue_from_operations - t.cost_of_goods_sold, t.revenue_from_operations), NS, uses=("cost_of_goods_sold",)),
        Metric("ebitda_margin", "profitability", RATIO, HIGHER, _ratio("ebitda", "revenue_from_operations"), F_, True, uses=("ebitda",)),
        Metric("pat_margin", "profitability", RATIO, HIGHER, _ratio("profit_after_tax", "revenue_from_operations"), headline=True),
        Metric("employee_cost_ratio", "profitability", RATIO, LOWER, _ratio("employee_benefits_expense", "revenue_from_operations")),
        Metric("other_expenses_ratio", "profitability", RATIO, LOWER, _ratio("other_expenses", "revenue_from_operations")),
        # earnings quality
        Metric("other_income_share_of_pbt", "earnings_quality", RATIO, LOWER, _ratio("other_income", "profit_before_tax")),
        Metric("exceptional_items_share_of_pbt", "earnings_quality", RATIO, NEUTRAL, _ratio("exceptional_items", "profit_before_tax")),
        Metric("effective_tax_rate", "earnings_quality", RATIO, NEUTRAL, lambda t: t.ratio(t.coalesce(t.total_tax_expense, t.current_tax + t.deferred_tax), t.profit_before_tax)),
        Metric("cfo_to_pat", "earnings_quality", TIMES, HIGHER, _ratio("net_cash_from_operating_activities", "profit_after_tax"), headline=True),
        Metric("cfo_to_ebitda", "earnings_quality", TIMES, HIGHER, _ratio("net_cash_from_operating_activities", "ebitda"), F_, uses=("ebitda",)),
        Metric("cumulative_cfo_to_pat_3y", "earnings_quality", TIMES, HIGHER, lambda t: t.ratio(t.grid.trailing_sum(t.net_cash_from_operating_activities, 3), t.grid.trailing_sum(t.profit_after_tax, 3))),
        Metric("accruals_ratio", "earnings_quality", RATIO, LOWER, lambda t: t.ratio(t.profit_after_tax - t.net_cash_from_operating_activities, t.grid.avg(t.total_assets))),
        # working capital
        Metric("dso", "working_capital", DAYS, LOWER, lambda t: t.amount(t.ratio(t.grid.avg(t.trade_receivables), t.revenue_from_operations) * t.days), F_, True),
        Metric("dio", "working_capital", DAYS, LOWER, lambda t: t.amount(t.ratio(t.grid.avg(t.inventories), t.cost_of_goods_sold) * t.days), NS, uses=("cost_of_goods_sold",)),
        Metric("dpo", "working_capital", DAYS, NEUTRAL, lambda t: t.amount(t.ratio(t.grid.avg(t.trade_payables), t.cost_of_goods_sold) * t.days), NS, uses=("cost_of_goods_sold",)),
        Metric("cash_conversion_cycle", "working_capital", DAYS, LOWER, lambda t: t.dso + t.dio - t.dpo, NS, uses=("dso", "dio", "dpo")),
        Metric("net_working_capital", "working_capital", CRORE, NEUTRAL, lambda t: t.trade_receivables + t.inventories - t.trade_payables, F_),
        Metric("unbilled_revenue_share", "working_capital", RATIO, LOWER, lambda t: t.ratio(t.unbilled_revenue, t.trade_receivables + t.unbilled_revenue), F_),
        Metric("receivables_growth", "working_capital", RATIO, LOWER, _growth("trade_receivables"), F_),
        Metric("inventory_growth", "working_capital", RATIO, LOWER, _growth("inventories"), F_),
        # leverage and liquidity
        Metric("total_debt", "leverage", CRORE, NEUTRAL, lambda t: t.borrowings_non_current + t.borrowings_current, F_),
        Metric("net_debt", "leverage", CRORE, LOWER, lambda t: t.total_debt - t.cash_and_cash_equivalents - t.other_bank_balances - t.current_investments, F_, uses=("total_debt",)),
        Metric("debt_to_equity", "leverage", TIMES, LOWER, _ratio("total_debt", "total_equity"), F_, True, uses=("total_debt",)),
        Metric("net_debt_to_ebitda", "leverage", TIMES, LOWER, lambda t: t.ratio(t.net_debt, t.yearly(t.ebitda)), F_, uses=("net_debt", "ebitda")),
        Metric("interest_coverage", "leverage", TIMES, HIGHER, _ratio("ebit", "finance_costs"), F_, True, uses=("ebit",)),
        Metric("borrowings_growth", "leverage", RATIO, LOWER, _growth("total_debt"), F_, uses=("total_debt",)),
        Metric("finance_cost_to_revenue", "leverage", RATIO, LOWER, _ratio("finance_costs", "revenue_from_operations"), F_),
        Metric("current_ratio", "liquidity", TIMES, HIGHER, _ratio("total_current_assets", "total_current_liabilities"), F_),
        Metric("quick_ratio", "liquidity", TIMES, HIGHER, lambda t: t.ratio(t.total_current_assets - t.inventories, t.total_current_liabilities), F_),
        # cash flow
        Metric("capex", "cash_flow", CRORE, NEUTRAL, lambda t: -t.purchase_of_property_plant_equipment),
        Metric("free_cash_flow", "cash_flow", CRORE, HIGHER, lambda t: t.net_cash_from_operating_activities - t.capex, headline=True, uses=("capex",)),
        Metric("capex_to_depreciation", "cash_flow", TIMES, NEUTRAL, _ratio("capex", "depreciation_amortisation"), uses=("capex",)),
        Metric("cwip_to_ppe", "cash_flow", RATIO, NEUTRAL, _ratio("capital_work_in_progress", "property_plant_equipment"), F_),
        # governance
        Metric("contingent_liabilities_to_net_worth", "governance", RATIO, LOWER, _ratio("contingent_liabilities", "total_equity")),
        Metric("related_party_revenue_share", "governance", RATIO, LOWER, _ratio("related_party_revenue", "revenue_from_operations")),
        Metric("related_party_loans_to_net_worth", "governance", RATIO, LOWER, _ratio("related_party_loans_given", "total_equity")),
        # growth and returns
        Metric("revenue_growth", "growth", RATIO, HIGHER, _growth("revenue_from_operations"), headline=True),
        Metric("revenue_growth_qoq", "growth", RATIO, HIGHER, lambda t: t.grid.seq_growth(t.revenue_from_operations)),
        Metric("ebitda_growth", "growth", RATIO, HIGHER, _growth("ebitda"), uses=("ebitda",)),
        Metric("pat_growth", "growth", RATIO, HIGHER, _growth("profit_after_tax"), headline=True),
        Metric("eps_growth", "growth", RATIO, HIGHER, _growth("eps_diluted")),
        Metric("employee_cost_growth", "growth", RATIO, LOWER, _growth("employee_benefits_expense")),
        Metric("capital_employed", "returns", CRORE, NEUTRAL, lambda t: t.total_equity + t.total_debt, F_, uses=("total_debt",)),
        Metric("roe", "returns", RATIO, HIGHER, lambda t: t.ratio(t.yearly(t.profit_after_tax), t.grid.avg(t.total_equity)), headline=True),
        Metric("roce", "returns", RATIO, HIGHER, lambda t: t.ratio(t.yearly(t.ebit), t.grid.avg(t.capital_employed)), F_, True, uses=("ebit", "capital_employed")),
        Metric("roa", "returns", RATIO, HIGHER, lambda t: t.ratio(t.yearly(t.profit_after_tax), t.grid.avg(t.total_assets))),
        Metric("asset_turnover", "returns", TIMES, HIGHER, lambda t: t.ratio(t.yearly(t.revenue_from_operations), t.grid.avg(t.total_assets)), F_),
        Metric("implied_eps", "integrity", RUPEES, NEUTRAL, lambda t: t.ratio(t.amount(t.coalesce(t.profit_attributable_to_owners, t.profit_after_tax) * t.face_value_per_share), t.coalesce(t.paid_up_equity_share_capital, t.equity_share_capital))),
        # offer documents: one value a document, at its anchor
        Metric("ofs_share_of_issue", "issue_structure", RATIO, NEUTRAL, _ratio("offer_for_sale_size", "total_issue_size"), scope=DOCUMENT),
        Metric("gcp_share_of_fresh_issue", "issue_structure", RATIO, LOWER, _ratio("general_corporate_purposes", "fresh_issue_size"), scope=DOCUMENT),
        Metric("debt_repayment_share_of_fresh_issue", "issue_structure", RATIO, NEUTRAL, _ratio("objects_debt_repayment", "fresh_issue_size"), scope=DOCUMENT),
        Metric("promoter_cost_multiple", "issue_structure", TIMES, NEUTRAL, _ratio("price_band_upper", "promoter_average_cost_per_share"), scope=DOCUMENT),
        Metric("promoter_dilution", "issue_structure", RATIO, NEUTRAL, lambda t: t.promoter_holding_pre_issue - t.promoter_holding_post_issue, scope=DOCUMENT),
        Metric("issue_pe", "valuation", TIMES, NEUTRAL, _ratio("price_band_upper", "eps_diluted"), scope=DOCUMENT),
        Metric("issue_pe_premium_to_peers", "valuation", RATIO, LOWER, lambda t: t.ratio(t.issue_pe, t.peer_median_pe) - 1, scope=DOCUMENT, uses=("issue_pe",)),
        Metric("litigation_to_net_worth", "governance", RATIO, LOWER, _ratio("litigation_amount_against_company", "total_equity"), scope=DOCUMENT),
    ]
}


def levels() -> list[list[Metric]]:
    """Metrics by depth of what they use: a level reads columns of earlier levels only."""
    depth: dict[str, int] = {}

    def of(key: str) -> int:
        if key not in depth:
            depth[key] = max((of(k) + 1 for k in METRICS[key].uses), default=0)
        return depth[key]

    found: list[list[Metric]] = [[] for _ in range(max(map(of, METRICS)) + 1)]
    for m in METRICS.values():
        found[of(m.key)].append(m)
    return found
