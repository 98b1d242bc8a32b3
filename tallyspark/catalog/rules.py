"""Rules: conditions over the grid's columns, with severity, escalations and where they apply."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.periods import HALF, NINE_MONTHS, QUARTER, YEAR
from .items import DOCUMENT, PERIOD
from .metrics import FINANCIALS, NO_STOCK, Terms

# Severities from least to most, and document types.
SEVERITIES = ("info", "low", "medium", "high", "critical")
ANNUAL, DRHP, RHP, QUARTERLY = "annual_report", "drhp", "rhp", "quarterly_result"
ALL_TYPES = (ANNUAL, DRHP, RHP, QUARTERLY)
ADR, DR, Q = (ANNUAL, DRHP, RHP), (DRHP, RHP), (QUARTERLY,)

Condition = Callable[[Terms], Column]


@dataclass(frozen=True)
class Rule:
    id: str
    pack: str
    severity: str
    when: Condition
    #: Columns the condition needs; shown as evidence, and as missing where they are null.
    needs: tuple[str, ...]
    escalate: tuple[tuple[Condition, str], ...] = ()
    applies_to: tuple[str, ...] = ALL_TYPES
    kinds: tuple[str, ...] = (YEAR,)
    exclude: frozenset[str] = frozenset()
    scope: str = PERIOD
    status: str = "active"


def over(name: str, bound) -> Condition:
    return lambda t: getattr(t, name) > F.lit(str(bound)).cast("decimal(24,12)")


def under(name: str, bound) -> Condition:
    return lambda t: getattr(t, name) < F.lit(str(bound)).cast("decimal(24,12)")


def d(x) -> Column:
    """An exact decimal literal."""
    return F.lit(str(x)).cast("decimal(24,12)")


def _core() -> list[Rule]:
    fin, ns = FINANCIALS, NO_STOCK
    return [
        Rule("WC_RECEIVABLES_OUTPACE_REVENUE", "core", "high", lambda t: (t.receivables_growth - t.revenue_growth > d("0.20")) & (t.trade_receivables > t.revenue_from_operations * d("0.05")),
             ("receivables_growth", "revenue_growth", "trade_receivables", "revenue_from_operations"), ((under("cfo_to_pat", "0.5"), "critical"),), ADR, exclude=fin),
        Rule("WC_DSO_ELEVATED", "core", "medium", lambda t: (t.dso > t.cohort_p90_dso) & (t.dso > t.grid.prior(t.dso)), ("dso",), (), ADR, exclude=fin),
        Rule("WC_INVENTORY_BUILDUP", "core", "medium", lambda t: (t.inventory_growth - t.revenue_growth > d("0.25")) & (t.inventories > t.revenue_from_operations * d("0.05")),
             ("inventory_growth", "revenue_growth", "inventories", "revenue_from_operations"), (), ADR, exclude=ns),
        Rule("WC_UNBILLED_REVENUE_HIGH", "core", "medium", lambda t: (t.unbilled_revenue_share > d("0.40")) & (t.unbilled_revenue_share > t.grid.prior(t.unbilled_revenue_share)), ("unbilled_revenue_share",), (), ADR, exclude=fin),
        Rule("WC_PAYABLES_STRETCHED", "core", "medium", lambda t: t.dpo - t.grid.prior(t.dpo) > d(30), ("dpo",), (), ADR, exclude=ns),
        Rule("LEV_HIGH_DEBT_TO_EQUITY", "core", "medium", lambda t: t.debt_to_equity > t.cohort_p90_debt_to_equity, ("debt_to_equity",), ((over("debt_to_equity", 3), "high"),), exclude=fin),
        Rule("LEV_WEAK_INTEREST_COVERAGE", "core", "high", lambda t: (t.finance_costs > d(0)) & (t.interest_coverage < d("2.5")), ("finance_costs", "interest_coverage"), ((under("interest_coverage", 1), "critical"),), kinds=(YEAR, QUARTER), exclude=fin),
        Rule("LEV_NET_DEBT_TO_EBITDA_HIGH", "core", "high", lambda t: ((t.ebitda > d(0)) & (t.net_debt_to_ebitda > d("3.5"))) | ((t.ebitda <= d(0)) & (t.net_debt > d(0))), ("ebitda", "net_debt_to_ebitda", "net_debt"), exclude=fin),
        Rule("LEV_DEBT_FUNDED_GROWTH", "core", "medium", lambda t: (t.borrowings_growth > d("0.5")) & (t.total_debt > t.total_equity * d("0.25")) & (t.free_cash_flow < d(0)), ("borrowings_growth", "total_debt", "total_equity", "free_cash_flow"), (), ADR, exclude=fin),
        Rule("LIQ_CURRENT_RATIO_BELOW_ONE", "core", "medium", under("current_ratio", 1), ("current_ratio",), kinds=(YEAR, HALF), exclude=fin),
        Rule("PRF_MARGIN_COMPRESSION", "core", "medium", lambda t: t.ebitda_margin - t.grid.prior(t.ebitda_margin) < d("-0.04"), ("ebitda_margin",), ((lambda t: t.ebitda_margin - t.grid.prior(t.ebitda_margin) < d("-0.08"), "high"),), exclude=fin),
        Rule("PRF_EMPLOYEE_COST_OUTPACING_REVENUE", "core", "medium", lambda t: (t.employee_cost_growth - t.revenue_growth > d("0.15")) & (t.employee_cost_ratio > d("0.10")), ("employee_cost_growth", "revenue_growth", "employee_cost_ratio")),
        Rule("PRF_LOSS_MAKING", "core", "high", under("profit_after_tax", 0), ("profit_after_tax",), ((lambda t: t.grid.streak(t.profit_after_tax < d(0), 3), "critical"),), ADR),
        Rule("CAP_CWIP_BUILDUP", "core", "medium", lambda t: (t.cwip_to_ppe > d("0.5")) & (t.capital_work_in_progress > t.grid.prior(t.capital_work_in_progress)), ("cwip_to_ppe", "capital_work_in_progress"), exclude=fin),
        Rule("EQ_CFO_PAT_DIVERGENCE", "core", "high", lambda t: (t.profit_after_tax > d(0)) & (t.cfo_to_pat < d("0.5")), ("profit_after_tax", "cfo_to_pat"), ((under("net_cash_from_operating_activities", 0), "critical"),), ADR),
        Rule("EQ_WEAK_THREE_YEAR_CASH_CONVERSION", "core", "high", lambda t: (t.grid.trailing_sum(t.profit_after_tax, 3) > d(0)) & (t.cumulative_cfo_to_pat_3y < d("0.6")), ("profit_after_tax", "cumulative_cfo_to_pat_3y"), (), ADR),
        Rule("EQ_PROFIT_UP_CASH_DOWN", "core", "high", lambda t: (t.pat_growth > d("0.15")) & (t.profit_after_tax > d(0)) & (t.net_cash_from_operating_activities < t.grid.prior(t.net_cash_from_operating_activities)), ("pat_growth", "profit_after_tax", "net_cash_from_operating_activities"), (), ADR),
        Rule("EQ_OTHER_INCOME_DEPENDENCE", "core", "medium", lambda t: (t.profit_before_tax > d(0)) & (t.other_income > d(0)) & (t.other_income_share_of_pbt > d("0.30")), ("profit_before_tax", "other_income", "other_income_share_of_pbt"), ((over("other_income_share_of_pbt", "0.5"), "high"),), kinds=(YEAR, QUARTER)),
        Rule("EQ_RECURRING_EXCEPTIONAL_ITEMS", "core", "medium", lambda t: t.grid.streak(t.abs(t.exceptional_items) > t.revenue_from_operations * d("0.01"), 3), ("exceptional_items", "revenue_from_operations"), (), ADR),
        Rule("EQ_EXCEPTIONAL_GAIN_DRIVES_PROFIT", "core", "medium", lambda t: (t.exceptional_items > d(0)) & (t.profit_before_tax > d(0)) & (t.exceptional_items_share_of_pbt > d("0.25")), ("exceptional_items", "profit_before_tax", "exceptional_items_share_of_pbt"), ((over("exceptional_items_share_of_pbt", "0.5"), "high"),), kinds=(YEAR, QUARTER)),
        Rule("EQ_EFFECTIVE_TAX_RATE_UNUSUAL", "core", "low", lambda t: (t.profit_before_tax > d(0)) & ((t.effective_tax_rate < d("0.15")) | (t.effective_tax_rate > d("0.40"))), ("profit_before_tax", "effective_tax_rate"), (), ADR),
        Rule("EQ_HIGH_ACCRUALS", "core", "medium", lambda t: t.accruals_ratio > t.cohort_p90_accruals_ratio, ("accruals_ratio",), (), ADR, exclude=fin),
        Rule("GOV_AUDITOR_MODIFIED_OPINION", "core", "critical", lambda t: t.auditor_opinion.isin("qualified", "adverse", "disclaimer"), ("auditor_opinion",), scope=DOCUMENT),
        Rule("GOV_EMPHASIS_OF_MATTER", "core", "medium", lambda t: t.emphasis_of_matter == "yes", ("emphasis_of_matter",), scope=DOCUMENT),
        Rule("GOV_AUDITOR_CHANGE", "core", "high", lambda t: t.auditor_changed_during_period == "yes", ("auditor_changed_during_period",), scope=DOCUMENT),
        Rule("GOV_PROMOTER_PLEDGE", "core", "high", over("promoter_shares_pledged", "0.25"), ("promoter_shares_pledged",), ((over("promoter_shares_pledged", "0.5"), "critical"),), scope=DOCUMENT),
        Rule("GOV_CONTINGENT_LIABILITIES_LARGE", "core", "high", over("contingent_liabilities_to_net_worth", "0.5"), ("contingent_liabilities_to_net_worth",), ((over("contingent_liabilities_to_net_worth", 1), "critical"),), ADR),
        Rule("GOV_RELATED_PARTY_REVENUE", "core", "medium", over("related_party_revenue_share", "0.20"), ("related_party_revenue_share",), ((over("related_party_revenue_share", "0.5"), "high"),)),
        Rule("GOV_RELATED_PARTY_LOANS", "core", "high", over("related_party_loans_to_net_worth", "0.10"), ("related_party_loans_to_net_worth",)),
        Rule("GOV_CUSTOMER_CONCENTRATION", "core", "medium", lambda t: (t.top_10_customer_revenue_share > d("0.60")) | (t.top_customer_revenue_share > d("0.25")), ("top_10_customer_revenue_share", "top_customer_revenue_share")),
    ]


def _integrity() -> list[Rule]:
    every = (YEAR, HALF, QUARTER, NINE_MONTHS)
    tax = lambda t: t.coalesce(t.total_tax_expense, t.current_tax + t.deferred_tax)
    return [
        Rule("INT_BALANCE_SHEET_DOES_NOT_BALANCE", "integrity", "high", lambda t: t.rel_diff(t.total_assets, t.total_equity_and_liabilities) > d("0.002"), ("total_assets", "total_equity_and_liabilities"), kinds=every),
        Rule("INT_EQUITY_COMPONENTS", "integrity", "medium", lambda t: t.rel_diff(t.total_equity, t.equity_share_capital + t.instruments_entirely_equity_in_nature + t.other_equity + t.non_controlling_interest) > d("0.005"), ("total_equity", "equity_share_capital", "other_equity"), kinds=(YEAR, HALF)),
        Rule("INT_PROFIT_BRIDGE", "integrity", "medium", lambda t: t.rel_diff(t.profit_after_tax, t.profit_before_tax - tax(t) + t.share_of_profit_of_associates + t.profit_from_discontinued_operations) > d("0.01"), ("profit_after_tax", "profit_before_tax"), kinds=every),
        Rule("INT_TOTAL_INCOME", "integrity", "low", lambda t: t.rel_diff(t.total_income, t.revenue_from_operations + t.other_income) > d("0.005"), ("total_income", "revenue_from_operations", "other_income"), kinds=every),
        Rule("INT_CASH_FLOW_SECTIONS", "integrity", "medium", lambda t: t.rel_diff(t.net_cash_from_operating_activities + t.net_cash_from_investing_activities + t.net_cash_from_financing_activities, t.net_change_in_cash) > d("0.02"), ("net_cash_from_operating_activities", "net_cash_from_investing_activities", "net_cash_from_financing_activities", "net_change_in_cash"), kinds=(YEAR, HALF)),
        Rule("INT_CASH_ROLL_FORWARD", "integrity", "low", lambda t: t.rel_diff(t.opening_cash_and_equivalents + t.net_change_in_cash, t.closing_cash_and_equivalents) > d("0.02"), ("opening_cash_and_equivalents", "net_change_in_cash", "closing_cash_and_equivalents"), kinds=(YEAR, HALF)),
        Rule("INT_CASH_FLOW_VS_BALANCE_SHEET_CASH", "integrity", "low", lambda t: t.rel_diff(t.closing_cash_and_equivalents, t.cash_and_cash_equivalents) > d("0.05"), ("closing_cash_and_equivalents", "cash_and_cash_equivalents"), kinds=(YEAR, HALF)),
        Rule("INT_EPS_INCONSISTENT_WITH_PROFIT", "integrity", "medium", lambda t: (t.eps_basic > d(0)) & (t.implied_eps > d(0)) & (t.rel_diff(t.eps_basic, t.implied_eps) > d("0.10")), ("eps_basic", "implied_eps"), kinds=(YEAR, QUARTER)),
        Rule("INT_EPS_GROWTH_DIVERGES_FROM_PROFIT", "integrity", "medium", lambda t: (t.profit_after_tax > d(0)) & (t.grid.prior(t.profit_after_tax) > d(0)) & (t.abs(t.eps_growth - t.pat_growth) > d("0.10")), ("profit_after_tax", "eps_growth", "pat_growth"), kinds=(QUARTER, YEAR)),
    ]


def _offers() -> list[Rule]:
    def rule(id: str, severity: str, when: Condition, needs, escalate=(), scope=DOCUMENT) -> Rule:
        return Rule(f"IPO_{id}", "offer_document", severity, when, needs, escalate, DR, scope=scope)

    def steps(name: str, bound, worse=None, to="high"):
        return over(name, bound), (name,), ((over(name, worse), to),) if worse else ()

    return [
        rule("OFS_HEAVY", "medium", *steps("ofs_share_of_issue", "0.5", "0.9")),
        rule("GCP_EXCEEDS_REGULATORY_CAP", "medium", *steps("gcp_share_of_fresh_issue", "0.20", "0.25", "critical")),
        rule("VALUATION_PREMIUM_TO_PEERS", "medium", lambda t: (t.eps_diluted > d(0)) & (t.issue_pe_premium_to_peers > d("0.5")), ("eps_diluted", "issue_pe_premium_to_peers"), ((over("issue_pe_premium_to_peers", 1), "high"),)),
        rule("LOSS_MAKING_ISSUER_PRICED_ON_EARNINGS", "high", lambda t: t.eps_diluted <= d(0), ("eps_diluted",)),
        rule("PROMOTER_ACQUISITION_COST_LOW", "medium", *steps("promoter_cost_multiple", 10)),
        rule("PROCEEDS_MAINLY_REPAY_DEBT", "low", *steps("debt_repayment_share_of_fresh_issue", "0.5")),
        rule("NEGATIVE_OPERATING_CASH_FLOW", "high", under("net_cash_from_operating_activities", 0), ("net_cash_from_operating_activities",), scope=PERIOD),
        rule("CRIMINAL_PROCEEDINGS_AGAINST_PROMOTERS", "high", *steps("litigation_criminal_against_promoters", 0)),
        rule("LITIGATION_MATERIAL", "high", *steps("litigation_to_net_worth", "0.10")),
        rule("LOW_POST_ISSUE_PROMOTER_HOLDING", "medium", under("promoter_holding_post_issue", "0.35"), ("promoter_holding_post_issue",)),
    ]


def _quarterly() -> list[Rule]:
    def rule(id: str, severity: str, when: Condition, needs, exclude=frozenset()) -> Rule:
        return Rule(f"QTR_{id}", "quarterly", severity, when, needs, (), Q, (QUARTER,), exclude)

    return [
        rule("REVENUE_DECLINE_YOY", "high", under("revenue_growth", "-0.10"), ("revenue_growth",)),
        rule("MARGIN_COLLAPSE_QOQ", "high", lambda t: t.ebitda_margin - t.grid.seq(t.ebitda_margin) < d("-0.05"), ("ebitda_margin",), FINANCIALS),
        rule("SWING_TO_LOSS", "high", lambda t: (t.profit_after_tax < d(0)) & (t.grid.prior(t.profit_after_tax) > d(0)), ("profit_after_tax",)),
        rule("OTHER_INCOME_SPIKE", "medium", lambda t: (t.other_income > t.grid.prior(t.other_income) * d(2)) & (t.profit_before_tax > d(0)) & (t.other_income_share_of_pbt > d("0.25")), ("other_income", "profit_before_tax", "other_income_share_of_pbt")),
        rule("EXCEPTIONAL_ITEM_MATERIAL", "medium", lambda t: (t.profit_before_tax != d(0)) & (t.abs(t.exceptional_items_share_of_pbt) > d("0.20")), ("profit_before_tax", "exceptional_items_share_of_pbt")),
        rule("TAX_RATE_SWING", "low", lambda t: (t.profit_before_tax > d(0)) & (t.grid.prior(t.profit_before_tax) > d(0)) & (t.abs(t.effective_tax_rate - t.grid.prior(t.effective_tax_rate)) > d("0.10")), ("profit_before_tax", "effective_tax_rate")),
    ]


RULES: dict[str, Rule] = {r.id: r for r in [*_core(), *_integrity(), *_offers(), *_quarterly()]}
#: Metric: (percentile, value where the cohort is too small).
COHORT_BOUNDS = {"dso": (90, "120"), "debt_to_equity": (90, "1.5"), "accruals_ratio": (90, "0.10")}
