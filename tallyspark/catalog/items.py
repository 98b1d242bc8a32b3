"""Line items: the vocabulary of facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

CRORE, RATIO, TIMES, DAYS, RUPEES, COUNT, TEXT = "inr_crore", "ratio", "times", "days", "inr", "count", "text"
STOCK, FLOW = "stock", "flow"
PERIOD, DOCUMENT = "period", "document"


@dataclass(frozen=True)
class Item:
    key: str
    statement: str
    unit: str = CRORE
    nature: str = FLOW
    scope: str = PERIOD
    #: Absent means zero where the item's statement was reported.
    nil_if_absent: bool = False
    #: Elements of tagged filings that add up to the item: a sign, a name, and #first or #last of several.
    elements: tuple[str, ...] = ()
    #: Several printed rows add up.
    sum_rows: bool = False


# Item keys, natures, units and filing elements, as filings and formulas name them. "*": nil if absent.
_BALANCE = """
property_plant_equipment PropertyPlantAndEquipment
*capital_work_in_progress CapitalWorkInProgress
right_of_use_assets
*goodwill Goodwill
other_intangible_assets OtherIntangibleAssets
*intangible_assets_under_development IntangibleAssetsUnderDevelopment
non_current_investments NoncurrentInvestments
total_non_current_assets NoncurrentAssets
*inventories Inventories
*current_investments CurrentInvestments
trade_receivables TradeReceivablesCurrent TradeReceivablesNoncurrent
unbilled_revenue
cash_and_cash_equivalents CashAndCashEquivalents
*other_bank_balances BankBalanceOtherThanCashAndCashEquivalents
loans_current LoansCurrent
total_current_assets CurrentAssets
total_assets Assets
equity_share_capital EquityShareCapital
*instruments_entirely_equity_in_nature
other_equity OtherEquity
equity_attributable_to_owners EquityAttributableToOwnersOfParent
*non_controlling_interest NonControllingInterest
total_equity Equity
*borrowings_non_current BorrowingsNoncurrent
*lease_liabilities_non_current
provisions_non_current ProvisionsNoncurrent
total_non_current_liabilities NoncurrentLiabilities
*borrowings_current BorrowingsCurrent
*lease_liabilities_current
trade_payables TradePayablesCurrent TradePayablesNoncurrent
contract_liabilities
total_current_liabilities CurrentLiabilities
total_liabilities Liabilities
total_equity_and_liabilities EquityAndLiabilities
"""
_CASH = """
cash_generated_from_operations CashFlowsFromUsedInOperations
income_taxes_paid -IncomeTaxesPaidRefundClassifiedAsOperatingActivities
net_cash_from_operating_activities CashFlowsFromUsedInOperatingActivities
purchase_of_property_plant_equipment -PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities
*proceeds_from_sale_of_property_plant_equipment ProceedsFromSalesOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities
net_cash_from_investing_activities CashFlowsFromUsedInInvestingActivities
interest_paid -InterestPaidClassifiedAsFinancingActivities -InterestPaidClassifiedAsOperatingActivities
*dividends_paid -DividendsPaidClassifiedAsFinancingActivities
net_cash_from_financing_activities CashFlowsFromUsedInFinancingActivities
net_change_in_cash IncreaseDecreaseInCashAndCashEquivalents
opening_cash_and_equivalents CashAndCashEquivalentsCashFlowStatement#first
closing_cash_and_equivalents CashAndCashEquivalentsCashFlowStatement#last
"""
_PROFIT = """
revenue_from_operations RevenueFromOperations
other_income OtherIncome
total_income Income
*cost_of_materials_consumed CostOfMaterialsConsumed
*purchases_of_stock_in_trade PurchasesOfStockInTrade
*changes_in_inventories ChangesInInventoriesOfFinishedGoodsWorkInProgressAndStockInTrade
employee_benefits_expense EmployeeBenefitExpense
finance_costs FinanceCosts
depreciation_amortisation DepreciationDepletionAndAmortisationExpense
other_expenses OtherExpenses
total_expenses Expenses
*exceptional_items ExceptionalItemsBeforeTax
profit_before_exceptional_items ProfitBeforeExceptionalItemsAndTax
profit_before_tax ProfitBeforeTax
current_tax CurrentTax
*deferred_tax DeferredTax
total_tax_expense TaxExpense
*share_of_profit_of_associates ShareOfProfitLossOfAssociatesAndJointVenturesAccountedForUsingEquityMethod
*profit_from_discontinued_operations ProfitLossFromDiscontinuedOperationsAfterTax
profit_after_tax ProfitLossForPeriod
profit_attributable_to_owners
other_comprehensive_income OtherComprehensiveIncomeNetOfTaxes
total_comprehensive_income ComprehensiveIncomeForThePeriod
"""


def _listed(text: str, statement: str, nature: str) -> list[Item]:
    rows = [line.split() for line in text.split("\n") if line]
    return [Item(r[0].lstrip("*"), statement, CRORE, nature, PERIOD, r[0].startswith("*"), tuple(r[1:]), r[0] == "purchase_of_property_plant_equipment") for r in rows]


def _documents(unit: str, *keys: str, statement: str = "issue") -> list[Item]:
    return [Item(k, statement, unit, STOCK, DOCUMENT) for k in keys]


ITEMS: dict[str, Item] = {
    i.key: i
    for i in [
        *_listed(_BALANCE, "balance_sheet", STOCK),
        *_listed(_CASH, "cash_flow", FLOW),
        *_listed(_PROFIT, "profit_and_loss", FLOW),
        Item("eps_basic", "profit_and_loss", RUPEES, elements=("BasicEarningsLossPerShareFromContinuingAndDiscontinuedOperations",)),
        Item("eps_diluted", "profit_and_loss", RUPEES, elements=("DilutedEarningsLossPerShareFromContinuingAndDiscontinuedOperations",)),
        Item("paid_up_equity_share_capital", "profit_and_loss", CRORE, STOCK, elements=("PaidUpValueOfEquityShareCapital",)),
        Item("face_value_per_share", "profit_and_loss", RUPEES, STOCK, elements=("FaceValueOfEquityShareCapital",)),
        Item("contingent_liabilities", "disclosure", CRORE, STOCK),
        Item("related_party_revenue", "disclosure"),
        Item("related_party_purchases", "disclosure"),
        Item("related_party_loans_given", "disclosure", CRORE, STOCK),
        Item("top_10_customer_revenue_share", "disclosure", RATIO),
        Item("top_customer_revenue_share", "disclosure", RATIO),
        Item("employee_count", "disclosure", COUNT, STOCK),
        *_documents(TEXT, "auditor_opinion", "emphasis_of_matter", "auditor_changed_during_period", statement="disclosure"),
        *_documents(RATIO, "promoter_holding", "promoter_shares_pledged", statement="disclosure"),
        *_documents(CRORE, "total_issue_size", "fresh_issue_size", "offer_for_sale_size", "general_corporate_purposes", "objects_debt_repayment", "litigation_amount_against_company"),
        *_documents(RUPEES, "price_band_upper", "promoter_average_cost_per_share"),
        *_documents(TIMES, "peer_median_pe"),
        *_documents(RATIO, "promoter_holding_pre_issue", "promoter_holding_post_issue"),
        *_documents(COUNT, "litigation_criminal_against_promoters"),
    ]
}


def items_frame(spark: SparkSession) -> DataFrame:
    """The vocabulary as a table; it has a fixed number of rows."""
    rows = [(i.key, i.statement, i.unit, i.nature, i.scope, i.nil_if_absent) for i in ITEMS.values()]
    return spark.createDataFrame(rows, "key string, statement string, unit string, nature string, scope string, nil_if_absent boolean")
