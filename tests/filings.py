"""A fictional three-year filing, as facts."""

from decimal import Decimal

from tallyspark.operators.facts import DOCUMENTS, FACTS

# FY23, FY24, FY25 in crore; None where nothing was reported.
YEARS = {
    "revenue_from_operations": (1000, 1100, 1232), "other_income": (20, 40, 75), "total_income": (1020, 1140, 1307),
    "cost_of_materials_consumed": (550, 600, 670), "changes_in_inventories": (-10, -20, -25), "employee_benefits_expense": (120, 135, 160),
    "finance_costs": (30, 32, 38), "depreciation_amortisation": (40, 45, 50), "other_expenses": (150, 165, 190), "total_expenses": (880, 957, 1083),
    "profit_before_tax": (140, 183, 224), "total_tax_expense": (35, 46, 56), "profit_after_tax": (105, 137, 168),
    "eps_basic": ("10.50", "13.70", "16.80"), "eps_diluted": ("10.50", "13.68", "16.75"), "face_value_per_share": (2, 2, 2),
    "property_plant_equipment": (600, 640, 700), "capital_work_in_progress": (50, 90, 150), "total_non_current_assets": (700, 785, 910),
    "inventories": (180, 210, 240), "trade_receivables": (200, 260, 403), "cash_and_cash_equivalents": (40, 45, 30),
    "total_current_assets": (500, 600, 765), "total_assets": (1200, 1385, 1675), "equity_share_capital": (20, 20, 20), "other_equity": (680, 797, 940),
    "total_equity": (700, 817, 960), "borrowings_non_current": (200, 230, 300), "total_non_current_liabilities": (220, 252, 325),
    "borrowings_current": (100, 110, 170), "trade_payables": (150, 170, 180), "total_current_liabilities": (280, 316, 390), "total_liabilities": (500, 568, 715),
    "total_equity_and_liabilities": (1200, 1385, 1675), "net_cash_from_operating_activities": (110, 95, 50),
    "purchase_of_property_plant_equipment": (-90, -110, -130), "net_cash_from_investing_activities": (-100, -115, -135),
    "net_cash_from_financing_activities": (-5, 25, 70), "net_change_in_cash": (5, 5, -15), "opening_cash_and_equivalents": (35, 40, 45),
    "closing_cash_and_equivalents": (40, 45, 30), "contingent_liabilities": (None, 300, 620), "related_party_revenue": (None, 90, 110),
}
DOCUMENT = {"auditor_opinion": "unmodified", "emphasis_of_matter": "no", "auditor_changed_during_period": "no", "promoter_holding": Decimal("0.62"), "promoter_shares_pledged": Decimal(0)}
OFFER = {
    "total_issue_size": 1000, "fresh_issue_size": 300, "offer_for_sale_size": 700, "general_corporate_purposes": 80, "objects_debt_repayment": 100,
    "price_band_upper": 500, "peer_median_pe": 18, "promoter_holding_pre_issue": "0.62", "promoter_holding_post_issue": "0.45",
    "promoter_average_cost_per_share": 12, "litigation_amount_against_company": 50, "litigation_criminal_against_promoters": 0,
}


def fact(document, key, value, kind=None, year=None, part=None):
    text = value if isinstance(value, str) and not value.replace(".", "").replace("-", "").isdigit() else None
    return (document, key, kind, year, part, None if text else Decimal(str(value)), text)


def annual_facts(document="d", years=YEARS, of_document=DOCUMENT):
    rows = [fact(document, k, v, "year", 2023 + n) for k, vs in years.items() for n, v in enumerate(vs) if v is not None]
    return rows + [fact(document, k, v) for k, v in of_document.items()]


def frames(spark, rows, documents=(("d", "Test Co", "manufacturing", "annual_report", 3),)):
    return spark.createDataFrame(rows, FACTS), spark.createDataFrame(list(documents), DOCUMENTS)
