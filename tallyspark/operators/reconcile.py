"""Reconciling statements of one filing, and merging filings that restate each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tolerance of sums, and of restatements.
TOLERANCE = "0.002"
RESTATED = 0.005


def close(a: Column, b: Column) -> Column:
    """Whether two amounts agree within a five-hundredth of the larger, or of one."""
    return F.abs(a - b) <= F.lit(TOLERANCE).cast("decimal(6,4)") * F.greatest(F.abs(a), F.abs(b), F.lit(1))


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def profit_and_loss(rows: DataFrame) -> DataFrame:
    """Corrected rows with `issues`.

    rows: wide by period, with total_income, total_expenses, finance_costs, depreciation_amortisation,
    exceptional_items, profit_before_exceptional_items, profit_before_tax, total_tax_expense, profit_after_tax; and, if told, current_tax and deferred_tax.
    Three signs of layout are undone where only the correction adds up: exceptional items and tax printed with the
    other sign, and expenses printed without finance costs and depreciation.
    """
    before, exceptional, pbt = F.col("profit_before_exceptional_items"), F.col("exceptional_items"), F.col("profit_before_tax")
    flip = ~close(before + exceptional, pbt) & close(before - exceptional, pbt) & (exceptional != 0)
    rows = rows.withColumn("_exceptional", F.coalesce(flip, F.lit(False)))
    rows = rows.withColumn("exceptional_items", F.when(F.col("_exceptional"), -exceptional).otherwise(exceptional))
    taxes = [c for c in ("total_tax_expense", "current_tax", "deferred_tax") if c in rows.columns]
    own, pat = [F.col(c) for c in taxes[1:]], F.col("profit_after_tax")
    # Without a total, what there is of current and deferred tax.
    parts = F.when(F.coalesce(*own).isNotNull(), sum((F.coalesce(c, F.lit(0)) for c in own), F.lit(0))) if own else F.lit(None)
    tax = F.coalesce(F.col("total_tax_expense"), parts)
    flip = F.coalesce(~close(pbt - tax, pat) & close(pbt + tax, pat) & (tax != 0), F.lit(False))
    rows = rows.withColumn("_tax", flip)
    rows = rows.withColumns({c: F.when(F.col("_tax"), -F.col(c)).otherwise(F.col(c)) for c in taxes})
    income, expenses = F.col("total_income"), F.col("total_expenses")
    left_out = F.col("finance_costs") + F.col("depreciation_amortisation")
    base = F.coalesce(before, pbt - _zero("exceptional_items"))
    short = ~close(income - expenses, base) & close(income - expenses - left_out, base)
    rows = rows.withColumn("_expenses", F.coalesce(short, F.lit(False))).withColumn("total_expenses", F.when(F.coalesce(short, F.lit(False)), expenses + left_out).otherwise(expenses))
    notes = {"_exceptional": "exceptional items had the other sign", "_tax": "tax had the other sign", "_expenses": "expenses left out finance costs and depreciation"}
    issues = F.filter(F.array(*(F.when(F.col(k), F.lit(v)) for k, v in notes.items())), lambda x: x.isNotNull())
    return rows.withColumn("issues", issues).drop(*notes)


def merge_restated(facts: DataFrame, keys: tuple[str, ...] = ("company", "key", "period"), order: tuple[str, ...] = ("filed", "document_id")) -> DataFrame:
    """The last filing's value of each fact, with `restated` where an earlier value differs by over half a percent."""
    newest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    value = F.col("value").cast("double")
    previous = F.lead(value).over(newest)
    apart = F.try_divide(F.abs(value - previous), F.greatest(F.abs(value), F.abs(previous))) > RESTATED
    whole = Window.partitionBy(*keys)
    rows = facts.withColumn("_n", F.row_number().over(newest)).withColumn("_changed", F.coalesce(apart, F.lit(False)))
    rows = rows.withColumn("restated", F.max("_changed").over(whole)).withColumn("filings", F.count("*").over(whole))
    return rows.where("_n = 1").drop("_n", "_changed")


def compatible(filings: DataFrame, group: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """(group, order, reason) of the filings (also isin, bse_code, nse_symbol, name, basis, fye_month) that can't be merged with the first of their group."""
    columns = ("isin", "bse_code", "nse_symbol", "name", "basis", "fye_month")
    head = F.first(F.struct(*columns)).over(Window.partitionBy(*group).orderBy(*order))
    rows = filings.select(*group, *order, F.struct(*columns).alias("own"), head.alias("first"))
    reason = (
        F.when(~F.coalesce(same_company("own", "first"), F.lit(False)), "another company").when(~F.col("own.basis").eqNullSafe(F.col("first.basis")), "standalone and consolidated figures")
        .when(~F.col("own.fye_month").eqNullSafe(F.col("first.fye_month")), "another fiscal year end")
    )
    return rows.select(*group, *order, reason.alias("reason")).where("reason is not null")


def same_company(a: str, b: str, identifiers: tuple[str, ...] = ("isin", "bse_code", "nse_symbol"), name: str = "name") -> Column:
    """The first identifier that both sides have decides, else the name without regard to case."""
    both = [F.when(F.col(f"{a}.{i}").isNotNull() & F.col(f"{b}.{i}").isNotNull(), F.col(f"{a}.{i}") == F.col(f"{b}.{i}")) for i in identifiers]
    return F.coalesce(*both, F.lower(F.col(f"{a}.{name}")) == F.lower(F.col(f"{b}.{name}")))
