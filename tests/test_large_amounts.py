"""Sums that grow with the tables: more digits than an amount has before its point."""

import datetime
from decimal import Decimal

from filings import YEARS, annual_facts, frames

from tallyspark.operators import engine
from tallyspark.plans import registry


def test_metric_pivot_of_a_year_beyond_a_trillion_cents(spark, tmp_path):
    dates = [datetime.datetime(1995, m, 15) for m in (4, 7, 10)] + [datetime.datetime(1996, 1, 15)]
    tables = {
        "customer": ([(1, 7)], "c_custkey long, c_nationkey int"),
        "orders": ([(n, 1, "O", 10.0, d) for n, d in enumerate(dates)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp"),
        "lineitem": ([(n, 2.5e11, 0.0, 0.0, "N") for n in range(4)], "l_orderkey long, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = registry.queries()["metric_pivot"](spark, str(tmp_path)).collect()
    assert [(r.entity, r.by_year) for r in got] == [(7, "FY96=10000000.0%")]


def test_ratios_of_large_amounts_are_those_of_small_ones(spark):
    """A year's amount times 365 has more digits than an amount; what is divided by it doesn't change."""
    own = ("revenue_from_operations", "total_expenses", "finance_costs", "depreciation_amortisation", "profit_after_tax", "total_assets", "total_equity", "borrowings_non_current", "borrowings_current")
    of = lambda scale: engine.analyse(*frames(spark, annual_facts(years={k: tuple(v * scale for v in YEARS[k]) for k in own}, of_document={})))["metrics"]
    small, large = ({(r.metric, r.period): r.value for r in of(scale).where("unit in ('ratio', 'times', 'days')").collect()} for scale in (1, 10**8))
    assert ("asset_turnover", "FY25") in small and ("roa", "FY25") in small and ("roce", "FY25") in small
    assert set(small) == set(large) and all(abs(small[k] - large[k]) < Decimal("1e-9") for k in small)
