"""The whole engine over the benchmark tables: nations report derived quarterly and yearly facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods
from ..functions.timeseries import AMOUNT
from ..operators import engine
from ..operators import facts as facts_
from ..operators.lineage import written
from .base import QUARTERS, quarters, query, rounded, table

#: Items and the share of the quarter's revenue, tax, receivables or returned goods that stands for them, in hundredths.
DERIVED = {
    "revenue_from_operations": ("revenue", 100), "total_tax_expense": ("tax", 100), "trade_receivables": ("receivables", 100), "inventories": ("returned", 60),
    "total_expenses": ("revenue", 85), "finance_costs": ("revenue", 4), "depreciation_amortisation": ("revenue", 5), "profit_after_tax": ("tax", 220), "profit_before_tax": ("tax", 320),
    "other_income": ("returned", 5), "net_cash_from_operating_activities": ("returned", 40), "total_equity": ("receivables", 150), "borrowings_non_current": ("returned", 80), "total_assets": ("receivables", 400),
}


def derived_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(facts, documents): flows by quarter and complete year, balances by quarter; amounts in whole cents."""
    q = quarters(spark, sf_dir)
    each = F.array(*(F.struct(F.lit(k).alias("key"), F.floor(F.col(c) * p / 100).cast("long").alias("amount")) for k, (c, p) in DERIVED.items()))
    by_quarter = q.select(F.col("entity").cast("string").alias("document_id"), "kind", "fiscal_year", "part", F.explode(each).alias("f")).select("document_id", "f.key", "kind", "fiscal_year", "part", "f.amount")
    stocks = [k for k in DERIVED if facts_.ITEMS[k].nature == "stock"]
    years = by_quarter.where(~F.col("key").isin(*stocks)).groupBy("document_id", "key", "fiscal_year").agg(F.sum("amount").alias("amount"), F.count("*").alias("n")).where("n = 4")
    years = years.select("document_id", "key", F.lit(periods.YEAR).alias("kind"), "fiscal_year", F.lit(None).cast("int").alias("part"), "amount")
    rows = by_quarter.unionByName(years).select("document_id", "key", "kind", "fiscal_year", "part", (F.col("amount") / 100).cast(AMOUNT).alias("value"), F.lit(None).cast("string").alias("text"))
    nations = table(spark, sf_dir, "nation")
    sector = F.when(F.col("n_regionkey") == 0, "banking").otherwise("manufacturing")
    documents = nations.select(F.col("n_nationkey").cast("string").alias("document_id"), F.col("n_name").alias("company"), sector.alias("sector"), F.lit("annual_report").alias("doc_type"), F.lit(3).alias("fye_month"))
    return rows, documents


@query()
def engine_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest outcome of every rule that applies, over the derived facts."""
    found = engine.analyse(*derived_facts(spark, sf_dir), peers=True)
    return found["latest"].select("document_id", "rule_id", "outcome", "severity", F.array_join("missing", ",").alias("missing"), F.array_join("fired_periods", ",").alias("fired_periods"))


#: The metrics that the derived facts give, in SQL over a period's row (b), the balance it opened with (o), and the period a year before: its flows (p) and balances (q). "F": not for banks.
METRICS_SQL = {
    "ebitda": ("b.ebitda / 100.0", ""), "ebit": ("b.ebit / 100.0", ""), "cost_of_goods_sold": ("0.0", ""), "gross_margin": ("b.rev / nullif(b.rev, 0.0)", "F"), "ebitda_margin": ("b.ebitda / nullif(b.rev, 0.0)", "F"),
    "pat_margin": ("b.pat / nullif(b.rev, 0.0)", ""), "other_income_share_of_pbt": ("b.oth / nullif(b.pbt, 0.0)", ""), "exceptional_items_share_of_pbt": ("0 / nullif(b.pbt, 0.0)", ""), "effective_tax_rate": ("b.tax / nullif(b.pbt, 0.0)", ""),
    "cfo_to_pat": ("b.cfo / nullif(b.pat, 0.0)", ""), "cfo_to_ebitda": ("b.cfo / nullif(b.ebitda, 0.0)", "F"), "cumulative_cfo_to_pat_3y": ("(b.cfo + p.cfo + p2.cfo) / nullif(b.pat + p.pat + p2.pat, 0.0)", ""),
    "accruals_ratio": ("(b.pat - b.cfo) / nullif(coalesce((o.ast + b.ast) / 2.0, b.ast), 0.0)", ""), "dso": ("coalesce((o.rec + b.rec) / 2.0, b.rec) / nullif(b.rev, 0.0) * b.days", "F"),
    "receivables_growth": ("(b.rec - q.rec) / nullif(abs(q.rec), 0.0)", "F"), "inventory_growth": ("(b.inv - q.inv) / nullif(abs(q.inv), 0.0)", "F"), "total_debt": ("b.bor / 100.0", "F"), "debt_to_equity": ("b.bor / nullif(b.eq, 0.0)", "F"),
    "interest_coverage": ("b.ebit / nullif(b.fin, 0.0)", "F"), "borrowings_growth": ("(b.bor - q.bor) / nullif(abs(q.bor), 0.0)", "F"), "finance_cost_to_revenue": ("b.fin / nullif(b.rev, 0.0)", "F"),
    "revenue_growth": ("(b.rev - p.rev) / nullif(abs(p.rev), 0.0)", ""), "revenue_growth_qoq": ("(b.rev - l.rev) / nullif(abs(l.rev), 0.0)", ""), "ebitda_growth": ("(b.ebitda - p.ebitda) / nullif(abs(p.ebitda), 0.0)", ""), "pat_growth": ("(b.pat - p.pat) / nullif(abs(p.pat), 0.0)", ""),
    "capital_employed": ("(b.eq + b.bor) / 100.0", "F"), "roe": ("b.pat * 365 / b.days / nullif(coalesce((o.eq + b.eq) / 2.0, b.eq), 0.0)", ""), "roce": ("b.ebit * 365 / b.days / nullif(coalesce((o.eq + o.bor + b.eq + b.bor) / 2.0, b.eq + b.bor), 0.0)", "F"),
    "roa": ("b.pat * 365 / b.days / nullif(coalesce((o.ast + b.ast) / 2.0, b.ast), 0.0)", ""), "asset_turnover": ("b.rev * 365 / b.days / nullif(coalesce((o.ast + b.ast) / 2.0, b.ast), 0.0)", "F"),
}
_EACH = " UNION ALL ".join(f"SELECT entity, kind, fiscal_year, part, '{m}' AS metric, CASE WHEN {'n_regionkey <> 0' if only else 'true'} THEN CAST({sql} AS DOUBLE) END AS value FROM joined_b" for m, (sql, only) in METRICS_SQL.items())
ENGINE_METRICS_SQL = f"""WITH {QUARTERS.strip()},
f AS (SELECT entity, 'quarter' AS kind, fiscal_year, part, seq_index, revenue AS rev, tax, receivables AS rec, returned * 60 // 100 AS inv, revenue * 85 // 100 AS exp, revenue * 4 // 100 AS fin, revenue * 5 // 100 AS dep, tax * 220 // 100 AS pat, tax * 320 // 100 AS pbt,
  returned * 5 // 100 AS oth, returned * 40 // 100 AS cfo, receivables * 150 // 100 AS eq, returned * 80 // 100 AS bor, receivables * 400 // 100 AS ast FROM quarters),
y AS (SELECT entity, 'year' AS kind, fiscal_year, CAST(NULL AS INTEGER) AS part, fiscal_year AS seq_index, sum(rev) AS rev, sum(tax) AS tax, max(CASE WHEN part = 4 THEN rec END) AS rec, max(CASE WHEN part = 4 THEN inv END) AS inv, sum(exp) AS exp, sum(fin) AS fin, sum(dep) AS dep, sum(pat) AS pat,
  sum(pbt) AS pbt, sum(oth) AS oth, sum(cfo) AS cfo, max(CASE WHEN part = 4 THEN eq END) AS eq, max(CASE WHEN part = 4 THEN bor END) AS bor, max(CASE WHEN part = 4 THEN ast END) AS ast FROM f GROUP BY entity, fiscal_year HAVING count(*) = 4),
u AS (SELECT * FROM f UNION ALL SELECT * FROM y),
d AS (SELECT *, rev - (exp - fin - dep) AS ebitda, rev - (exp - fin - dep) - dep AS ebit, CASE WHEN part IS NULL THEN make_date(fiscal_year, 4, 1) - make_date(fiscal_year - 1, 4, 1)
  WHEN part = 4 THEN make_date(fiscal_year, 4, 1) - make_date(fiscal_year, 1, 1) WHEN part = 1 THEN 91 ELSE 92 END AS days FROM u),
joined AS (SELECT b, o, p, p2, q, l, n_regionkey FROM d b JOIN nation ON n_nationkey = b.entity
  LEFT JOIN d o ON o.entity = b.entity AND o.kind = 'quarter' AND o.seq_index = CASE WHEN b.part IS NULL THEN b.fiscal_year * 4 - 1 ELSE b.seq_index - 1 END
  LEFT JOIN d p ON p.entity = b.entity AND p.kind = b.kind AND p.fiscal_year = b.fiscal_year - 1 AND p.part IS NOT DISTINCT FROM b.part
  LEFT JOIN d p2 ON p2.entity = b.entity AND p2.kind = b.kind AND p2.fiscal_year = b.fiscal_year - 2 AND p2.part IS NOT DISTINCT FROM b.part
  LEFT JOIN d q ON q.entity = b.entity AND q.kind = 'quarter' AND q.seq_index = CASE WHEN b.part IS NULL THEN b.fiscal_year * 4 - 1 ELSE b.seq_index - 4 END
  LEFT JOIN d l ON l.entity = b.entity AND l.kind = b.kind AND l.seq_index = b.seq_index - 1),
joined_b AS (SELECT b.entity AS entity, b.kind AS kind, b.fiscal_year AS fiscal_year, b.part AS part, * FROM joined),
every AS ({_EACH})"""
#: Amounts have 12 digits after a division of 14. Metrics at each nation's last period (its last complete year where that ends with it) against its own earlier ones and those of the others of its sector and size.
ENGINE_ANOMALIES_SQL = f"""{ENGINE_METRICS_SQL},
v AS (SELECT entity, kind, metric, round(round(value, 14), 12) AS value, fiscal_year * 4 + coalesce(part, 4) AS e FROM every WHERE value IS NOT NULL AND metric NOT IN ('ebitda', 'ebit', 'cost_of_goods_sold', 'total_debt', 'capital_employed')),
anchors AS (SELECT entity, arg_max(struct_pack(kind := kind, e := fiscal_year * 4 + coalesce(part, 4), rev := rev, days := days), (fiscal_year * 4 + coalesce(part, 4)) * 2 + CASE WHEN part IS NULL THEN 1 ELSE 0 END) AS a FROM d GROUP BY entity),
of AS (SELECT entity, a.kind AS kind, a.e AS e, CASE WHEN n_regionkey = 0 THEN 'banking' ELSE 'manufacturing' END AS sector, CASE WHEN a.rev * 365 / a.days < 50000 THEN 'small' WHEN a.rev * 365 / a.days < 500000 THEN 'mid' ELSE 'large' END AS size FROM anchors JOIN nation ON n_nationkey = entity),
s AS (SELECT *, list(value) OVER (PARTITION BY entity, metric, kind ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM v),
at_anchor AS (SELECT s.*, of.sector, of.size FROM s JOIN of ON of.entity = s.entity AND of.kind = s.kind AND of.e = s.e),
h AS (SELECT *, list_median(w) AS med FROM at_anchor WHERE len(w) >= 3),
z AS (SELECT *, list_median([abs(x - med) for x in w]) AS mad, list_avg([abs(x - med) for x in w]) AS dev FROM h),
history AS (SELECT entity, metric, 'history' AS basis, value > med AS high, CASE WHEN mad <> 0 THEN 0.6745 * (value - med) / mad WHEN dev <> 0 THEN (value - med) / (1.253314 * dev) END AS score, CAST(len(w) AS BIGINT) AS n FROM z),
peers AS (SELECT t.entity, t.metric, t.value, count(*) AS n, count(*) FILTER (v.value < t.value) + count(*) FILTER (v.value = t.value) / 2.0 AS below, median(v.value) AS med
  FROM at_anchor t JOIN of o ON o.sector = t.sector AND o.size = t.size AND o.entity <> t.entity JOIN v ON v.entity = o.entity AND v.metric = t.metric AND v.kind = t.kind GROUP BY ALL),
cohort AS (SELECT entity, metric, 'cohort' AS basis, value > med AS high, below / n AS score, n FROM peers WHERE n >= 8)
SELECT CAST(entity AS VARCHAR) AS document_id, metric, basis, CASE WHEN high THEN 'high' ELSE 'low' END AS direction, round(score, 6) AS score, CAST(n AS INTEGER) AS n
FROM (SELECT * FROM history WHERE abs(score) > 3.5 UNION ALL SELECT * FROM cohort WHERE score <= 0.05 OR score >= 0.95)"""


@query(ENGINE_METRICS_SQL + """
SELECT CAST(entity AS VARCHAR) AS document_id, metric, kind, CAST(fiscal_year AS INTEGER) AS fiscal_year, CAST(coalesce(part, 0) AS INTEGER) AS part, round(value, 6) AS value FROM every WHERE value IS NOT NULL""")
def engine_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.analyse(*derived_facts(spark, sf_dir))
    return found["metrics"].select("document_id", "metric", "kind", "fiscal_year", F.coalesce("part", F.lit(0)).alias("part"), rounded(F.col("value")).alias("value"))


@query(ENGINE_ANOMALIES_SQL)
def engine_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against each document's own history and its cohort without itself."""
    found = engine.analyse(*derived_facts(spark, sf_dir), peers=True)["anomalies"]
    return found.select("document_id", "metric", "basis", "direction", rounded(F.col("score")).alias("score"), "n")


@query("""
WITH o AS (SELECT c.c_nationkey AS e, (year(CAST(o_orderdate AS DATE)) * 12 + month(CAST(o_orderdate AS DATE)) - 1 + 9) // 3 AS q FROM orders JOIN customer c ON c_custkey = o_custkey),
quarters AS (SELECT DISTINCT e, 'quarter' AS kind, q // 4 AS fy, q % 4 + 1 AS part, q AS s FROM o),
years AS (SELECT e, 'year' AS kind, fy, CAST(NULL AS BIGINT) AS part, fy AS s FROM quarters GROUP BY e, fy HAVING count(*) = 4),
p AS (SELECT *, CASE WHEN part IS NULL THEN '' ELSE 'Q' || part END || 'FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') AS label FROM (SELECT * FROM quarters UNION ALL SELECT * FROM years)),
reads AS (
  SELECT p.*, 'revenue_growth' AS metric, CASE WHEN part IS NULL THEN '' ELSE 'Q' || part END || 'FY' || lpad(CAST((fy - 1) % 100 AS VARCHAR), 2, '0') AS other, EXISTS (SELECT 1 FROM p b WHERE b.e = p.e AND b.kind = p.kind AND b.fy = p.fy - 1 AND b.part IS NOT DISTINCT FROM p.part) AS has FROM p
  UNION ALL
  SELECT p.*, 'revenue_growth_qoq', CASE WHEN part IS NULL THEN 'FY' || lpad(CAST((fy - 1) % 100 AS VARCHAR), 2, '0') ELSE 'Q' || ((s - 1) % 4 + 1) || 'FY' || lpad(CAST(((s - 1) // 4) % 100 AS VARCHAR), 2, '0') END, EXISTS (SELECT 1 FROM p b WHERE b.e = p.e AND b.kind = p.kind AND b.s = p.s - 1) FROM p)
SELECT CAST(e AS VARCHAR) AS document_id, metric, kind, CAST(fy AS INTEGER) AS fiscal_year, CAST(coalesce(part, 0) AS INTEGER) AS part, CASE WHEN has THEN '' ELSE 'f:revenue_from_operations@' || other END AS missing,
  CASE WHEN has THEN least('f:revenue_from_operations@' || label, 'f:revenue_from_operations@' || other) || ',' || greatest('f:revenue_from_operations@' || label, 'f:revenue_from_operations@' || other) ELSE 'f:revenue_from_operations@' || label END AS inputs FROM reads""")
def metric_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What growth on the year and on the period before lacks and reads, down to facts, in every reported period."""
    kept, _ = facts_.validate(derived_facts(spark, sf_dir)[0])
    grid = engine.with_metrics(written(facts_.grid(written(kept, "gaps-facts"), derived_facts(spark, sf_dir)[1]), "gaps-items"))
    found = engine.metric_provenance(engine.with_provenance(grid)).where(F.col("metric").isin("revenue_growth", "revenue_growth_qoq"))
    return found.select("document_id", "metric", "kind", "fiscal_year", F.coalesce("part", F.lit(0)).alias("part"), F.array_join("missing", ",").alias("missing"), F.array_join("inputs", ",").alias("inputs"))
