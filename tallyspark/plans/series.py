"""Queries over the quarterly series: look-backs, balances, rules and the tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog.rules import Rule
from ..functions import periods, statistics, timeseries
from ..functions.text import group_indian
from ..functions.timeseries import Grid, divide
from ..operators import engine, facts, report
from .base import over_quarters, quarters, query, rounded, table

G = Grid(("entity",))
KEYS = ("entity", "seq_index")


def _double(name: str):
    return F.col(name).cast("double")


@query(over_quarters(" SELECT entity, seq_index, CAST(fiscal_year AS INTEGER) AS fiscal_year, part, revenue, tax, receivables, returned FROM quarters"))
def quarterly_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarters(spark, sf_dir).select(*KEYS, "fiscal_year", "part", "revenue", "tax", "receivables", "returned")


@query(over_quarters("""
SELECT a.entity, a.seq_index, round((a.revenue - b.revenue) / nullif(CAST(abs(b.revenue) AS DOUBLE), 0), 6) AS revenue_growth,
  round((a.receivables - b.receivables) / nullif(CAST(abs(b.receivables) AS DOUBLE), 0), 6) AS receivables_growth
FROM quarters a LEFT JOIN quarters b ON b.entity = a.entity AND b.seq_index = a.seq_index - 4"""))
def growth_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quarters(spark, sf_dir)
    return q.select(*KEYS, rounded(G.growth(_double("revenue"))).alias("revenue_growth"), rounded(G.growth(_double("receivables"))).alias("receivables_growth"))


@query(over_quarters("""
SELECT a.entity, a.seq_index, round((a.revenue - b.revenue) / nullif(CAST(abs(b.revenue) AS DOUBLE), 0), 6) AS revenue_growth_qoq
FROM quarters a LEFT JOIN quarters b ON b.entity = a.entity AND b.seq_index = a.seq_index - 1"""))
def growth_qoq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarters(spark, sf_dir).select(*KEYS, rounded(G.seq_growth(_double("revenue"))).alias("revenue_growth_qoq"))


@query(over_quarters(""", kept AS (SELECT * FROM quarters WHERE (entity + seq_index) % 3 <> 0)
SELECT a.entity, a.seq_index, a.revenue, b.revenue AS before FROM kept a LEFT JOIN kept b ON b.entity = a.entity AND b.seq_index = a.seq_index - 1"""))
def prior_gap_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A period that is absent is null, never the row before it."""
    q = quarters(spark, sf_dir).where((F.col("entity") + F.col("seq_index")) % 3 != 0)
    return q.select(*KEYS, "revenue", G.seq(F.col("revenue")).alias("before"))


@query(over_quarters("""
SELECT a.entity, a.seq_index, round(coalesce((b.receivables + a.receivables) / 2.0, a.receivables), 6) AS average_receivables,
  round(coalesce((b.receivables + a.receivables) / 2.0, a.receivables) / nullif(CAST(a.revenue AS DOUBLE), 0) * 91, 6) AS dso
FROM quarters a LEFT JOIN quarters b ON b.entity = a.entity AND b.seq_index = a.seq_index - 1"""))
def dso(spark: SparkSession, sf_dir: str) -> DataFrame:
    average = G.avg(_double("receivables"))
    return quarters(spark, sf_dir).select(*KEYS, rounded(average).alias("average_receivables"), rounded(divide(average, _double("revenue")) * 91).alias("dso"))


@query(over_quarters("""
SELECT entity, seq_index, CASE WHEN count(*) OVER w = 4 THEN CAST(sum(revenue) OVER w AS BIGINT) END AS revenue_ttm FROM quarters
WINDOW w AS (PARTITION BY entity ORDER BY seq_index RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)"""))
def ttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarters(spark, sf_dir).select(*KEYS, G.ttm(F.col("revenue")).alias("revenue_ttm"))


@query(over_quarters("""
SELECT entity, seq_index, CASE WHEN count(*) OVER w = 3 THEN CAST(sum(revenue) OVER w AS BIGINT) END AS revenue_3y FROM quarters
WINDOW w AS (PARTITION BY entity, part ORDER BY fiscal_year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)"""))
def trailing_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarters(spark, sf_dir).select(*KEYS, G.trailing_sum(F.col("revenue"), 3).alias("revenue_3y"))


@query(over_quarters(""", c AS (SELECT a.entity, a.seq_index, a.revenue > b.revenue AS up FROM quarters a LEFT JOIN quarters b ON b.entity = a.entity AND b.seq_index = a.seq_index - 1)
SELECT entity, seq_index, (CASE WHEN count(CASE WHEN NOT up THEN 1 END) OVER w > 0 THEN false WHEN count(up) OVER w = 3 THEN true END)::VARCHAR AS up_three FROM c
WINDOW w AS (PARTITION BY entity ORDER BY seq_index RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)"""))
def streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quarters(spark, sf_dir).withColumn("up", F.col("revenue") > G.seq(F.col("revenue")))
    return q.select(*KEYS, G.streak(F.col("up"), 3).cast("string").alias("up_three"))


RULE_SQL = over_quarters(""", g AS (
  SELECT a.*, (a.revenue - b.revenue) / nullif(CAST(abs(b.revenue) AS DOUBLE), 0) AS rg, (a.receivables - b.receivables) / nullif(CAST(abs(b.receivables) AS DOUBLE), 0) AS cg
  FROM quarters a LEFT JOIN quarters b ON b.entity = a.entity AND b.seq_index = a.seq_index - 4),
o AS (
  SELECT *, CASE WHEN cg - rg > 0.20 AND receivables > 0.05 * revenue THEN 'fired' WHEN NOT (cg - rg > 0.20 AND receivables > 0.05 * revenue) THEN 'passed' ELSE 'insufficient_data' END AS outcome,
    CASE WHEN tax < 0.035 * revenue THEN 4 ELSE 3 END AS severity_rank FROM g)""")


#: Receivables outpace revenue; critical where the tax is low.
OUTPACE = Rule(
    "QTR-001", "core", "high", lambda t: (t.cg - t.rg > 0.20) & (t.receivables > 0.05 * t.revenue), ("cg", "rg"),
    escalate=((lambda t: t.tax < 0.035 * t.revenue, "critical"),), kinds=(periods.QUARTER,),
)


def _engine_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule's outcome for each entity and quarter, by the engine."""
    q = quarters(spark, sf_dir).withColumn("rg", G.growth(_double("revenue"))).withColumn("cg", G.growth(_double("receivables")))
    named = {"document_id": F.col("entity"), "sector": F.lit("manufacturing"), "doc_type": F.lit("annual_report"), "observed": F.lit(True), "is_anchor": F.lit(False)}
    end = periods.end_date(F.col("kind"), F.col("fiscal_year"), F.col("part"), F.lit(3))
    return engine.rule_outcomes(q.withColumns(named | {"end_date": end}), {OUTPACE.id: OUTPACE})


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes beside the figures that they were found from."""
    value = lambda name: F.get(F.filter("evidence", lambda e: e["name"] == name), F.lit(0))["value"].cast("double")
    found = _engine_outcomes(spark, sf_dir).select(F.col("document_id").alias("entity"), (F.col("fiscal_year") * 4 + F.col("part") - 1).cast("int").alias("seq_index"), "fiscal_year", "outcome", "severity_rank", value("rg").alias("rg"), value("cg").alias("cg"))
    return found.join(quarters(spark, sf_dir).select(*KEYS, "revenue", "tax", "receivables"), list(KEYS))


@query(RULE_SQL + " SELECT entity, seq_index, outcome, severity_rank, round(cg, 6) AS receivables_growth, round(rg, 6) AS revenue_growth FROM o")
def rule_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receivables outpace revenue: three-valued outcome, escalated severity, evidence."""
    return _outcomes(spark, sf_dir).select(*KEYS, "outcome", "severity_rank", rounded(F.col("cg")).alias("receivables_growth"), rounded(F.col("rg")).alias("revenue_growth"))


@query(RULE_SQL + """ SELECT entity, arg_max(outcome, seq_index) AS outcome, arg_max(severity_rank, seq_index) AS severity_rank,
  coalesce(string_agg(CASE WHEN outcome = 'fired' THEN 'Q' || part || 'FY' || lpad(CAST(fiscal_year % 100 AS VARCHAR), 2, '0') END, ',' ORDER BY seq_index), '') AS fired_periods FROM o GROUP BY entity""")
def rule_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.latest(_engine_outcomes(spark, sf_dir))
    return found.select(F.col("document_id").alias("entity"), "outcome", "severity_rank", F.array_join("fired_periods", ",").alias("fired_periods"))


@query(RULE_SQL + """ SELECT fiscal_year::INTEGER AS fiscal_year, CAST(count(*) FILTER (outcome = 'fired') AS BIGINT) AS fired, CAST(count(*) FILTER (outcome = 'passed') AS BIGINT) AS passed,
  CAST(count(*) FILTER (outcome = 'insufficient_data') AS BIGINT) AS insufficient_data, max(CASE WHEN outcome = 'fired' THEN severity_rank END) AS worst_rank FROM o GROUP BY 1""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.scorecard(_outcomes(spark, sf_dir), ("fiscal_year",))


@query(RULE_SQL + """ SELECT entity, CASE WHEN max(severity_rank) > 3 OR count(*) FILTER (severity_rank = 3) >= 3 THEN 'high' WHEN count(*) FILTER (severity_rank = 3) >= 1 THEN 'elevated'
  WHEN max(severity_rank) = 2 THEN 'moderate' ELSE 'low' END AS risk FROM o WHERE outcome = 'fired' GROUP BY entity""")
def overall_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).where("outcome = 'fired'").groupBy("entity").agg(report.risk().alias("risk"))


@query(RULE_SQL + " SELECT severity_rank, CAST(count(*) AS BIGINT) AS n FROM o WHERE outcome = 'fired' GROUP BY severity_rank")
def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).where("outcome = 'fired'").groupBy("severity_rank").agg(F.count("*").alias("n"))


@query(RULE_SQL + """ SELECT entity, finding_id, severity_rank, confidence, summary, CAST(row_number() OVER (PARTITION BY entity ORDER BY severity_rank DESC, confidence DESC, finding_id) AS INTEGER) AS position FROM (
  SELECT entity, 'R-' || seq_index AS finding_id, severity_rank, CASE WHEN seq_index % 3 = 0 THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence, seq_index || ' (' || fiscal_year || '): tax {{x:tax@' || fiscal_year || '}}.' AS summary FROM o WHERE outcome = 'fired')""")
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fired quarter as a finding, in the order of a report; some rules have a learned confidence."""
    o, text = _outcomes(spark, sf_dir), lambda c: F.col(c).cast("string")
    latest = o.select(
        F.col("entity").alias("document_id"), text("seq_index").alias("rule_id"), F.lit("core").alias("pack"), F.lit("high").alias("severity"), "severity_rank", "outcome", text("fiscal_year").alias("period"),
        F.array(F.struct(F.lit("tax").alias("name"), text("tax").alias("value"))).alias("evidence"), F.array().cast("array<string>").alias("fired_periods"),
    )
    known = o.where("seq_index % 3 = 0").select(text("seq_index").alias("rule_id"), F.lit(0.9).alias("score")).distinct()
    found = report.in_order(report.findings(latest, known))
    return found.select(F.col("document_id").alias("entity"), "finding_id", "severity_rank", "confidence", "summary", "position")


@query(RULE_SQL + """ SELECT entity, string_agg(DISTINCT m, ',' ORDER BY m) AS missing FROM (
  SELECT entity, unnest([CASE WHEN rg IS NULL THEN 'revenue_growth' END, CASE WHEN cg IS NULL THEN 'receivables_growth' END]) AS m FROM o WHERE outcome = 'insufficient_data') WHERE m IS NOT NULL GROUP BY entity""")
def data_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.array(F.when(F.col("rg").isNull(), F.lit("revenue_growth")), F.when(F.col("cg").isNull(), F.lit("receivables_growth")))
    each = _outcomes(spark, sf_dir).where("outcome = 'insufficient_data'").select("entity", F.explode(missing).alias("m")).where("m is not null")
    return each.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("m")), ",").alias("missing"))


@query(over_quarters("""
SELECT entity, seq_index, (g > 0 AND h > 0)::VARCHAR AS both_up, (g > 0 OR h > 0)::VARCHAR AS either_up, (CASE WHEN g IS NOT NULL AND h IS NOT NULL THEN g < h AND h < 1 END)::VARCHAR AS ordered FROM (
  SELECT a.entity, a.seq_index, (a.revenue - b.revenue) / nullif(CAST(abs(b.revenue) AS DOUBLE), 0) AS g, (a.receivables - c.receivables) / nullif(CAST(abs(c.receivables) AS DOUBLE), 0) AS h
  FROM quarters a LEFT JOIN quarters b ON b.entity = a.entity AND b.seq_index = a.seq_index - 1 LEFT JOIN quarters c ON c.entity = a.entity AND c.seq_index = a.seq_index - 4)"""))
def kleene_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quarters(spark, sf_dir).withColumn("g", G.seq_growth(_double("revenue"))).withColumn("h", G.growth(_double("receivables")))
    g, h = F.col("g"), F.col("h")
    return q.select(*KEYS, *(c.cast("string").alias(n) for n, c in (("both_up", (g > 0) & (h > 0)), ("either_up", (g > 0) | (h > 0)), ("ordered", timeseries.chain(g < h, h < 1, operands=(g, h))))))


@query(over_quarters("""
SELECT entity, seq_index, round(CASE WHEN revenue IS NOT NULL AND receivables IS NOT NULL THEN CASE WHEN greatest(abs(revenue), abs(receivables)) = 0 THEN 0
  ELSE abs(revenue - receivables) / CAST(greatest(abs(revenue), abs(receivables)) AS DOUBLE) END END, 6) AS apart FROM quarters"""))
def relative_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarters(spark, sf_dir).select(*KEYS, rounded(timeseries.rel_diff(_double("revenue"), _double("receivables"))).alias("apart"))


@query(over_quarters(""", s AS (SELECT entity, seq_index, revenue, list(CAST(revenue AS DOUBLE)) OVER (PARTITION BY entity ORDER BY seq_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM quarters),
m AS (SELECT *, list_median(v) AS med FROM s WHERE len(v) >= 3),
z AS (SELECT *, list_median(list_transform(v, lambda x: abs(x - med))) AS d, list_avg(list_transform(v, lambda x: abs(x - med))) AS a FROM m)
SELECT entity, seq_index, round(CASE WHEN d <> 0 THEN 0.6745 * (revenue - med) / d WHEN a <> 0 THEN (revenue - med) / (1.253314 * a) END, 6) AS score, CAST(len(v) AS INTEGER) AS n FROM z"""))
def history_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    earlier = Window.partitionBy("entity").orderBy("seq_index").rowsBetween(Window.unboundedPreceding, -1)
    q = quarters(spark, sf_dir).withColumn("sample", F.collect_list("revenue").over(earlier)).where(F.size("sample") >= statistics.LEAST_HISTORY)
    return q.select(*KEYS, rounded(statistics.modified_z(F.col("revenue"), F.col("sample"))).alias("score"), F.size("sample").alias("n"))


@query(over_quarters(""", y AS (SELECT entity, CAST(fiscal_year AS INTEGER) AS fiscal_year, CAST(sum(revenue) AS BIGINT) AS revenue FROM quarters GROUP BY ALL HAVING count(*) = 4)
SELECT entity, string_agg('FY' || lpad(CAST(fiscal_year % 100 AS VARCHAR), 2, '0') || '=' || CAST(CAST(round(revenue * 100.0 / 1e9, 1) AS DECIMAL(18, 1)) AS VARCHAR) || '%', ';' ORDER BY fiscal_year) AS by_year FROM y GROUP BY entity"""))
def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = quarters(spark, sf_dir).groupBy("entity", "fiscal_year").agg(F.sum("revenue").alias("revenue"), F.count("*").alias("n")).where("n = 4")
    year = F.col("fiscal_year").cast("int")
    # A count of cents has more digits before the point than an amount; its share of a billion fits.
    share = timeseries.divide(F.col("revenue").cast("decimal(20,0)"), F.lit(10**9)).cast(timeseries.AMOUNT)
    metrics = years.select(
        F.col("entity").alias("document_id"), F.lit("revenue_share").alias("metric"), F.lit("ratio").alias("unit"), F.lit(True).alias("headline"), periods.label(F.lit(periods.YEAR), year, F.lit(None).cast("int")).alias("period"),
        periods.end_date(F.lit(periods.YEAR), year, F.lit(None).cast("int"), F.lit(3)).alias("end_date"), share.alias("value"),
    )
    entries = F.transform(F.map_entries("values"), lambda e: F.concat_ws("=", e["key"], F.replace(e["value"], F.lit(","), F.lit(""))))
    return report.metric_table(metrics).select(F.col("document_id").alias("entity"), F.array_join(entries, ";").alias("by_year"))


@query(over_quarters("""
SELECT entity, seq_index, CASE WHEN y < 500 THEN 'small' WHEN y < 5000 THEN 'mid' WHEN y IS NOT NULL THEN 'large' END AS size_bucket FROM (SELECT *, revenue / 4e5 * 365 / 91.0 AS y FROM quarters)"""))
def size_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarters(spark, sf_dir).select(*KEYS, facts.size_bucket(_double("revenue") / 4e5, F.lit(91.0)).alias("size_bucket"))


@query("""
WITH d AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS s FROM orders),
p AS (SELECT s, n, CAST(s + to_months(n) - INTERVAL 1 DAY AS DATE) AS e FROM d, (VALUES (1), (3), (6), (9), (12)) t(n)),
q AS (SELECT *, CASE WHEN month(e) > 3 THEN year(e) + 1 ELSE year(e) END AS fy FROM p),
o AS (SELECT *, (year(s) * 12 + month(s)) - ((fy - 1) * 12 + 4) AS off FROM q)
SELECT s::VARCHAR AS start_date, e::VARCHAR AS end_date, CAST(CASE WHEN n = 3 AND off % 3 = 0 THEN 'Q' || (off // 3 + 1) WHEN n = 6 AND off % 6 = 0 THEN 'H' || (off // 6 + 1) WHEN n = 9 AND off = 0 THEN '9M' WHEN n = 12 AND off = 0 THEN '' END
  || 'FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') AS VARCHAR) AS label FROM o""")
def period_from_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("start_date")).distinct()
    spans = starts.select("start_date", F.explode(F.array(*map(F.lit, (1, 3, 6, 9, 12)))).alias("n"))
    spans = spans.select("start_date", F.date_sub(F.add_months("start_date", F.col("n")), 1).alias("end_date")).withColumn("p", periods.from_dates(F.col("start_date"), F.col("end_date"), F.lit(3)))
    return spans.select(F.col("start_date").cast("string"), F.col("end_date").cast("string"), periods.label(F.col("p.kind"), F.col("p.fiscal_year"), F.col("p.part")).alias("label"))


@query("SELECT DISTINCT CAST((year(o_orderdate) * 12 + month(o_orderdate) + 8) // 3 AS INTEGER) AS seq_index, CAST(make_date((((year(o_orderdate) * 12 + month(o_orderdate) + 8) // 3) // 4) - 1, 4, 1) + to_months(3 * (((year(o_orderdate) * 12 + month(o_orderdate) + 8) // 3) % 4)) AS DATE)::VARCHAR AS start_date FROM orders")
def fiscal_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .base import with_periods

    q = with_periods(table(spark, sf_dir, "orders").select(periods.fiscal_quarter(F.col("o_orderdate")).alias("seq_index")).distinct())
    return q.select("seq_index", periods.start_date(F.col("kind"), F.col("fiscal_year"), F.col("part"), F.lit(3)).cast("string").alias("start_date"))


@query(over_quarters(", w AS (SELECT *, CAST(revenue // 100 AS VARCHAR) AS t FROM quarters) SELECT entity, seq_index, CASE WHEN length(t) <= 3 THEN t ELSE regexp_replace(reverse(regexp_replace(reverse(left(t, length(t) - 3)), '(..)', '\\1,', 'g')), '^,', '') || ',' || right(t, 3) END AS shown FROM w"))
def indian_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarters(spark, sf_dir).select(*KEYS, group_indian(F.floor(F.col("revenue") / 100), 0).alias("shown"))
