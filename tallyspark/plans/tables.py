"""Queries of statistics, cohorts, joins, sets, learning, text and retrieval over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import statistics, text
from ..operators import evidence, labels, layout, learning, reconcile, retrieval
from ..sources import filings
from .base import query, rounded, table


@query("""
WITH m AS (SELECT c_mktsegment AS segment, median(c_acctbal) AS med FROM customer GROUP BY 1)
SELECT segment, CAST(count(*) AS BIGINT) AS n, round(any_value(med), 6) AS median, round(median(abs(c_acctbal - med)), 6) AS mad FROM customer JOIN m ON segment = c_mktsegment GROUP BY segment""")
def median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.group_mad(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "segment"), ["segment"], "c_acctbal")
    return found.select("segment", "n", rounded(F.col("median")).alias("median"), rounded(F.col("mad")).alias("mad"))


@query("""
WITH m AS (SELECT c_nationkey, median(c_acctbal) AS med, count(*) AS n FROM customer GROUP BY 1),
a AS (SELECT c_nationkey, any_value(med) AS med, any_value(n) AS n, median(abs(c_acctbal - med)) AS mad FROM customer JOIN m USING (c_nationkey) GROUP BY 1)
SELECT c_custkey, round(0.6745 * (c_acctbal - med) / mad, 6) AS z FROM customer JOIN a USING (c_nationkey) WHERE n >= 2 AND mad <> 0""")
def modified_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.join(statistics.group_mad(c, ["c_nationkey"], "c_acctbal").where("n >= 2 and mad <> 0"), "c_nationkey").select("c_custkey", rounded(F.lit(statistics.MAD_SCALE) * (F.col("c_acctbal") - F.col("median")) / F.col("mad")).alias("z"))


@query("SELECT p_size, round(quantile_cont(p_retailprice, 0.9), 6) AS p90, round(quantile_cont(p_retailprice, 0.1), 6) AS p10 FROM part GROUP BY p_size")
def percentile_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").groupBy("p_size").agg(rounded(F.percentile(price, F.lit(0.9))).alias("p90"), rounded(F.percentile(price, F.lit(0.1))).alias("p10"))


@query("""
SELECT p_partkey, round((count(*) FILTER (true) OVER b + (count(*) OVER e) / 2.0) / count(*) OVER g, 6) AS mid_rank FROM part
WINDOW g AS (PARTITION BY p_brand), e AS (PARTITION BY p_brand, p_size), b AS (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)""")
def mid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.group_mid_rank(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size")
    return found.select("p_partkey", rounded(F.col("mid_rank")).alias("mid_rank"))


@query("""
WITH g AS (SELECT a.c_custkey, any_value(a.c_acctbal) AS own, count(b.c_custkey) AS n, quantile_cont(b.c_acctbal, 0.9) AS p FROM customer a LEFT JOIN customer b ON a.c_mktsegment = b.c_mktsegment AND a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey GROUP BY 1)
SELECT c_custkey, own > CASE WHEN n >= 8 THEN p ELSE 5000 END AS above, CAST(n AS BIGINT) AS peers FROM g""")
def cohort_percentile_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Above the 90th percentile of the cohort without the own value, or a fixed bound where the cohort is under 8."""
    c, keys = table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"]
    peers = statistics.peer_percentile(c, c, keys, "c_custkey", "c_acctbal", 90)
    bound = F.when(F.col("n") >= statistics.TRUSTED_COHORT, F.col("percentile")).otherwise(5000.0)
    return c.join(peers, ["c_custkey", *keys], "left").select("c_custkey", (F.col("c_acctbal") > bound).alias("above"), F.coalesce("n", F.lit(0)).cast("long").alias("peers"))


@query("""
SELECT c_custkey, round(r, 6) AS score FROM (SELECT a.c_custkey, count(b.c_custkey) AS n, (count(*) FILTER (b.c_acctbal < a.c_acctbal) + count(*) FILTER (b.c_acctbal = a.c_acctbal) / 2.0) / count(*) AS r
  FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey GROUP BY 1) WHERE n >= 8 AND (r <= 0.05 OR r >= 0.95)""")
def cohort_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in either tail of 8 or more others of their cohort."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    ranked = statistics.peer_mid_rank(c, c, ["c_nationkey"], "c_custkey", "c_acctbal")
    r = F.col("mid_rank")
    return ranked.where((F.col("n") >= statistics.TRUSTED_COHORT) & ((r <= statistics.TAIL) | (r >= 1 - statistics.TAIL))).select("c_custkey", rounded(r).alias("score"))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN 'not positive' WHEN c_custkey IS NULL THEN 'unknown customer' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END AS reason
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE o_totalprice <= 0 OR c_custkey IS NULL OR o_orderstatus NOT IN ('F', 'O')""")
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    o = table(spark, sf_dir, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    reason = F.when(F.col("o_totalprice") <= 0, "not positive").when(F.col("c_custkey").isNull(), "unknown customer").when(~F.col("o_orderstatus").isin("F", "O"), "status")
    return o.select("o_orderkey", reason.alias("reason")).where("reason is not null")


@query("""
WITH f AS (SELECT user_id, event_type, ts, event_id, value, row_number() OVER w AS n, lead(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC))
SELECT user_id, event_type, arg_min(value, n) AS value, max(coalesce(abs(value - before) / nullif(greatest(abs(value), abs(before)), 0) > 0.005, false)::INT) = 1 AS restated, CAST(count(*) AS BIGINT) AS filings FROM f GROUP BY 1, 2""")
def restatement_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconcile.merge_restated(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ("user_id", "event_type"), ("ts", "event_id"))
    return found.select("user_id", "event_type", "value", "restated", "filings")


@query("""
WITH w AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS BIGINT) * 100 AS income, CAST(l_quantity AS BIGINT) * 70 AS expenses, CAST(l_quantity AS BIGINT) * 5 AS fin, CAST(l_quantity AS BIGINT) * 10 AS dep, CAST(l_quantity AS BIGINT) * 15 AS pbt,
  CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END * CAST(l_quantity AS BIGINT) * 4 AS tax, CAST(l_quantity AS BIGINT) * 19 AS pat FROM lineitem)
SELECT k, n, CASE WHEN NOT abs(income - expenses - pbt) <= 0.002 * greatest(abs(income - expenses), abs(pbt), 1) AND abs(income - expenses - fin - dep - pbt) <= 0.002 * greatest(abs(income - expenses - fin - dep), abs(pbt), 1) THEN expenses + fin + dep ELSE expenses END AS expenses,
  CASE WHEN NOT abs(pbt - tax - pat) <= 0.002 * greatest(abs(pbt - tax), abs(pat), 1) AND abs(pbt + tax - pat) <= 0.002 * greatest(abs(pbt + tax), abs(pat), 1) THEN -tax ELSE tax END AS tax FROM w""")
def pnl_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (q * 100).alias("total_income"), (q * 70).alias("total_expenses"), (q * 5).alias("finance_costs"), (q * 10).alias("depreciation_amortisation"),
        F.lit(0).cast("long").alias("exceptional_items"), F.lit(None).cast("long").alias("profit_before_exceptional_items"), (q * 15).alias("profit_before_tax"),
        (F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1) * q * 4).alias("total_tax_expense"), (q * 19).alias("profit_after_tax"),
    )
    return reconcile.profit_and_loss(rows).select("k", "n", F.col("total_expenses").alias("expenses"), F.col("total_tax_expense").alias("tax"))


VERDICT_SQL = """
WITH f AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('click', 'purchase') THEN 'confirm' ELSE 'dismiss' END AS verdict FROM events WHERE event_type IN ('click', 'purchase', 'error')),
v AS (SELECT user_id, arg_max(verdict, (ts, event_id)) AS verdict FROM f GROUP BY user_id)"""


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase", "error"))
    return e.select("user_id", "event_id", "ts", F.when(F.col("event_type") == "error", "dismiss").otherwise("confirm").alias("verdict"))


@query(VERDICT_SQL + " SELECT user_id, verdict FROM v")
def latest_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.latest_verdicts(_feedback(spark, sf_dir), ("user_id",), ("ts", "event_id"))


RULES_SQL = VERDICT_SQL + """, r AS (SELECT verdict, unnest([user_id % 7, 7 + user_id % 5]) AS rule_id FROM v),
c AS (SELECT rule_id, count(*) FILTER (verdict = 'confirm') AS confirms, count(*) FILTER (verdict = 'dismiss') AS dismisses FROM r GROUP BY rule_id)"""


def _by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id").cast("long")
    each = latest_verdict(spark, sf_dir).select("verdict", F.explode(F.array(u % 7, 7 + u % 5)).alias("rule_id"))
    return each.groupBy("rule_id").agg(F.count_if(F.col("verdict") == "confirm").alias("confirms"), F.count_if(F.col("verdict") == "dismiss").alias("dismisses"))


@query(RULES_SQL + " SELECT CAST(rule_id AS BIGINT) AS rule_id, CAST(confirms AS BIGINT) AS confirms, CAST(dismisses AS BIGINT) AS dismisses, round((3 + confirms) / (5.0 + confirms + dismisses), 6) AS score FROM c")
def reliability_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id").cast("long")
    feedback = _feedback(spark, sf_dir).select(F.lit(1).alias("analysis_id"), F.col("user_id").alias("finding_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"), "verdict")
    findings = table(spark, sf_dir, "events").select(F.lit(1).alias("analysis_id"), F.col("user_id").alias("finding_id"), F.array(u % 7, 7 + u % 5).alias("rule_ids")).distinct()
    return learning.rule_reliability(feedback, findings).withColumn("score", rounded(F.col("score")))


@query(RULES_SQL + " SELECT CAST(rule_id AS BIGINT) AS chunk, round(least(1.0, greatest(-0.5, 0.2 * confirms - 0.1 * dismisses)), 6) AS boost FROM c")
def chunk_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_rule(spark, sf_dir).select(F.col("rule_id").alias("chunk"), rounded(learning.boost(F.col("confirms"), F.col("dismisses"))).alias("boost"))


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS k, CAST(l_shipdate AS DATE) AS s, CAST(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS e FROM lineitem),
i AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, CAST(date_trunc('month', l_shipdate + to_days(l_linenumber * 9)) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS d FROM lineitem)
SELECT i.k, i.n, d::VARCHAR AS at, min(s)::VARCHAR AS start, CAST(max(date_diff('day', s, e)) AS INTEGER) AS days FROM i LEFT JOIN s ON s.k = i.k AND e = d GROUP BY ALL""")
def instant_to_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balance at a date takes the longest of its entity's spans that end on that date, and none where none does."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.to_date("l_shipdate").alias("s"))
    spans = lines.select("k", F.col("s").alias("start_date"), F.last_day("s").alias("end_date")).distinct().withColumn("period", F.struct("start_date"))
    instants = lines.select("k", "n", F.last_day(F.date_add("s", (F.col("n") * 9).cast("int"))).alias("end_date")).distinct()
    found = instants.join(filings.longest_ending(spans, ("k",)), ["k", "end_date"], "left")
    return found.select("k", "n", F.col("end_date").cast("string").alias("at"), F.col("period.start_date").cast("string").alias("start"), F.datediff("end_date", "period.start_date").alias("days"))


@query("""
WITH c AS (SELECT s_nationkey AS page, s_suppkey AS col, s_acctbal - 1000 AS lo, s_acctbal AS hi FROM supplier)
SELECT c_custkey, CAST(min(col) AS BIGINT) AS col FROM customer LEFT JOIN c ON page = c_nationkey AND lo < c_acctbal AND c_acctbal <= hi GROUP BY c_custkey""")
def range_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes go to the first column whose interval holds their right edge."""
    words = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("page"), F.col("c_acctbal").alias("x1"))
    columns = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), F.col("s_suppkey").cast("long").alias("column"), (F.col("s_acctbal") - 1000).alias("left"), F.col("s_acctbal").alias("right"))
    return layout.assign_columns(words, columns).select("c_custkey", F.col("column").alias("col"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def uncovered_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fired rules of their customers: those neither covered by an urgent sibling nor dismissed by a returned line."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("rule_id"), "o_orderpriority")
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("rule_id")).distinct()
    return evidence.uncovered(o, o.where("o_orderpriority = '1-URGENT'"), o.join(returned, "rule_id")).select(F.col("rule_id").alias("o_orderkey"))


@query("""
SELECT c_nationkey, c_custkey, CAST(n AS INTEGER) AS rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 500) DESC, c_custkey) AS n FROM customer) WHERE n <= 5""")
def topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.floor(F.col("c_acctbal") / 500).alias("score"))
    return retrieval.ranked(scores, 5, "c_nationkey", "c_custkey").select("c_nationkey", "c_custkey", "rank")


@query("""
WITH r AS (SELECT source, doc_id, length(text) // 4 + 1 AS t, row_number() OVER w AS rank, sum(length(text) // 4 + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM r WHERE used <= 4000 OR rank = 1""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    return retrieval.pack(hits, 4000, "source").select("source", "doc_id", F.col("used").cast("long").alias("used"))


@query("""
WITH a AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS p, list(DISTINCT o_orderstatus) AS s FROM orders GROUP BY 1)
SELECT k, array_to_string(list_sort(list_distinct(list_concat(p, s))), ',') AS either, CAST(len(list_filter(p, lambda x: NOT list_contains(['1-URGENT', '2-HIGH'], x))) AS INTEGER) AS plain FROM a""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("p"), F.collect_set("o_orderstatus").alias("s"))
    return a.select("k", F.array_join(F.array_sort(F.array_union("p", "s")), ",").alias("either"), F.size(F.array_except("p", F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))).alias("plain"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def events_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("n"))


@query("""
WITH p AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events WHERE event_type = 'error'),
i AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM p)
SELECT user_id, CAST(min(day) AS INTEGER) AS first, CAST(max(day) AS INTEGER) AS last, CAST(count(*) AS BIGINT) AS days FROM i GROUP BY user_id, g""")
def page_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("day")).distinct()
    return layout.islands(p, ["user_id"], "day").groupBy("user_id", "island").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days")).drop("island")


@query("""
WITH n AS (SELECT user_id, value, CASE WHEN value - lag(value) OVER w > 6 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value)),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY value ROWS UNBOUNDED PRECEDING) AS g FROM n)
SELECT user_id, min(value) AS low, max(value) AS high, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY user_id, g HAVING count(*) >= 3""")
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.clusters(table(spark, sf_dir, "events").select("user_id", "value"), ["user_id"], "value").drop("cluster")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("seen", F.when(F.col("event_type") == "signup", F.col("value")))
    return e.select("event_id", layout.forward_fill(e, ["user_id"], ["ts", "event_id"], "seen").alias("filled"))


@query("""
WITH t AS (SELECT unnest(['(1,602.15)', '-', 'abc', '12,34,567.89', '-45', '(7)', 'nil', '1,2']) AS token, 1 AS one),
d AS (SELECT token, regexp_replace(token, '[(),-]', '', 'g') AS digits FROM t)
SELECT DISTINCT token, CASE WHEN token IN ('-', 'nil') THEN 0.0 WHEN token NOT IN ('abc', '1,2') THEN CASE WHEN starts_with(token, '(') OR starts_with(token, '-') THEN -CAST(digits AS DOUBLE) ELSE CAST(digits AS DOUBLE) END END AS amount FROM d, region""")
def parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array(*map(F.lit, ("(1,602.15)", "-", "abc", "12,34,567.89", "-45", "(7)", "nil", "1,2")))
    return table(spark, sf_dir, "region").select(F.explode(tokens).alias("token")).distinct().select("token", text.parse_amount(F.col("token")).cast("double").alias("amount"))


#: The stems and expansions change no word of the synthetic languages' stop lists; SQL follows the same steps.
STEM_SQL = """
stems AS (SELECT *, CASE WHEN length(w) > 3 AND NOT regexp_full_match(w, '[0-9]+') THEN
    CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%sses' THEN left(w, length(w) - 2)
      WHEN w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, length(w) - 1) ELSE w END END AS p FROM words),
cut AS (SELECT *, CASE WHEN p LIKE '%ingly' AND length(p) >= 9 THEN left(p, length(p) - 5) WHEN p LIKE '%edly' AND length(p) >= 8 THEN left(p, length(p) - 4) WHEN p LIKE '%ing' AND length(p) >= 7 THEN left(p, length(p) - 3)
    WHEN p LIKE '%ed' AND length(p) >= 6 THEN left(p, length(p) - 2) WHEN p LIKE '%ly' AND length(p) >= 6 THEN left(p, length(p) - 2) ELSE p END AS c FROM stems),
stemmed AS (SELECT *, CASE WHEN p IS NULL THEN w WHEN c LIKE '%e' AND length(c) > 4 THEN left(c, length(c) - 1) ELSE c END AS term FROM cut)"""
_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
#: Written out again, so that the comparison can see what the library's list leaves out.
_EXPANSIONS = """
  ('dso', 'days sales outstanding receivables'),
  ('dio', 'days inventory outstanding'),
  ('dpo', 'days payables outstanding'),
  ('ccc', 'cash conversion cycle'),
  ('cfo', 'cash flow operating activities'),
  ('fcf', 'free cash flow'),
  ('pat', 'profit after tax'),
  ('pbt', 'profit before tax'),
  ('ebitda', 'earnings before interest tax depreciation amortisation operating profit'),
  ('ebit', 'operating profit'),
  ('eps', 'earnings per share'),
  ('roce', 'return capital employed'),
  ('roe', 'return equity'),
  ('roa', 'return assets'),
  ('etr', 'effective tax rate'),
  ('capex', 'capital expenditure'),
  ('cwip', 'capital work progress'),
  ('rpt', 'related party transactions'),
  ('rpts', 'related party transactions'),
  ('ofs', 'offer sale'),
  ('gcp', 'general corporate purposes'),
  ('ipo', 'initial public offer'),
  ('drhp', 'draft red herring prospectus offer document'),
  ('rhp', 'red herring prospectus offer document'),
  ('icdr', 'issue capital disclosure requirements'),
  ('lodr', 'listing obligations disclosure requirements'),
  ('kam', 'key audit matters'),
  ('kams', 'key audit matters'),
  ('caro', 'companies auditor report order'),
  ('npa', 'non performing assets'),
  ('npas', 'non performing assets'),
  ('gnpa', 'gross non performing assets'),
  ('nnpa', 'net non performing assets'),
  ('crar', 'capital risk weighted assets ratio'),
  ('nim', 'net interest margin'),
  ('ecl', 'expected credit loss'),
  ('nbfc', 'non banking financial company'),
  ('msme', 'micro small medium enterprises'),
  ('epc', 'engineering procurement construction'),
  ('sez', 'special economic zone'),
  ('waca', 'weighted average cost acquisition'),
  ('kpi', 'key performance indicators'),
  ('kpis', 'key performance indicators'),
  ('qib', 'qualified institutional buyers'),
  ('qibs', 'qualified institutional buyers'),
  ('esop', 'employee stock options share based payments'),
  ('esops', 'employee stock options share based payments'),
  ('yoy', 'year on year'),
  ('qoq', 'quarter on quarter')"""
WORDS_SQL = f"""
raw AS (SELECT chunk, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.''][a-z0-9]+)*')) AS r FROM texts),
wider AS (SELECT chunk, unnest(CASE WHEN v IS NULL THEN [r] ELSE list_concat([r], string_split(v, ' ')) END) AS w FROM raw LEFT JOIN (VALUES {_EXPANSIONS}) x(k, v) ON k = r),
words AS (SELECT * FROM wider WHERE w NOT IN ({_STOPS})), {STEM_SQL.strip()}"""


@query(f"WITH texts AS (SELECT item_id AS chunk, text FROM benchmark), {WORDS_SQL} SELECT chunk, term, CAST(count(*) AS BIGINT) AS tf FROM stemmed GROUP BY ALL")
def tokenize_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.postings(table(spark, sf_dir, "benchmark"), "item_id").select("chunk", "term", "tf")


BM25_SQL = f"""
WITH texts AS (SELECT 2 * doc_id AS chunk, text FROM documents UNION ALL SELECT 2 * item_id + 1, text FROM benchmark), {WORDS_SQL},
counts AS (SELECT chunk, term, count(*) AS tf FROM stemmed GROUP BY ALL),
post AS (SELECT *, sum(tf) OVER (PARTITION BY chunk) AS len FROM counts WHERE chunk % 2 = 0),
size AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM post) / CAST((SELECT count(*) FROM documents) AS DOUBLE) AS average),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (SELECT (q.chunk - 1) // 2 AS query, p.chunk // 2 AS chunk, round(sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * len / average))), 6) AS score
  FROM counts q JOIN df USING (term) JOIN post p USING (term), size WHERE q.chunk % 2 = 1 GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS rank FROM scored)"""


def _bm25(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("query_text"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.bm25_top(asked, docs, limit)


@query(BM25_SQL + " SELECT CAST(query AS BIGINT) AS query, CAST(chunk AS BIGINT) AS chunk, CAST(rank AS INTEGER) AS rank, score FROM hits WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 10).select("query", "chunk", "rank", "score")


COSINE_SQL = """
WITH s AS (SELECT a.vec_id AS query, b.vec_id AS chunk, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS rank FROM s)"""


def _cosine(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """A stated set of queries against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return retrieval.nearest(asked, e.select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("vector")), limit)


@query(COSINE_SQL + " SELECT query, chunk, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM hits WHERE rank <= 5")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cosine(spark, sf_dir, 5).select("query", "chunk", "rank", rounded(F.col("score")).alias("score"))


@query(COSINE_SQL + """, other AS (SELECT query, chunk, row_number() OVER (PARTITION BY query ORDER BY chunk) AS rank FROM s)
SELECT query, chunk, round(sum(w / (60 + rank)), 6) AS score FROM (SELECT query, chunk, rank, 1.0 AS w FROM hits WHERE rank <= 20 UNION ALL SELECT query, chunk, rank, 0.5 FROM other WHERE rank <= 20) GROUP BY ALL""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors fused with the first by number, of which any query's 20 are among the first 21."""
    e = table(spark, sf_dir, "embeddings")
    first = [r.vec_id for r in e.select("vec_id").orderBy("vec_id").limit(21).collect()]
    each = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.explode(F.array(*map(F.lit, first))).alias("chunk")).where("query <> chunk")
    other = retrieval.ranked(each.withColumn("score", -F.col("chunk").cast("double")))
    found = retrieval.fuse((_cosine(spark, sf_dir, 20), 1.0), (other, 0.5))
    return found.select("query", "chunk", rounded(F.col("score")).alias("score"))


@query(COSINE_SQL + """, x AS (SELECT DISTINCT a.vec_id AS query, b.vec_id AS chunk FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
best AS (SELECT query, min(rank) AS best FROM hits JOIN x USING (query, chunk) WHERE rank <= 20 GROUP BY query)
SELECT CAST(count(*) AS BIGINT) AS queries, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN best <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5,
  round(avg(coalesce(1.0 / best, 0)), 6) AS mrr FROM (SELECT DISTINCT query FROM x) LEFT JOIN best USING (query)""")
def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    a = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "label")
    expected = a.join(e.select(F.col("vec_id").alias("chunk"), "label"), "label").where("query <> chunk").select("query", "chunk")
    found = retrieval.evaluate(_cosine(spark, sf_dir, 20), expected)
    return found.select("queries", *(rounded(F.col(c)).alias(c) for c in ("recall_1", "recall_3", "recall_5", "mrr")))


@query("""
WITH s AS (SELECT p_partkey, list_distinct(string_split(lower(p_type), ' ')) AS a, list_distinct(string_split(lower(p_name), ' ')) AS b FROM part)
SELECT p_partkey, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))), 6) AS score FROM s""")
def label_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    return table(spark, sf_dir, "part").select("p_partkey", rounded(labels.jaccard(words("p_type"), words("p_name"))).alias("score"))


@query("SELECT doc_id, CAST(length(text) // 4 + 1 AS BIGINT) AS tokens, left(sha256(text), 12) AS version, regexp_replace(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents")
def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).cast("long").alias("tokens"), F.substring(F.sha2("text", 256), 1, 12).alias("version"), text.slug(F.concat_ws(" ", "source", "lang")).alias("slug"))
