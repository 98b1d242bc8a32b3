"""Queries of what puts filings together, over the benchmark tables: customers stand for companies, orders and events for what they file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import periods, printed, tables
from ..functions.timeseries import AMOUNT
from ..operators import evidence, facts, labels, layout, reconcile, retrieval
from ..sources import filings
from .base import over_quarters, quarters, query, table
from .tables import WORDS_SQL


@query(f"WITH texts AS (SELECT doc_id AS chunk, concat_ws(' ', text, source, lang, source, lang) AS text FROM documents), {WORDS_SQL}, counts AS (SELECT chunk, term, count(*) AS tf FROM stemmed GROUP BY ALL) SELECT chunk, term, CAST(tf AS BIGINT) AS tf, CAST(sum(tf) OVER (PARTITION BY chunk) AS BIGINT) AS length FROM counts")
def heading_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of source and language count twice beside the text's."""
    return retrieval.postings(table(spark, sf_dir, "documents"), "doc_id", headings=("source", "lang"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS isin, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS bse, o_orderkey % 4 AS name, o_orderstatus AS basis, 3 + o_orderkey % 2 AS fye FROM orders),
f AS (SELECT *, first(struct_pack(isin := isin, bse := bse, name := name, basis := basis, fye := fye)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS h FROM o),
r AS (SELECT o_custkey, o_orderkey, CASE WHEN NOT (CASE WHEN isin IS NOT NULL AND h.isin IS NOT NULL THEN isin = h.isin WHEN bse IS NOT NULL AND h.bse IS NOT NULL THEN bse = h.bse ELSE name = h.name END) THEN 'another company'
  WHEN basis IS DISTINCT FROM h.basis THEN 'standalone and consolidated figures' WHEN fye <> h.fye THEN 'another fiscal year end' END AS reason FROM f)
SELECT * FROM r WHERE reason IS NOT NULL""")
def merge_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order of a customer against the customer's first: the same identifiers, basis and calendar."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.when(key % 3 == 0, F.col("o_orderpriority")).alias("isin"), F.when(key % 2 == 0, F.col("o_orderstatus")).alias("bse_code"), F.lit(None).cast("string").alias("nse_symbol"),
        (key % 4).cast("string").alias("name"), F.col("o_orderstatus").alias("basis"), (3 + key % 2).cast("int").alias("fye_month"),
    )
    return reconcile.compatible(rows, ("o_custkey",), ("o_orderkey",))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ',' || strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') || ',' || strftime(o_orderdate + INTERVAL 80 DAY, '%Y-%m-%d') AS dates FROM orders""")
def dates_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three forms of dates in one text, and one that no calendar has."""
    at = lambda days, form: F.date_format(F.date_add("o_orderdate", days), form)
    said = F.concat(F.lit("As of "), at(0, "d MMMM yyyy"), F.lit(", filed "), at(40, "MMM d, yyyy"), F.lit(" and not 31.02.2020 but "), at(80, "dd.MM.yyyy"), F.lit("."))
    found = table(spark, sf_dir, "orders").select("o_orderkey", printed.find_dates(said).alias("dates"))
    return found.select("o_orderkey", F.array_join(F.transform("dates", lambda d: d.cast("string")), ",").alias("dates"))


@query("""
WITH e AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS e FROM orders),
p AS (SELECT e, hint, n, CAST(date_trunc('month', e) - to_months(n - 1) AS DATE) AS s, CASE WHEN month(e) > 3 THEN year(e) + 1 ELSE year(e) END AS fy FROM e, (VALUES ('quarter', 3), ('half_year', 6), ('nine_months', 9), ('year', 12)) t(hint, n)),
o AS (SELECT *, (year(s) * 12 + month(s)) - ((fy - 1) * 12 + 4) AS off FROM p)
SELECT e::VARCHAR AS end_date, hint, CAST(CASE WHEN n = 3 AND off % 3 = 0 THEN 'Q' || (off // 3 + 1) WHEN n = 6 AND off % 6 = 0 THEN 'H' || (off // 6 + 1) WHEN n = 9 AND off = 0 THEN '9M' WHEN n = 12 AND off = 0 THEN '' END
  || 'FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') AS VARCHAR) AS label FROM o""")
def hinted_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period of each hinted length that ends with a month."""
    ends = table(spark, sf_dir, "orders").select(F.last_day("o_orderdate").alias("end_date")).distinct()
    rows = ends.select("end_date", F.explode(F.array(*map(F.lit, printed.HINT_MONTHS))).alias("hint")).withColumn("p", printed.period_ending(F.col("end_date"), F.col("hint"), F.lit(3)))
    return rows.select(F.col("end_date").cast("string").alias("end_date"), "hint", periods.label(F.col("p.kind"), F.col("p.fiscal_year"), F.col("p.part")).alias("label"))


@query("""
WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page FROM events),
f AS (SELECT user_id, page, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER w AS columns, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS scale FROM e WINDOW w AS (PARTITION BY user_id ORDER BY page ROWS UNBOUNDED PRECEDING))
SELECT user_id, CAST(page AS BIGINT) AS page, columns, scale, CASE WHEN columns IS NULL THEN 'no period columns found' WHEN scale IS NULL THEN 'currency unit not stated' END AS reason FROM f""")
def continued_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without columns or scale of their own take those before them; what has none to take is told."""
    kind = lambda name, to: F.when(F.col("event_type") == name, F.col("value")).alias(to)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pages = table(spark, sf_dir, "events").select("user_id", F.row_number().over(order).cast("long").alias("page"), kind("signup", "columns"), kind("view", "scale"))
    kept, issues = layout.continued(pages, ("user_id",))
    filled = pages.select("user_id", "page", *(layout.forward_fill(pages, ["user_id"], ["page"], c).alias(c) for c in ("columns", "scale")))
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(issues.join(filled, ["user_id", "page"]).select("user_id", "page", "columns", "scale", "reason"))


@query("""
SELECT user_id, string_agg(DISTINCT 'Some' || event_type, ',' ORDER BY 'Some' || event_type) AS elements FROM events WHERE event_type NOT IN ('view', 'click') AND value <> 0 GROUP BY user_id""")
def unmapped_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with a number that no line item takes: views are called dates, clicks an element that is taken."""
    name = F.when(F.col("event_type") == "view", "DateOfView").when(F.col("event_type") == "click", "RevenueFromOperations").otherwise(F.concat(F.lit("Some"), "event_type"))
    rows = table(spark, sf_dir, "events").select("user_id", name.alias("element"), F.col("value").cast("string").alias("text"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("dimensional"))
    return filings.unmapped(rows, ("user_id",)).select("user_id", F.array_join("elements", ",").alias("elements"))


@query("""
WITH f AS (SELECT CAST(o_custkey AS VARCHAR) AS document_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'trade_receivables' WHEN '2-HIGH' THEN 'auditor_opinion' ELSE 'no_such_item' END AS key, CASE WHEN o_orderstatus <> 'O' THEN 'year' END AS kind,
  CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CASE WHEN o_orderkey % 5 <> 0 THEN 1 END AS value, CASE WHEN o_orderkey % 7 = 0 THEN 'x' END AS text FROM orders),
r AS (SELECT *, CASE WHEN key = 'no_such_item' THEN 'unknown item' WHEN (value IS NULL) = (text IS NULL) THEN 'exactly one of value and text is needed' WHEN key = 'auditor_opinion' AND text IS NULL THEN 'text is needed'
  WHEN key <> 'auditor_opinion' AND value IS NULL THEN 'a number is needed' WHEN key = 'trade_receivables' AND kind IS NULL THEN 'a period is needed' WHEN key = 'auditor_opinion' AND kind IS NOT NULL THEN 'no period belongs here'
  WHEN count(*) OVER (PARTITION BY document_id, kind, fiscal_year, key) > 1 THEN 'repeated fact' END AS reason FROM f)
SELECT document_id, key, kind, fiscal_year, reason, CASE WHEN key = 'no_such_item' THEN 'warning' ELSE 'error' END AS level FROM r WHERE reason IS NOT NULL""")
def fact_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as facts: unknown items, wrong types, wrong scopes and repeats."""
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("document_id"), F.when(priority == "1-URGENT", "trade_receivables").when(priority == "2-HIGH", "auditor_opinion").otherwise("no_such_item").alias("key"),
        F.when(F.col("o_orderstatus") != "O", "year").alias("kind"), F.year("o_orderdate").alias("fiscal_year"), F.lit(None).cast("int").alias("part"),
        F.when(key % 5 != 0, F.lit(1)).cast(AMOUNT).alias("value"), F.when(key % 7 == 0, "x").alias("text"),
    )
    return facts.validate(rows)[1].drop("part")


DISPLAY_SQL = over_quarters(""", w AS (SELECT entity, seq_index, 'f:revenue_from_operations@Q' || part || 'FY' || lpad(CAST(fiscal_year % 100 AS VARCHAR), 2, '0') AS ref, CAST(revenue // 100 AS VARCHAR) AS t, lpad(CAST(revenue % 100 AS VARCHAR), 2, '0') AS c FROM quarters WHERE revenue > 0),
d AS (SELECT entity, seq_index, ref, '₹' || CASE WHEN length(t) <= 3 THEN t ELSE regexp_replace(reverse(regexp_replace(reverse(left(t, length(t) - 3)), '(..)', '\\1,', 'g')), '^,', '') || ',' || right(t, 3) END || '.' || c || ' cr' AS display FROM w)""")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of quarterly revenues, in crore."""
    q = quarters(spark, sf_dir).where("revenue > 0")
    rows = q.select(F.col("entity").alias("document_id"), F.lit("revenue_from_operations").alias("key"), "kind", "fiscal_year", "part", (F.col("revenue") / 100).cast("decimal(24,2)").cast(AMOUNT).alias("value"), F.lit(None).cast("string").alias("text"))
    metrics = spark.createDataFrame([], f"document_id int, metric string, period string, value {AMOUNT}, unit string")
    outcomes = spark.createDataFrame([], "document_id int, period string, evidence array<struct<name:string,value:string>>")
    return evidence.index(rows, metrics, outcomes)


@query(DISPLAY_SQL + " SELECT entity, ref, display FROM d")
def evidence_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as they are shown, by reference."""
    return _evidence(spark, sf_dir).select(F.col("document_id").alias("entity"), "ref", "display")


@query(DISPLAY_SQL + """, t AS (SELECT d.entity, seq_index, n, CASE WHEN seq_index % 2 = 0 THEN display ELSE replace(display, ' cr', ' crore') END AS figure, ref FROM d JOIN (SELECT entity, display, count(*) AS n FROM d GROUP BY ALL) USING (entity, display))
SELECT entity, seq_index, 'It sold ' || CASE WHEN n = 1 THEN '{{' || ref || '}}' ELSE figure END || ' of goods, {{m:x}} kept, 7.77% unknown.' AS linked FROM t""")
def figures_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revenue written out in prose gives way to the one reference that shows it; other figures and references stay."""
    shown = _evidence(spark, sf_dir)
    part, year = (F.regexp_extract("ref", r"@Q(\d)FY(\d+)$", n).cast("int") for n in (1, 2))
    seq = part - 1 + 4 * (year + F.when(year < 50, 2000).otherwise(1900))
    figure = F.when(seq % 2 == 0, F.col("display")).otherwise(F.replace("display", F.lit(" cr"), F.lit(" crore")))
    texts = shown.select("document_id", seq.alias("text_id"), F.concat(F.lit("It sold "), figure, F.lit(" of goods, {{m:x}} kept, 7.77% unknown.")).alias("text"))
    return evidence.linked(texts, shown).select(F.col("document_id").alias("entity"), F.col("text_id").alias("seq_index"), "linked")


@query("""
WITH l AS (SELECT p_partkey, 's' || p_size % 2 AS st, list_sort(list_distinct(list_filter([lower(p_type), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), CASE WHEN p_size % 3 = 0 THEN 'brand' END, CASE WHEN p_size % 5 = 0 THEN 'spare' END, CASE WHEN p_size % 15 = 0 THEN 'kept' END], lambda x: x IS NOT NULL))) AS w FROM part),
n AS (SELECT DISTINCT 's' || p_size % 2 AS st, p_type || ' ' || p_name AS name, list_sort(list_distinct([lower(p_type), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)])) AS v FROM part WHERE p_brand <> 'Brand#1'),
u AS (SELECT DISTINCT st, w FROM l),
s AS (SELECT u.st, w, name, v, CAST(len(list_intersect(w, v)) AS DOUBLE) / len(list_distinct(list_concat(w, v))) AS score, len(list_intersect(w, v)) = len(v) AS held FROM u JOIN n ON n.st = u.st),
b AS (SELECT *, row_number() OVER (PARTITION BY st, w ORDER BY score DESC, name) AS k FROM s WHERE score >= 0.8 OR (held AND score >= 0.5))
SELECT p_partkey, name AS key, round(score, 3) AS score FROM l JOIN b ON b.st = l.st AND b.w = l.w WHERE k = 1""")
def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's label, with qualifying words in some, against the names of the parts of its group."""
    part = table(spark, sf_dir, "part")
    group, size = F.concat(F.lit("s"), (F.col("p_size") % 2).cast("string")), F.col("p_size")
    label = F.concat_ws(" ", "p_type", "p_name", F.when(size % 3 == 0, "Brand"), F.when(size % 5 == 0, "spare"), F.when(size % 15 == 0, "kept (refer note 7)"))
    names = part.where("p_brand <> 'Brand#1'").select(group.alias("statement"), F.concat_ws(" ", "p_type", "p_name").alias("key")).distinct().select("statement", "key", F.col("key").alias("name"), F.lit(0).alias("rank"))
    found = labels.match(part.select(F.col("p_partkey").alias("label_id"), group.alias("statement"), label.alias("label")), names)
    return found.select(F.col("label_id").alias("p_partkey"), "key", "score")


@query("""
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type || CASE WHEN event_id % 3 = 0 THEN ' again' ELSE '' END AS text FROM events),
r(user_id, n, chunk, size) AS (
  SELECT user_id, n, 1, length(text) FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, CASE WHEN (r.size + 1 + length(e.text)) // 4 + 1 > 12 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN (r.size + 1 + length(e.text)) // 4 + 1 > 12 THEN length(e.text) ELSE r.size + 1 + length(e.text) END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(chunk AS INTEGER) AS chunk, CAST(min(n) AS BIGINT) AS first, CAST(count(*) AS INTEGER) AS n_lines, CAST(max(size) // 4 + 1 AS INTEGER) AS tokens, string_agg(text, chr(10) ORDER BY n) AS text
FROM r JOIN e USING (user_id, n) GROUP BY user_id, chunk""")
def packed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events, in order, packed into chunks by a table function that SQL calls by partition."""
    tables.register(spark)
    text = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, " again").otherwise(""))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    lines = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.row_number().over(order).cast("long").alias("n"), text.alias("text"))
    found = spark.sql("SELECT * FROM pack_lines(12, TABLE(SELECT key, n, text FROM {lines}) PARTITION BY key ORDER BY n)", lines=lines)
    return found.withColumnRenamed("key", "user_id")
