"""Queries of printed statements' operators over the benchmark tables: a user's events stand for a table's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import statements
from .base import query, table


@query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line,
  CASE event_type WHEN 'signup' THEN 'Sign' WHEN 'view' THEN 'of views' WHEN 'error' THEN '' ELSE event_type END AS label, event_type NOT IN ('signup', 'view') AS has FROM events),
w AS (SELECT *, event_typed AND line > 1 AS wraps FROM (SELECT *, label = 'of views' AS event_typed FROM e)),
f AS (SELECT *, coalesce(last_value(CASE WHEN NOT wraps THEN has END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS filled FROM w),
j AS (SELECT *, sum(CASE WHEN wraps OR has AND label = '' AND NOT filled THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS row FROM f)
SELECT user_id, CAST(row AS BIGINT) AS row, CAST(min(line) AS BIGINT) AS line, coalesce(string_agg(CASE WHEN label <> '' THEN label END, ' ' ORDER BY line), '') AS label, bool_or(has) AS has FROM j GROUP BY user_id, row""")
def wrapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_type", "value", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line")
    label = F.when(kind == "signup", "Sign").when(kind == "view", "of views").when(kind == "error", "").otherwise(kind)
    values = F.array(F.when(~kind.isin("signup", "view"), F.col("value").cast("string")))
    rows = e.select("user_id", F.col("line").cast("long").alias("line"), F.col("value").alias("x0"), label.alias("label"), values.alias("values"))
    # 'click' and 'purchase' are lower case but hold values, so only bare lines go on with others.
    return statements.merge_wrapped(rows, ("user_id",)).select("user_id", "row", "line", "label", statements.has_values().alias("has"))


@query("""
WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events),
b AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS block FROM e),
h AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN value END) OVER (PARTITION BY user_id, block) AS x FROM b),
o AS (SELECT *, bool_or(event_type <> 'signup' AND value <= x + 1) OVER (PARTITION BY user_id, block ORDER BY line ROWS UNBOUNDED PRECEDING) AS ended FROM h)
SELECT user_id, line, coalesce(NOT ended, false) AS from_parent, CASE WHEN coalesce(NOT ended, false) THEN 'signup' ELSE event_type END AS key FROM o WHERE event_type <> 'signup'""")
def header_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_type", "value", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line")
    values = F.array(F.when(F.col("event_type") != "signup", F.col("value").cast("string")))
    rows = e.select(F.col("user_id").alias("document_id"), F.lit(1).alias("table"), F.col("line").cast("long").alias("line"), F.col("value").alias("x0"), F.col("event_type").alias("label"), values.alias("values"), F.lit("cash_flow").alias("statement"))
    known = statements.with_sections(rows).withColumns({"key": F.col("label"), "score": F.lit(1.0)})
    return statements.with_parents(known).select(F.col("document_id").alias("user_id"), "line", "from_parent", "key")


@query("""
SELECT l_orderkey, CAST(CASE WHEN count(*) FILTER (l_returnflag <> 'N') = 0 THEN sum(l_quantity) WHEN l_orderkey % 5 = 0 THEN sum(l_quantity) FILTER (l_returnflag <> 'N')
  ELSE arg_min(l_quantity, l_linenumber * 1000 + l_quantity) FILTER (l_returnflag <> 'N') END AS DOUBLE) AS value FROM lineitem GROUP BY l_orderkey""")
def direct_or_summed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("double").alias("value"), F.lit("").alias("label"), (F.col("l_returnflag") == "N").alias("from_parent"), (F.col("l_orderkey") % 5 == 0).alias("sum_rows"))
    return statements.item_amounts(parts, ("l_orderkey",)).select("l_orderkey", "value")
