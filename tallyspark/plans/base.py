"""The benchmark tables as facts: nations are the reporting entities, fiscal quarters their periods.

Amounts are whole cents, so sums are exact in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x):
    return F.round(x * 100).cast("long")


def with_periods(df: DataFrame) -> DataFrame:
    fq = F.col("seq_index")
    return df.withColumn("kind", F.lit(periods.QUARTER)).withColumn("fiscal_year", F.floor(fq / 4).cast("int")).withColumn("part", (fq % 4 + 1).cast("int"))


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, seq_index, kind, fiscal_year, part, revenue, tax, receivables, returned) by nation and fiscal quarter."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", periods.fiscal_quarter(F.col("o_orderdate")).alias("seq_index"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity"))
    placed = orders.join(customers, "o_custkey")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(cents(net)).alias("revenue"), F.sum(cents(net * F.col("l_tax"))).alias("tax"), F.sum(F.when(F.col("l_returnflag") == "R", cents(F.col("l_extendedprice"))).otherwise(0)).alias("returned")
    )
    each = placed.join(lines, "o_orderkey", "left")
    found = each.groupBy("entity", "seq_index").agg(
        F.sum(F.coalesce("revenue", F.lit(0))).alias("revenue"), F.sum(F.coalesce("tax", F.lit(0))).alias("tax"),
        F.sum(F.when(F.col("o_orderstatus") == "O", cents(F.col("o_totalprice"))).otherwise(0)).alias("receivables"), F.sum(F.coalesce("returned", F.lit(0))).alias("returned"),
    )
    return with_periods(found)


QUARTERS = """
placed AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice, c_nationkey AS entity, CAST((year(o_orderdate) * 12 + month(o_orderdate) + 8) // 3 AS INTEGER) AS seq_index
  FROM orders JOIN customer ON c_custkey = o_custkey),
lines AS (
  SELECT l_orderkey AS o_orderkey,
    CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS revenue,
    CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * l_tax * 100) AS BIGINT)) AS BIGINT) AS tax,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS returned
  FROM lineitem GROUP BY l_orderkey),
quarters AS (
  SELECT entity, seq_index, seq_index // 4 AS fiscal_year, CAST(seq_index % 4 + 1 AS INTEGER) AS part,
    CAST(sum(coalesce(revenue, 0)) AS BIGINT) AS revenue, CAST(sum(coalesce(tax, 0)) AS BIGINT) AS tax,
    CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS receivables, CAST(sum(coalesce(returned, 0)) AS BIGINT) AS returned
  FROM placed LEFT JOIN lines USING (o_orderkey) GROUP BY entity, seq_index)"""


def over_quarters(body: str) -> str:
    """SQL over the quarters table."""
    return f"WITH {QUARTERS.strip()}{body}"


def rounded(x, digits: int = 6):
    return F.round(x.cast("double"), digits)
