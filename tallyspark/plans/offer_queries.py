"""Queries of printed pages over the benchmark tables: each supplier's deliveries are printed as a statement, word by word, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import group_indian
from ..functions.timeseries import AMOUNT
from ..operators import offer
from ..operators.lineage import written
from .base import cents, query, table

LABELS = ("Alpha revenue", "Beta revenue", "Gamma revenue", "Delta revenue", "Epsilon revenue", "Zeta revenue", "Eta revenue")
TITLE = "Restated Consolidated Statement of Profit and Loss"
#: Right edges of the columns, and points of a letter.
EDGES, LETTER = (300, 400, 500), 5


def printed_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pages, words) of a statement for each supplier: a row for each line number, a column for each third year; five rows, then two on a page without header."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("document_id"), F.col("l_linenumber").cast("int").alias("n"), (F.year("l_shipdate") % 3).alias("c"), cents(F.col("l_extendedprice")).alias("cents"))
    # Written, so that lines are read once: all that is printed comes from their sums.
    sums = written(lines.groupBy("document_id", "n", "c").agg(F.sum("cents").alias("cents")), "printed-sums")
    every = sums.select("document_id").distinct().select("document_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("n")).select("document_id", "n", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c"))
    cells = every.join(sums, ["document_id", "n", "c"], "left")
    shown = group_indian((F.col("cents") / 100).cast(AMOUNT))
    shown = F.when(F.coalesce("cents", F.lit(0)) == 0, "-").when(F.col("n") == 3, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
    right, top = F.element_at(F.array(*map(F.lit, EDGES)), F.col("c") + 1).cast("double"), F.col("n") * 12.0 + 60
    page = F.when(F.col("n") > 5, 2).otherwise(1)
    cells = cells.select("document_id", page.alias("page"), "n", shown.alias("t"), right.alias("right"), top.alias("top")).withColumn("x0", F.col("right") - LETTER * F.length("t"))
    # In every second row a number's first digit is a word of its own, as spaced digits are.
    splits = (F.col("n") % 2 == 0) & (F.length("t") > 6)
    word = lambda text, x0, x1, top: F.struct(text.alias("text"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), top.cast("double").alias("top"))
    whole = word(F.col("t"), F.col("x0"), F.col("right"), F.col("top"))
    parts = F.array(word(F.substring("t", 1, 1), F.col("x0"), F.col("x0") + LETTER, F.col("top") + 1.5), word(F.expr("substring(t, 2)"), F.col("x0") + LETTER, F.col("right"), F.col("top")))
    numbers = cells.select("document_id", "page", F.explode(F.when(splits, parts).otherwise(F.array(whole))).alias("w"))
    documents = every.select("document_id").distinct()

    def text_words(text: str, x: float, top: float) -> list:
        out = []
        for t in text.split():
            out.append(word(F.lit(t), F.lit(x), F.lit(x + LETTER * len(t)), F.lit(top)))
            x += LETTER * (len(t) + 1)
        return out

    first = [*text_words(TITLE, 50, 10), *text_words("(Amounts in ₹ million)", 50, 22)]
    for right, year in zip(EDGES, (2025, 2024, 2023)):
        first += [*text_words("For the year", right - 60, 34), *text_words("ended March", right - 60, 44), *text_words(f"31, {year}", right - 60, 54)]
    for n, label in enumerate(LABELS[:5], 1):
        first += text_words(label, 50, n * 12 + 60)
    second = text_words(f"{TITLE} (continued)", 50, 10)
    for n, label in enumerate(LABELS[5:], 6):
        second += text_words(label, 50, n * 12 + 60)
    said = [documents.select("document_id", F.lit(p).alias("page"), F.explode(F.array(*w)).alias("w")) for p, w in ((1, first), (2, second))]
    words = numbers.unionByName(said[0]).unionByName(said[1]).select("document_id", "page", "w.*")
    texts = F.array(F.struct(F.lit(1).alias("page"), F.lit(f"{TITLE}\n(Amounts in ₹ million)").alias("text")), F.struct(F.lit(2).alias("page"), F.lit(f"{TITLE} (continued)").alias("text")))
    return documents.select("document_id", F.explode(texts).alias("p")).select("document_id", "p.*"), words


@query(f"""
WITH s AS (SELECT l_suppkey, l_linenumber AS n, year(CAST(l_shipdate AS DATE)) % 3 AS c, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY ALL),
e AS (SELECT DISTINCT l_suppkey, t.n, u.c FROM lineitem, unnest(range(1, 8)) t(n), unnest(range(0, 3)) u(c))
SELECT CAST(e.l_suppkey AS VARCHAR) AS document_id, 'item_' || e.n AS key, 'year' AS kind, CAST(2025 - e.c AS INTEGER) AS fiscal_year, CAST(coalesce(CASE WHEN e.n = 3 THEN -cents ELSE cents END, 0) / 1000.0 AS DOUBLE) AS value,
  CASE WHEN e.n > 5 THEN 2 ELSE 1 END AS page, '{TITLE}' AS title, list_extract({list(LABELS)!r}, e.n) AS raw_label
FROM e LEFT JOIN s ON s.l_suppkey = e.l_suppkey AND s.n = e.n AND s.c = e.c""")
def pages_to_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers' pages in one plan: lines, columns, header dates, joined fragments, signs, units, the page without header."""
    pages, words = printed_pages(spark, sf_dir)
    names = spark.createDataFrame([("profit_and_loss", f"item_{n}", label, n) for n, label in enumerate(LABELS, 1)], "statement string, key string, name string, rank int")
    items = spark.createDataFrame([(f"item_{n}", "inr_crore", False) for n in range(1, 8)], "key string, unit string, sum_rows boolean")
    found = offer.read(pages, words, names, items)["facts"]
    return found.select("document_id", "key", "kind", "fiscal_year", F.col("value").cast("double").alias("value"), "page", "title", "raw_label")
