"""Facts: schema, validation, and the grid of periods that everything else is computed on.

Facts are long: (document_id, key, kind, fiscal_year, part, value, text); the period is null for
items of document scope. The grid is wide: one row for each document and period, with a column
for each item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog.items import DOCUMENT, ITEMS, PERIOD, STOCK, TEXT, items_frame
from ..functions import periods
from ..functions.timeseries import AMOUNT

FACTS = "document_id string, key string, kind string, fiscal_year int, part int, value decimal(24,12), text string"
DOCUMENTS = "document_id string, company string, sector string, doc_type string, fye_month int"
#: Years before the first observed one that the grid reaches back, for nested look-backs.
REACH = 4
PERIOD_KEYS = ["document_id", "kind", "fiscal_year", "part"]


def validate(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept facts, issues): unknown keys are a warning; wrong types, wrong scopes and repeated facts are errors.

    Of facts that repeat a key and period none is kept.
    """
    known = F.broadcast(items_frame(facts.sparkSession)).withColumn("known", F.lit(True))
    rows = facts.join(known, "key", "left")
    is_text = F.col("unit") == TEXT
    reason = (
        F.when(F.col("known").isNull(), "unknown item")
        .when(F.col("value").isNull() == F.col("text").isNull(), "exactly one of value and text is needed")
        .when(is_text & F.col("text").isNull(), "text is needed")
        .when(~is_text & F.col("value").isNull(), "a number is needed")
        .when((F.col("scope") == PERIOD) & F.col("kind").isNull(), "a period is needed")
        .when((F.col("scope") == DOCUMENT) & F.col("kind").isNotNull(), "no period belongs here")
    )
    again = F.count("*").over(Window.partitionBy(*PERIOD_KEYS, "key"))
    rows = rows.withColumn("reason", F.coalesce(reason, F.when(again > 1, "repeated fact")))
    issues = rows.where("reason is not null").select("document_id", "key", "kind", "fiscal_year", "part", "reason", F.when(F.col("known").isNull(), "warning").otherwise("error").alias("level"))
    return rows.where("reason is null").select(facts.columns), issues


def with_calendar(df: DataFrame) -> DataFrame:
    """Adds start, end, days and the sequence number of each row's period."""
    args = [F.col(c) for c in ("kind", "fiscal_year", "part", "fye_month")]
    df = df.withColumn("start_date", periods.start_date(*args)).withColumn("end_date", periods.end_date(*args))
    return df.withColumn("days", periods.days(F.col("start_date"), F.col("end_date"))).withColumn("seq_index", periods.seq_index(*args[:3]))


def spine(observed: DataFrame) -> DataFrame:
    """Every period of each kind that a document reports, from REACH years before its first to its last; years too."""
    span = observed.groupBy("document_id").agg(F.min("fiscal_year").alias("low"), F.max("fiscal_year").alias("high"), F.array_union(F.collect_set("kind"), F.array(F.lit(periods.YEAR))).alias("kinds"))
    parts = F.when(F.col("kind") == periods.QUARTER, F.array(*map(F.lit, (1, 2, 3, 4)))).when(F.col("kind") == periods.HALF, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(None).cast("int")))
    rows = span.select("document_id", F.explode("kinds").alias("kind"), "low", "high").withColumn("parts", parts)
    rows = rows.select("document_id", "kind", "parts", F.explode(F.sequence(F.col("low") - REACH, F.col("high"))).alias("fiscal_year"))
    return rows.select("document_id", "kind", "fiscal_year", F.explode("parts").alias("part"))


def _same_period(a: DataFrame, b: DataFrame) -> Column:
    return (a["document_id"] == b["document_id"]) & (a["kind"] == b["kind"]) & (a["fiscal_year"] == b["fiscal_year"]) & a["part"].eqNullSafe(b["part"])


def grid(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """The wide grid: spine, calendar, `observed`, `is_anchor`, every item as a column, and `nil_items`, those read as nil.

    A balance is found under any label with the same end date, of the longest period that has it.
    An item that is nil if absent is zero where its statement was reported: flows under that label,
    balances at that end date.
    """
    by_scope = {s: [i for i in ITEMS.values() if i.scope == s] for s in (PERIOD, DOCUMENT)}
    flows = [i.key for i in by_scope[PERIOD] if i.nature != STOCK]
    stocks = [i.key for i in by_scope[PERIOD] if i.nature == STOCK]
    statements = sorted({i.statement for i in by_scope[PERIOD] if i.nil_if_absent})
    dated = with_calendar(facts.where("kind is not null").join(documents.select("document_id", "fye_month"), "document_id"))
    statement = F.create_map(*(F.lit(x) for i in ITEMS.values() for x in (i.key, i.statement)))[F.col("key")]
    pick = lambda k: F.when(F.col("key") == k, F.col("value"))
    by_label = dated.groupBy(*PERIOD_KEYS).agg(F.lit(True).alias("observed"), *(F.max(pick(k)).alias(k) for k in flows), *(F.max(statement == s).alias(f"_label_{s}") for s in statements))
    by_date = dated.groupBy("document_id", "end_date").agg(*(F.max_by(pick(k), F.when(F.col("key") == k, F.col("days"))).alias(k) for k in stocks), *(F.max(statement == s).alias(f"_date_{s}") for s in statements))
    of_document = facts.where("kind is null").groupBy("document_id").agg(
        *(F.max(F.when(F.col("key") == i.key, F.col("text" if i.unit == TEXT else "value"))).alias(i.key) for i in by_scope[DOCUMENT])
    )
    rows = with_calendar(spine(by_label.select(*PERIOD_KEYS)).join(documents, "document_id"))
    rows = rows.alias("r").join(by_label.alias("l"), _same_period(rows, by_label), "left").select("r.*", F.coalesce("l.observed", F.lit(False)).alias("observed"), *(f"l.{c}" for c in by_label.columns[5:]))
    rows = rows.join(by_date, ["document_id", "end_date"], "left").join(of_document, "document_id", "left")
    nil, read_as_nil = {}, {}
    for i in by_scope[PERIOD]:
        reported = F.col(f"_{'date' if i.nature == STOCK else 'label'}_{i.statement}") if i.nil_if_absent else None
        if reported is not None:
            nil[i.key] = F.coalesce(F.col(i.key), F.when(reported, F.lit(0).cast(AMOUNT)))
            read_as_nil[i.key] = F.coalesce(reported, F.lit(False))
    absent = F.array(*(F.when(F.col(k).isNull() & filled, F.lit(k)) for k, filled in read_as_nil.items()))
    rows = rows.withColumn("nil_items", F.filter(absent, lambda k: k.isNotNull())).withColumns(nil).drop(*(f"_{x}_{s}" for x in ("label", "date") for s in statements))
    return rows.withColumn("is_anchor", anchor())


def anchor() -> Column:
    """Whether the row is its document's anchor: the full year if it ends last, else the shortest period that ends last."""
    order = Window.partitionBy("document_id").orderBy(F.desc("observed"), F.desc("end_date"), F.desc(F.col("kind") == periods.YEAR), F.asc("days"), F.asc("kind"))
    return (F.row_number().over(order) == 1) & F.col("observed")


def size_bucket(revenue: Column, days: Column) -> Column:
    """small, mid or large by yearly revenue in crore."""
    yearly = F.try_divide(revenue * 365, days)
    return F.when(yearly < 500, "small").when(yearly < 5000, "mid").when(yearly.isNotNull(), "large")
