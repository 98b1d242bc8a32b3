"""Printed statements: runs of pages, rows with wrapped labels, headers with their sub-rows, amounts by item and period.

Rows are (document_id, table, line, x0, label, values): `values` holds a printed amount or null for each column. All
steps are windows over the lines of one table, which a printed statement bounds, or joins on document and table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods, printed
from ..functions.text import parse_amount
from . import labels
from .layout import islands

# Headings of statements, what may stand before and behind them, sections, owners, footers.
BEFORE = r"(?i)^(?:annexure\s+[ivx\d]+\s*[-–:]\s*)?(?:(?:restated|audited|unaudited|consolidated|standalone)\s+)*"
BEHIND = r"\s*(?:\(continued\)|\(contd\.?\)|as\s+(?:at|on)\s[^,]{0,40}|for\s+the\s[^,]{0,50})?\s*$"
HEADINGS = {
    "balance_sheet": r"(?:balance\s+sheet|statement\s+of\s+assets\s+and\s+liabilities)",
    "profit_and_loss": r"(?:statement\s+of\s+profit\s+(?:and|or)\s+loss|profit\s+and\s+loss\s+account)(?:\s*\(including\s+other\s+comprehensive\s+income\))?",
    "cash_flow": r"(?:cash\s+flow\s+statement|statement\s+of\s+cash\s+flows?)",
}
LONGEST_HEADING = 140
SECTION = r"(?i)\b(?:non[\s-]*current|current)\s+(?:assets|liabilities)\b|^(?:equity|liabilities|assets)\b|\b(?:operating|investing|financing)\s+activities\b"
OWNERS = r"(?i)^(?:owners|equity\s+holders|shareholders)\s+of\b"
OTHERS = r"(?i)^non[\s-]*controlling\s+interests?\b"
FOOTER = r"(?i)^(?:the above (?:statement|annexure)|as per our report|for and on behalf|in terms of our report)"
ENUMERATED = r"^\(?(?:[ivxlc]+|[a-z])\)\s"
OWNERS_KEY = "profit_attributable_to_owners"
LEAST_ROWS = 5
TABLE = ("document_id", "table")


def runs(pages: DataFrame) -> DataFrame:
    """(document_id, statement, first_page, last_page, title, consolidated, restated) of consecutive pages that carry a heading.

    pages: (document_id, page, text). A page belongs to the first statement of `HEADINGS` that a line of it names.
    """
    found = F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))

    def title(heading: str) -> Column:
        return F.get(F.filter("lines", lambda x: (F.length(x) <= LONGEST_HEADING) & x.rlike(BEFORE + heading + BEHIND)), F.lit(0))

    titles = [title(h) for h in HEADINGS.values()]
    named = F.coalesce(*(F.when(t.isNotNull(), F.struct(F.lit(s).alias("statement"), t.alias("title"))) for s, t in zip(HEADINGS, titles)))
    headed = pages.withColumn("lines", found).withColumn("_n", named).where("_n is not null").select("document_id", "page", "_n.*")
    run = islands(headed, ["document_id", "statement"], "page").groupBy("document_id", "statement", "island")
    run = run.agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min_by("title", "page").alias("title")).drop("island")
    return run.select("*", F.col("title").rlike(r"(?i)\bconsolidated\b").alias("consolidated"), F.col("title").rlike(r"(?i)\brestated\b").alias("restated"))


def best_runs(found: DataFrame, consolidated: bool = True) -> DataFrame:
    """The fullest run of each statement: most `mapped` rows (five at least), then the wished basis, then restated, then the first."""
    rank = F.struct("mapped", (F.col("consolidated") == consolidated).alias("basis"), "restated", (-F.col("first_page")).alias("early"))
    best = found.where(F.col("mapped") >= LEAST_ROWS).groupBy("document_id", "statement").agg(F.max_by(F.struct(*(c for c in found.columns if c not in ("document_id", "statement"))), rank).alias("_best"))
    return best.select("document_id", "statement", "_best.*")


def has_values(values: str = "values") -> Column:
    return F.exists(values, lambda v: v.isNotNull())


def continues(label: Column) -> Column:
    """A line that goes on with the label before it: lower case, an opening bracket aside, and no enumerator."""
    return ~label.rlike(ENUMERATED) & label.rlike(r"^\(*\p{Ll}")


def body(rows: DataFrame) -> DataFrame:
    """`rows` before the table's footer, without lines that have neither label nor values."""
    so_far = Window.partitionBy(*TABLE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_over", F.max(F.col("label").rlike(FOOTER)).over(so_far)).where((F.col("label") != "") | has_values()).where("not _over").drop("_over")


def merge_wrapped(rows: DataFrame, group: tuple[str, ...] = TABLE, line: str = "line") -> DataFrame:
    """One row for each printed row: labels that run over several lines are joined, values printed under a bare label join it.

    Whether values fill the row above depends on the last line that did not go on with another, so two windows number the rows.
    """
    order = Window.partitionBy(*group).orderBy(line)
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_has", has_values()).withColumn("_wraps", ~F.col("_has") & continues(F.col("label")) & (F.row_number().over(order) > 1))
    filled = F.coalesce(F.last(F.when(~F.col("_wraps"), F.col("_has")), ignorenulls=True).over(above), F.lit(True))
    rows = rows.withColumn("_joins", F.col("_wraps") | F.col("_has") & (F.col("label") == "") & ~filled)
    rows = rows.withColumn("row", F.count_if(~F.col("_joins")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.filter(F.array_sort(F.collect_list(F.struct(line, "label")))["label"], lambda x: x != "")
    return rows.groupBy(*group, "row").agg(F.min(line).alias(line), F.min_by("x0", line).alias("x0"), F.array_join(words, " ").alias("label"), F.max_by("values", "_has").alias("values"))


def with_sections(rows: DataFrame) -> DataFrame:
    """Adds `header`, the last label without values, `section`, the last of those that names one, and `block`, the header's number."""
    so_far = Window.partitionBy(*TABLE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    bare = ~has_values() & (F.col("label") != "")
    last = lambda when: F.last(F.when(when, F.col("label")), ignorenulls=True).over(so_far)
    return rows.select("*", last(bare).alias("header"), last(bare & F.col("label").rlike(SECTION)).alias("section"), F.count_if(bare).over(so_far).alias("block"))


def matched(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds `key` and `score` of each row's item: the label alone or with its section's current / noncurrent, whichever fits better.

    rows: with `statement` and `section`; names as `labels.match` takes them.
    """
    kinds = labels.word_set(F.lit("current noncurrent"))
    own, qualifiers = labels.word_set(F.col("label")), F.array_intersect(labels.word_set(F.coalesce("section", F.lit(""))), kinds)
    qualify = (F.size(qualifiers) > 0) & ~F.arrays_overlap(own, kinds) & ~F.array_contains(own, "total")
    texts = F.when(qualify, F.array(F.concat_ws(" ", "label", F.array_join(qualifiers, " ")), F.col("label"))).otherwise(F.array("label"))
    # Filings print the same labels over and over: each is read and matched once, under its section.
    printed_ = {"_statement": F.col("statement"), "_label": F.col("label"), "_section": F.coalesce("section", F.lit(""))}
    own_texts = rows.select("statement", "label", printed_["_section"].alias("section")).distinct()
    each = own_texts.select(*(c.alias(k) for k, c in printed_.items()), F.posexplode(texts).alias("turn", "text"))
    each = each.select(F.struct(*printed_, "turn").alias("label_id"), F.col("_statement").alias("statement"), F.col("text").alias("label"))
    found = labels.match(each, names)
    best = found.groupBy(*(f"label_id.{k}" for k in printed_)).agg(F.max_by(F.struct("key", "score"), F.struct((F.col("score") == 1).alias("exact"), "score", (-F.col("label_id.turn")).alias("early"))).alias("_m"))
    return rows.withColumns(printed_).join(best, list(printed_), "left").select(*rows.columns, "_m.key", "_m.score")


def with_parents(rows: DataFrame) -> DataFrame:
    """Rows with values and the item they count to: `key`, and whether it is their header's (`from_parent`).

    Rows under a header that is an item by name, until one is printed no further in than it, are its parts. Lines that attribute profit to
    owners count only under a profit header of the income statement; other attributions never. Rows without item keep a null key.
    """
    so_far = Window.partitionBy(*TABLE, "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = lambda c: F.first(F.when(~F.col("_has"), F.col(c))).over(so_far)
    rows = rows.withColumn("_has", has_values()).where("label <> ''").withColumns({"_key": head("key"), "_score": head("score"), "_x0": head("x0")})
    ended = F.max((F.col("x0") <= F.col("_x0") + 1) & F.col("_has")).over(so_far)
    rows = rows.withColumn("from_parent", F.coalesce((F.col("_score") == 1) & ~ended, F.lit(False))).where("_has")
    owners, others = F.col("label").rlike(OWNERS), F.col("label").rlike(OTHERS)
    profit = (F.col("statement") == "profit_and_loss") & F.coalesce(F.col("header").rlike("(?i)profit") & ~F.col("header").rlike("(?i)comprehensive"), F.lit(False))
    key = F.when(owners & profit, OWNERS_KEY).when(owners | others, None).when(F.col("from_parent"), F.col("_key")).otherwise(F.col("key"))
    return rows.withColumn("key", key).withColumn("from_parent", F.col("from_parent") & ~owners & ~others).drop("_has", "_key", "_score", "_x0")


def contributions(rows: DataFrame, columns: DataFrame, items: DataFrame) -> DataFrame:
    """(document_id, table, line, key, period, label, value, from_parent, sum_rows) of each printed amount of money.

    columns: (document_id, table, column, period, scale); items: (key, unit, sum_rows). Crores are scaled as the table says.
    """
    each = rows.where("key is not null").select(*TABLE, "line", "label", "key", "from_parent", F.posexplode("values").alias("column", "printed"))
    each = each.where("printed is not null").join(columns.where("period is not null"), [*TABLE, "column"]).join(items.where(F.col("unit").isin("inr_crore", "inr")), "key")
    amount = parse_amount(F.col("printed"))
    scaled = F.when(F.col("unit") == "inr_crore", amount * F.col("scale")).otherwise(amount)
    return each.select(*TABLE, "line", "key", "period", "label", scaled.alias("value"), "from_parent", "sum_rows").where("value is not null")


def item_amounts(parts: DataFrame, group: tuple[str, ...] = ("document_id", "key", "period"), line: str = "line") -> DataFrame:
    """One amount for each group: the first direct row's; the sum of direct rows where the item adds up rows; without any, the sum of sub-rows.

    ignored: labels of direct rows that say something else. Of rows on one line the smallest value comes first.
    """
    direct = ~F.col("from_parent")
    first, own = F.min_by("value", F.when(direct, F.struct(line, "value"))), F.count_if(direct)
    told = F.array_sort(F.collect_list(F.when(direct, F.struct(line, "label", "value"))))
    found = parts.groupBy(*group).agg(own.alias("_own"), F.max("sum_rows").alias("_adds"), first.alias("_first"), F.sum(F.when(direct, F.col("value"))).alias("_direct"), F.sum("value").alias("_all"), told.alias("_told"))
    other = F.filter("_told", lambda t: t["value"] != F.col("_first"))["label"]
    value = F.when(F.col("_own") == 0, F.col("_all")).when(F.col("_adds"), F.col("_direct")).otherwise(F.col("_first"))
    return found.select(*group, value.alias("value"), F.when((F.col("_own") > 0) & ~F.col("_adds"), other).otherwise(F.array().cast("array<string>")).alias("ignored"))


def column_periods(columns: DataFrame, fye: Column) -> DataFrame:
    """`columns` with `period`: (kind, fiscal_year, part) of what each column of printed values covers; null where nothing tells.

    columns: (document_id, statement, start_date, end_date, hint, ...). A stated start decides, then the hint; balance sheets and columns without
    a hint take the longest period that another statement has to their date, else the year where their month closes one. So the statements of
    flows are read first and balance sheets then.
    """
    is_balance = F.col("statement") == "balance_sheet"
    stated = F.when(~is_balance & F.col("start_date").isNotNull(), periods.from_dates(F.col("start_date"), F.col("end_date"), fye))
    hinted = F.when(~is_balance, printed.period_ending(F.col("end_date"), F.col("hint"), fye))
    rows = columns.withColumn("_own", F.coalesce(stated, hinted))
    kind, year, part = (F.col("_own")[c] for c in ("kind", "fiscal_year", "part"))
    own = rows.where("_own is not null").select("document_id", "end_date", periods.start_date(kind, year, part, fye).alias("start_date"), F.col("_own").alias("period"))
    known = own.groupBy("document_id", "end_date").agg(F.max_by("period", F.datediff("end_date", "start_date")).alias("_known"))
    year = F.when(F.month("end_date") == fye, printed.period_ending(F.col("end_date"), F.lit("year"), fye))
    return rows.join(known, ["document_id", "end_date"], "left").withColumn("period", F.coalesce("_own", "_known", year)).select(*columns.columns, "period")
