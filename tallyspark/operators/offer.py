"""Printed pages to facts: one plan that carries the pages of many documents from words with positions to facts and issues.

Given are ``pages`` (document_id, page, text) and ``words`` (document_id, page, text, x0, x1, top). Only pages of runs that carry a statement's
heading have their words read. A page is one row then, its lines and columns arrays: what is printed on a page bounds them, so lines, columns,
headers and cells are array expressions without a shuffle; rows of all pages are exploded once and from there on are windows by page (a table) and
groups by document. Statements of flows come before balances, as these take their periods from those; that order is a key, not a loop.

Defined cases: pages without words, and words of pages without a heading, are left out; null texts name nothing; documents without any statement
have an issue and no facts; repeated pages of a document are read as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods, printed
from ..functions.text import detect_scale, parse_amount
from ..functions.timeseries import AMOUNT
from . import labels, reconcile, statements
from .layout import COLUMN_GAP, COLUMN_WORDS, LINE_GAP, forward_fill
from .lineage import written

# Lines searched for values, for headers above them, for row labels in between and for cells that make columns; of a page's top; edges in points.
SEARCHED, HEADER, LABELS, BODY, TOP_LINES, TOP_TEXT = 80, 12, 4, 30, 15, 20
TIGHT, WIDE, FIRST_HEADER, HEADER_RIGHT, NOTE_RIGHT = 12, 30, 45, 12, 120
#: Statements in the order in which they are read.
ORDER = ("profit_and_loss", "cash_flow", "balance_sheet")
PAGE = ["document_id", "page"]
_WORD = "struct<x0:double,x1:double,top:double,text:string>"
_COLUMN = "struct<left:double,right:double,header:string>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last(array: Column) -> Column:
    return F.get(array, F.size(array) - 1)


def page_lines(words: DataFrame) -> DataFrame:
    """(document_id, page, lines): a line is what lies within 2.5 points of its first word's top, its words from left to right."""
    each = F.struct("top", F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), "text")
    pages = words.withColumn("top", F.col("top").cast("double")).groupBy(*PAGE).agg(F.array_sort(F.collect_list(each)).alias("w"))
    starts = lambda held, top: F.when(F.coalesce(top - _last(held) > LINE_GAP, F.lit(True)), F.concat(held, F.array(top))).otherwise(held)
    pages = pages.withColumn("_tops", F.aggregate(F.array_distinct(F.col("w")["top"]), F.array().cast("array<double>"), starts))

    def line(top: Column, i: Column) -> Column:
        own = F.filter("w", lambda x: (x["top"] >= top) & F.coalesce(x["top"] < F.get(F.col("_tops"), i + 1), F.lit(True)))
        return F.struct(top.alias("top"), F.array_sort(F.transform(own, lambda x: F.struct(x["x0"].alias("x0"), x["x1"].alias("x1"), x["top"].alias("top"), x["text"].alias("text")))).alias("words"))

    lines = F.transform(F.transform("_tops", line), lambda x: F.struct(x["top"].alias("top"), F.get(x["words"], F.lit(0))["x0"].alias("x0"), F.array_join(x["words"]["text"], " ").alias("text"), x["words"].alias("words")))
    return pages.select(*PAGE, lines.alias("lines"))


def _right_edges(words: Column) -> Column:
    """Columns of amounts: (right, width) of clusters of right edges, from left to right."""
    member = F.array_sort(F.transform(words, lambda w: F.struct(w["x1"].alias("x1"), (w["x1"] - w["x0"]).alias("width"))))
    none = F.array().cast("array<struct<edges:array<double>,width:double>>")

    def add(held: Column, w: Column) -> Column:
        alone = F.struct(F.array(w["x1"]).alias("edges"), w["width"].alias("width"))
        near = F.coalesce(w["x1"] - _last(_last(held)["edges"]) <= COLUMN_GAP, F.lit(False))
        joined = _let(_last(held), lambda g: F.struct(F.concat(g["edges"], F.array(w["x1"])).alias("edges"), F.greatest(g["width"], w["width"]).alias("width")))
        return F.when(near, F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(held, F.array(alone)))

    groups = F.filter(F.aggregate(member, none, add), lambda g: F.size(g["edges"]) >= COLUMN_WORDS)
    middle = lambda xs: (F.get(xs, F.floor((F.size(xs) - 1) / 2).cast("int")) + F.get(xs, F.floor(F.size(xs) / 2).cast("int"))) / 2
    return F.transform(groups, lambda g: F.struct(middle(g["edges"]).alias("right"), g["width"].alias("width")))


def with_columns(pages: DataFrame) -> DataFrame:
    """Adds `columns` (left, right, header, start_date, end_date, hint), null without any, and `start`, the first line of the table's body.

    A column is a cluster of amounts' right edges whose header, which reaches from the column before, holds a date; others are notes or stray numbers.
    """
    counts = F.transform(F.slice("lines", 1, SEARCHED), lambda x: printed.value_count(x["words"]["text"]) >= 2)
    pages = pages.withColumn("_first", (F.array_position(counts, True) - 1).cast("int"))
    first = F.col("_first")
    above = F.reverse(F.slice("lines", F.greatest(first - LABELS, F.lit(0)) + 1, F.greatest(F.least(first, F.lit(LABELS)), F.lit(0))))
    ends = F.array_position(F.transform(above, lambda x: printed.is_row_label(x["text"])), False).cast("int")
    pages = pages.withColumn("_start", first - F.when(ends > 0, ends - 1).otherwise(F.size(above)))
    body = F.flatten(F.transform(F.slice("lines", F.greatest(first, F.lit(0)) + 1, BODY), lambda x: x["words"]))
    head = F.flatten(F.transform(F.slice("lines", F.greatest(F.col("_start") - HEADER, F.lit(0)) + 1, F.greatest(F.least(F.col("_start"), F.lit(HEADER)), F.lit(0))), lambda x: x["words"]))
    by_top = F.array_sort(F.transform(head, lambda w: F.struct(w["top"].alias("top"), w["x0"].alias("x0"), w["x1"].alias("x1"), w["text"].alias("text"))))
    pages = pages.withColumn("_edges", _right_edges(F.filter(body, lambda w: printed.is_value(w["text"])))).withColumn("_head", by_top)

    def add(held: Column, edge: Column) -> Column:
        before, right, width = held["before"], edge["right"], edge["width"]
        left = F.when(before.isNull(), right - width - TIGHT).otherwise(F.greatest(before + 2, right - width - WIDE))
        reach = F.when(before.isNull(), right - width - FIRST_HEADER).otherwise(before + 2)
        over = F.filter("_head", lambda w: ((w["x0"] + w["x1"]) / 2 > reach) & ((w["x0"] + w["x1"]) / 2 <= right + HEADER_RIGHT))
        found = lambda text: F.struct(right.alias("before"), F.concat(held["columns"], F.array(F.struct(left.alias("left"), (right + COLUMN_GAP).alias("right"), text.alias("header")))).alias("columns"))
        return _let(F.array_join(over["text"], " "), lambda text: F.when(F.size(printed.find_dates(text)) > 0, found(text)).otherwise(held))

    none = F.struct(F.lit(None).cast("double").alias("before"), F.array().cast(f"array<{_COLUMN}>").alias("columns"))
    pages = pages.withColumn("_found", F.aggregate("_edges", none, add)["columns"])

    def dated(c: Column) -> Column:
        def of(dates: Column) -> Column:
            end, start = _last(dates), F.get(dates, F.lit(0))
            return F.struct(c["left"].alias("left"), c["right"].alias("right"), c["header"].alias("header"), F.when(start < end, start).alias("start_date"), end.alias("end_date"), printed.period_hint(c["header"]).alias("hint"))

        return _let(printed.find_dates(c["header"]), of)

    has = (first >= 0) & (F.size("_found") > 0)
    found = pages.withColumn("columns", F.when(has, F.transform("_found", dated))).withColumn("start", F.when(has, F.col("_start")).otherwise(0))
    return found.drop("_first", "_start", "_edges", "_head", "_found")


def table_rows(pages: DataFrame) -> DataFrame:
    """(document_id, page, line, x0, label, note, values) of each line of the body: fragments of a number are joined by column, note references set apart.

    `values` has, for each column, the printed amount or null.
    """
    limit = F.get(F.col("columns"), F.lit(0))["left"] + 2

    def cells(line: Column, i: Column) -> Column:
        place = lambda w: F.array_position(F.transform("columns", lambda c: (c["left"] < w["x1"]) & (w["x1"] <= c["right"])), True)
        placed = F.transform(line["words"], lambda w: F.struct(w["text"].alias("text"), w["x0"].alias("x0"), w["x1"].alias("x1"), F.when(w["text"].rlike(printed.FRAGMENT), place(w)).otherwise(0).alias("column")))

        def of(placed: Column) -> Column:
            free = F.filter(placed, lambda w: (w["column"] == 0) & (w["x1"] <= limit))
            is_note = lambda w, k: (k > 0) & w["text"].rlike(printed.NOTE) & (w["x0"] > line["x0"] + NOTE_RIGHT)
            notes = F.filter(free, is_note)
            words = F.filter(free, lambda w, k: ~is_note(w, k))
            raw = F.transform(F.col("columns"), lambda c, k: F.array_join(F.filter(placed, lambda w: w["column"] == k + 1)["text"], ""))
            return F.struct(i.alias("line"), line["x0"].alias("x0"), F.array_join(words["text"], " ").alias("label"), _last(notes)["text"].alias("note"), raw.alias("raw"), line["text"].alias("whole"))

        return _let(placed, of)

    body = F.slice("lines", F.col("start") + 1, F.greatest(F.size("lines") - F.col("start"), F.lit(0)))
    rows = pages.select(*PAGE, F.explode(F.transform(body, cells)).alias("r")).select(*PAGE, "r.*")
    so_far = Window.partitionBy(*PAGE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_over", F.max(F.col("whole").rlike(statements.FOOTER)).over(so_far)).where("not _over")
    rows = rows.where((F.col("label") != "") | F.exists("raw", lambda r: r != ""))
    return rows.select(*PAGE, F.col("line").cast("long").alias("line"), "x0", "label", "note", F.transform("raw", lambda r: F.when(parse_amount(r).isNotNull(), r)).alias("values"))


def statement_pages(pages: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, issues) of all runs: lines, columns and scale, taken from the page before in the run where a page has none of its own."""
    texts = pages.groupBy(*PAGE).agg(F.min("text").alias("text"))
    runs = statements.runs(texts)
    each = runs.select("document_id", "statement", "first_page", "title", "consolidated", "restated", F.explode(F.sequence("first_page", "last_page")).alias("page"))
    each = written(each, "offer-runs")
    found = written(with_columns(page_lines(words.join(each.select(*PAGE), PAGE, "left_semi"))), "offer-pages").join(each, PAGE).join(texts, PAGE)
    run = ["document_id", "statement", "first_page"]
    found = found.withColumn("own_columns", F.col("columns").isNotNull()).withColumn("columns", forward_fill(found, run, ["page"], "columns"))
    no_columns = found.where("columns is null").select("document_id", "statement", "first_page", "page", F.lit("warning").alias("level"), F.lit("no period columns found").alias("reason"))
    kept = found.where("columns is not null")
    top = F.concat(F.transform(F.slice("lines", 1, TOP_LINES), lambda x: x["text"]), F.coalesce(F.slice(F.split("text", r"\r?\n"), 1, TOP_TEXT), F.array().cast("array<string>")))
    kept = kept.withColumn("scale", detect_scale(F.array_join(top, "\n")))
    kept = kept.withColumn("scale", forward_fill(kept, run, ["page"], "scale"))
    no_scale = kept.where("scale is null").select("document_id", "statement", "first_page", "page", F.lit("error").alias("level"), F.lit("currency unit not stated").alias("reason"))
    return kept, no_columns.unionByName(no_scale)


def _period_columns(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns with periods, fiscal year ends): the month in which most columns of a year end, March without any."""
    each = pages.select("document_id", F.col("page").alias("table"), "statement", "scale", F.posexplode("columns").alias("column", "c")).select("*", "c.start_date", "c.end_date", "c.hint").drop("c")
    yearly = (F.col("statement") != "balance_sheet") & (F.col("hint") == "year")
    ends = each.groupBy("document_id").agg(printed.modal_month(F.when(yearly, F.col("end_date"))).alias("fye_month"))
    with_end = each.join(ends, "document_id")
    return statements.column_periods(with_end, F.col("fye_month")), ends


def _reconciled(amounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(amounts, issues) after the identities of the income statement: rows of a period side by side, corrected, and long again."""
    keys = ("total_income", "total_expenses", "finance_costs", "depreciation_amortisation", "exceptional_items", "profit_before_exceptional_items", "profit_before_tax", "total_tax_expense", "current_tax", "deferred_tax", "profit_after_tax")
    by = ["document_id", "period"]
    wide = amounts.groupBy(*by).agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys))
    fixed = reconcile.profit_and_loss(wide)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("fixed")) for k in keys)))
    changed = fixed.where(F.size("issues") > 0).select(*by, each.alias("c")).select(*by, "c.*").where("fixed is not null")
    out = amounts.join(changed, [*by, "key"], "left").withColumn("value", F.coalesce("fixed", "value")).drop("fixed")
    return out, fixed.select("document_id", "period", F.explode("issues").alias("reason"))


def read(pages: DataFrame, words: DataFrame, names: DataFrame, items: DataFrame, consolidated: bool = True) -> dict[str, DataFrame]:
    """What the pages say.

    facts: (document_id, key, kind, fiscal_year, part, value, page, title, raw_label, method); issues: (document_id, level, ref, reason); unmapped:
    (document_id, statement, page, label); documents: (document_id, fye_month, consolidated, restated). names: (statement, key, name, rank); items: (key, unit, sum_rows).
    """
    every, issues = statement_pages(pages, words)
    every = written(every, "offer-statements")
    rows = table_rows(every).withColumnRenamed("page", "table")
    rows = statements.merge_wrapped(rows).join(every.select("document_id", F.col("page").alias("table"), "statement", "first_page", "own_columns"), list(statements.TABLE))
    rows = written(rows, "offer-rows")
    # A run is as full as its first page's table, read by its own columns.
    first = rows.where((F.col("table") == F.col("first_page")) & F.col("own_columns") & statements.has_values())
    told = labels.match(first.select(F.struct("document_id", "table", "line").alias("label_id"), "statement", "label"), names)
    mapped = told.groupBy("label_id.document_id", F.col("label_id.table").alias("first_page")).agg(F.count("*").alias("mapped"))
    runs = every.select("document_id", "statement", "first_page", "title", "consolidated", "restated").distinct().join(mapped, ["document_id", "first_page"])
    chosen = statements.best_runs(runs, consolidated).select("document_id", "statement", "first_page")
    chosen = written(chosen, "offer-chosen")
    kept = written(every.join(chosen, ["document_id", "statement", "first_page"]).where("scale is not null").drop("lines"), "offer-kept")
    columns, ends = _period_columns(kept)
    columns = written(columns, "offer-columns")

    rows = rows.drop("own_columns").join(kept.select("document_id", F.col("page").alias("table")), list(statements.TABLE))
    rows = written(statements.matched(statements.with_sections(rows), names), "offer-matched")
    rows = written(statements.with_parents(rows), "offer-mapped")
    parts = statements.contributions(rows, columns.select(*statements.TABLE, "column", "period", "scale"), items)
    place = kept.select("document_id", F.col("page").alias("table"), "statement", "title", "text")
    parts = written(parts.join(place.drop("text"), list(statements.TABLE)), "offer-parts")
    by = [*statements.TABLE, "statement", "title", "key", "period"]
    amounts = statements.item_amounts(parts, tuple(by)).join(_used_labels(parts, by), by)
    faces = columns.where("statement = 'profit_and_loss' and period is not null").select(*statements.TABLE, "period").distinct()
    faces = faces.join(place.where("statement = 'profit_and_loss'"), list(statements.TABLE)).withColumn("value", printed.face_value(F.col("text"))).where("value is not null")
    faces = faces.select(*by[:4], F.lit("face_value_per_share").alias("key"), "period", "value", F.array().cast("array<string>").alias("ignored"), F.lit("face value").alias("raw_label"))
    both = amounts.withColumn("method", F.lit("table")).unionByName(faces.withColumn("method", F.lit("text")).select(*amounts.columns, "method"))
    turn = F.struct(F.array_position(F.array(*map(F.lit, ORDER)), F.col("statement")).alias("turn"), "table", F.col("method").alias("method"))
    supplied = Window.partitionBy("document_id", "key", "period").orderBy(turn)
    amounts = written(both.withColumn("_n", F.row_number().over(supplied)).where("_n = 1").drop("_n"), "offer-amounts")

    fixed, corrected = _reconciled(amounts)
    label = periods.label(F.col("period.kind"), F.col("period.fiscal_year"), F.col("period.part"))
    facts = fixed.select("document_id", "key", "period.*", F.col("value").cast(AMOUNT).alias("value"), F.col("table").alias("page"), "title", "raw_label", "method")
    several = amounts.where(F.size("ignored") > 0).select("document_id", F.lit("warning").alias("level"), F.concat(F.lit("f:"), "key", F.lit("@"), label).alias("ref"), F.concat(F.lit("several rows map to this item; kept '"), "raw_label", F.lit("', ignored '"), F.array_join("ignored", "; "), F.lit("'")).alias("reason"))
    # Only pages of the chosen runs have issues.
    none = F.lit(None).cast("string")
    missing = issues.join(chosen, ["document_id", "statement", "first_page"], "left_semi").select("document_id", "level", none.alias("ref"), F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(": "), "reason").alias("reason"))
    known = pages.select("document_id").distinct()
    have = kept.groupBy("document_id").agg(F.collect_set("statement").alias("have"))
    absent = known.join(have, "document_id", "left")
    lacking = absent.where("have is not null").select("document_id", F.explode(F.array_except(F.array(*map(F.lit, ORDER)), "have")).alias("s")).select("document_id", F.lit("warning").alias("level"), none.alias("ref"), F.concat("s", F.lit(" not found")).alias("reason"))
    bare = absent.where("have is null").select("document_id", F.lit("error").alias("level"), none.alias("ref"), F.lit("no primary financial statements found").alias("reason"))
    corrected = corrected.select("document_id", F.lit("info").alias("level"), label.alias("ref"), "reason")
    documents = kept.groupBy("document_id").agg(F.max("consolidated").alias("consolidated"), F.max("restated").alias("restated")).join(ends, "document_id")
    attribution = F.col("label").rlike(statements.OWNERS) | F.col("label").rlike(statements.OTHERS)
    unmapped = rows.where(F.col("key").isNull() & ~attribution).select("document_id", "statement", F.col("table").alias("page"), "label")
    return {"facts": facts, "issues": missing.unionByName(lacking).unionByName(bare).unionByName(several).unionByName(corrected), "unmapped": unmapped, "documents": documents}


def _used_labels(parts: DataFrame, by: list[str]) -> DataFrame:
    """The labels of the rows that make an amount: all that are summed, or the first direct one."""
    line = F.struct("line", "value", "label")
    direct = F.array_sort(F.collect_list(F.when(~F.col("from_parent"), line)))
    every = F.array_sort(F.collect_list(line))
    found = parts.groupBy(*by).agg(direct.alias("_direct"), every.alias("_every"), F.max("sum_rows").alias("_adds"))
    used = F.when(F.size("_direct") == 0, F.col("_every")).when(F.col("_adds"), F.col("_direct")).otherwise(F.slice("_direct", 1, 1))
    return found.select(*by, F.array_join(F.transform(used, lambda u: u["label"]), " + ").alias("raw_label"))


def cover(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, issues) of the first two pages: type, company and registration number; what a cover doesn't tell is an error."""
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    head = Window.partitionBy("document_id").orderBy("page")
    texts = pages.withColumn("_n", F.dense_rank().over(head)).where("_n <= 2").groupBy("document_id").agg(first.alias("cover"))
    found = texts.select("document_id", printed.document_type(F.col("cover")).alias("doc_type"), printed.company_name(F.col("cover")).alias("company"), printed.registration_number(F.col("cover")).alias("cin"))
    told = F.array(
        F.when(F.col("doc_type").isNull(), F.struct(F.lit("error").alias("level"), F.lit("the cover names no red herring prospectus").alias("reason"))),
        F.when(F.col("company").isNull(), F.struct(F.lit("error").alias("level"), F.lit("the cover names no company").alias("reason"))),
        F.when(F.col("cin").isNotNull(), F.struct(F.lit("info").alias("level"), F.concat(F.lit("corporate identity number "), "cin").alias("reason"))),
    )
    return found, found.select("document_id", F.explode(F.filter(told, lambda t: t.isNotNull())).alias("t")).select("document_id", "t.*")
