"""Tables from words with positions: lines, columns, rows, runs of pages, as windows and range joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in points: words of a line, edges of a column, words that make a column.
LINE_GAP, COLUMN_GAP, COLUMN_WORDS = 2.5, 6.0, 3


def islands(df: DataFrame, group: list[str], at: str) -> DataFrame:
    """Adds `island`: runs of consecutive integers of `at` in each group share one."""
    order = Window.partitionBy(*group).orderBy(at)
    return df.withColumn("island", F.col(at) - F.row_number().over(order))


def clusters(df: DataFrame, group: list[str], at: str, gap: float = COLUMN_GAP, least: int = COLUMN_WORDS) -> DataFrame:
    """(group, cluster, low, high, n): values no further apart than `gap`, of `least` members or more."""
    order = Window.partitionBy(*group).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(order) > gap).cast("int"), F.lit(0))
    numbered = df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy(*group, "cluster").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least)


def lines(words: DataFrame, group: tuple[str, ...] = ("page",)) -> DataFrame:
    """words (`group`, text, x0, x1, top) with `line`: a line is what lies within 2.5 points of its first word's top.

    The comparison is with the line's first word, a fold in order, so each page's words (a page is bounded by what is
    printed on it) are walked in pandas. Words of several documents take the group ("document_id", "page").
    """
    kinds = words.schema

    def number(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["top", "x0"], ignore_index=True)
        line, first, found = -1, None, []
        for top in page["top"]:
            if first is None or top - first > LINE_GAP:
                line, first = line + 1, top
            found.append(line)
        return page.assign(line=found)

    return words.groupBy(*group).applyInPandas(number, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", line long")


def assign_columns(words: DataFrame, columns: DataFrame, group: tuple[str, ...] = ("page",)) -> DataFrame:
    """Each word's column: the first with left < x1 <= right on its page.

    The columns' edges cut a page's line into slots: slot n reaches from edge n - 1 up to and with edge n, and inside one the first column is the same for
    all words. A column covers at most two blocks of slots of each power of two, and a slot lies in one of each, so slots meet columns by
    equality of blocks: rows grow with the edges times their logarithm, never with words times columns. A word takes the slot of the
    next edge of its page.
    """
    by = list(group)
    top_power = lambda n: (F.length(F.bin(n)) - 1).cast("int")
    inside = columns.where(F.col("left") < F.col("right")).select(*by, F.col("left").alias("_left"), F.col("right").alias("_right"), F.col("column").alias("_column")).dropna(subset=by)
    numbered = inside.select(*by, F.explode(F.array("_left", "_right")).alias("_x")).distinct().withColumn("_slot", F.row_number().over(Window.partitionBy(*by).orderBy("_x")).cast("long"))

    low, high = (numbered.select(*by, F.col("_x").alias(edge), F.col("_slot").alias(f"{edge}_slot")) for edge in ("_left", "_right"))
    held = inside.join(low, [*by, "_left"]).join(high, [*by, "_right"]).groupBy(*by, (F.col("_left_slot") + 1).alias("_first"), (F.col("_right_slot") + 1).alias("_end")).agg(F.min("_column").alias("_column"))
    each = held.select(*by, "_first", "_end", "_column", F.explode(F.sequence(F.lit(0), top_power(F.col("_end") - F.col("_first")))).alias("_power"))
    size = F.expr("shiftleft(1L, _power)")
    each = each.select(*by, "_column", "_power", F.floor((F.col("_first") + size - 1) / size).alias("_l"), F.floor(F.col("_end") / size).alias("_r")).where("_l < _r")
    ends = F.array(F.when(F.col("_l") % 2 == 1, F.col("_l")), F.when(F.col("_r") % 2 == 1, F.col("_r") - 1))
    blocks = each.select(*by, "_column", "_power", F.explode(ends).alias("_block")).where("_block is not null").groupBy(*by, "_power", "_block").agg(F.min("_column").alias("_column"))
    # Slots count from 1 and the first lies in no column, so no block 0 is asked for.
    asked = numbered.select(*by, "_slot", F.explode(F.sequence(F.lit(0), top_power(F.col("_slot")))).alias("_power")).withColumn("_block", F.expr("shiftright(_slot, _power)"))
    first = asked.join(blocks, [*by, "_power", "_block"]).groupBy(*by, "_slot").agg(F.min("_column").alias("_column"))

    given = words.select(*by, F.col("x1").alias("_x"), F.struct(*(F.col(c) for c in words.columns)).alias("_word"))
    rows = given.withColumn("_slot", F.lit(None).cast("long")).unionByName(numbered.withColumn("_word", F.lit(None).cast(given.schema["_word"].dataType)))
    # From the right, the least slot so far is that of the next edge.
    rows = rows.withColumn("_slot", F.min("_slot").over(Window.partitionBy(*by).orderBy(F.desc_nulls_first("_x")).rangeBetween(Window.unboundedPreceding, Window.currentRow))).where("_word is not null")
    return rows.join(first, [*by, "_slot"], "left").select("_word.*", F.col("_column").alias("column"))


def find_columns(words: DataFrame, values: Column, group: tuple[str, ...] = ("page",)) -> DataFrame:
    """(`group`, column, left, right, header): columns of values and the header words whose middle lies above them.

    words: (`group`, text, x0, x1, top); values: which of them are values. A column is a cluster of the values' right edges; its header reaches
    from the column before it to a little beyond its own edge. Header words meet columns in a join on the interval.
    """
    rows = words.withColumn("_is_value", values)
    valued = rows.where("_is_value")
    edges = clusters(valued.select(*group, "x1"), list(group), "x1")
    met = valued.alias("v").join(edges.alias("e"), (F.col("x1") >= F.col("low")) & (F.col("x1") <= F.col("high")) & _same(group, "v", "e"))
    sized = met.groupBy(*(F.col(f"e.{c}").alias(c) for c in group), F.col("low").alias("_low")).agg(F.median("x1").alias("right"), F.max(F.col("x1") - F.col("x0")).alias("width"), F.min("top").alias("_top"))
    order = Window.partitionBy(*group).orderBy("right")
    before = F.lag("right").over(order)
    sized = sized.select(
        *group, F.row_number().over(order).alias("column"), F.when(before.isNull(), F.col("right") - F.col("width") - 12).otherwise(F.greatest(before + 2, F.col("right") - F.col("width") - 30)).alias("left"),
        F.when(before.isNull(), F.col("right") - F.col("width") - 45).otherwise(before + 2).alias("_from"), "right", F.min("_top").over(Window.partitionBy(*group)).alias("_top"),
    )
    middle = (F.col("x0") + F.col("x1")) / 2
    above = sized.alias("c").join(rows.where("not _is_value").alias("w"), (middle > F.col("c._from")) & (middle <= F.col("c.right") + 12) & (F.col("w.top") < F.col("c._top")) & _same(group, "c", "w"), "left")
    text = F.array_join(F.array_sort(F.collect_list(F.struct("w.top", "w.x0", "w.text")))["text"], " ")
    return above.groupBy(*(F.col(f"c.{c}").alias(c) for c in group), "column", "left", "right").agg(text.alias("header"))


def _same(group: tuple[str, ...], a: str, b: str) -> Column:
    held = F.lit(True)
    for c in group:
        held = held & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return held


def continued(pages: DataFrame, run: tuple[str, ...] = ("document_id", "statement"), page: str = "page", taken: tuple[str, ...] = ("columns", "scale")) -> tuple[DataFrame, DataFrame]:
    """(pages, issues): a page without columns or scale of its own takes those of the page before it in its run; one that has none to take is an issue."""
    filled = pages.withColumns({c: forward_fill(pages, list(run), [page], c) for c in taken})
    lacks = F.when(F.col(taken[0]).isNull(), "no period columns found").when(F.col(taken[1]).isNull(), "currency unit not stated")
    return filled.where(lacks.isNull()), filled.where(lacks.isNotNull()).select(*run, page, lacks.alias("reason"))


def forward_fill(df: DataFrame, group: list[str], order: list[str], value: str) -> Column:
    """The last known value up to the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def rows_of(words: DataFrame, group: tuple[str, ...] = ("page",)) -> DataFrame:
    """(`group`, line, text): the words of each line from left to right."""
    ordered = F.array_sort(F.collect_list(F.struct("x0", "text")))
    return lines(words, group).groupBy(*group, "line").agg(F.array_join(ordered["text"], " ").alias("text"))
