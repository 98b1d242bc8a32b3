"""Fiscal periods as columns: kind, fiscal year, part, and the calendar they stand for.

A period is a year, a half year, a quarter or the first nine months of a fiscal year that ends
with month `fye` (3: March). Labels read FY25, H1FY25, Q3FY25, 9MFY25, in any case and spacing,
with two digits of the year or 20yy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR, HALF, QUARTER, NINE_MONTHS = "year", "half_year", "quarter", "nine_months"
MONTHS = {YEAR: 12, HALF: 6, QUARTER: 3, NINE_MONTHS: 9}
LABEL = r"^\s*(?:(Q\s*[1-4])|(H\s*[12])|(9\s*M))?\s*FY\s*(?:20)?(\d{2})\s*$"


def _month_count(kind: Column) -> Column:
    found = F.when(kind == YEAR, 12)
    for k in (HALF, QUARTER, NINE_MONTHS):
        found = found.when(kind == k, MONTHS[k])
    return found


def _offset(kind: Column, part: Column) -> Column:
    """Months between the fiscal year's first day and the period's."""
    return F.when(kind.isin(QUARTER, HALF), (part - 1) * _month_count(kind)).when(kind.isNotNull(), 0).cast("int")


def start_date(kind: Column, fiscal_year: Column, part: Column, fye: Column) -> Column:
    return F.add_months(F.make_date(fiscal_year, fye, F.lit(1)), F.lit(-11) + _offset(kind, part))


def end_date(kind: Column, fiscal_year: Column, part: Column, fye: Column) -> Column:
    return F.date_sub(F.add_months(start_date(kind, fiscal_year, part, fye), _month_count(kind)), 1)


def days(start: Column, end: Column) -> Column:
    """Days of the period, both ends included."""
    return F.datediff(end, start) + 1


def seq_index(kind: Column, fiscal_year: Column, part: Column) -> Column:
    """Numbers that are consecutive for consecutive periods of one kind."""
    return F.when(kind == QUARTER, fiscal_year * 4 + part - 1).when(kind == HALF, fiscal_year * 2 + part - 1).otherwise(fiscal_year).cast("int")


def label(kind: Column, fiscal_year: Column, part: Column) -> Column:
    year = F.concat(F.lit("FY"), F.lpad((fiscal_year % 100).cast("string"), 2, "0"))
    head = F.when(kind == QUARTER, F.concat(F.lit("Q"), part.cast("string"))).when(kind == HALF, F.concat(F.lit("H"), part.cast("string"))).when(kind == NINE_MONTHS, F.lit("9M")).otherwise(F.lit(""))
    return F.when(kind.isNotNull(), F.concat(head, year))


def parse(text: Column) -> Column:
    """struct(kind, fiscal_year, part) of a label; null where it is none."""
    text = F.upper(text)
    group = lambda n: F.regexp_extract(text, LABEL, n)
    year = F.try_to_number(group(4), F.lit("99")).cast("int") + 2000
    digit = lambda n: F.regexp_extract(group(n), r"([1-4])", 1).cast("int")
    kind = F.when(group(1) != "", QUARTER).when(group(2) != "", HALF).when(group(3) != "", NINE_MONTHS).otherwise(YEAR)
    part = F.when(group(1) != "", F.nullif(F.regexp_extract(group(1), "([1-4])", 1), F.lit("")).try_cast("int")).when(group(2) != "", F.nullif(F.regexp_extract(group(2), "([12])", 1), F.lit("")).try_cast("int"))
    return F.when(text.rlike(LABEL), F.struct(kind.alias("kind"), year.alias("fiscal_year"), part.alias("part")))


def from_dates(start: Column, end: Column, fye: Column) -> Column:
    """struct(kind, fiscal_year, part) of a whole quarter, half, nine months or year of the fiscal calendar; else null."""
    fiscal_year = F.year(end) + F.when(F.month(end) > fye, 1).otherwise(0)
    first = F.add_months(F.make_date(fiscal_year, fye, F.lit(1)), -11)
    length, offset = F.months_between(F.date_add(end, 1), start), F.months_between(start, first)
    whole = (F.dayofmonth(start) == 1) & (F.dayofmonth(F.date_add(end, 1)) == 1) & (start <= end)
    quarter, half = whole & (length == 3) & (offset % 3 == 0), whole & (length == 6) & (offset % 6 == 0)
    kind = F.when(quarter, QUARTER).when(half, HALF).when(whole & (length == 9) & (offset == 0), NINE_MONTHS).when(whole & (length == 12) & (offset == 0), YEAR)
    part = F.when(quarter, (offset / 3).cast("int") + 1).when(half, (offset / 6).cast("int") + 1)
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), fiscal_year.cast("int").alias("fiscal_year"), part.alias("part")))


def fiscal_quarter(date: Column, fye: int = 3) -> Column:
    """Consecutive number of the fiscal quarter of a date: fiscal year * 4 + quarter - 1."""
    months = F.year(date) * 12 + F.month(date) - 1 + (12 - fye)
    return F.floor(months / 3).cast("int")
