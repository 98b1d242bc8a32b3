"""Calendar-addressed functions over a grid of periods, as window columns.

A grid has one row for each entity and period with the columns `entity`, `kind`, `part`, `fiscal_year`
and `seq_index`. Frames are ranges of years or of consecutive periods, never rows: where a
period is absent the answer is null, not the next row that happens to be there.

Windows don't nest: an argument is a column of the grid or arithmetic over such columns.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from . import periods

#: Amounts are exact decimals; after every operation they return to this scale.
AMOUNT = "decimal(24,12)"


def amount(x) -> Column:
    """A column or number as an exact amount; what doesn't fit is null."""
    x = x if isinstance(x, Column) else F.lit(str(x))
    return x.try_cast(AMOUNT)


class Grid:
    """The window functions of one grid. `entity`: the columns that name a series."""

    def __init__(self, entity: tuple[str, ...] = ("document_id",)):
        self.entity = entity

    @property
    def by_year(self) -> WindowSpec:
        return Window.partitionBy(*self.entity, "kind", "part").orderBy("fiscal_year")

    @property
    def by_period(self) -> WindowSpec:
        return Window.partitionBy(*self.entity, "kind").orderBy("seq_index")

    def _at(self, x: Column, window, back: int) -> Column:
        return F.max(x).over(window.rangeBetween(-back, -back))

    def prior(self, x: Column) -> Column:
        """The same period one fiscal year earlier."""
        return self._at(x, self.by_year, 1)

    def seq(self, x: Column) -> Column:
        """The period of the same length just before; for years and nine months the year before."""
        return self._at(x, self.by_period, 1)

    def opening(self, x: Column) -> Column:
        """As `seq`, but nine months open where the full year before closed."""
        years = Window.partitionBy(*self.entity).orderBy("fiscal_year").rangeBetween(-1, -1)
        return F.when(F.col("kind") == periods.NINE_MONTHS, F.max(F.when(F.col("kind") == periods.YEAR, x)).over(years)).otherwise(self.seq(x))

    def growth(self, x: Column) -> Column:
        """Change on the prior year against the prior's size; null on a base of zero."""
        return self._change(x, self.prior(x))

    def seq_growth(self, x: Column) -> Column:
        return self._change(x, self.seq(x))

    @staticmethod
    def _change(x: Column, before: Column) -> Column:
        return divide(x - before, F.abs(before))

    def avg(self, x: Column) -> Column:
        """Mean of opening and closing balance; the closing alone where there is no opening."""
        return F.coalesce(divide(self.opening(x) + x, F.lit(2)), x)

    def ttm(self, x: Column) -> Column:
        """A year's own value, or the sum of four consecutive quarters; null for other kinds."""
        four = self.by_period.rangeBetween(-3, 0)
        quarters = F.when(F.count(x).over(four) == 4, F.sum(x).over(four))
        return F.when(F.col("kind") == periods.YEAR, x).when(F.col("kind") == periods.QUARTER, quarters)

    def trailing_sum(self, x: Column, n: int) -> Column:
        """Sum over this and the n - 1 years before; null unless all are there."""
        frame = self.by_year.rangeBetween(-(n - 1), 0)
        return F.when(F.count(x).over(frame) == n, F.sum(x).over(frame))

    def streak(self, condition: Column, n: int) -> Column:
        """Whether the condition held in n consecutive periods: one false decides, else one unknown leaves it unknown."""
        frame = self.by_period.rangeBetween(-(n - 1), 0)
        return F.when(~F.min(condition).over(frame), False).when(F.count(condition).over(frame) == n, True)

    def history(self, x: Column) -> Column:
        """Array of the earlier observed values of the same kind, by end date."""
        earlier = Window.partitionBy(*self.entity, "kind").orderBy("end_date").rowsBetween(Window.unboundedPreceding, -1)
        return F.collect_list(F.when(F.col("observed"), x)).over(earlier)


def divide(a: Column, b: Column) -> Column:
    """a / b; null where b is zero."""
    return F.try_divide(a, b)


def rel_diff(a: Column, b: Column) -> Column:
    """|a - b| over the larger of |a| and |b|; 0 where both are 0."""
    most = F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(most == 0, F.lit(0)).otherwise(divide(F.abs(a - b), most)))


def strict_least(*xs: Column) -> Column:
    """The least argument, null if any is: unlike ``least``, which skips nulls."""
    return _strict(F.least, xs)


def strict_greatest(*xs: Column) -> Column:
    return _strict(F.greatest, xs)


def _strict(f, xs) -> Column:
    known = F.lit(True)
    for x in xs:
        known = known & x.isNotNull()
    return F.when(known, f(*xs))


def chain(*steps: Column, operands: tuple[Column, ...]) -> Column:
    """All comparisons of a chain; unknown if any operand is, even where an earlier comparison is false."""
    known = F.lit(True)
    for x in operands:
        known = known & x.isNotNull()
    held = steps[0]
    for s in steps[1:]:
        held = held & s
    return F.when(known, held)
