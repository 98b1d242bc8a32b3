"""Where a value comes from: formulas evaluated with columns that carry what they read beside their value.

A `Traced` is a value and, as arrays of strings, what it lacks (`missing`), the facts and metrics read (`inputs`) and remarks (`notes`). The
catalog's formulas are functions of `Terms`; given `TracedTerms` they yield traced columns, level by level as metrics do, so a metric's arrays
hold all below it. A fact is ``f:key@period``, a metric ``m:key@period``. Arithmetic and comparisons lack what any operand lacks; of alternatives
only where none is there; an average of balances goes without its opening one, with a note. A known side of "and" or "or" has read
what it needs, so what lacks is the same set whatever the order.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog.items import DOCUMENT, ITEMS
from ..catalog.metrics import METRICS, Terms
from . import periods, timeseries
from .timeseries import Grid

NONE = "array<string>"


def none() -> Column:
    return F.array().cast(NONE)


def union(parts: list[Column]) -> Column:
    """The parts' entries in their order, each once."""
    return F.array_distinct(F.concat(*parts)) if parts else none()


def said(when: Column, text: Column) -> Column:
    return F.when(when, F.array(text)).otherwise(none())


def at(key: str, period: Column, mark: str = "f") -> Column:
    return F.concat(F.lit(f"{mark}:{key}@"), period)


class Traced:
    """`text`: the formula, as reasons name it; the arrays are lists of columns, put together at the end."""

    def __init__(self, value: Column, text: str, missing=(), inputs=(), notes=()):
        self.value, self.text = value, text
        self.missing, self.inputs, self.notes = list(missing), list(inputs), list(notes)

    def _with(self, value: Column, text: str, *others, missing=()) -> Traced:
        traced = [self, *(o for o in others if isinstance(o, Traced))]
        return Traced(value, text, [*(c for t in traced for c in t.missing), *missing], [c for t in traced for c in t.inputs], [c for t in traced for c in t.notes])

    def _two(self, other, f, sign: str, swap: bool = False) -> Traced:
        b, text = (other.value, other.text) if isinstance(other, Traced) else (other, str(other))
        value, shown = (f(b, self.value), f"{text} {sign} {self.text}") if swap else (f(self.value, b), f"{self.text} {sign} {text}")
        return self._with(value, shown, other)

    def __neg__(self) -> Traced:
        return self._with(-self.value, f"-{self.text}")

    def __invert__(self) -> Traced:
        return self._with(~self.value, f"not {self.text}")

    def isin(self, *values) -> Traced:
        return self._with(self.value.isin(*values), self.text)

    __hash__ = None


def _operators() -> None:
    for name, sign in (("add", "+"), ("sub", "-"), ("mul", "*"), ("truediv", "/"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("eq", "=="), ("ne", "!="), ("and_", "and"), ("or_", "or")):
        f = getattr(operator, name)
        setattr(Traced, f"__{name.strip('_')}__", lambda self, other, f=f, sign=sign: self._two(other, f, sign))
        if name in ("add", "sub", "mul", "and_", "or_"):
            setattr(Traced, f"__r{name.strip('_')}__", lambda self, other, f=f, sign=sign: self._two(other, f, sign, True))


_operators()


def label() -> Column:
    return periods.label(F.col("kind"), F.col("fiscal_year"), F.col("part"))


class TracedGrid:
    """The functions of `Grid` over traced columns: what a value lacks in another period is read in that period's row."""

    def __init__(self, grid: Grid):
        self.grid = grid

    def _moved(self, x: Traced, name: str, move) -> Traced:
        arrays = [[move(union(c))] if c else [] for c in (x.missing, x.inputs, x.notes)]
        # Where the grid has no such row nothing is known of it.
        arrays = [[F.coalesce(c, none()) for c in part] for part in arrays]
        return Traced(move(x.value), f"{name}({x.text})", *arrays)

    def prior(self, x: Traced) -> Traced:
        return self._moved(x, "prior", self.grid.prior)

    def seq(self, x: Traced) -> Traced:
        return self._moved(x, "seq", self.grid.seq)

    def _change(self, x: Traced, before: Traced, value: Column) -> Traced:
        undefined = said((before.value == 0) & x.value.isNotNull(), F.concat(F.lit(f"change undefined: {x.text} was 0 before "), label()))
        return x._with(value, f"growth({x.text})", before, missing=[undefined])

    def growth(self, x: Traced) -> Traced:
        return self._change(x, self.prior(x), self.grid.growth(x.value))

    def seq_growth(self, x: Traced) -> Traced:
        return self._change(x, self.seq(x), self.grid.seq_growth(x.value))

    def avg(self, x: Traced) -> Traced:
        opening = self.grid.opening(x.value)
        remark = said(opening.isNull() & x.value.isNotNull(), F.concat(F.lit(f"{x.text}: no opening balance before "), label(), F.lit(", closing balance used")))
        moved = self._moved(x, "opening", self.grid.opening)
        read = [F.when(opening.isNotNull(), c).otherwise(none()) for c in moved.inputs]
        told = [F.when(opening.isNotNull(), c).otherwise(none()) for c in moved.notes]
        return Traced(self.grid.avg(x.value), f"avg({x.text})", x.missing, [*x.inputs, *read], [*x.notes, *told, remark])

    def _over(self, x: Traced, value: Column, name: str, move, n: int) -> Traced:
        return x._with(value, f"{name}({x.text})", *(self._moved(x, name, move(k)) for k in range(1, n)))

    def trailing_sum(self, x: Traced, n: int) -> Traced:
        years = lambda k: lambda c: self.grid._at(c, self.grid.by_year, k)
        return self._over(x, self.grid.trailing_sum(x.value, n), "trailing_sum", years, n)

    def streak(self, x: Traced, n: int) -> Traced:
        before = lambda k: lambda c: self.grid._at(c, self.grid.by_period, k)
        return self._over(x, self.grid.streak(x.value, n), "streak", before, n)


class TracedTerms(Terms):
    """The grid's columns by name, traced. The grid needs `nil_items` and, for the metrics read, ``missing_``, ``inputs_`` and ``notes_`` columns."""

    def __init__(self, grid: Grid):
        self.grid = TracedGrid(grid)

    def __getattr__(self, name: str) -> Traced:
        value = F.col(name)
        if name in ITEMS:
            ref = F.lit(f"f:{name}") if ITEMS[name].scope == DOCUMENT else at(name, label())
            nil = F.array_contains("nil_items", name)
            remark = F.concat(F.lit(f"{name} not reported for "), label(), F.lit("; read as nil"))
            return Traced(value, name, [said(value.isNull(), ref)], [said(value.isNotNull() & ~nil, ref)], [said(nil, remark)])
        if name in METRICS:
            ref = F.lit(f"m:{name}") if METRICS[name].scope == DOCUMENT else at(name, label(), "m")
            return Traced(value, name, [F.col(f"missing_{name}")], [said(value.isNotNull(), ref)], [F.when(value.isNotNull(), F.col(f"notes_{name}")).otherwise(none())])
        return Traced(value, name)

    @staticmethod
    def ratio(a: Traced, b: Traced) -> Traced:
        by_zero = said((b.value == 0) & a.value.isNotNull(), F.concat(F.lit(f"division by zero: {b.text} is 0 in "), label()))
        return a._with(Terms.ratio(a.value, b.value), f"{a.text} / {b.text}", b, missing=[by_zero])

    def yearly(self, x: Traced) -> Traced:
        return x._with(Terms.yearly(self, x.value), x.text)

    @staticmethod
    def amount(x: Traced) -> Traced:
        return x._with(timeseries.amount(x.value), x.text)

    @staticmethod
    def abs(x: Traced) -> Traced:
        return x._with(F.abs(x.value), f"abs({x.text})")

    @staticmethod
    def rel_diff(a: Traced, b: Traced) -> Traced:
        return a._with(timeseries.rel_diff(a.value, b.value), f"rel_diff({a.text}, {b.text})", b)

    @staticmethod
    def coalesce(*xs: Traced) -> Traced:
        """Only where no alternative is there do all lack; the first that is there has been read."""
        value = F.coalesce(*(x.value for x in xs))
        inputs, notes, before = [], [], F.lit(True)
        for x in xs:
            inputs += [F.when(before, c).otherwise(none()) for c in x.inputs]
            notes += [F.when(before, c).otherwise(none()) for c in x.notes]
            before = before & x.value.isNull()
        missing = [F.when(value.isNull(), c).otherwise(none()) for x in xs for c in x.missing]
        return Traced(value, f"coalesce({', '.join(x.text for x in xs)})", missing, inputs, notes)
