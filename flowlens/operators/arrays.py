"""Arrays of a row, grouped and looked up by column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named there: as the variable of an outer lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _where_differs(rows: Column, names: tuple[str, ...], step: int) -> Column:
    differs = lambda x, y: reduce(or_, [~x[n].eqNullSafe(y[n]) for n in names])
    return let(rows, lambda all_: F.filter(all_, lambda x, i: F.get(all_, i + step).isNull() | differs(x, F.get(all_, i + step))))


def first_of_each(rows: Column, *names: str) -> Column:
    """The first of each stretch of `rows`, in their order, that agree in the fields `names`."""
    return _where_differs(rows, names, -1)


def last_of_each(rows: Column, *names: str) -> Column:
    """The last of each such stretch."""
    return _where_differs(rows, names, 1)


def looked_up(entries: Column, key: Column) -> Column:
    """The value of `key` in a map, null if it has none."""
    return F.try_element_at(entries, key)


def lines_between(lines: Column, start: Column, end: Column) -> Column:
    """The lines numbered from `start` to `end`, counted from 1, of those that there are."""
    size = F.greatest(F.least(end, F.size(lines)) - start + 1, F.lit(0))
    return F.when(lines.isNotNull(), F.slice(lines, F.greatest(start, F.lit(1)), size))
