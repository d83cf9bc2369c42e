"""Column functions: step functions in arrays, h-index, slabs of time, and whole-number arithmetic that doesn't wrap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AREA = "decimal(38,0)"
MOST = 2**63 - 1


def slab(t: Column, width: int) -> Column:
    """The number of the slab of ``width`` that holds ``t``; whole-number arithmetic, exact for any time."""
    return F.call_function("div", t - F.pmod(t, F.lit(width)), F.lit(width)).cast("long")


def h_index(values: Column) -> Column:
    """The largest h such that at least h of the values are h or more."""
    down = F.sort_array(values, asc=False)
    return F.size(F.filter(F.transform(down, lambda y, i: y >= i + 1), lambda z: z)).cast("int")


def value_at(deltas: Column, values: Column, delta: Column) -> Column:
    """The step function at ``delta``: the last value whose scale is at most ``delta``."""
    return F.get(values, F.size(F.filter(deltas, lambda d: d <= delta)) - 1)


def onset_of(deltas: Column, values: Column, k: Column) -> Column:
    below = F.size(F.filter(values, lambda v: v < k))
    return F.when(below == 0, F.lit(0).cast("long")).otherwise(F.get(deltas, below))


def area_to(deltas: Column, values: Column, delta: Column) -> Column:
    """The sum of the step function over the whole scales from its first to ``delta`` - 1."""
    steps = F.transform(deltas, lambda d, i: (F.greatest(F.least(F.coalesce(F.get(deltas, i + 1), delta), delta) - F.least(d, delta), F.lit(0)).cast(AREA) * F.get(values, i)).cast(AREA))
    return F.aggregate(steps, F.lit(0).cast(AREA), lambda a, b: (a + b).cast(AREA))


def window(t: Column, delta: Column) -> tuple[Column, Column]:
    """The ends of the window of ``delta`` around a time from 0 on; they stop at 0 and at the largest whole number."""
    return F.greatest(t - delta, F.lit(0)), F.coalesce(F.try_add(t, delta), F.lit(MOST))


def scaled(value: Column, num: int, den: int) -> Column:
    """``value`` times num / den, rounded down, for values from 0 on; the product of value and num is never made."""
    div = lambda x: F.call_function("div", x, F.lit(den))
    return div(value) * num + div(value % den * num)
