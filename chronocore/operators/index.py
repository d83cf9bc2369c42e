"""Tables and queries of the edge core index: staircases, breakpoints, point, onset, snapshot and area.

The index is ``staircases()``: (e, deltas, values), from the scale ``floor`` to ``dmax``. Queries join it on the edge and
read its arrays; no row of it is blown up. A scale outside the index gives null, or an error if ``strict``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocore.functions.columns import AREA, area_to, onset_of, value_at
from chronocore.plans.storage import shuffled


def guarded(value: Column, delta: Column, floor: int, dmax: int, strict: bool) -> Column:
    inside = (delta >= floor) & (delta <= dmax)
    wrong = F.raise_error(F.concat(F.lit(f"scale outside [{floor}, {dmax}]: "), delta.cast("string"))) if strict else F.lit(None)
    return F.when(inside, value).otherwise(wrong.cast("int"))


def point(index: DataFrame, queries: DataFrame, floor: int, dmax: int, strict: bool = False) -> DataFrame:
    """(e, delta, c) of each query (e, delta)."""
    c = guarded(value_at(F.col("deltas"), F.col("values"), F.col("delta")), F.col("delta"), floor, dmax, strict)
    return queries.join(shuffled(index), "e").select("e", "delta", c.alias("c"))


def onset(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(e, k, delta) of each query (e, k): 0 if the first value is k or more, null if k is never reached."""
    return queries.join(shuffled(index), "e").select("e", "k", onset_of(F.col("deltas"), F.col("values"), F.col("k")).alias("delta"))


def snapshot(index: DataFrame, delta: int, floor: int, dmax: int) -> DataFrame:
    """(e, c) of every edge at one scale."""
    if not floor <= delta <= dmax:
        raise ValueError(f"scale outside [{floor}, {dmax}]: {delta}")
    return index.select("e", value_at(F.col("deltas"), F.col("values"), F.lit(delta)).alias("c"))


def area(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(e, a, b, area) of each query (e, a, b), a <= b: the sum of the core numbers at the scales a .. b - 1."""
    d, v = F.col("deltas"), F.col("values")
    value = (area_to(d, v, F.col("b")) - area_to(d, v, F.col("a"))).cast(AREA)
    return queries.join(shuffled(index), "e").select("e", "a", "b", F.when(F.col("a") <= F.col("b"), value).alias("area"))


def directory(index: DataFrame) -> DataFrame:
    """(e, base, top): the first and the last value."""
    return index.select("e", F.col("values")[0].alias("base"), F.element_at("values", -1).alias("top"))


def breakpoints(index: DataFrame) -> DataFrame:
    """(e, delta, value, prefix): each step after the first; prefix is the area up to it."""
    steps = F.transform(F.slice("deltas", 2, F.size("deltas")), lambda d, i: F.struct(d.alias("delta"), F.get("values", i + 1).alias("value"), area_to(F.col("deltas"), F.col("values"), d).alias("prefix")))
    return index.select("e", F.explode(steps).alias("s")).select("e", "s.delta", "s.value", "s.prefix")


def drops(index: DataFrame) -> DataFrame:
    """(delta_below, e, value_below): the steps read downward, the scale just below each and the value there."""
    steps = F.transform(F.slice("deltas", 2, F.size("deltas")), lambda d, i: F.struct((d - 1).alias("delta_below"), F.get("values", i).alias("value_below")))
    return index.select("e", F.explode(steps).alias("s")).select("s.delta_below", "e", "s.value_below")


def from_drops(seed: DataFrame, dropped: DataFrame, floor: int) -> DataFrame:
    """The index from (e, top) and drops; drops that repeat a scale of an edge count once, with the least value below."""
    once = dropped.groupBy("e", "delta_below").agg(F.min("value_below").alias("value_below"))
    above = F.lag("value_below").over(Window.partitionBy("e").orderBy(F.desc("delta_below")))
    steps = once.join(shuffled(seed), "e").withColumn("value", F.coalesce(above, F.col("top")))
    steps = steps.groupBy("e").agg(F.sort_array(F.collect_list(F.struct((F.col("delta_below") + 1).alias("delta"), "value"))).alias("s"), F.min("value_below").alias("base"))
    joined = seed.join(shuffled(steps), "e", "left")
    deltas = F.concat(F.array(F.lit(floor).cast("long")), F.coalesce(F.col("s.delta"), F.array().cast("array<long>")))
    values = F.concat(F.array(F.coalesce("base", "top")), F.coalesce(F.col("s.value"), F.array().cast("array<int>")))
    return joined.select("e", deltas.alias("deltas"), values.alias("values"))


def drop_faults(seed: DataFrame, dropped: DataFrame, floor: int, dmax: int) -> DataFrame:
    """(e, fault) of what a log of drops must not hold: a scale outside [floor, dmax), a repeat, a value that doesn't fall."""
    order = Window.partitionBy("e").orderBy(F.desc("delta_below"))
    d = dropped.join(shuffled(seed), "e", "left").withColumn("above", F.coalesce(F.lag("value_below").over(order), F.col("top")))
    fault = (
        F.when(F.col("top").isNull(), "unknown edge")
        .when((F.col("delta_below") < floor) | (F.col("delta_below") >= dmax), "scale")
        .when(F.lag("delta_below").over(order) == F.col("delta_below"), "repeat")
        .when(F.col("value_below") >= F.col("above"), "value")
    )
    return d.select("e", fault.alias("fault")).filter("fault is not null")


def levels(index: DataFrame, maxk: int | None = None, only: int | None = None, *carry: str) -> DataFrame:
    """(k, e, delta): every level that an edge reaches, up to ``maxk``, and its onset; or one level alone."""
    top = F.element_at("values", -1)
    if only is None:
        top = top if maxk is None else F.least(top, F.lit(maxk))
        rows = index.select("e", "deltas", "values", *carry, F.explode(F.sequence(F.lit(1), top)).alias("k"))
    else:
        rows = index.filter(top >= only).select("e", "deltas", "values", *carry, F.lit(only).alias("k"))
    return rows.select("k", "e", onset_of(F.col("deltas"), F.col("values"), F.col("k")).alias("delta"), *carry)


def level_sizes(index: DataFrame) -> DataFrame:
    """(k, n) of every level."""
    return levels(index).groupBy("k").agg(F.count("*").alias("n"))
