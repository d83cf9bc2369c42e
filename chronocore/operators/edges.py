"""Edges of a temporal multigraph: canonical form, ordinals, interned nodes, sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronocore.functions.columns import h_index, slab
from chronocore.plans.storage import stored


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``e``: the place of each row in the order given, from 0. Stored.

    Rows are sorted by range partitions; a partition's offset is the sum of the counts before it, so no task sees all.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    rows = stored(parts.withColumns({"__part": F.shiftright(place, 33), "__row": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("__offset", before).select("__part", "__offset")  # one row for each partition
    return rows.join(F.broadcast(offsets), "__part").select((F.col("__row") + F.col("__offset")).alias("e"), *df.columns)


def canonical(interactions: DataFrame) -> DataFrame:
    """(e, u, v, t) from (u, v, t): no self loops, u < v, no repeats, ordinals by (t, u, v)."""
    rows = interactions.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "t").distinct()
    return numbered(rows, "t", "u", "v")


def first_seen(interactions: DataFrame, line: str = "line") -> DataFrame:
    """(raw, x): nodes numbered in the order in which lines name them, u before v; self loops name none."""
    rows = interactions.filter("u <> v")
    ends = rows.select(F.col("u").alias("raw"), (F.col(line) * 2).alias("at")).unionByName(rows.select(F.col("v").alias("raw"), (F.col(line) * 2 + 1).alias("at")))
    return numbered(ends.groupBy("raw").agg(F.min("at").alias("at")), "at", "raw").select("raw", F.col("e").alias("x"))


def interned(interactions: DataFrame, line: str = "line") -> DataFrame:
    """Canonical edges over first-seen node numbers."""
    nodes = stored(first_seen(interactions, line))
    rows = interactions.filter("u <> v").select("u", "v", "t")
    rows = rows.join(nodes.select(F.col("raw").alias("u"), F.col("x").alias("xu")), "u").join(nodes.select(F.col("raw").alias("v"), F.col("x").alias("xv")), "v")
    return canonical(rows.select(F.col("xu").alias("u"), F.col("xv").alias("v"), "t"))


def rebased(interactions: DataFrame) -> DataFrame:
    """The same with times counted from the first one: no result depends on it, and times near the largest whole number fit."""
    first = interactions.agg(F.min("t").alias("first"))
    return interactions.crossJoin(F.broadcast(first)).withColumn("t", F.col("t") - F.col("first")).drop("first")  # one row


def sides(edges: DataFrame, *carry: str) -> DataFrame:
    """(e, s, x, t): two rows for each edge, one for each of its ends."""
    ends = F.array(F.struct(F.lit(0).alias("s"), F.col("u").alias("x")), F.struct(F.lit(1).alias("s"), F.col("v").alias("x")))
    return edges.select("e", "t", *carry, F.explode(ends).alias("end")).select("e", "end.s", "end.x", "t", *carry)


def window_degrees(edges: DataFrame, delta: int) -> DataFrame:
    """(e, degree): the least, over both ends, of the number of edges there within ``delta`` of t, itself included.

    Counts come from a range frame over (vertex, slab of time); copies within ``delta`` of a slab's ends complete the
    frames, so a vertex with very many edges is spread over its slabs and never meets in one task.
    """
    width = max(1, 4 * delta)
    near = F.array_distinct(F.array(slab(F.col("t") - delta, width), slab(F.col("t"), width), slab(F.col("t") + delta, width)))
    ends = sides(edges).withColumn("home", slab(F.col("t"), width)).withColumn("slab", F.explode(near))
    frame = Window.partitionBy("x", "slab").orderBy("t").rangeBetween(-delta, delta)
    counted = ends.withColumn("n", F.count("*").over(frame)).filter("slab = home")
    return counted.groupBy("e").agg(F.min("n").alias("degree"))


def h_round(edges: DataFrame, values: DataFrame, delta: int) -> DataFrame:
    """(e, h): one round of the core fixpoint, the least over both ends of the h-index of the values in the window."""
    width = max(1, 4 * delta)
    near = F.array_distinct(F.array(slab(F.col("t") - delta, width), slab(F.col("t"), width), slab(F.col("t") + delta, width)))
    ends = sides(edges.join(values, "e"), "c").withColumn("home", slab(F.col("t"), width)).withColumn("slab", F.explode(near))
    frame = Window.partitionBy("x", "slab").orderBy("t").rangeBetween(-delta, delta)
    return ends.withColumn("h", h_index(F.collect_list("c").over(frame))).filter("slab = home").groupBy("e").agg(F.min("h").alias("h"))


def critical_radii(edges: DataFrame, floor: int, dmax: int) -> DataFrame:
    """(delta): distinct gaps in time, over ``floor`` and at most ``dmax``, of two edges that share a vertex."""
    width = max(1, dmax)
    a = sides(edges).select("x", F.col("t").alias("ta"), F.explode(F.array(slab(F.col("t"), width), slab(F.col("t"), width) + 1)).alias("slab")).distinct()
    b = sides(edges).select("x", F.col("t").alias("tb"), slab(F.col("t"), width).alias("slab")).distinct()
    gap = F.col("tb") - F.col("ta")
    return a.join(b, ["x", "slab"]).filter((gap > floor) & (gap <= dmax)).select(gap.alias("delta")).distinct()


def statistics(edges: DataFrame) -> DataFrame:
    """One row: number of edges and nodes, time span (the default for the largest delta), the largest degree and vertex span."""
    ends = sides(edges).groupBy("x").agg(F.count("*").alias("degree"), (F.max("t") - F.min("t")).alias("span"))
    nodes = ends.agg(F.count("*").alias("nodes"), F.max("degree").alias("max_degree"), F.max("span").alias("max_vertex_span"))
    whole = edges.agg(F.count("*").alias("edges"), (F.max("t") - F.min("t")).alias("span"))
    return whole.crossJoin(F.broadcast(nodes))  # one row each
