"""Connected components of an undirected graph: each task joins what it sees, and what its parts share joins them.

Parts that have too many links for one task are joined by minimum labels with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronocore.plans.storage import hinted, stored

#: Rounds after which something is wrong: labels at least double their reach in each.
MOST_ROUNDS = 200
#: Nodes that a task holds at once, and links between parts that are joined in one task.
HELD, ONE = 1_000_000, 2_000_000


def ranks(values: pa.Array) -> np.ndarray:
    """Whole numbers in the order of the values; a struct is ordered by its fields."""
    if pa.types.is_struct(values.type):
        out = np.zeros(len(values), np.int64)
        for field in values.flatten():
            own = ranks(field)
            out = np.unique(out * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
        return out
    if pa.types.is_integer(values.type):
        return np.unique(values.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    coded = values.dictionary_encode()
    place = np.empty(len(coded.dictionary), np.int64)
    place[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
    return place[coded.indices.to_numpy()]


def least_labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the least one of its component, from links (i, j): a component hooks on to the least one beside it."""
    label = np.arange(n)
    while True:
        apart = i != j
        i, j = i[apart], j[apart]
        if not len(i):
            return label
        np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))
        while True:
            beyond = label[label]
            if (beyond == label).all():
                break
            label = beyond
        i, j = label[i], label[j]


def _stars(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Every node once, with the least one of its component."""
    both = pa.concat_arrays([a, b])
    _, first, code = np.unique(ranks(both), return_index=True, return_inverse=True)
    label = least_labels(code[: len(a)], code[len(a) :], len(first))
    return both.take(pa.array(first)), both.take(pa.array(first[label]))


def contracted(edges: DataFrame, held: int | None = HELD) -> DataFrame:
    """Edges (a, b) with the same components: each task joins the ends it sees, and names every node's least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[pa.Array, pa.Array]] = []
        kept = rows = 0
        for batch in batches:
            parts.append((batch.column(0), batch.column(1)))
            rows += batch.num_rows
            if rows >= kept + HELD:
                parts = [_stars(*(pa.concat_arrays(x) for x in zip(*parts, strict=True)))]
                kept = rows = len(parts[0][0])
                if held and kept >= held:
                    yield pa.RecordBatch.from_arrays(list(parts[0]), ["a", "b"])
                    parts, kept, rows = [], 0, 0
        if rows:
            yield pa.RecordBatch.from_arrays(list(_stars(*(pa.concat_arrays(x) for x in zip(*parts, strict=True)))), ["a", "b"])

    pairs = edges.select("a", "b")
    return pairs.mapInArrow(run, pairs.schema)


def connected_components(edges: DataFrame, ranged: bool = False) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); the component is its least node.

    Tasks join what they see; a node seen by several tasks links their parts, and those links are joined in one task if
    they are few. ``ranged`` puts nodes that are near in order together first, which leaves few links where edges join such nodes.
    """
    near = edges.select("a", "b").repartitionByRange("a").sortWithinPartitions("a") if ranged else edges
    stars = contracted(near)
    # A node has one row for each task that saw it.
    seen = stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"), F.collect_set("b").alias("all"))
    seen = stored(seen.select("node", "low", F.when(F.size("all") > 1, F.col("all")).alias("all")))
    seams = stored(seen.filter("all is not null").select(F.col("low").alias("a"), F.explode("all").alias("b")).filter("a <> b").distinct())
    n = seams.count()
    if not n:
        return seen.select("node", F.col("low").alias("component"))
    parts = stored(contracted(seams.coalesce(1), None).select(F.col("a").alias("low"), F.col("b").alias("component"))) if n <= ONE else _settled(seams)
    return seen.select("node", "low").join(hinted(parts), "low", "left").select("node", F.coalesce("component", "low").alias("component"))


def _settled(edges: DataFrame) -> DataFrame:
    """(low, component) of every node in ``edges`` (a, b), a <> b.

    In each round a node takes the least label among itself and its neighbours, and then the label of that label. Nodes
    with many edges are the side that AQE splits, and minima are taken in each task before the shuffle.
    """
    stars = contracted(edges)
    both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    for _ in range(MOST_ROUNDS):
        near = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("near"))
        step = stored(labels.join(near, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("was")))
        if step.filter("next <> was").isEmpty():
            break
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        labels = stored(step.join(jump, "next").select("node", F.least("next", "beyond").alias("component")))
    else:  # pragma: no cover
        raise RuntimeError("connected components did not settle")
    return labels.withColumnRenamed("node", "low")
