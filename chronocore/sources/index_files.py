"""The index on disk: a text form, one line an edge, and a Parquet layout with a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocore.operators.index import breakpoints, directory, drop_faults, drops, from_drops
from chronocore.plans.storage import stored

# The first line and the fields of the text form.
HEADER = "# (k,Delta)-core spectrum index  |  Delta in [{floor}, {dmax}]"
SECOND = "# format:  u v t | base=<core at Delta=floor> ; <Delta_up>:<core> ..."
_LINE = r"^(\d+) (\d+) (\d+) \| base=(\d+) ;((?: \d+:\d+)*)\s*$"
_HEAD = r"^# \(k,Delta\)-core spectrum index  \|  Delta in \[\s*(\d+),\s*(\d+)\]\s*$"
VERSION = 1


def write_text(edges: DataFrame, index: DataFrame, path: str, floor: int, dmax: int) -> None:
    """Lines in the order of edges; the two header lines come first."""
    steps = F.transform(F.slice("deltas", 2, F.size("deltas")), lambda d, i: F.concat(F.lit(" "), d.cast("string"), F.lit(":"), F.get("values", i + 1).cast("string")))
    line = F.concat(F.concat_ws(" ", "u", "v", "t"), F.lit(" | base="), F.col("values")[0].cast("string"), F.lit(" ;"), F.array_join(steps, ""))
    body = edges.join(index, "e").select("e", line.alias("value"))
    spark = edges.sparkSession
    head = spark.createDataFrame([(-2, HEADER.format(floor=floor, dmax=dmax)), (-1, SECOND)], "e long, value string")
    head.unionByName(body).repartitionByRange("e").sortWithinPartitions("e").select("value").write.text(path)


def read_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int, int]:
    """(edges, index, floor, dmax); lines that break the form or its order are an error."""
    from chronocore.sources.edge_list import lines_of

    lines = stored(lines_of(spark, path))
    head = lines.filter(F.col("value").rlike(_HEAD)).orderBy("line").first()
    if head is None or head["line"] != 1:
        raise ValueError(f"{path}: no header")
    row = spark.createDataFrame([head]).select(*[F.regexp_extract("value", _HEAD, i).cast("long").alias(n) for i, n in ((1, "floor"), (2, "dmax"))]).first()
    floor, dmax = row["floor"], row["dmax"]
    body = lines.filter(~F.col("value").startswith("#"))
    if floor > dmax or not body.filter(~F.col("value").rlike(_LINE)).isEmpty():
        raise ValueError(f"{path}: broken lines")
    part = lambda i: F.regexp_extract("value", _LINE, i)
    pairs = F.transform(F.filter(F.split(part(5), " "), lambda x: x != ""), lambda x: F.split(x, ":"))
    rows = body.select(
        "line", *[part(i + 1).cast("long").alias(n) for i, n in enumerate("uvt")],
        F.concat(F.array(F.lit(floor).cast("long")), F.transform(pairs, lambda p: p[0].cast("long"))).alias("deltas"),
        F.concat(F.array(part(4).cast("int")), F.transform(pairs, lambda p: p[1].cast("int"))).alias("values"),
    )
    first = body.agg(F.min("line")).first()[0]
    rows = stored(rows.withColumn("e", F.col("line") - F.lit(first)))
    rising = lambda c: F.size(F.filter(F.slice(c, 2, F.size(c)), lambda x, i: x <= F.get(c, i))) > 0
    if not rows.filter(rising("deltas") | rising("values") | (F.element_at("deltas", -1) > dmax)).isEmpty():
        raise ValueError(f"{path}: steps don't rise within ({floor}, {dmax}]")
    return rows.select("e", "u", "v", "t"), rows.select("e", "deltas", "values"), floor, dmax


def fingerprint(edges: DataFrame) -> str:
    """A digest of all edges: digests of ranges in order, then the digest of those."""
    width = 100_000
    part = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("e", F.concat_ws(" ", "e", "u", "v", "t").alias("s")))), lambda x: x["s"]), "\n").cast("binary"), 256)
    parts = edges.groupBy(F.floor(F.col("e") / width).alias("p")).agg(part.alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "").cast("binary"), 256)).first()[0]


def write_tables(edges: DataFrame, index: DataFrame, path: str, floor: int, dmax: int) -> None:
    """edges, directory, breakpoints and drops, each in the order that its readers prune by, and a manifest."""
    edges.repartitionByRange("e").sortWithinPartitions("e").write.parquet(f"{path}/edges")
    directory(index).repartitionByRange("e").sortWithinPartitions("e").write.parquet(f"{path}/directory")
    breakpoints(index).repartitionByRange("e").sortWithinPartitions("e", "delta").write.parquet(f"{path}/breakpoints")
    log = drops(index)
    log.repartitionByRange(F.desc("delta_below"), "e").sortWithinPartitions(F.desc("delta_below"), "e").write.parquet(f"{path}/drops")
    said = {"version": VERSION, "floor": floor, "dmax": dmax, "edges": edges.count(), "breakpoints": log.count(), "sha256": fingerprint(edges)}
    edges.sparkSession.createDataFrame([(json.dumps(said, sort_keys=True),)], "value string").write.text(f"{path}/manifest")


def read_tables(spark: SparkSession, path: str, verify: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """(edges, index, manifest); with ``verify`` counts, digest and the order of drops are checked."""
    said = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if said["version"] != VERSION:
        raise ValueError(f"{path}: version {said['version']}")
    edges, seed, log = (spark.read.parquet(f"{path}/{n}") for n in ("edges", "directory", "drops"))
    if verify:
        wrong = drop_faults(seed.select("e", "top"), log, said["floor"], said["dmax"]).first()
        found = {"edges": edges.count(), "breakpoints": log.count(), "sha256": fingerprint(edges)}
        if wrong or any(said[k] != v for k, v in found.items()):
            raise ValueError(f"{path}: {wrong or found}")
    return edges, from_drops(seed.select("e", "top"), log, said["floor"]), said
