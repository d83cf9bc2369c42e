"""Edge lists as text: one interaction ``u v t`` a line, further columns ignored, ``#`` and ``%`` comments, blank lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocore.operators.edges import numbered
from chronocore.plans.storage import stored

_NUMBER = r"[+-]?[0-9]++"
_EDGE = rf"^\s*+({_NUMBER})\s++({_NUMBER})\s++({_NUMBER})(?:\s.*)?$"
_LOOSE = rf"^\s*+({_NUMBER})\s*+({_NUMBER})\s*+({_NUMBER})"
_COUNT = r"^\s*+\+?[0-9]++\s*+(?:[#%].*)?$"
_SKIPPED = r"^\s*+(?:[#%].*)?$"


def _fields(line: Column, pattern: str) -> list[Column]:
    return [F.regexp_extract(line, pattern, i + 1).try_cast("long").alias(n) for i, n in enumerate("uvt")]


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines with their place, from 1, over the files in the order of their names."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = stored(text.withColumn("at", F.monotonically_increasing_id()))
    return numbered(rows, "file", "block", "at").select((F.col("e") + 1).alias("line"), "value")


def faults(lines: DataFrame) -> DataFrame:
    """(line, fault) of lines that a strict reader refuses."""
    v = F.col("value")
    u, w, t = _fields(v, _EDGE)
    first = lines.filter(v.rlike(_EDGE)).agg(F.min("line").alias("first_edge"))
    count = lines.filter(v.rlike(_COUNT)).agg(F.min("line").alias("first_count"))
    rows = lines.filter(~v.rlike(_SKIPPED)).crossJoin(F.broadcast(first)).crossJoin(F.broadcast(count))  # one row each
    fault = (
        F.when(v.rlike(_COUNT) & ((F.col("line") > F.col("first_count")) | (F.col("line") > F.col("first_edge"))), "a count may stand only once, before all edges")
        .when(v.rlike(_COUNT), None)
        .when(~v.rlike(_EDGE) | u.isNull() | w.isNull() | t.isNull(), "no edge")
        .when(t < 0, "negative time")
    )
    return rows.select("line", fault.alias("fault")).filter("fault is not null")


def read(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """(line, u, v, t). ``strict`` refuses what is no edge, comment or leading count; ``permissive`` leaves it out."""
    lines = stored(lines_of(spark, path))
    if mode == "strict":
        wrong = faults(lines).orderBy("line").first()
        if wrong:
            raise ValueError(f"{path}:{wrong['line']}: {wrong['fault']}")
        rows = lines.filter(F.col("value").rlike(_EDGE)).select("line", *_fields(F.col("value"), _EDGE))
        if rows.isEmpty():
            raise ValueError(f"{path}: no edges")
        return rows
    if mode != "permissive":
        raise ValueError(f"unknown mode: {mode}")
    rows = lines.filter(~F.col("value").rlike(_SKIPPED)).select("line", *_fields(F.col("value"), _LOOSE))
    return rows.filter("u is not null and v is not null and t is not null and t >= 0")


def write(interactions: DataFrame, path: str) -> None:
    interactions.select(F.concat_ws(" ", "u", "v", "t").alias("value")).write.text(path)
