"""Graphs of interactions (u, v, t) on the tables at hand: whole-number times, vertices in separate ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

APART = 1_000_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(col: str):
    return F.unix_date(F.col(col).cast("date")).cast("long")


def supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").cast("long").alias("u"), (F.col("l_partkey").cast("long") + APART).alias("v"), _days("l_shipdate").alias("t"))


def user_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    code = F.ascii("event_type").cast("long") * 1000 + F.length("event_type") + 10 * APART  # distinct for the five types
    return rows.select(F.col("user_id").cast("long").alias("u"), code.alias("v"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long").alias("t"))


def customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("u"), _days("o_orderdate").alias("t"))
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey").cast("long") + APART).alias("v"))
    return orders.join(lines, "o_orderkey").select("u", "v", "t")
