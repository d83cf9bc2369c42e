"""What the training-data operators share.

Conventions that hold for every operator here:

* a null text counts as an empty text;
* a null ``doc_id`` is one document of its own, ordered below every other id;
* only the named columns are read, so extra columns never clash with working columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside an operator.
NULL_ID = -(2**63)


def row_id(df: DataFrame, col: str = "doc_id") -> Column:
    return F.coalesce(df[col].cast("long"), F.lit(NULL_ID)).alias("id")


def given_id(col: str = "id") -> Column:
    """The inverse of ``row_id``."""
    return F.when(F.col(col) != F.lit(NULL_ID), F.col(col))


def remainder(df: DataFrame, mod: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(df[col].cast("string"), F.lit("")).cast("binary")) % mod


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
