"""From raw documents to a training mix: language ID, exact and near duplicates, benchmark leaks, mixing by weight.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and reread as the next
one's ``docs``. A stage works on all that the one before it has kept; all but the last return the columns of
``docs``. What a stage does with nulls, ties, repeated rows and empty tables is told by its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronocore.llm import decontam, exact, langid, mixing, near
from chronocore.plans.storage import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a known language; texts without a letter, and those of no language with a chance of a half, go."""
    return langid.speaks(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (A-Z lower-cased), that with the largest id."""
    return exact.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least id."""
    return near.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of a test item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows selected for the mix, once for each epoch, with ``epoch`` and ``n_tokens``."""
    return mixing.mixed(docs, mixing.Mix())


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_duplicates),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", mix),
]

#: Naive Bayes, Order MinHash and alignment can't be put as SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
