"""Tables in the folder that all executors share, and size-checked broadcast."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast; a row of the sides in question takes tens of bytes.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a private one is set only where the session names none and all runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="chronocore-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder of this session's tables."""
    return f"{shared_dir(spark)}/chronocore/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete this session's tables. Results that were not written anywhere else can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch. A task holds a batch several times over, on both sides of its Python worker.
BATCH_BYTES = 16 << 20


def lean(spark: SparkSession) -> None:
    """Lower the session's limit for Arrow batches to ``BATCH_BYTES``; a lower one stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _bytes(size: str) -> int:
    number = size.rstrip("bBkKmMgGtT")
    unit = size[len(number) :].lower()[:1]
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{uuid.uuid4().hex}"
    lean(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parted(df: DataFrame, column: str, values: list) -> list[DataFrame]:
    """``df`` stored as one table for each of the values of ``column``, without it; a value without rows has an empty one."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{uuid.uuid4().hex}"
    lean(spark)
    df.write.option("compression", "zstd").partitionBy(column).parquet(path)
    schema = df.drop(column).schema
    there = lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    folders = [f"{path}/{column}={v}" for v in values]
    return [spark.read.schema(schema).parquet(f) if there(spark._jvm.org.apache.hadoop.fs.Path(f)) else spark.createDataFrame([], schema) for f in folders]


def forget(df: DataFrame) -> None:
    """Delete a stored table that nothing will read again, and sweep."""
    spark = df.sparkSession
    if files := df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    sweep(spark)


def sweep(spark: SparkSession) -> None:
    """Let the files of finished shuffles go."""
    # Spark deletes a shuffle's files when no plan that Python or the JVM still holds refers to it.
    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.5)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has so few rows that it may be broadcast. It counts; pass a stored table."""
    return df.count() <= rows


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side that is never broadcast: Spark goes by the bytes of files, and rows that compress well take many times theirs."""
    return df.hint("merge")


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small; beyond that the join shuffles, and AQE splits what is skewed."""
    return F.broadcast(df) if small(df, rows) else df


#: Partitions that groups are dealt to at most.
DEALT = 10_000


def dealt(df: DataFrame, number: Column, parts: int, *keys: str) -> GroupedData:
    """``df`` grouped by (dealt, *keys): groups go to ``parts`` partitions by their numbers in turn. A hash puts several large ones into one task."""
    parts = max(1, min(parts, DEALT))
    return df.withColumn("dealt", F.pmod(number, F.lit(parts)).cast("int")).repartitionById(parts, "dealt").groupBy("dealt", *keys)
