"""Edge lists that arrive file by file: each micro-batch adds the edges that are not there yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from chronocore.sources.edge_list import _LOOSE, _SKIPPED, _fields


def ingest(spark: SparkSession, source: str, table: str, checkpoint: str) -> StreamingQuery:
    """Read what has arrived in ``source`` into the Parquet table (u, v, t, batch); lines that are no edge are left out.

    A batch overwrites its own partition, so one that is run again after a failure adds nothing twice.
    """

    def add(rows: DataFrame, batch: int) -> None:
        new = rows.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "t").distinct()
        try:
            old = spark.read.parquet(table).filter(F.col("batch") != batch).select("u", "v", "t")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            old = new.limit(0)  # the first batch
        new.join(old, ["u", "v", "t"], "left_anti").write.mode("overwrite").parquet(f"{table}/batch={batch}")

    lines = spark.readStream.format("text").load(source).filter(~F.col("value").rlike(_SKIPPED))
    edges = lines.select(*_fields(F.col("value"), _LOOSE)).filter("u is not null and v is not null and t is not null and t >= 0")
    return edges.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
