"""Exact duplicates: binary-fuse filters screen an incoming batch against an immutable snapshot.

A snapshot is frozen once: its digests are grouped, and every bucket of digests gets a static binary-fuse filter.
Digests of an incoming batch are grouped among themselves; each distinct one is held against the filter of its bucket.
What the filter denies is new for certain. What it lets pass joins the exact bucket, and every group of more than one
row is then compared byte by byte, so that not even a collision of digests joins two different texts.

Texts are equal when identical after lower-casing A-Z. The row with the largest id stays; of rows that repeat that id,
one stays. Null texts are empty texts; rows with a null id order below all others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocore.llm import fuse
from chronocore.llm.shared import documents, given_id, row_id
from chronocore.plans.storage import hinted, lean, stored

#: Digests that share a filter, about.
KEYS_PER_FILTER = 16_384

Digest = Callable[[memoryview], bytes]


def full_digest(text: memoryview) -> bytes:
    return sha256(text).digest()


def _normal(column: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(column.cast(pa.string()), ""))


def digests(docs: DataFrame, digest: Digest = full_digest, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(uid, id, digest) of every row, stored. ``uid`` is unique to the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [digest(x.as_buffer()) for x in _normal(b.column(1)).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["id", "digest"])

    rows = docs.select(row_id(docs, key), docs[text].cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "id long, digest binary").select(F.monotonically_increasing_id().alias("uid"), "id", "digest"))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max(F.struct("id", "uid")).alias("keep"), F.count("*").alias("n"))


def _bucket(buckets: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(buckets)).alias("bucket")


@dataclass(frozen=True)
class Snapshot:
    """Exact groups (digest, keep, n) and the filters (bucket, filter) over their digests."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def _keys(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x[-8:].rjust(8, b"\0") for x in column), "<u8")


def freeze(rows: DataFrame) -> Snapshot:
    """An immutable snapshot of digest rows."""

    def filters(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "filter": [fuse.build(_keys(pdf["digest"]))]})

    groups = stored(_grouped(rows))
    buckets = max(1, -(-groups.count() // KEYS_PER_FILTER))
    keyed = groups.select(_bucket(buckets), "digest")
    return Snapshot(groups, stored(keyed.groupBy("bucket").applyInPandas(filters, "bucket long, filter binary")), buckets)


def screen(snapshot: Snapshot, batch: DataFrame) -> DataFrame:
    """The groups of an incoming batch (digest, keep, n) with ``positive``: whether the snapshot may hold the digest."""

    def probe(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        passed = fuse.contains(old["filter"].iloc[0], _keys(new["digest"])) if len(old) and len(new) else np.zeros(len(new), bool)
        return new[["digest", "id", "uid", "n"]].assign(positive=passed)

    new = _grouped(batch).select(_bucket(snapshot.buckets), "digest", "keep.id", "keep.uid", "n")
    probed = new.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInPandas(probe, "digest binary, id long, uid long, n long, positive boolean")
    return stored(probed.select("digest", F.struct("id", "uid").alias("keep"), "n", "positive"))


def merged(snapshot: Snapshot, screened: DataFrame) -> DataFrame:
    """Groups of more than one row over snapshot and batch; only positives meet the exact buckets, by their digests."""
    positive = stored(screened.filter("positive").select("digest", F.col("keep").alias("new"), F.col("n").alias("more")))
    known = snapshot.groups.join(hinted(positive), "digest", "left")
    known = known.select("digest", F.greatest("keep", F.coalesce("new", "keep")).alias("keep"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    # A positive that the snapshot doesn't hold, and groups that are new for certain.
    wrong = positive.filter("more > 1").join(snapshot.groups, "digest", "left_anti").select("digest", F.col("new").alias("keep"), F.col("more").alias("n"))
    return known.unionByName(wrong).unionByName(screened.filter("not positive").drop("positive")).filter("n > 1")


def save(snapshot: Snapshot, path: str) -> None:
    """Write a snapshot to a folder, for batches to come."""
    snapshot.groups.write.parquet(f"{path}/groups")
    snapshot.filters.withColumn("buckets", F.lit(snapshot.buckets)).write.parquet(f"{path}/filters")


def load(spark: SparkSession, path: str) -> Snapshot:
    """A snapshot from save()."""
    groups, filters = spark.read.parquet(f"{path}/groups"), spark.read.parquet(f"{path}/filters")
    row = filters.first()
    return Snapshot(groups, filters.drop("buckets"), row["buckets"] if row else 1)


def _texts(docs: DataFrame, digest: Digest, text: str, key: str) -> DataFrame:
    lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            normal = _normal(b.column(1))
            found = [digest(x.as_buffer()) for x in normal.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), normal], ["id", "digest", "normal"])

    return docs.select(row_id(docs, key), docs[text].cast("string").alias("text")).mapInArrow(run, "id long, digest binary, normal string")


def duplicates(docs: DataFrame, digest: Digest = full_digest, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, and the hex ``digest`` of the normalised text.

    Half of the rows, drawn by a hash of the id, is the snapshot; the other half is the incoming batch.
    """
    rows = digests(docs, digest, text, key)
    old = F.xxhash64("id").bitwiseAND(F.lit(1)) == 0
    snapshot = freeze(rows.filter(old))
    groups = stored(merged(snapshot, screen(snapshot, rows.filter(~old))))
    few = hinted(groups)
    # The byte check: rows of a group are grouped anew by their bytes; map-side sums leave a row per text and task.
    texts = _texts(docs, digest, text, key).join(few.select("digest"), "digest", "left_semi")
    bytewise = texts.groupBy("digest", "normal").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    apart = stored(bytewise.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"))
    found = rows.join(few, "digest", "left")
    if not apart.isEmpty():
        found = _split(docs, rows, found, apart, digest, text, key)
    keep = F.coalesce(F.col("keep"), F.struct("id", "uid"))
    return found.select(
        given_id().alias("doc_id"), F.when(keep["id"] != F.lit(-(2**63)), keep["id"]).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (keep["uid"] == F.col("uid")).alias("kept"), F.lower(F.hex("digest")).alias("digest"),
    )


def _split(docs: DataFrame, rows: DataFrame, found: DataFrame, apart: DataFrame, digest: Digest, text: str, key: str) -> DataFrame:
    """Groups whose digests collide, taken apart by their bytes.

    A row has no text beside its uid, so rows of one id and digest are told apart by rank: they carry the same id, and
    which of them stands for which text makes no difference to any column of the result.
    """
    from pyspark.sql import Window

    texts = _texts(docs, digest, text, key).join(apart, "digest", "left_semi").select("id", "digest", "normal")
    own = Window.partitionBy("id", "digest")
    texts = texts.withColumn("rank", F.row_number().over(own.orderBy("normal")))
    hit = rows.join(apart, "digest", "left_semi").withColumn("rank", F.row_number().over(own.orderBy("uid")))
    hit = hit.join(texts, ["id", "digest", "rank"])
    groups = hit.groupBy("digest", "normal").agg(F.max(F.struct("id", "uid")).alias("keep"), F.count("*").alias("n"))
    again = hit.select("digest", "uid", "id", "normal").join(groups, ["digest", "normal"]).select("digest", "uid", "id", "keep", "n")
    return found.join(apart, "digest", "left_anti").select("digest", "uid", "id", "keep", "n").unionByName(again)


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that repeat an equal text; of a repeated id and text, one row stays."""
    verdict = stored(duplicates(docs, text=text, key=key))
    gone = verdict.filter("not kept").groupBy("doc_id").agg(F.max("keep_id").alias("keep_id"))
    # Rows that repeat one id with one text can't be told apart by id: they are made one first.
    twice = verdict.groupBy("doc_id").count().filter("count > 1")
    if twice.isEmpty():
        gone = gone.select(F.col("doc_id").alias("gone"))
        return docs.join(hinted(gone), docs[key].cast("long").eqNullSafe(gone["gone"]), "left_anti")
    normal = F.translate(F.coalesce(docs[text].cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # The rows are packed, so that no name of theirs meets another.
    packed = docs.select(row_id(docs, key), F.sha2(normal.cast("binary"), 256).alias("digest"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    stay = verdict.filter("kept").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "digest").distinct()
    return packed.dropDuplicates(["id", "digest"]).join(stay, ["id", "digest"], "left_semi").select("row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
