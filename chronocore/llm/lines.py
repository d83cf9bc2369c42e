"""Repeated lines: normalised lines are hashed, documents are counted by hash, and the rest is put together by position.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least ``min_chars`` code points
that are found in at least ``min_docs`` documents lose all their lines, except in the largest id that holds them.

Null texts are empty texts, and have one empty line. All rows with a null id are one document, ordered below the
others; rows that repeat an id are one document too, but each row keeps its own text. A document of which every line
goes is left with an empty text. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocore.llm.shared import documents, given_id, row_id
from chronocore.plans.storage import hinted, stored

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, version, text); ``version`` tells rows of one id with different texts apart."""
    value = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(row_id(docs, key), F.xxhash64(value).alias("version"), value.alias("text"))


def line_hashes(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, version, pos, hash) of every line whose key is long enough; 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pc.split_pattern(b.column(2), "\n")
            ends = lists.offsets.to_numpy()
            row = np.repeat(np.arange(len(lists)), np.diff(ends))
            pos = np.arange(ends[-1] - ends[0]) - (ends[:-1] - ends[0])[row]
            keys = pc.ascii_lower(pc.ascii_trim(lists.flatten(), SPACE))
            long = pc.greater_equal(pc.utf8_length(keys), min_chars)
            at = pa.array(np.flatnonzero(long.to_numpy(zero_copy_only=False)))
            row, pos = row[at], pos[at]
            found = [xxhash.xxh3_128_digest(x.as_buffer()) for x in keys.take(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(pos, pa.int32()), pa.array(found, pa.binary())], ["id", "version", "pos", "hash"])

    return rows.mapInArrow(run, "id long, version long, pos int, hash binary")


def repeated(hashes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(hash, last) of keys in at least ``min_docs`` distinct documents; two-step counts, so no key gathers in one task."""
    return hashes.groupBy("hash").agg(F.countDistinct("id").alias("docs"), F.max("id").alias("last")).filter(F.col("docs") >= min_docs).select("hash", "last")


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, the kept ``text``, n_lines and n_dropped."""
    rows = _rows(docs, text, key)
    hashes = stored(line_hashes(rows, min_chars))
    gone = hashes.join(hinted(stored(repeated(hashes, min_docs))), "hash").filter("id <> last")
    # Rows that repeat an id and a text have the same positions.
    gone = stored(gone.groupBy("id", "version").agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    # Positions grow with the corpus, so this is a shuffle of both sides at every size.
    return rows.join(gone.hint("merge"), ["id", "version"], "left").select(
        "id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeated_lines(documents(spark, sf_dir))
    return kept.select(given_id().alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH s AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM s),
g AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> g.last, false) AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
