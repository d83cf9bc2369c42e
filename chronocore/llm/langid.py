"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every character that is no letter counts as a space, and two- and three-character windows that
hold a letter are hashed to buckets. Training sums bucket counts by language, at most ``SAMPLE_ROWS`` labelled rows
(drawn by a hash of the id); the log-probability matrix has languages x ``BUCKETS`` cells, whatever the corpus, and is
broadcast. Scoring gathers and sums in numpy, a block of texts at a time.

A text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned. Ties go to the
language that sorts first. Null languages are not learned; rows that repeat are scored alike; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocore.llm import textops
from chronocore.llm.shared import documents, given_id, remainder, row_id
from chronocore.plans.storage import lean

BUCKETS, SIZES = 1 << 16, (2, 3)
#: Labelled rows that training reads, about; the draw is by a hash of the id, and never depends on the order of rows.
SAMPLE_ROWS = 40_000
SMOOTHING = 0.5
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    #: log-probabilities, languages x buckets
    table: np.ndarray
    prior: np.ndarray


def letters() -> np.ndarray:
    """Whether a code point is a letter, for the basic plane."""
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def codes(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points with a space for whatever is no letter, which are letters, offsets) of lower-cased texts."""
    low = pc.utf8_lower(texts)
    data, _ = textops.buffers(low)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum(pc.utf8_length(low).to_numpy(zero_copy_only=False))]).astype(np.int64)
    letter = table[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]):
        letter[points == c] = chr(c).isalpha()
    return np.where(letter, points, np.uint32(32)), letter, offsets


def windows(points: np.ndarray, letter: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every window that holds a letter, offsets of the texts)."""
    m = max(len(points) - n + 1, 0)
    h, some = np.full(m, n, np.uint32), np.zeros(m, bool)
    for i in range(n):
        h = h * np.uint32(0x01000193) + points[i : i + m] * np.uint32(0x9E3779B1)
        some |= letter[i : i + m]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    bucket = (h >> np.uint32(16)).astype(np.int64)
    for i in range(1, n):  # windows over the end of a text
        at = offsets[1:-1] - i
        some[at[(at >= 0) & (at < m)]] = False
    where = np.flatnonzero(some)
    return bucket[where], np.searchsorted(where, offsets)


def train(rows: DataFrame) -> Model:
    """``rows`` has lang and text. Counts are summed in each task first; a cell goes to the driver once for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, found = letters(), {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for at, part in textops.blocks(b.column(1)):
                points, letter, offsets = codes(part, table)
                here = langs[at : at + len(part)]
                for lang in set(here):
                    sums = found.setdefault(lang, [np.zeros(BUCKETS, np.int64), 0])
                    sums[1] += int((here == lang).sum())
                for n in SIZES:
                    bucket, starts = windows(points, letter, offsets, n)
                    lang_of = np.repeat(here, np.diff(starts))
                    for lang in set(here):
                        found[lang][0] += np.bincount(bucket[lang_of == lang], minlength=BUCKETS)
        for lang, (sums, docs) in found.items():
            at = np.flatnonzero(sums)
            at, n = np.append(at, -1), np.append(sums[at], docs)  # bucket -1 counts documents
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])

    counts = rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table, prior = np.full((len(langs), BUCKETS), SMOOTHING), np.zeros(len(langs))
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        cells = own[own["bucket"] >= 0]
        table[i, cells["bucket"]] += cells["n"]
        prior[i] = own.loc[own["bucket"] < 0, "n"].sum()
    return Model(langs, np.log(table / table.sum(axis=1, keepdims=True)), np.log(prior / max(prior.sum(), 1)))


def sample(rows: DataFrame, total: int, bound: int = SAMPLE_ROWS) -> DataFrame:
    """About ``bound`` rows, drawn by a hash of the id."""
    share = min(1.0, bound / max(total, 1))
    return rows if share >= 1 else rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def learn(docs: DataFrame, use: Column | None = None, bound: int = SAMPLE_ROWS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """A model from the rows that ``use`` selects and that have a text and a language."""
    lean(docs.sparkSession)
    chosen = docs.filter(docs[text].isNotNull() & docs[lang].isNotNull())
    chosen = chosen.filter(use) if use is not None else chosen
    rows = chosen.select(row_id(docs, key), docs[lang].cast("string").alias("lang"), docs[text].cast("string").alias("text"))
    return train(sample(rows, chosen.count(), bound))


def scores(points: np.ndarray, letter: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Log-probabilities, texts x languages."""
    total = np.tile(model.prior, (len(offsets) - 1, 1))
    for n in SIZES:
        bucket, starts = windows(points, letter, offsets, n)
        full = np.flatnonzero(np.diff(starts))
        if len(full):
            for i in range(len(model.langs)):
                total[full, i] += np.add.reduceat(model.table[i][bucket], starts[full])
    return total


def predict(docs: DataFrame, model: Model, carry: Column | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, carry, lang_pred, score) of every row."""
    lean(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.langs, model.table, model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = Model(*shared.value), letters()
        for b in batches:
            langs, best = [], []
            for _, part in textops.blocks(pc.fill_null(b.column(2), "")):
                points, letter, offsets = codes(part, table)
                runs = np.concatenate([[0], np.cumsum(letter)])
                known = (runs[offsets[1:]] > runs[offsets[:-1]]) & bool(model.langs)
                if not model.langs:
                    langs += [UNKNOWN] * len(part)
                    best.append(np.zeros(len(part)))
                    continue
                s = scores(points, letter, offsets, model)
                top = s.argmax(axis=1)
                chance = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                langs += [model.langs[i] if k else UNKNOWN for i, k in zip(top, known, strict=True)]
                best.append(np.where(known, chance, 0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(np.concatenate(best) if best else [], pa.float64())], ["id", "carry", "lang_pred", "score"])

    value = F.lit(None).cast("boolean") if carry is None else carry
    rows = docs.select(row_id(docs, key), value.alias("carry"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, carry boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder(docs, 4) == 2
    found = predict(docs, learn(docs, ~held_out), held_out)
    return found.select(given_id().alias("doc_id"), F.col("carry").alias("held_out"), "lang_pred", "score")


def speaks(docs: DataFrame, least: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that are ``und``, or of no language with a chance of at least ``least``.

    A row's verdict depends on its text alone, so rows are judged where they stand and nothing is shuffled.
    """
    model = learn(docs, text=text, key=key)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.prior))
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = Model(*shared.value), letters()
        for b in batches:
            good = np.zeros(len(b), bool)
            for first, part in textops.blocks(pc.fill_null(b.column(at), "")):
                points, letter, offsets = codes(part, table)
                runs = np.concatenate([[0], np.cumsum(letter)])
                known = runs[offsets[1:]] > runs[offsets[:-1]]
                if model.langs:
                    s = scores(points, letter, offsets, model)
                    known &= 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1) >= least
                good[first : first + len(part)] = known
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
