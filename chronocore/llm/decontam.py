"""Benchmark decontamination: n-gram seeds propose passages, Smith-Waterman alignment of words decides.

All windows of a test item of so many words as ``seed_words`` tells are its seeds, however many documents hold them, and
are looked up in every document. Around each seed found lies a stretch that holds every alignment through it that can be
good enough. If that has enough words of the item, it is aligned with the item (match 1, mismatch and gap -1); else no
alignment in it can score enough. A document is contaminated if the best score is at least ``LEAST`` of the item's
length, which is what a copy with a fifth of its words replaced or left out scores. Any such copy keeps a seed: n words
with r <= n / 5 of them changed have a run of at least (n - r) / (r + 1) words, over 3 from 16 words on, over 2 from 6
on, and over 1 below. A copy with words put in between, which cost less, can be without one; tests measure how many are.

Test items go to the workers in blocks of ``BLOCK_ITEMS`` and ``BLOCK_CHARS`` at most, one pass over the documents for
each block; documents are never shuffled. Null and empty texts match nothing. Items of fewer than ``SHORT`` words are too
short for an edit, and match only where all of their words stand in a row; items without a word match nothing. Items that
repeat each match. Rows that repeat, and rows with null ids, are judged one by one; no rows or no items give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocore.llm import textops
from chronocore.llm.shared import documents, given_id, row_id
from chronocore.plans.storage import lean

LEAST = 0.6
#: Items of fewer words must be found whole.
SHORT = 4
#: Items in a block, and their characters; a single longer item makes a block of its own.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8 << 20
#: Cells of an alignment, and seeds found, that are held at once; a document is never parted.
CELLS, FOUND = 1 << 21, 1 << 19


def seed_words(size: np.ndarray) -> np.ndarray:
    """Words of the seeds of items of ``size`` words: as many as any copy with a fifth of its words changed has in a row."""
    return np.select([size < SHORT, size < 6, size < 16], [size, 2, 3], 4)


class Items:
    """Words of test items, and their seeds: sorted hashes with (item, place) of each."""

    def __init__(self, texts: list[str | None], least: float = LEAST):
        t = textops.tokens(pc.utf8_lower(pa.array([x or "" for x in texts], pa.string())), textops.word_bytes(), textops.byte_values())
        self.words = [t.hashes[a:b] for a, b in zip(t.starts[:-1], t.starts[1:], strict=True)]
        self.size = np.diff(t.starts)
        self.least = np.where(self.size < SHORT, 1.0, least)
        own = seed_words(self.size)
        self.lengths = np.unique(own[self.size > 0]).tolist()
        found = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for n in self.lengths:
            grams, starts = textops.ngrams(t, n)
            item = np.repeat(np.arange(len(texts)), np.diff(starts))
            keep = (own == n)[item]
            for column, x in zip(found, (grams, item, np.arange(len(grams)) - starts[item]), strict=True):
                column.append(x[keep])
        grams, item, place = map(np.concatenate, found)
        order = np.argsort(grams, kind="stable")
        self.grams, self.item, self.place = grams[order], item[order], place[order]

    def parts(self) -> dict:
        return vars(self)

    @classmethod
    def of(cls, parts: dict) -> Items:
        out = object.__new__(cls)
        vars(out).update(parts)
        return out


class Screen:
    """Which hashes may be seeds: a bit table for most, a search for the rest."""

    def __init__(self, grams: np.ndarray, bits: int = 22):
        self.grams, self.shift = np.unique(grams), np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.grams >> self.shift] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[hashes >> self.shift])
        if not len(self.grams):
            return at[:0]
        place = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        return at[self.grams[place] == hashes[at]]


def smith_waterman(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best score, where it ends) of each item in its window; 0 fills up items, 1 windows. Match 1, mismatch and gap -1."""
    n, width = windows.shape
    slope = np.arange(width, dtype=np.int32)
    row, best, end = np.zeros((n, width), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        new = np.where(items[:, i, None] == windows, 1, -1).astype(np.int32)
        new[:, 1:] += row[:, :-1]
        np.maximum(new, row - 1, out=new)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope, axis=1) - slope  # gaps in the item
        at = row.argmax(axis=1)
        top = row[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


def enough_words(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, items: Items) -> np.ndarray:
    """Whether each stretch low..high has, for the least share of the item's length, enough of its words, each as often as in the item."""
    good = np.zeros(len(low), bool)
    width = high - low
    cuts = np.searchsorted(np.cumsum(width), np.arange(CELLS, int(width.sum()) + CELLS, CELLS))
    at = 0
    for to in [*np.unique(np.maximum(cuts, 1)).tolist(), len(low)]:
        if to <= at:
            continue
        n = width[at:to]
        stretch = np.repeat(np.arange(to - at), n)
        words = hashes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:to], n)]
        own = [items.words[i] for i in item[at:to]]
        size = items.size[item[at:to]]
        # The mark of a word and its stretch; equal marks by chance could only make the bound larger.
        ours = textops.mix(words + textops.mix(stretch.astype(np.uint64)))
        theirs = np.concatenate(own)
        of = np.repeat(np.arange(to - at), size)
        kinds, first, times = np.unique(textops.mix(theirs + textops.mix(of.astype(np.uint64))), return_index=True, return_counts=True)
        spot = np.minimum(np.searchsorted(kinds, ours), len(kinds) - 1)
        there = np.bincount(spot[kinds[spot] == ours], minlength=len(kinds))
        common = np.bincount(of[first], np.minimum(there, times), minlength=to - at)
        good[at:to] = common >= items.least[item[at:to]] * size
        at = to
    return good


def matches(part: pa.Array, items: Items, screen: Screen, values: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(row, item, score over the item's length, last word) of every passage that aligns well enough; the best for each row and item."""
    t = textops.tokens(pc.utf8_lower(part), textops.word_bytes(), values)
    spots, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in items.lengths:
        grams, starts = textops.ngrams(t, n)
        hit = screen.hits(grams)
        of = np.searchsorted(starts, hit, "right") - 1
        spots.append(hit - starts[of] + t.starts[of])
        keys.append(grams[hit])
    spot, keys = np.concatenate(spots), np.concatenate(keys)
    if not len(spot):
        return []
    order = np.argsort(spot, kind="stable")
    spot, keys = spot[order], keys[order]
    row = np.searchsorted(t.starts, spot, "right") - 1
    first, last = np.searchsorted(items.grams, keys), np.searchsorted(items.grams, keys, "right")
    many = np.cumsum(last - first)
    found, at = [], 0
    while at < len(spot):
        before = many[at - 1] if at else 0
        to = max(int(np.searchsorted(many, before + FOUND, "right")), at + 1)
        # Whole documents: back to where the last one begins, or on to where the only one ends.
        if to < len(spot) and row[to] == row[to - 1]:
            begin = int(np.searchsorted(row, row[to]))
            to = begin if begin > at else int(np.searchsorted(row, row[to], "right"))
        found += _aligned(t, spot[at:to], row[at:to], first[at:to], last[at:to], items)
        at = to
    return found


def _aligned(t: textops.Tokens, spot: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, items: Items) -> list[tuple[int, int, float, int]]:
    """matches() for seeds at the words ``spot`` of documents ``row``; their grams are ``first`` .. ``last`` - 1 of the items'."""
    many = last - first
    which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    row, spot, item = np.repeat(row, many), np.repeat(spot, many), items.item[which]
    begin = spot - items.place[which]
    size, least = items.size[item], items.least[item]
    # A score of least * size leaves room for so many words too many on either side.
    slack = ((1 - least) * size + 1e-9).astype(np.int64) + 2
    low = np.maximum(begin - slack, t.starts[row])
    # Seeds of one item whose windows lie close make one window.
    order = np.lexsort((low, item, row))
    row, item, low, size, slack, least = row[order], item[order], low[order], size[order], slack[order], least[order]
    high = np.minimum(low + size + 2 * slack + 2, t.starts[row + 1])
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (low[1:] - low[:-1] > slack[1:])
    heads = np.flatnonzero(fresh)
    low, high, row, item = low[heads], np.maximum.reduceat(high, heads), row[heads], item[heads]
    good = enough_words(t.hashes, low, high, item, items)
    low, high, row, item = low[good], high[good], row[good], item[good]
    size, least = items.size[item], items.least[item]
    found: dict[tuple[int, int], tuple[float, int]] = {}
    order = np.lexsort((high - low, size))
    at = 0
    while at < len(order):
        # Windows that a long chain of seeds has made are as long as the chain; each alignment takes room in proportion.
        to, wide = at, 1
        while to < len(order) and (to - at + 1) * max(wide, int((high - low)[order[to]])) <= CELLS // 8:
            wide = max(wide, int((high - low)[order[to]]))
            to += 1
        to = max(to, at + 1)
        some = order[at:to]
        tall, wide = int(size[some].max()), int((high - low)[some].max())
        left, right = np.zeros((len(some), tall), np.uint64), np.ones((len(some), wide), np.uint64)
        for j, k in enumerate(some):
            left[j, : size[k]] = items.words[item[k]]
            right[j, : high[k] - low[k]] = t.hashes[low[k] : high[k]]
        score, end = smith_waterman(left, right)
        for j in np.flatnonzero(score >= least[some] * size[some]):
            k = some[j]
            key, value = (int(row[k]), int(item[k])), (float(score[j]) / float(size[k]), int(low[k] + end[j] - t.starts[row[k]]))
            if key not in found or value[0] > found[key][0]:
                found[key] = value
        at = to
    return [(r, i, *v) for (r, i), v in sorted(found.items())]


def blocks_of(benchmark: DataFrame, text: str = "text", key: str = "item_id") -> Iterator[tuple[list, list[str | None]]]:
    """(ids, texts) of at most about ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters at a time."""
    rows = benchmark.select(benchmark[key].alias("item"), benchmark[text].cast("string").alias("text"))
    size = rows.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(-(-size["items"] // BLOCK_ITEMS), min(-(-size["chars"] // BLOCK_CHARS), size["items"]))
    for i in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i) if blocks > 1 else rows
        found = own.collect()
        yield [r["item"] for r in found], [r["text"] for r in found]


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(row_id(docs, key), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, item_id, similarity, last_word) of every document and item that align; similarity is the score over the item's length."""
    lean(docs.sparkSession)
    rows = _rows(docs, text, key)
    kind = benchmark.schema["item_id"].dataType
    found = []
    for names, texts in blocks_of(benchmark):
        items = Items(texts, least)
        shared = docs.sparkSession.sparkContext.broadcast((names, items.parts()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, parts = shared.value
            items, values = Items.of(parts), textops.byte_values()
            screen = Screen(items.grams)
            for b in batches:
                for first, part in textops.blocks(b.column(1)):
                    hits = matches(part, items, screen, values)
                    if hits:
                        row, item, score, last = zip(*hits, strict=True)
                        ids = b.column(0).take(pa.array([first + r for r in row]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([names[i] for i in item]), pa.array(score, pa.float64()), pa.array(last, pa.int64())], ["id", "item_id", "similarity", "last_word"])

        found.append(rows.mapInArrow(run, f"id long, item_id {kind.simpleString()}, similarity double, last_word long"))
    if not found:
        return docs.sparkSession.createDataFrame([], f"id long, item_id {kind.simpleString()}, similarity double, last_word long")
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that hold a test item; rows are judged where they stand."""
    lean(docs.sparkSession)
    at = docs.columns.index(text)
    out = docs
    for _, texts in blocks_of(benchmark):
        items = Items(texts, least)
        shared = docs.sparkSession.sparkContext.broadcast(items.parts())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, values = Items.of(shared.value), textops.byte_values()
            screen = Screen(items.grams)
            for b in batches:
                good = np.ones(len(b), bool)
                for first, part in textops.blocks(pc.fill_null(b.column(at), "")):
                    good[[first + m[0] for m in matches(part, items, screen, values)]] = False
                yield b.filter(pa.array(good))

        out = out.mapInArrow(run, docs.schema)
    return out


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(given_id().alias("doc_id"), "item_id", "similarity", "last_word")
