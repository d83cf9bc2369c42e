"""Language-model scores: a log-frequency Bloom filter of quantised one- and two-token counts, probed again and again.

A count c is held as the levels 1 .. 1 + floor(log2 c) of its n-gram; a probe goes up the levels until one is missing,
and the last one found is the count, quantised. The filter has ``BITS_PER_LEVEL`` at least for each level of the n-grams
counted, over all training rows, so it holds every one of them and grows with them. P(w | v) is smoothed towards P(w)
with ``PULL`` pseudo-counts; both come from probes.

A filter that grows can't be broadcast whole, so it is cut into shards by the n-gram's hash, as many as the bytes of text
ask for. Texts are worked on in blocks: a block sends each shard its distinct n-grams, with their counts in training
rows, once. A shard adds up the counts of all blocks, builds its part of the filter from them, and answers every block
with the levels that probes of its n-grams find; for single tokens it adds the exact counts, from which the base score
comes. N-grams that are frequent are one line for each block, so none is hot.

N-grams are keyed by hashes of 56 bits. Null texts are empty and hold the end token alone. Rows that repeat are scored
alike; null ids stay null, and their remainder is that of an empty text; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocore.llm import textops
from chronocore.llm.shared import documents, given_id, remainder, row_id
from chronocore.plans.storage import parted, sweep

PROBES, BITS_PER_LEVEL = 5, 9
PULL = 20.0
FLOOR = 0.1
#: Tokens of a block, about, and bytes of text for which there is a shard.
BLOCK_TOKENS, SHARD_BYTES = 1 << 20, 16 << 20
END = 0xE17D0F7E87000000
#: Bits of a hash that aren't kept.
LOW = np.uint64(8)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_HELD = pa.schema([("block", pa.int64()), ("shard", pa.int32()), *((c, pa.binary()) for c in "abcde")])
_ANSWERED = pa.schema([("own", pa.bool_()), *_HELD, ("tokens", pa.int64()), ("distinct", pa.int64())])
_SCORES = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def tokenized(part: pa.Array, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the tokens of each text, its end token included."""
    t = textops.tokens(pc.ascii_lower(part), textops.space_bytes(), values)
    n = len(part)
    starts = t.starts + np.arange(n + 1)
    hashes = np.full(starts[-1], END, np.uint64)
    hashes[np.arange(len(t.hashes)) + t.owner] = t.hashes >> LOW << LOW
    return hashes, starts


def pairs(hashes: np.ndarray) -> np.ndarray:
    """The hash of each token and the one before it; that of a text's first token has no meaning."""
    before = np.concatenate([hashes[:1], hashes[:-1]])
    return textops.mix(before * _PAIR + hashes) >> LOW << LOW


def _level_hash(grams: np.ndarray, level: int) -> np.ndarray:
    return textops.mix(grams + np.uint64(level * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))


@dataclass
class Filter:
    """A part of the log-frequency Bloom filter."""

    bits: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray, bits_per_level: int = BITS_PER_LEVEL) -> Filter:
        """The filter over n-grams with counts of 1 at least, a power of two of bits."""
        top = np.frexp(counts)[1]  # 1 + floor(log2)
        need = max(int(top.sum()) * bits_per_level, 64)
        out = cls(np.zeros(1 << (need - 1).bit_length(), bool))
        for level in range(1, int(top.max(initial=0)) + 1):
            for place in out._places(grams[top >= level], level):
                out.bits[place] = True
        return out

    def _places(self, grams: np.ndarray, level: int) -> Iterator[np.ndarray]:
        h, mask = _level_hash(grams, level), np.uint64(len(self.bits) - 1)
        step = textops.mix(h) | np.uint64(1)
        for i in range(PROBES):
            yield ((h + np.uint64(i) * step) & mask).astype(np.int64)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The last level that probes find, going up from 1 until one is missing; 0 if none is found."""
        found, alive = np.zeros(len(grams), np.uint8), np.arange(len(grams))
        for level in range(1, 64):
            there = np.ones(len(alive), bool)
            for place in self._places(grams[alive], level):
                there &= self.bits[place]
            alive = alive[there]
            found[alive] = level
            if not len(alive):
                break
        return found


def quantised(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range."""
    return np.where(levels > 0, (3 * 2.0 ** (levels.astype(np.float64) - 1) - 1) / 2, 0.0)


def log_chances(tokens: np.ndarray, both: np.ndarray, starts: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 of the probability of each text, from the quantised counts of its tokens and of the pairs that they end."""
    before = np.concatenate([tokens[:1], tokens[:-1]])
    first = starts[:-1]
    before[first] = 0
    alone = np.minimum((tokens + FLOOR) / (total + FLOOR * (distinct + 1)), 1.0)
    chance = (np.minimum(both, before) + PULL * alone) / (before + PULL)
    return np.add.reduceat(np.log10(chance), first)


def _planes(x: np.ndarray, kind: str = "<u4") -> bytes:
    """Whole numbers from 0 on, packed: how many, then all low bytes and so on, as most high ones are zero."""
    x = x.astype(kind)
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _many(packed: bytes) -> int:
    return int.from_bytes(bytes(packed[:8]), "little")


def _numbers(packed: bytes, kind: str = "<u4") -> np.ndarray:
    n, width = _many(packed), np.dtype(kind).itemsize
    raw = pa.decompress(packed[8:], n * width, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel() if n else np.zeros(0, kind)


def _ascending(x: np.ndarray) -> bytes:
    """Hashes that ascend, by the first one and the steps; their low byte is zero."""
    return _planes(np.diff(x >> LOW, prepend=np.uint64(0)), "<u8")


def _summed(planes: bytes) -> np.ndarray:
    return np.cumsum(_numbers(planes, "<u8"), dtype=np.uint64) << LOW


def _shard_starts(grams: np.ndarray, shards: int) -> np.ndarray:
    """Where the n-grams of each shard begin among ``grams``, which ascend; shards are ranges of the hash."""
    return np.searchsorted((grams >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1, dtype=np.uint64))


def blocks(rows: DataFrame, shards: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of ``rows`` (id, held_out, text) and what they send to each shard.

    Shard -1: ids, held_out, number of tokens of each text, and of each token the place of the token, and of the pair
    that it ends, among the block's distinct ones. Other shards: distinct tokens and their counts, distinct pairs and
    theirs, in ascending order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, task, number = textops.byte_values(), TaskContext.get().partitionId(), 0
        held: list[list[np.ndarray]] = [[], [], [], []]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            ids, out, sizes, hashes = map(np.concatenate, held)
            for part in held:
                part.clear()
            block, number = task << 32 | number, number + 1
            starts = np.concatenate([[0], np.cumsum(sizes)])
            learned, inner = np.repeat(~out, sizes), np.ones(len(hashes), bool)
            inner[starts[:-1]] = False
            tokens, at = np.unique(hashes, return_inverse=True)
            n_tokens = np.bincount(at[learned], minlength=len(tokens))
            double, of = np.unique(pairs(hashes)[inner], return_inverse=True)
            n_double = np.bincount(of[learned[inner]], minlength=len(double))
            row = [ids.astype(np.int64).tobytes(), out.astype(np.uint8).tobytes(), sizes.astype(np.int64).tobytes(), _planes(at), _planes(of)]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], schema=_HELD)
            cut, cut_double = _shard_starts(tokens, shards), _shard_starts(double, shards)
            some = np.flatnonzero((np.diff(cut) > 0) | (np.diff(cut_double) > 0))
            columns: list[list[bytes]] = [[], [], [], []]
            for s in some:
                x, y = slice(cut[s], cut[s + 1]), slice(cut_double[s], cut_double[s + 1])
                for column, value in zip(columns, (_ascending(tokens[x]), _planes(n_tokens[x]), _ascending(double[y]), _planes(n_double[y])), strict=True):
                    column.append(value)
            sent = [pa.array(c, pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(some.astype(np.int32)), *sent, pa.nulls(len(some), pa.binary())], schema=_HELD)

        for b in batches:
            for first, part in textops.blocks(b.column(2), textops.WIDE_BYTES):
                hashes, starts = tokenized(part, values)
                own = (b.column(i).slice(first, len(part)).to_numpy(zero_copy_only=False) for i in (0, 1))
                for part_, value in zip(held, (*own, np.diff(starts), hashes), strict=True):
                    part_.append(value)
                if sum(map(len, held[3])) >= block_tokens:
                    yield from flush()
        if held[0]:
            yield from flush()

    return rows.mapInArrow(run, "block long, shard int, a binary, b binary, c binary, d binary, e binary")


def answered(rows: DataFrame, bits_per_level: int = BITS_PER_LEVEL) -> list[DataFrame]:
    """Blocks, and what shards answer to them, stored apart. ``rows`` is from blocks(), and goes through one shuffle, blocks as they are.

    Answers: levels of the tokens, their counts, levels of the pairs; block -1 has the number of training tokens of the
    shard, and of distinct ones.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        n, shard = len(table), key[0].as_py()
        if shard < 0:
            return pa.table([pa.array([True] * n), *(table.column(c) for c in _HELD.names), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=_ANSWERED)
        joined = lambda c: np.concatenate([np.zeros(0, np.uint64), *(_summed(x.as_buffer()) for x in table.column(c))])
        levels, counts, sums = {}, None, [0, 0]
        for grams, times in (("a", "b"), ("c", "d")):
            kinds, at = np.unique(joined(grams), return_inverse=True)
            own = np.concatenate([np.zeros(0, np.int64), *(_numbers(x.as_buffer()).astype(np.int64) for x in table.column(times))])
            total = np.zeros(len(kinds), np.int64)
            np.add.at(total, at, own)
            there = total > 0
            levels[grams] = Filter.of(kinds[there], total[there], bits_per_level).levels(kinds)[at]
            if grams == "a":
                counts, sums = total[at], [int(total.sum()), int(there.sum())]
        ends = [np.cumsum([0, *(_many(x.as_buffer()) for x in table.column(c))]) for c in "ac"]
        cut = lambda x, e: [x[i:j] for i, j in zip(e[:-1], e[1:], strict=True)]
        rows = ([x.tobytes() for x in cut(levels["a"], ends[0])], [_planes(x, "<u8") for x in cut(counts, ends[0])], [x.tobytes() for x in cut(levels["c"], ends[1])])
        said = [pa.array([*x, None], pa.binary()) for x in rows]
        return pa.table([
            pa.array([False] * (n + 1)), pa.array([*table.column("block").to_pylist(), -1], pa.int64()), pa.array([shard] * (n + 1), pa.int32()), *said, pa.nulls(n + 1, pa.binary()), pa.nulls(n + 1, pa.binary()),
            pa.array([None] * n + sums[:1], pa.int64()), pa.array([None] * n + sums[1:], pa.int64()),
        ], schema=_ANSWERED)

    # A block has a key of its own, below 0.
    key = F.when(F.col("shard") < 0, -1 - F.col("block")).otherwise(F.col("shard").cast("long"))
    fields = "own boolean, block long, shard int, a binary, b binary, c binary, d binary, e binary, tokens long, distinct long"
    return parted(rows.groupBy(key.alias("key")).applyInArrow(run, fields), "own", ["true", "false"])


def score(docs: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", shard_bytes: int = SHARD_BYTES, block_tokens: int = BLOCK_TOKENS, bits_per_level: int = BITS_PER_LEVEL) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(row_id(docs, key), held_out.alias("held_out"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    held, found = answered(blocks(rows, max(-(-size // shard_bytes), 1), block_tokens), bits_per_level)
    sweep(docs.sparkSession)
    sums = found.filter("block = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct")).first()
    total, distinct = sums["tokens"], sums["distinct"]

    def finish(block: pa.Table, said: pa.Table) -> pa.Table:
        ids, out, sizes = (np.frombuffer(block.column(c)[0].as_buffer(), kind) for c, kind in zip("abc", (np.int64, np.uint8, np.int64), strict=True))
        at, of = (_numbers(block.column(c)[0].as_buffer()) for c in "de")
        said = said.take(pa.array(np.argsort(said.column("shard").to_numpy())))
        joined = lambda c: np.frombuffer(b"".join(x.as_buffer() for x in said.column(c)), np.uint8)
        counted = np.concatenate([_numbers(x.as_buffer(), "<u8") for x in said.column("b")]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        counts = counted[at]
        both, inner = np.zeros(len(at)), np.ones(len(at), bool)
        inner[starts[:-1]] = False
        both[inner] = quantised(joined("c"))[of]
        chance = log_chances(quantised(joined("a"))[at], both, starts, total, distinct)
        base = np.add.reduceat(np.log10((counts + FLOOR) / (total + FLOOR * (distinct + 1))), starts[:-1])
        known = np.add.reduceat((counts > 0).astype(np.int64), starts[:-1])
        return pa.table({"id": pa.array(ids), "held_out": pa.array(out.astype(bool)), "n_tokens": pa.array(sizes), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(chance)})

    own = held.drop("tokens", "distinct").groupBy("block").cogroup(found.filter("block >= 0").select("block", "shard", "a", "b", "c").groupBy("block"))
    return own.applyInArrow(finish, _SCORES).withColumn("train_tokens", F.lit(total).cast("long"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = score(docs, remainder(docs, 10) == 0)
    return found.select(given_id().alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
