"""Vectorised text: token boundaries, token hashes and n-gram hashes of many texts at once, in numpy over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are worked on at once, so that arrays of a few numbers for each byte stay small; a longer text is worked
#: on alone. WIDE_BYTES is for work with a cost for each block.
BLOCK_BYTES, WIDE_BYTES = 1 << 17, 1 << 19
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_values() -> np.ndarray:
    """A random 64-bit value for each byte."""
    return mix((np.arange(1, 257, dtype=np.uint64)) * _GOLD)


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(max(n, 1), _BASE, np.uint64)) if n else np.zeros(0, np.uint64)


def space_bytes() -> np.ndarray:
    """True for the bytes of tokens that end at white space (space and 0x09-0x0D)."""
    kind = np.ones(256, bool)
    kind[[32, 9, 10, 11, 12, 13]] = False
    return kind


def word_bytes() -> np.ndarray:
    """True for the bytes of words: ASCII letters and digits, and all of any other character."""
    kind = np.zeros(256, bool)
    kind[128:] = True
    for a, b in ((48, 58), (65, 91), (97, 123)):
        kind[a:b] = True
    return kind


@dataclass
class Tokens:
    """Tokens of ``n`` texts: hash, first byte and end in ``data``; those of text i are ``starts[i]:starts[i + 1]``."""

    data: np.ndarray
    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    starts: np.ndarray
    offsets: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, some rows) with about ``limit`` bytes at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and offsets from 0. Nulls must be filled."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def tokens(texts: pa.Array, kind: np.ndarray, values: np.ndarray) -> Tokens:
    """Tokens are maximal runs of bytes of the ``kind``; ``values`` is from byte_values()."""
    data, offsets = buffers(texts)
    inside = kind[data]
    edge = np.empty(len(data), bool)
    if len(data):
        edge[0] = True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:])
        cuts = offsets[1:-1]
        edge[cuts[cuts < len(data)]] = True
    runs = np.flatnonzero(edge)
    ends = np.append(runs[1:], len(data))
    real = inside[runs] if len(runs) else np.zeros(0, bool)
    begin, end = runs[real], ends[real]
    starts = np.searchsorted(begin, offsets)
    if not len(begin):
        return Tokens(data, np.zeros(0, np.uint64), begin, end, starts, offsets)
    length = end - begin
    power = powers(int(length.max()))
    # The bytes of the tokens alone, each times the power of its place in the token.
    inner = np.flatnonzero(inside)
    first = np.cumsum(length) - length
    place = np.arange(len(inner)) - np.repeat(first, length)
    hashes = np.add.reduceat(values[data[inner]] * power[place], first)
    return Tokens(data, mix(hashes), begin, end, starts, offsets)


def ngrams(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the n-token windows of each text; a text of fewer tokens, but one at least, has one shorter window."""
    counts = np.diff(t.starts)
    size = np.maximum(counts - n + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(starts[-1]) + np.repeat(t.starts[:-1] - starts[:-1], size)
    left = np.repeat(t.starts[1:], size)
    hashes = np.zeros(len(at), np.uint64)
    for i in range(n):
        place = at + i
        there = place < left
        hashes = mix(hashes * _GOLD + np.where(there, t.hashes[np.minimum(place, len(t.hashes) - 1)], np.uint64(i))) if len(at) else hashes
    return hashes, starts
