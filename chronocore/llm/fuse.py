"""Static binary-fuse filters (three-wise, 16-bit fingerprints) over 64-bit keys, in numpy."""

from __future__ import annotations

import numpy as np

_HEAD = np.dtype("<u8")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """The murmur finaliser of ``keys + seed``."""
    h = keys + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, count: int) -> tuple[np.ndarray, ...]:
    """One slot in each of three consecutive segments; the first segment is drawn from the high bits."""
    first = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    mask, low = np.uint64(segment - 1), h
    base = first * np.uint64(segment)
    return tuple((base + np.uint64(i * segment) + ((low >> np.uint64(10 * i)) & mask)).astype(np.int64) for i in range(3))


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """A filter of the distinct ``keys`` (uint64). No key of the set is ever denied; another passes with a chance of 2^-16."""
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    if not n:
        return np.array([0, 0, 0], _HEAD).tobytes()
    # Segments are at most 1,024 slots, so that the three offsets come from separate bits of the hash.
    segment = 1 << max(2, min(10, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    for attempt in range(1000):
        count = max(1, int(np.ceil(n * factor * (1 + 0.02 * attempt) / segment)))
        size = (count + 2) * segment
        seed = (attempt + 1) * 0x2545F4914F6CDD1D
        h = _mix(keys, seed)
        where = _slots(h, segment, count)
        order = _peel(where, size, n)
        if order is not None:
            break
    else:  # pragma: no cover - the chance of one failure is small and attempts are independent
        raise RuntimeError("no binary fuse filter found")
    table, prints = np.zeros(size, np.uint16), _fingerprint(h)
    for chosen, slot in reversed(order):
        value = prints[chosen]
        for w in where:
            other = w[chosen]
            value = value ^ np.where(other == slot, np.uint16(0), table[other])
        table[slot] = value
    return np.array([seed & 0xFFFFFFFFFFFFFFFF, segment, count], _HEAD).tobytes() + table.tobytes()


def _peel(where: tuple[np.ndarray, ...], size: int, n: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot that each alone holds); None if some keys can't be peeled."""
    degree, owners, ids = np.zeros(size, np.int64), np.zeros(size, np.int64), np.arange(n)
    for w in where:
        degree += np.bincount(w, minlength=size)
        np.bitwise_xor.at(owners, w, ids)
    order, left, alone = [], n, np.flatnonzero(degree == 1)
    while len(alone):
        chosen, first = np.unique(owners[alone], return_index=True)
        order.append((chosen, alone[first]))
        left -= len(chosen)
        touched = np.concatenate([w[chosen] for w in where])
        np.subtract.at(degree, touched, 1)
        np.bitwise_xor.at(owners, touched, np.concatenate([chosen] * 3))
        touched = np.unique(touched)
        alone = touched[degree[touched] == 1]
    return order if not left else None


def contains(data: bytes, keys: np.ndarray) -> np.ndarray:
    seed, segment, count = (int(x) for x in np.frombuffer(data, _HEAD, 3))
    keys = np.asarray(keys, np.uint64)
    if not segment:
        return np.zeros(len(keys), bool)
    table, h = np.frombuffer(data, np.uint16, offset=24), _mix(keys, seed)
    a, b, c = _slots(h, segment, count)
    return (table[a] ^ table[b] ^ table[c]) == _fingerprint(h)
