"""Banded alignment of token sequences: bit-parallel edit distance within a band of diagonals."""

from __future__ import annotations

import numpy as np


def distance_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """The edit distance (insert, delete, replace) of two sequences of integers, or None if it is over ``limit``.

    Only the diagonals at most ``limit`` away from the main one are computed: a column of the band is one integer of
    2 x limit + 1 bits.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return None
    n = len(b)
    same = a[:n] == b
    lead = n if same.all() else int(same.argmin())
    a, b = a[lead:], b[lead:]
    n = len(b)
    if n:
        same = a[len(a) - n :][::-1] == b[::-1]
        tail = n if same.all() else int(same.argmin())
        a, b = a[: len(a) - tail], b[: n - tail]
    if not len(b):
        return len(a) if len(a) <= limit else None
    if over_bag(a, b, limit):
        return None
    return _banded(a.tolist(), b.tolist(), min(limit, len(a)))


def over_bag(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """Whether even the multisets of tokens are too far apart."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return max(len(a), len(b)) - int(np.minimum(n[i], m[j]).sum()) > limit


def _banded(a: list[int], b: list[int], limit: int) -> int | None:
    """``a`` runs down the column, ``b`` across. Bit t of a column j stands for row j - limit + t."""
    rows = len(a)
    match: dict[int, int] = {}
    for i, x in enumerate(a):
        match[x] = match.get(x, 0) | 1 << i
    width = 2 * limit + 1
    full = (1 << width) - 1
    top = 1 << (width - 1)
    up = (full >> limit) << limit  # rows at and below the main diagonal differ by one from the row above
    down = 0
    dist, mark = limit, top >> 1
    for j, x in enumerate(b):
        eq = match.get(x, 0)
        eq = (eq >> (j - limit) if j >= limit else eq << (limit - j)) & full
        diag = ((((eq & up) + up) ^ up) | eq | down) & full
        right_up = (down | ~(diag | up)) & full
        right_down = diag & up
        if j < rows - limit:
            dist += not diag & top
        else:
            dist += bool(right_up & mark) - bool(right_down & mark)
            mark >>= 1
        shifted = diag >> 1
        up = (right_down | ~(shifted | right_up)) & full
        down = shifted & right_up
        if dist - (len(b) - 1 - j) - limit > limit:
            return None
    return dist if dist <= limit else None


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether 1 - distance / length of the longer is at least ``similarity``."""
    longest = max(len(a), len(b))
    limit = int((1 - similarity) * longest + 1e-9)
    return distance_within(a, b, limit) is not None
