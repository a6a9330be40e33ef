"""Merging two ascending arrays of token ends by equal pieces of work."""

from __future__ import annotations

import numpy as np


def borders(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) at which the merge of ``a`` and ``b`` is cut, first and last included.

    Cut k lies on the diagonal i + j = k * work: all that is merged before it is smaller than what comes after. All
    diagonals are searched at once, by halving. Two equal ends stay in one piece, which may so be one longer.
    """
    total = len(a) + len(b)
    diagonal = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        i = (low + high) >> 1
        # Does a[i] come before b[j - 1], of equal ones a first?
        before = open_ & (a[np.minimum(i, len(a) - 1)] <= b[np.maximum(diagonal - i - 1, 0)])
        low = np.where(before, i + 1, low)
        high = np.where(open_ & ~before, i, high)
    i, j = low, diagonal - low
    split = (i > 0) & (j < len(b))
    split[split] = a[i[split] - 1] == b[j[split]]
    return i, j + split


def shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that both arrays hold."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(b, a)
    both = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a)
    return both, at[both]


def pieces(a: np.ndarray, b: np.ndarray, work: int):
    """(i, j, a's part, b's part) of each piece."""
    i, j = (x.tolist() for x in borders(a, b, work))
    for k in range(len(i) - 1):
        yield i[k], j[k], slice(i[k], i[k + 1]), slice(j[k], j[k + 1])


def links(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shared ends, found piece by piece and put together."""
    found = [(x + i, y + j) for i, j, p, q in pieces(a, b, work) for x, y in [shared(a[p], b[q])]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))
