"""Minimal perfect hashes over 128-bit keys, by levels of bit arrays; everything is done on whole numpy arrays.

On each level the keys that are left are thrown into a bit array of twice their number. Keys that are alone on their
place stay there and set its bit, the others go on to the next level. The number of set bits before a key's own is its
place in 0 .. n - 1.
"""

from __future__ import annotations

import numpy as np

_GOLDEN, _C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bits of a level for each key that is thrown into it.
_ROOM = 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def _place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.array([level + 1], np.uint64) * _GOLDEN
    return (_mixed(high ^ _mixed(low + salt)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Places of the keys it was built from; any other key gets some place or -1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        """From distinct keys, given as two arrays of unsigned 64-bit halves."""
        sizes, parts = [], []
        while len(high):
            size = -(-_ROOM * len(high) // 64) * 64
            at = _place(high, low, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = ~alone[at]
            high, low = high[rest], low[rest]
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, "<u8"))

    def places(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        found = np.full(len(high), -1, np.int64)
        rest, first = np.arange(len(high)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _place(high[rest], low[rest], level, size) + first
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            block = self.bits[word]
            here = (block >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(block & ((np.uint64(1) << bit) - np.uint64(1)))
            found[rest[here]] = (self.before[word] + below)[here]
            rest, first = rest[~here], first + size
            if not len(rest):
                break
        return found


class CountIndex:
    """For each key a fingerprint of 32 bits and its count, capped at what the smallest fitting integer holds."""

    def __init__(self, hashed: PerfectHash, prints: np.ndarray, counts: np.ndarray):
        self.hashed, self.prints, self.counts = hashed, prints, counts

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray, kind: str) -> CountIndex:
        hashed = PerfectHash.build(high, low)
        at = hashed.places(high, low)
        prints, stored = np.zeros(len(high), "<u4"), np.zeros(len(high), kind)
        prints[at] = low.astype(np.uint32)
        stored[at] = np.minimum(counts, np.iinfo(kind).max)
        return cls(hashed, prints, stored)

    def count(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Counts of these keys; 0 for a key whose fingerprint is not the one at its place."""
        at = self.hashed.places(high, low)
        found = np.zeros(len(high), np.int64)
        known = at >= 0
        known[known] = self.prints[at[known]] == low[known].astype(np.uint32)
        found[known] = self.counts[at[known]]
        return found

    def dump(self) -> tuple[bytes, bytes, bytes, bytes]:
        return tuple(a.tobytes() for a in (self.hashed.sizes, self.hashed.bits, self.prints, self.counts))

    @classmethod
    def load(cls, sizes: bytes, bits: bytes, prints: bytes, counts: bytes, kind: str) -> CountIndex:
        hashed = PerfectHash(np.frombuffer(sizes, "<i8"), np.frombuffer(bits, "<u8"))
        return cls(hashed, np.frombuffer(prints, "<u4"), np.frombuffer(counts, kind))


def counter_kind(most: int) -> str:
    """The smallest unsigned integer that tells counts below ``most`` from others."""
    return next(k for k in ("<u1", "<u2", "<u4", "<u8") if np.iinfo(k).max >= most)
