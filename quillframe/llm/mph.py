"""Minimal perfect hashing of a set of byte-string keys, with stored fingerprints.

Keys are hashed into levels of bit arrays; a key rests on the first level where
no other key shares its bit, and its slot is the number of set bits before it.
Both building and lookup are vectorised; a lookup reads a bounded number of
positions, two on average.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bits for each key left on a level.
GAMMA = 2.0
#: After so many levels the keys left (none in practice) are numbered by their full hash.
LEVELS = 48


def key_hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a 128-bit hash of each key."""
    both = [xxhash.xxh3_128_intdigest(k) for k in keys]
    return np.array([h & 0xFFFFFFFFFFFFFFFF for h in both], np.uint64), np.array([h >> 64 for h in both], np.uint64)


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a + b * np.uint64(2 * level + 1)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """Slots 0 to n-1 for n different keys."""

    def __init__(self, sizes: list[int], words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.starts = np.concatenate([[0], np.cumsum([-(-s // 64) for s in sizes])]).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> MinimalPerfectHash:
        sizes, levels = [], []
        for level in range(LEVELS):
            if not len(a):
                break
            size = max(64, int(len(a) * GAMMA))
            at = _mix(a, b, level) % np.uint64(size)
            _, back, n = np.unique(at, return_inverse=True, return_counts=True)
            alone = n[back] == 1
            bits = np.zeros(-(-size // 64) * 64, np.uint8)
            bits[at[alone].astype(np.int64)] = 1
            sizes.append(size)
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            a, b = a[~alone], b[~alone]
        rest = np.sort(a)
        if len(np.unique(rest)) < len(rest):
            raise ValueError("keys repeat")
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"), rest)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that rest on no level."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, size in enumerate(self.sizes):
            if not len(left):
                return out
            at = (_mix(a[left], b[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.starts[level] + (at >> 6), (at & 63).astype(np.uint64)
            found = (self.words[word] >> bit & np.uint64(1)).astype(bool)
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[found]] = (self.before[word] + np.bitwise_count(below))[found]
            left = left[~found]
        if len(self.rest) and len(left):
            at = np.searchsorted(self.rest, a[left])
            there = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == a[left])
            out[left[there]] = self.before[-1] + at[there]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), len(self.rest), *self.sizes], "<u8")
        return head.tobytes() + self.rest.astype("<u8").tobytes() + self.words.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalPerfectHash:
        n, m = np.frombuffer(data, "<u8", 2).tolist()
        sizes = np.frombuffer(data, "<u8", n, 16).tolist()
        rest = np.frombuffer(data, "<u8", m, 16 + 8 * n)
        return cls(sizes, np.frombuffer(data, "<u8", -1, 16 + 8 * (n + m)), rest)
