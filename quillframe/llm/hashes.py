"""XXH64 of many slices of a text at once."""

from __future__ import annotations

import numpy as np
import xxhash

_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _xxh64(buffer: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """XXH64 (seed 0) of the ``size`` bytes, under 32, that begin at each start."""
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buffer, size)[starts])
    out = np.full(len(starts), (_P5 + size) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while size - at >= 8:
            lane = np.ascontiguousarray(rows[:, at : at + 8]).view("<u8")[:, 0].astype(np.uint64)
            out = _rotated(out ^ _rotated(lane * np.uint64(_P2), 31) * np.uint64(_P1), 27) * np.uint64(_P1) + np.uint64(_P4)
            at += 8
        if size - at >= 4:
            lane = np.ascontiguousarray(rows[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64)
            out = _rotated(out ^ lane * np.uint64(_P1), 23) * np.uint64(_P2) + np.uint64(_P3)
            at += 4
        for i in range(at, size):
            out = _rotated(out ^ rows[:, i].astype(np.uint64) * np.uint64(_P5), 11) * np.uint64(_P1)
        out = (out ^ (out >> np.uint64(33))) * np.uint64(_P2)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(_P3)
        return out ^ (out >> np.uint64(32))


def slice_hashes(text: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the slices of a text, those of one size at once; nothing is remembered of them."""
    buffer, out = np.frombuffer(text, np.uint8), np.zeros(len(starts), np.uint64)
    order = np.argsort(np.minimum(sizes, 32).astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(np.minimum(sizes, 32), minlength=33))[:32].tolist()
    a = ends[0]
    out[order[:a]] = xxhash.xxh64_intdigest(b"")
    for size, b in enumerate(ends[1:], 1):
        if a < b:
            out[order[a:b]] = _xxh64(buffer, starts[order[a:b]], size)
        a = b
    for i in order[a:].tolist():
        out[i] = xxhash.xxh64_intdigest(text[starts[i] : starts[i] + sizes[i]])
    return out
