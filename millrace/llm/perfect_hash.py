"""Minimal perfect hashing of 128-bit keys with numpy.

Level by level every remaining key gets one position in a bit array; keys alone
on their position are settled there, the others go on to the next, smaller
level. A key's index is the number of set bits before its own, so n keys map to
0 .. n-1 at about three bits a key. A key outside the set gets -1 or the index
of another key: the caller compares a fingerprint.
"""

from __future__ import annotations

import struct

import numpy as np

from millrace.llm.common import mix64

#: Positions per remaining key of a level.
SPREAD = 2.0


def _positions(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
    return mix64(high ^ mix64(low + seed)) % np.uint64(size)


class PerfectHash:
    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> "PerfectHash":
        """Hash of distinct (high, low) keys."""
        sizes, levels = [], []
        while len(high):
            if len(sizes) > 200:
                raise ValueError("keys of a perfect hash must be distinct")
            size = -(-max(64, int(SPREAD * len(high))) // 64) * 64
            at = _positions(high, low, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = ~alone[at.astype(np.int64)]
            high, low = high[left], low[left]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    def index(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        out = np.full(len(high), -1, np.int64)
        todo, start = np.arange(len(high)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = _positions(high[todo], low[todo], level, size)
            word = (at >> np.uint64(6)).astype(np.int64) + start
            bit = np.uint64(1) << (at & np.uint64(63))
            hit = (self.words[word] & bit) != 0
            below = np.bitwise_count(self.words[word] & (bit - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (self.before[word] + below)[hit]
            todo, start = todo[~hit], start + size // 64
        return out

    def pack(self) -> bytes:
        return struct.pack(f"<I{len(self.sizes)}Q", len(self.sizes), *self.sizes) + self.words.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> "PerfectHash":
        (n,) = struct.unpack_from("<I", data)
        sizes = list(struct.unpack_from(f"<{n}Q", data, 4))
        return cls(sizes, np.frombuffer(data, np.uint64, offset=4 + 8 * n))
