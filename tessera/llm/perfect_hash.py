"""A minimal perfect hash over distinct 32-byte digests, in numpy.

The structure follows the level scheme of Limasset, Rizk, Chikhi and Peterlongo
(2017): at each level every remaining key sets one bit of a table twice as large
as the number of keys; keys that share a bit go on to the next level. A key's
slot is the number of set bits before its own.
"""

from __future__ import annotations

import numpy as np

DIGEST_BYTES = 32
#: Table bits per remaining key.
GAMMA = 2
#: Distinct digests part within a few levels; more than this means equal keys.
MAX_LEVELS = 256


def as_words(digests) -> np.ndarray:
    """An (n, 4) array of 64-bit words of n digests."""
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, DIGEST_BYTES // 8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    return (_mix(words[:, 0] ^ _mix(words[:, 1] + salt)) % np.uint64(size)).astype(np.int64)


class MinimalPerfectHash:
    """Maps each of n distinct keys to its own slot in 0..n-1; other keys to any slot or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.cumsum(bits) - bits for bits in levels]
        self.starts = np.concatenate([[0], np.cumsum([int(bits.sum()) for bits in levels])]).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray) -> MinimalPerfectHash:
        levels, rest = [], words
        while len(rest):
            if len(levels) == MAX_LEVELS:
                raise ValueError("the keys are not distinct")
            size = max(64, GAMMA * len(rest))
            at = _place(rest, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.int64))
            rest = rest[~alone[at]]
        return cls(levels)

    def slots(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, dtype=np.int64)
        open_ = np.arange(len(words))
        for k, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = _place(words[open_], k, len(bits))
            hit = bits[at] == 1
            out[open_[hit]] = self.starts[k] + self.ranks[k][at[hit]]
            open_ = open_[~hit]
        return out

    def pack(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], dtype="<i8").tobytes()
        return head + b"".join(np.packbits(bits.astype(np.uint8)).tobytes() for bits in self.levels)

    @classmethod
    def unpack(cls, blob: bytes) -> MinimalPerfectHash:
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        sizes = np.frombuffer(blob, "<i8", n, 8)
        at, levels = 8 * (n + 1), []
        for size in map(int, sizes):
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, width, at), count=size).astype(np.int64))
            at += width
        return cls(levels)
