"""A minimal perfect hash over 64-bit keys, built level by level in numpy.

A level has ``2 * keys`` bits; keys alone on their bit are placed there, the
rest go on to the next level. The rank of a key's bit is its slot, so n keys
get exactly the slots 0..n-1. About 3 bits a key plus the ranks.
"""

from __future__ import annotations

import numpy as np

MAX_LEVELS = 64
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((level * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * _MUL
    x = (x ^ (x >> np.uint64(29))) * _MUL
    return x ^ (x >> np.uint64(32))


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct uint64 keys -> (bits of each level, all levels' bits packed)."""
    sizes, bits = [], []
    rest = np.asarray(keys, dtype=np.uint64)
    while len(rest):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("keys repeat")
        m = max(64, -(-2 * len(rest) // 64) * 64)
        at = (_mix(rest, len(sizes)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        sizes.append(m)
        bits.append(alone)
        rest = rest[~alone[at]]
    packed = np.packbits(np.concatenate(bits), bitorder="little") if bits else np.zeros(0, np.uint8)
    return np.array(sizes, dtype=np.int64), packed


class Index:
    """Probes a built hash."""

    def __init__(self, sizes: np.ndarray, packed: np.ndarray):
        self.sizes = np.asarray(sizes, dtype=np.int64)
        self.packed = np.asarray(packed, dtype=np.uint8)
        words = np.bitwise_count(self.packed.view(np.uint64)).astype(np.int64) if len(self.packed) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(words)])

    def __len__(self) -> int:
        return int(self.before[-1])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1, or any slot, for keys that were not built in."""
        keys = np.asarray(keys, dtype=np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        rest, base = np.arange(len(keys)), 0
        for level, m in enumerate(self.sizes):
            if not len(rest):
                break
            at = base + (_mix(keys[rest], level) % np.uint64(m)).astype(np.int64)
            hit = (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            found = at[hit]
            word = self.packed.view(np.uint64)[found >> 6]
            below = word & ((np.uint64(1) << (found & 63).astype(np.uint64)) - np.uint64(1))
            out[rest[hit]] = self.before[found >> 6] + np.bitwise_count(below).astype(np.int64)
            rest, base = rest[~hit], base + int(m)
        return out
