"""Self-join of 64-bit fingerprints at a Hamming radius by walking pairs of trie nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A node pair of at most so many leaf pairs is compared leaf by leaf.
LEAF_PAIRS = 16


def _expand(lo_a, hi_a, lo_b, hi_b) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of the ranges; of a range with itself those with i < j."""
    wide = hi_b - lo_b
    n = (hi_a - lo_a) * wide
    k = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    i, j = lo_a[k] + at // wide[k], lo_b[k] + at % wide[k]
    keep = (lo_a[k] != lo_b[k]) | (i < j)
    return i[keep], j[keep]


def near_pairs(x: np.ndarray, nodes: tuple[np.ndarray, ...], depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``x`` that differ in at most ``budget`` bits.

    ``x`` is sorted, and ``nodes`` holds (lo_a, hi_a, lo_b, hi_b, differing)
    of the node pairs to start from: ranges that share their first ``depth``
    bits, and in how many of those the two sides differ. Both nodes go one bit
    deeper together; unequal children add one differing bit, and pairs over the
    budget are pruned.
    """
    lo_a, hi_a, lo_b, hi_b, diff = (np.asarray(v, np.int64) for v in nodes)
    while len(lo_a):
        n = (hi_a - lo_a) * (hi_b - lo_b)
        leaf = (n <= LEAF_PAIRS) | (depth >= 64)
        if leaf.any():
            i, j = _expand(lo_a[leaf], hi_a[leaf], lo_b[leaf], hi_b[leaf])
            near = np.bitwise_count(x[i] ^ x[j]) <= budget
            yield i[near], j[near]
            lo_a, hi_a, lo_b, hi_b, diff = (v[~leaf] for v in (lo_a, hi_a, lo_b, hi_b, diff))
        if not len(lo_a):
            return
        ones = np.concatenate([[0], np.cumsum((x >> np.uint64(63 - depth)) & np.uint64(1))]).astype(np.int64)
        mid_a, mid_b = hi_a - (ones[hi_a] - ones[lo_a]), hi_b - (ones[hi_b] - ones[lo_b])
        own = lo_a == lo_b  # a node with itself: its two children make one mixed pair
        parts = [
            (lo_a, mid_a, lo_b, mid_b, diff), (mid_a, hi_a, mid_b, hi_b, diff),
            (lo_a, mid_a, mid_b, hi_b, diff + 1), tuple(v[~own] for v in (mid_a, hi_a, lo_b, mid_b, diff + 1)),
        ]
        lo_a, hi_a, lo_b, hi_b, diff = (np.concatenate(v) for v in zip(*parts, strict=True))
        keep = (hi_a > lo_a) & (hi_b > lo_b) & (diff <= budget) & ((lo_a != lo_b) | (hi_a - lo_a > 1))
        lo_a, hi_a, lo_b, hi_b, diff = (v[keep] for v in (lo_a, hi_a, lo_b, hi_b, diff))
        depth += 1


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of 0..n-1 reaches over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        old = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, old[i], low)
        np.minimum.at(label, old[j], low)
        label = label[label]
        if np.array_equal(label, old):
            return label
