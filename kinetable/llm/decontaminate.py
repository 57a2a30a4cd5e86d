"""Benchmark decontamination: SimHash windows of item size, Hamming blocks, exact shingle similarity."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinetable.llm.common import stage

#: Words of benchmark text that one pass over the documents looks for.
PASS_WORDS = 500_000

#: 64 bits in 8 blocks: two fingerprints within 23 bits differ by at most 2 in some block.
RADIUS, BLOCKS = 23, 8
BLOCK_BITS = 64 // BLOCKS
NEAR = RADIUS // BLOCKS

SIEVE_BITS = 22

#: Windows whose bits are summed at once.
CHUNK = 4096

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


def word_id(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode())


def shingles(ids: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` word ids; shorter sequences are one shingle.

    Equal runs have equal numbers; others agree once in 2**64.
    """
    n = max(1, len(ids) - size + 1)
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(min(size, len(ids))):
        out = (out ^ ids[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _signs(x: np.ndarray) -> np.ndarray:
    """64 signs for each shingle."""
    y = (x ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB)
    y ^= y >> np.uint64(29)
    y *= np.uint64(0x8EBC6AF09C88C6E3)
    y ^= y >> np.uint64(32)
    return np.unpackbits(y.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _numbered(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers for the ``at``-th occurrence (from 1) of shingles in a window; the first keeps its own.

    A weighted set becomes a plain one: two windows share as many numbered
    shingles as the minimum of the weights, so a shingle that comes often moves
    as many fingerprint bits as others of its weight, not one direction alone.
    """
    return x + (at - 1).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)


def _occurrences(x: np.ndarray) -> np.ndarray:
    """Which occurrence of its value each place of a sorted array is, from 1."""
    place = np.arange(len(x))
    return place - np.maximum.accumulate(np.where(np.concatenate([[True], x[1:] != x[:-1]]), place, 0)) + 1


def _bits(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


@dataclass
class Sized:
    """The items of one number of words, with their fingerprints indexed by blocks."""

    items: np.ndarray  # places among all items
    prints: np.ndarray
    starts: np.ndarray  # by block and value, where its fingerprints begin in ``near``
    near: np.ndarray  # those within NEAR bits in that block


@dataclass
class Items:
    """One pass's items, as sent to every task; bounded by PASS_WORDS."""

    ids: list  # item_id
    vocabulary: dict[str, int]
    parts: list[np.ndarray]  # sorted shingles of each item, repeats included
    sized: dict[int, Sized]
    known: np.ndarray  # all items' shingles, sorted
    sieve: np.ndarray  # by first bits: whether any of them begins so
    lengths: list[int]  # words in their shingles


def _blocks(prints: np.ndarray) -> np.ndarray:
    """The value of each block (columns)."""
    return prints[:, None] >> (np.arange(BLOCKS, dtype=np.uint64) * np.uint64(BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)


def _index(items: np.ndarray, prints: np.ndarray) -> Sized:
    values = np.arange(1 << BLOCK_BITS, dtype=np.uint64)
    near = np.bitwise_count(values[None, :, None] ^ _blocks(prints).T[:, None, :]) <= NEAR
    counts = near.sum(axis=2).ravel()
    return Sized(items, prints, np.concatenate([[0], np.cumsum(counts)]), np.nonzero(near.reshape(-1, len(prints)))[1])


def prepare(rows: list[tuple], size: int) -> Items:
    vocabulary: dict[str, int] = {}
    ids, sizes, parts = [], [], []
    for item, text in rows:
        own = words(text)
        if not own:
            continue
        vocabulary.update((w, word_id(w)) for w in own)
        seq = np.array([vocabulary[w] for w in own], np.uint64)
        ids.append(item)
        sizes.append(len(own))
        parts.append(np.sort(shingles(seq, size)))
    prints = _bits(np.array([_signs(_numbered(p, _occurrences(p))).sum(axis=0) for p in parts])) if parts else np.zeros(0, np.uint64)
    sized = {n: _index(at := np.flatnonzero(np.array(sizes) == n), prints[at]) for n in sorted(set(sizes))}
    known = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[known >> np.uint64(64 - SIEVE_BITS)] = True
    return Items(ids, vocabulary, parts, sized, known, sieve, sorted({min(n, size) for n in sizes}))


def _same(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two sorted multisets: a shingle weighs as often as it occurs."""
    va, na = np.unique(a, return_counts=True)
    vb, nb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    both = int(np.minimum(na[i], nb[j]).sum())
    return both / (len(a) + len(b) - both)


def matches(text: str | None, items: Items, size: int, least: float) -> list[tuple[int, int, int, float, int]]:
    """(item, first word, words, similarity, differing bits) of the best window of each item found."""
    if not items.ids:
        return []
    own = words(text)
    if not own:
        return []
    # A window as similar as asked to an item has so many of its shingles in common with it, so at
    # least as many that occur in any item; windows with fewer need no fingerprint. Most texts have
    # none, which shows without hashing the words that no item has.
    get = items.vocabulary.get
    ids = np.fromiter(map(get, own, repeat(0)), np.uint64, len(own))
    counts = {}
    for k in items.lengths:
        sh = shingles(ids, k)
        maybe = np.flatnonzero(items.sieve[sh >> np.uint64(64 - SIEVE_BITS)])
        maybe = maybe[items.known[np.searchsorted(items.known, sh[maybe]).clip(max=len(items.known) - 1)] == sh[maybe]]
        counts[k] = np.zeros(len(sh) + 1, np.int64)
        counts[k][maybe + 1] = 1
        counts[k] = np.cumsum(counts[k])
    found: dict[int, tuple[int, int, int, float, int]] = {}
    full = None
    for n, index in items.sized.items():
        k = min(n, size)  # items of fewer words are one shorter shingle
        count = counts[k]
        width, own_parts = max(1, min(n, len(ids)) - k + 1), n - k + 1  # shingles in a window, in the item
        need = max(1, math.ceil(least * (width + own_parts) / (1 + least) - 1e-9))
        if count[-1] < need:
            continue
        starts = np.flatnonzero(count[width:] - count[:-width] >= need)
        if not len(starts):
            continue
        if full is None:
            full = np.array([get(w) or word_id(w) for w in own], np.uint64)
        sh = shingles(full, k)
        for low in range(0, len(starts), CHUNK):
            part = starts[low : low + CHUNK]
            at, which, bits = _candidates(_window_prints(sh, part, width), index)
            for i in np.unique(which).tolist():
                own_at = which == i
                best = _verify(sh, part[at[own_at]], width, items.parts[index.items[i]], least)
                item = int(index.items[i])
                if best is not None and (item not in found or (best[1], -best[0]) > (found[item][3], -found[item][1])):
                    found[item] = (item, best[0], min(n, len(ids)), best[1], int(bits[own_at][part[at[own_at]] == best[0]][0]))
    return list(found.values())


def _window_prints(sh: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of the windows at ``starts``, summed over each stretch of near starts.

    Where shingles repeat in a window, sums of first occurrences are corrected:
    a window that moves by one place gains the last occurrence of the shingle
    that enters and loses the last one of the shingle that leaves.
    """
    out = np.empty(len(starts), np.uint64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(starts) > width) + 1, [len(starts)]])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        first = starts[a]
        part = sh[first : starts[b - 1] + width]
        sums = np.cumsum(_signs(part), axis=0, dtype=np.int32)
        sums = np.concatenate([np.zeros((1, 64), np.int32), sums])
        own = starts[a:b] - first
        sums = sums[own + width] - sums[own]
        order = np.argsort(part, kind="stable")
        near = np.flatnonzero((part[order][1:] == part[order][:-1]) & (np.diff(order) < width))
        if len(near):
            sums = sums + _repeats(part, order, width)[own]
        out[a:b] = _bits(sums)
    return out


def _repeats(part: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """By start of a window, what numbering its shingles adds to the sum of their signs."""
    n = len(part)
    value = np.empty(n, np.int64)  # equal shingles have one number
    value[order] = np.cumsum(np.concatenate([[False], part[order][1:] != part[order][:-1]]))
    keys = value[order] * (n + 1) + order  # sorted: by value, then place
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    place = np.arange(n)
    # Occurrences in the window that ends with a place, and in the one that begins with it.
    ending = rank - np.searchsorted(keys, value * (n + 1) + np.maximum(place - width + 1, 0)) + 1
    starting = np.searchsorted(keys, value * (n + 1) + np.minimum(place + width, n)) - rank
    change = np.zeros((n - width + 1, 64), np.int32)

    def extra(at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return _signs(_numbered(part[at], count[at])) - _signs(part[at])

    at = np.flatnonzero(ending > 1)
    for low in range(0, len(at), CHUNK):
        # All that enter before the first window is whole count for it.
        x = at[low : low + CHUNK]
        np.add.at(change, np.maximum(x - width + 1, 0), extra(x, ending))
    at = np.flatnonzero((starting > 1) & (place < n - width))
    for low in range(0, len(at), CHUNK):
        x = at[low : low + CHUNK]
        change[x + 1] -= extra(x, starting)
    return np.cumsum(change, axis=0, dtype=np.int32)


def _candidates(prints: np.ndarray, index: Sized) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, differing bits) of all within RADIUS, by looking up every block."""
    key = (_blocks(prints).astype(np.int64) + (np.arange(BLOCKS) << BLOCK_BITS)).ravel()
    first, n = index.starts[key], index.starts[key + 1] - index.starts[key]
    w = np.repeat(np.arange(len(key)) // BLOCKS, n)
    i = index.near[np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)]
    d = np.bitwise_count(prints[w] ^ index.prints[i])
    pair = np.unique((w * len(index.prints) + i)[d <= RADIUS])  # met in several blocks
    w, i = pair // len(index.prints), pair % len(index.prints)
    return w, i, np.bitwise_count(prints[w] ^ index.prints[i])


def _verify(sh: np.ndarray, starts: np.ndarray, width: int, item: np.ndarray, least: float) -> tuple[int, float] | None:
    """The first of the most similar windows, and its similarity, if that reaches ``least``."""
    low, high = int(starts[0]), int(starts[-1]) + width
    own = sh[low:high]
    inside = item[np.searchsorted(item, own).clip(max=len(item) - 1)] == own
    count = np.concatenate([[0], np.cumsum(inside)])
    both = np.minimum(count[starts - low + width] - count[starts - low], len(item))  # as if nothing repeated: a bound
    bound = both / (width + len(item) - both)
    best = None
    for k in np.lexsort((starts, -bound)).tolist():
        if bound[k] < least or best is not None and bound[k] <= best[1]:
            break
        s = _same(np.sort(sh[starts[k] : starts[k] + width]), item)
        if s >= least and (best is None or s > best[1] or s == best[1] and starts[k] < best[0]):
            best = int(starts[k]), s
    return best


def item_passes(bench: DataFrame, id_col: str, text_col: str, size: int, pass_words: int = PASS_WORDS) -> Iterator[Items]:
    """The benchmark in parts of at most ``pass_words`` words (or one longer item), so that what is sent to tasks is bounded."""
    rows = bench.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    # Items are cut into passes by size classes of a hash: each holds about half of the bound.
    total = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    passes = max(1, -(-total // (pass_words * 3)))
    rows = stage(rows.withColumn("pass", F.pmod(F.xxhash64("item", "text"), F.lit(passes))))
    for p in range(passes):
        yield prepare([(r["item"], r["text"]) for r in rows.filter(F.col("pass") == p).sort("item", "text").collect()], size)


def _hits(docs: DataFrame, bench: DataFrame, cols: list, kind: str, make, bench_id: str, bench_text: str, size: int) -> DataFrame:
    spark = docs.sparkSession
    out = None
    for items in item_passes(bench, bench_id, bench_text, size):
        sent = spark.sparkContext.broadcast(items)
        part = docs.select(*cols).mapInArrow(make(sent), kind)
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text", size: int = 5, least: float = 0.8
) -> DataFrame:
    """Pairs of a document and an item it contains: doc_id, item_id, first_word, n_words, similarity, differing_bits.

    A document contains an item if one of its windows of as many words as the
    item has (the whole document, if that is shorter) reaches a weighted
    Jaccard similarity of ``least`` over shingles of ``size`` words; the best
    window is returned, the first one of equals. Words are lower-cased runs of
    letters and digits, so case, punctuation and line breaks do not matter. A
    window is compared with the items whose SimHash differs in at most 23 of 64
    bits; at similarity 0.8 more differ in about one window of 100,000, whether
    or not shingles repeat, as each occurrence counts as a shingle of its own.
    Null, empty and wordless texts, of documents or items, match nothing. Rows
    that repeat are judged row by row. Other columns do not matter. Extra
    passes over the documents are made only for a benchmark too large for one.
    """
    item_type = bench.schema[bench_id].dataType.simpleString()
    arrow_item = to_arrow_type(bench.schema[bench_id].dataType)

    def make(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                row, got = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    m = matches(text, items, size, least)
                    row += [i] * len(m)
                    got += m
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())), pa.array([items.ids[g[0]] for g in got], arrow_item), pa.array([g[1] for g in got], pa.int64()),
                        pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.float64()), pa.array([g[4] for g in got], pa.int32()),
                    ], ["doc_id", "item_id", "first_word", "n_words", "similarity", "differing_bits"],
                )

        return run

    kind = f"doc_id long, item_id {item_type}, first_word long, n_words long, similarity double, differing_bits int"
    return _hits(docs, bench, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")], kind, make, bench_id, bench_text, size)


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` without the rows that ``contaminated`` would return; columns and other rows stay as they are."""
    at = docs.columns.index(text_col)
    for items in item_passes(bench, bench_id, bench_text, size):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not matches(x, sent.value, size, least) for x in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
