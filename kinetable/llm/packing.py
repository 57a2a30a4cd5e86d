"""Best-fit packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.llm.common import lean, stage

END_ID = 2

#: Fixed value: marks at the end of words.
MARKS = ".,;:!?"

#: Words whose ids a worker remembers, pieces of one block of the numbering.
WORDS = 1_000_000
BLOCK_PIECES = 100_000


class WordCoder:
    """Ids of whole texts by a byte-level BPE file, with repeated words encoded once.

    The pre-tokenizer cuts before a space or line feed that stands between two
    visible characters, and between a letter or digit and punctuation. So a
    text whose spaces and line feeds all stand alone is the sequence of its
    words, each with the space or line feed before it, and a word at the end
    of a clause is the plain word and the mark. Other texts are encoded as a
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        width = {i: len(t) for t, i in self.tokenizer.get_vocab().items()}  # a letter of the byte alphabet a byte
        self.width = np.zeros(max(width) + 1, np.int64)
        self.width[list(width)] = list(width.values())
        self.known: dict[str, bytes | bool] = {}  # False: white space where it does not stand alone
        self.marks: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32).tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Encodes the words in one text and cuts its ids at the words' ends."""
        if not words:
            return {}
        spaced = [w if w[0] == "\n" else " " + w for w in words]
        ids = np.frombuffer(self._plain("".join(spaced)), np.uint32)
        ends = np.cumsum(np.fromiter((len(w.encode()) for w in spaced), np.int64, len(words)))
        reach = np.cumsum(self.width[ids])
        at = np.searchsorted(reach, ends)
        if reach[-1] != ends[-1] or not np.array_equal(reach[at], ends):
            return {w: self._plain(s) for w, s in zip(words, spaced, strict=True)}
        raw, at = ids.tobytes(), (4 * (at + 1)).tolist()
        return {w: raw[a:b] for w, a, b in zip(words, [0, *at[:-1]], at, strict=True)}

    def _learn(self, fresh: set[str]) -> dict[str, bytes | bool]:
        got: dict[str, bytes | bool] = {w: self._plain(w or " ") for w in ("", "\n") if w in fresh}
        ended, plain = [], set()
        for w in fresh.difference(got):
            if w.isalnum():
                plain.add(w)
                continue
            if w[0].isspace() and (w[0] != "\n" or w[1].isspace()) or w[-1].isspace():
                got[w] = False
                continue
            stem = w.rstrip(MARKS)
            if stem != w and stem[-1:].isalnum():
                ended.append((w, stem))
                if stem not in self.known:
                    plain.add(stem)
            else:
                plain.add(w)
        got |= self._words(list(plain))
        for w, stem in ended:
            mark = w[len(stem) :]
            if mark not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks.clear()
                self.marks[mark] = self._plain(mark)
            got[w] = (got.get(stem) or self.known[stem]) + self.marks[mark]
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        # A line feed put before the text makes its first word one like the others; its id is cut off again.
        split = [None if "\n\n" in t or "  " in (x := "\n" + t.replace("\n", " \n")) else x.split(" ") for t in texts]
        # The words of these texts get a dictionary of their own, small enough to stay at hand; each is looked up once among all words.
        words = set().union(*(s for s in split if s))
        here = dict(zip(words, map(self.known.get, words), strict=True))
        got = self._learn({w for w, x in here.items() if x is None})
        here.update(got)
        if len(self.known) + len(got) <= WORDS:
            self.known.update(got)
        out = []
        for t, s in zip(texts, split, strict=True):
            try:
                out.append(self._plain(t) if s is None else b"".join(map(here.__getitem__, s))[4:])
            except TypeError:  # a False among the words
                out.append(self._plain(t))
        return out


@lru_cache(maxsize=2)
def _coder(path: str) -> WordCoder:
    return WordCoder(path)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], np.uint32).tobytes()
    wide = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(coder.encode([x or "" for x in part.column(1).to_pylist()])):
                    ids += end
                    a = 0
                    b = len(ids) % wide or wide  # only the first piece may be shorter
                    k = 0
                    while a < len(ids):
                        x = ids[a:b]
                        row.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(x) // 4)
                        crc.append(zlib.crc32(x))
                        if with_ids:
                            kept.append(np.frombuffer(x, np.uint32).astype(np.int32))
                        a, b, k = b, b + wide, k + 1
                cols = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return lean(run)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece; a null text is empty."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), kind)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """How many pieces of each length go where, from the number of pieces by length.

    Returns runs (length, rank, n, sequence, offset): the pieces of that length
    with ranks rank..rank+n-1 go to sequences sequence..sequence+n-1 at that
    offset. At most ``capacity`` lengths exist, so neither the input nor the
    work grows with the corpus: runs of equal sequences are moved as one.

    Pieces over a third of the capacity fit at most twice into a sequence: from
    the longest down, each is matched with the longest left that fits, which
    makes the most pairs possible. Shorter ones, from the longest down, go to
    the smallest gap that takes them, and open a sequence where none does.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # by what is free: (first sequence, number of sequences)
    used = dict.fromkeys(counts, 0)
    left = {k: int(v) for k, v in counts.items() if v}
    bins = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], n, sequence, offset))
        used[length] += n
        left[length] -= n

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for k in large:
        while left[k]:
            mate = next((m for m in large if left[m] and m + k <= capacity and (m != k or left[k] > 1)), None)
            n = left[k] if mate is None else left[k] // 2 if mate == k else min(left[k], left[mate])
            put(k, n, bins, 0)
            if mate is not None:
                put(mate, n, bins, k)
            gaps.setdefault(capacity - k - (mate or 0), []).append((bins, n))
            bins += n
    for k in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[k]:
            gap = min((g for g in gaps if g >= k and gaps[g]), default=None)
            if gap is None:
                times = max(1, capacity // k)
                n = max(1, left[k] // times)
                gaps.setdefault(capacity, []).append((bins, n))
                bins += n
                continue
            first, n = gaps[gap].pop()
            # As many into each as fit, whole sequences first; the rest fills one more.
            times = min(gap // k, left[k])
            full = min(n, left[k] // times)
            for t in range(times):
                put(k, full, first, capacity - gap + t * k)
            gaps.setdefault(gap - times * k, []).append((first, full))
            if full < n:
                gaps.setdefault(gap, []).append((first + full, n - full))
    return runs


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...).

    Pieces are numbered within their length block by block, so no task orders
    all pieces of one length; the plan of ``plan_bins`` turns a number into a
    place. Numbers are unique whatever rows repeat.
    """
    n = cut.count()
    blocks = max(1, -(-n // BLOCK_PIECES), int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    sizes = stage(cut.groupBy("length", "_block").agg(F.count("*").alias("n")))
    total = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row for each length up to the capacity
    runs = plan_bins(total, capacity)
    plan = np.array(sorted(runs), np.int64).reshape(-1, 5)
    sizes_schema = "length long, _block int, first long"

    def firsts(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        n = table["n"].to_numpy()
        return pa.table({"length": table["length"], "_block": table["_block"], "first": pa.array(np.cumsum(n) - n)})

    first = sizes.groupBy("length").applyInArrow(firsts, sizes_schema)
    names = cut.columns
    out_schema = T.StructType([f for f in cut.schema.fields if f.name != "_block"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan[:, 0] * (1 << 44) + plan[:, 1]
        seen: dict[tuple[int, int], int] = {}
        for b in batches:
            length, block, low = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "_block", "first"))
            # Rows come ordered by (block, length); count on across batches.
            cut_at = np.flatnonzero((np.diff(length) != 0) | (np.diff(block) != 0)) + 1
            start, stop = np.concatenate([[0], cut_at]), np.concatenate([cut_at, [len(length)]])
            rank = low.copy()
            for s, e in zip(start.tolist(), stop.tolist(), strict=True):
                if e > s:
                    k = (int(length[s]), int(block[s]))
                    rank[s:e] += seen.get(k, 0) + np.arange(e - s)
                    seen = {k: seen.get(k, 0) + e - s}
            at = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            where = plan[at]
            cols = [b.column(b.schema.get_field_index(c)) for c in names if c != "_block"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(where[:, 3] + rank - where[:, 1]), pa.array(where[:, 4])], schema=None, names=[f.name for f in out_schema.fields])

    rows = cut.join(first.hint("shuffle_merge"), ["length", "_block"]).select(*names, "first")
    return rows.repartition(blocks, "_block").sortWithinPartitions("_block", "length").mapInArrow(place, out_schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its text's ids (null: none) and ``end_id``. Documents over
    ``capacity`` are cut into pieces of that length, the first one may be
    shorter. Null or repeated ids are documents like any other. Sequences are
    filled from 0 without gaps; see ``plan_bins``. Other columns do not matter.
    """
    return pack(stage(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids)), capacity)
