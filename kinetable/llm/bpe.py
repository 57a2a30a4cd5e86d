"""Byte-level BPE: encoding by an index from each pair to its positions, and decoding."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The cuts of the file's pre-tokenizer, and Unicode's white space, which its \s stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: Chunks whose ids a worker remembers; code points that are read before the new chunks among them are encoded; rows in one output batch.
MEMO, READ_CHARS, OUT_ROWS = 500_000, 48 << 20, 256


def byte_letters() -> dict[str, int]:
    """The letter that the file writes for each byte: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """The vocabulary and merges of a byte-level BPE file, with the words encoded lately.

    No match of the pre-tokenizer goes on from a visible character to white
    space, so a text falls into chunks, white space and what follows it, that
    are cut and encoded apart from each other. Distinct words are encoded
    together (``merge``).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        pre = spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or odd:
            raise ValueError("only byte-level BPE without prefix space, normalizer or special options")
        self.vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t for t in spec.get("added_tokens", [])}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added.values()):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = {c: t["id"] for c, t in added.items()}
        self.cut_added = re.compile("|".join(re.escape(c) for c in sorted(added, key=len, reverse=True))) if added else None
        size = 1 + max([*self.vocab.values(), *self.added.values()])
        self.text: list[bytes] = [b""] * size
        for t, i in self.vocab.items():
            self.text[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        for t, i in self.added.items():
            self.text[i] = t.encode()
        self.byte_id = np.full(256, -1, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = self.vocab.get(c, -1)
        if (self.byte_id < 0).any():
            raise ValueError("a byte has no token")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        latest = np.full(size, -1, np.int64)
        np.maximum.at(latest, self.made, np.arange(len(pairs)))
        if (latest[self.left] >= np.arange(len(pairs))).any() or (latest[self.right] >= np.arange(len(pairs))).any():
            raise ValueError("a merge stands before the merges that make its parts")
        key = self.left << 32 | self.right
        self.order = np.argsort(key, kind="stable")
        self.keys = np.append(key[self.order], np.int64(1 << 62))
        self.ranks = np.append(self.order, -1)
        self.cut = regex.compile(PATTERN)
        self.chunk = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.memo: dict[str, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, -1 if there is none. Symbols under 0 are word borders."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.ranks[at], -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit numbers, all words at once.

        The words' symbols stand behind each other with borders between. An
        index maps every pair that has a merge to all its positions. Of the
        ranks in the index the lowest is applied next: at each position that
        still holds its pair, from left to right, the right symbol goes, and
        the pairs that the new symbol forms with its neighbours are entered
        at their positions. Merges stand behind those that make their parts,
        so the ranks entered are higher than the rank applied.
        """
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes + np.arange(1, len(words) + 1)
        total = int(sizes.sum()) + len(words) + 1
        sym = np.full(total, -1, np.int64)
        at = np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(words) + 1), sizes)
        sym[at] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(a: np.ndarray, b: np.ndarray, where: np.ndarray) -> None:
            r = self.rank(a, b)
            has = r >= 0
            if not has.any():
                return
            r, where = r[has], where[has]
            order = np.argsort(r, kind="stable")
            r, where = r[order], where[order]
            edges = np.flatnonzero(r[1:] != r[:-1]) + 1
            low = 0
            for high in [*edges.tolist(), len(r)]:
                k = int(r[low])
                if k in index:
                    index[k].append(where[low:high])
                else:
                    index[k] = [where[low:high]]
                    heapq.heappush(heap, k)
                low = high

        enter(sym[:-1], sym[1:], np.arange(total - 1))
        while heap:
            k = heapq.heappop(heap)
            lists = index.pop(k)
            a, b, new = self.left[k], self.right[k], self.made[k]
            p = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            p = p[sym[p] == a]
            p = p[sym[after[p]] == b]
            if a == b and len(p) > 1:
                # Of a row of equal symbols every other position counts, from its left end.
                joined = np.append(False, after[p[:-1]] == p[1:])
                place = np.arange(len(p))
                p = p[(place - np.maximum.accumulate(np.where(joined, 0, place))) % 2 == 0]
            if not len(p):
                continue
            gone = after[p]
            right, left = after[gone], before[p]
            sym[p], sym[gone] = new, -2
            after[p], before[right] = right, p
            full = np.full(len(p), new)
            # Where two merged places touch, the pair of both new symbols is entered from the left one and again from the right one; one counts.
            enter(full, sym[right], p)
            enter(sym[left], full, left)
        alive = np.flatnonzero(sym >= 0)
        raw = sym[alive].astype("<u4").tobytes()
        cuts = (4 * np.searchsorted(alive, np.append(starts, total))).tolist()
        return [raw[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def parts(self, text: str) -> list[str | int]:
        """Text between added tokens, and the added tokens' ids."""
        if self.cut_added is None or not self.cut_added.search(text):
            return [text]
        out: list[str | int] = []
        low = 0
        for m in self.cut_added.finditer(text):
            out += [text[low : m.start()], self.added[m.group()]]
            low = m.end()
        return [*out, text[low:]]

    def learn(self, texts: Iterable[str]) -> None:
        """Remembers the ids of all chunks of ``texts``; forgets others where there are too many."""
        fresh: set[str] = set()
        for t in texts:
            for x in self.parts(t):
                if isinstance(x, str):
                    fresh.update(self.chunk.findall(x))
        new = [c for c in fresh if c not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(fresh)
        cut = [self.cut.findall(c) for c in new]
        words = list({w for ws in cut for w in ws})
        ids = dict(zip(words, self.merge([w.encode() for w in words]), strict=True))
        self.memo.update((c, ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])) for c, ws in zip(new, cut, strict=True))

    def ids(self, text: str) -> bytes:
        """The ids of a text whose chunks are remembered."""
        out = []
        for x in self.parts(text):
            out += [self.memo[c] for c in self.chunk.findall(x)] if isinstance(x, str) else [int(x).to_bytes(4, "little")]
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit numbers."""
        self.learn(texts)
        return [self.ids(t) for t in texts]

    def decode(self, ids: bytes) -> str:
        """The text of ids, with U+FFFD for bytes that are no UTF-8. An id without a token stands for nothing."""
        text, n = self.text, len(self.text)
        return b"".join([text[i] if i < n else b"" for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _bpe(path: str) -> Bpe:
    return Bpe(path)


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges with about READ_CHARS bytes of text; a longer text is a range of its own."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0))
    low = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > low and total + n > READ_CHARS:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(sizes):
        yield low, len(sizes)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit numbers).

    Whole texts are encoded as the tokenizers library does with the same file
    and no special tokens added; the file's own added tokens are found in the
    text as there. A null or empty text has no ids. ``with_text`` adds
    ``decoded``, the text that ``decode`` makes of the ids, in the same pass.
    Repeated rows, null ids and other columns do not matter. A task holds the
    distinct words of READ_CHARS bytes of text, or of one longer text, at once.
    """
    kind = "doc_id long, n_tokens long, ids binary" + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            for low, high in _groups(batch.column(1)):
                part = batch.slice(low, high - low)
                rows = lambda k, p=part: [x or "" for x in p.column(1).slice(k, OUT_ROWS).to_pylist()]
                bpe.learn(t for k in range(0, part.num_rows, OUT_ROWS) for t in rows(k))
                for k in range(0, part.num_rows, OUT_ROWS):
                    ids = [bpe.ids(t) for t in rows(k)]
                    cols = [part.column(0).slice(k, OUT_ROWS), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                    if with_text:
                        cols.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"][: len(cols)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kind)


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows with ids as ``encode`` gives them; null ids have a null text.

    Bytes that do not form UTF-8 become U+FFFD, and ids that the file does not have stand for nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            for k in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(k, OUT_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else bpe.decode(x) for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
