"""Spelling variants: words one edit apart, found by one-edit neighbourhoods over a reduced alphabet."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import stage, task_count

#: Fixed value: the letters that words are made of.
LETTERS = "A-Za-zÀ-ÿ"

#: Words that a task counts before it hands them on, words with one reduced word before they are compared letter by letter, numbers made at once.
COUNTED, CLASS_WORDS, MADE = 400_000, 64, 1_000_000

#: Rows of a task that makes neighbourhoods.
TASK_WORDS = 5_000

_BASE, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop: int = 199, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """word and n of the words of whole texts.

    A word is a maximal run of letters with A-Z lower-cased. h is the crc32 of
    ``<id>:<run>`` (a null id is empty); where ``drop`` divides it, the run
    loses its code point h % length, a run of one its only one. Words of fewer
    than ``min_chars`` code points or ``min_count`` occurrences do not count.
    """
    runs = re.compile(f"[{LETTERS.replace('A-Z', '')}]{{{min_chars},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = x.as_py()
                if not text:
                    continue
                own = Counter(runs.findall(text.encode().lower().decode()))
                before = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), before)
                    if h % drop == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_chars:
                            continue
                    total[word] += n
                if len(total) > COUNTED:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _symbol(points: np.ndarray, symbols: int | None) -> np.ndarray:
    """The symbol of each code point; with None every code point is its own."""
    if symbols is None:
        return points.astype(np.int64)
    return ((points.astype(np.int64) * 0x9E3779B1 & 0xFFFFFFFF) >> 13) % symbols


def _value(symbol: np.ndarray) -> np.ndarray:
    """A 64-bit number for each symbol."""
    x = (symbol.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _BASE)))


def _sized(n: int) -> np.uint64:
    """What a length adds to a number."""
    return np.uint64(n * int(_LENGTH) & 0xFFFFFFFFFFFFFFFF)


def number(values: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row of symbols' values: a polynomial of them, and their count."""
    n = values.shape[1]
    return (values * _powers(n)[:n][::-1]).sum(axis=1, dtype=np.uint64) + _sized(n)


def neighbourhood(values: np.ndarray, every: np.ndarray) -> np.ndarray:
    """The numbers of each row of symbols and of all rows that one symbol inserted, deleted or replaced makes of it, each once.

    ``every`` holds the values of all symbols. Positions that give what another
    one gives have the mask False in the second result.
    """
    m, n = values.shape
    power = _powers(n + 1)
    before = np.zeros((m, n + 1), np.uint64)  # polynomial of the first i
    for i in range(n):
        before[:, i + 1] = before[:, i] * _BASE + values[:, i]
    after = np.zeros((m, n + 1), np.uint64)  # of those from i on
    for i in range(n - 1, -1, -1):
        after[:, i] = after[:, i + 1] + values[:, i] * power[n - 1 - i]
    keys, keep = [number(values)[:, None]], [np.ones((m, 1), bool)]
    i = np.arange(n)
    keys.append(before[:, :n] * power[n - 1 - i] + after[:, 1:] + _sized(n - 1))
    keep.append(np.append(np.ones((m, min(n, 1)), bool), values[:, 1:] != values[:, :-1], axis=1))  # of equal ones the first goes
    for v in every:
        keys.append(before[:, :n] * power[n - i] + v * power[n - 1 - i] + after[:, 1:] + _sized(n))
        keep.append(values != v)
        j = np.arange(n + 1)
        keys.append(before * power[n + 1 - j] + v * power[n - j] + after + _sized(n + 1))
        keep.append(np.append(values != v, np.ones((m, 1), bool), axis=1))  # before an equal one is the same as behind it
    return np.concatenate(keys, axis=1), np.concatenate(keep, axis=1)


def _by_length(words: list[str], symbols: int | None) -> Iterator[tuple[list[int], np.ndarray]]:
    """Rows of words of one length, and their symbols' values."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, rows in groups.items():
        points = np.frombuffer("".join(words[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), n)
        yield rows, _value(_symbol(points, symbols))


def _numbered(words: DataFrame, symbols: int | None) -> DataFrame:
    """``words`` (word, n) with key, the number of the reduced word, and red, the reduced word itself as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_pylist()
            keys, red = np.zeros(len(own), np.uint64), [b""] * len(own)
            for rows, values in _by_length(own, symbols):
                keys[rows] = number(values)
                for i, v in zip(rows, values, strict=True):
                    red[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys.view(np.int64)), pa.array(red, pa.binary())], ["word", "n", "key", "red"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long, red binary")


def _links(reduced: DataFrame, rows: int, every: np.ndarray) -> DataFrame:
    """src, dst: the number of each reduced word (red) and of everything in its neighbourhood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups: dict[int, list[bytes]] = {}
            for x in b.column(0).to_pylist():
                groups.setdefault(len(x), []).append(x)
            for n, words in groups.items():
                some = max(1, MADE // (len(every) * (n + 1)))
                for low in range(0, len(words), some):
                    values = np.frombuffer(b"".join(words[low : low + some]), np.uint64).reshape(-1, n // 8)
                    keys, keep = neighbourhood(values, every)
                    src = np.repeat(number(values), keep.sum(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(keys[keep].view(np.int64))], ["src", "dst"])

    return reduced.select("red").repartition(task_count(reduced.sparkSession, rows, TASK_WORDS)).mapInArrow(run, "src long, dst long")


def _near(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """word, near, n: pairs of words of ``left`` and ``right`` with linked numbers that are one edit apart."""
    keys = right.select(F.col("key").alias("dst")).distinct()
    pairs = links.join(keys, "dst", "left_semi").distinct()
    own = left.select(F.col("key").alias("src"), "word")
    other = right.select(F.col("key").alias("dst"), F.col("word").alias("near"), "n")
    return pairs.join(own, "src").join(other, "dst").filter(F.levenshtein("word", "near", 1) == 1).select("word", "near", "n")


def _alphabet(words: DataFrame) -> np.ndarray:
    """Values of all letters that occur: one row a letter, and letters are few."""
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect()
    return _value(_symbol(np.array(sorted(ord(r.c) for r in letters), np.int64), None))


def near_words(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """word, near, n: every ordered pair of ``words`` (word, n; each once) that are one code point inserted, deleted or replaced apart.

    Letters are hashed to a few symbols. Words one edit apart have reduced
    words at most one edit apart, so each is in the other's neighbourhood:
    that of every distinct reduced word is generated whole and joined with the
    reduced vocabulary, and what meets is compared letter by letter. The
    number of symbols follows the vocabulary's size, so that few words share a
    reduced word. Words that more than CLASS_WORDS share are not paired with
    each other: their neighbourhoods are generated over the full alphabet.
    """
    n = words.count()
    symbols = symbols or min(24, max(4, round(n ** (1 / 7))))
    every = _value(np.arange(symbols))
    own = stage(_numbered(words, symbols))
    classes = own.groupBy("red").agg(F.count("*").alias("m"), F.first("key").alias("key"))
    classes = stage(classes)
    crowded = classes.filter(F.col("m") > CLASS_WORDS)
    few = classes.filter(F.col("m") <= CLASS_WORDS)
    if crowded.isEmpty():
        return _near(_links(few, n, every), own, own)
    calm = own.join(crowded.select("red"), "red", "left_anti")
    out = _near(_links(few, n, every), calm, calm)
    whole = stage(_numbered(words, None))
    busy = stage(own.join(crowded.select("red"), "red", "left_semi").select("word").join(whole, "word"))
    found = stage(_near(_links(busy, busy.count(), _alphabet(words)), busy, whole))
    sizes = words.select(F.col("word"), F.col("n").alias("own"))
    back = found.join(sizes, "word").select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("own").alias("n"))
    # Pairs of two busy words are found from both sides.
    return out.union(found.union(back).distinct())


def _followed(forms: DataFrame) -> DataFrame:
    """word and root: the end of the chain of forms (word, form). Each round doubles the steps; n grows along a chain, so it ends."""
    now = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stage(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = 5, symbols: int | None = None) -> DataFrame:
    """One row per word of ``words`` (word, n): word, form, root, n, n_near, form_n.

    n_near counts the words one edit apart. The form is the one of these with
    the largest n, of several the smallest in code-point order, if its n is at
    least ``ratio`` (more than 1) times the word's; else null, and form_n with
    it. root follows forms to the last word, which may be the word itself.
    """
    if ratio <= 1:
        raise ValueError("ratio has to be more than 1, so that forms lead to larger counts")
    words = stage(words)
    near = near_words(words, symbols)
    best = stage(near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("b")))
    full = words.join(best, "word", "left")
    fits: Column = -F.col("b.less") >= F.col("n") * ratio
    full = stage(full.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("b.near")).alias("form"), F.when(fits, -F.col("b.less")).alias("form_n")))
    roots = _followed(full.filter("form IS NOT NULL"))
    return full.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of ``docs`` grouped by ``variants``; what a word is ``word_counts`` says.

    Null and empty texts have no words, rows that repeat each count, a null id
    enters the hash as nothing, texts are read whole, and other columns do not
    matter. An empty table has no words.
    """
    return variants(word_counts(docs, id_col, text_col))
