"""Secret scan: patterns, and a battery of randomness tests with false-discovery control."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import stage

#: The kinds in order, and what each matches; matches that are too short are dropped.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
WORDS = ("pass", "secret", "token", "api")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32

#: Shortest run that the battery judges, its level for calling a run not random, and the share of false finds.
MIN_RUN, ALPHA, FALSE_SHARE = 20, 0.001, 0.01

#: Runs are compared with runs of about their own length: classes end below these.
LENGTH_CLASSES = (24, 32, 48, 64, 128, 1 << 62)

#: p-values are counted in bins of this many powers of ten, down to the smallest.
BIN, LAST_BIN = 0.05, 2000

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "letters": LOWER, "LETTERS": UPPER, "base32": UPPER + "234567", "base36": DIGITS + LOWER, "BASE36": DIGITS + UPPER,
    "Letters": UPPER + LOWER, "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
}
_PART = re.compile(r"[A-Za-z0-9]+")
_RUN = np.zeros(128, bool)
_RUN[[ord(c) for c in UPPER + LOWER + DIGITS + "+/-_"]] = True


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    encoding: str | None = None
    p: float | None = None  # chance of so random a run in text like the document's
    battery: float | None = None  # chance of so uneven a run among random ones


def _runs(text: str, least: int) -> list[tuple[int, int]]:
    """Maximal runs of letters, digits and + / - _ of at least ``least`` code points."""
    if text.isascii():
        inside = _RUN[np.frombuffer(text.encode("ascii"), np.uint8)]
    else:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = (points < 128) & _RUN[points & 127]
    gaps = np.flatnonzero(~inside)
    before = np.concatenate([[-1], gaps])
    long = np.flatnonzero(np.diff(np.concatenate([before, [len(inside)]])) > least)
    return [(int(before[k]) + 1, int(gaps[k]) if k < len(gaps) else len(inside)) for k in long]


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer(run: str) -> str | None:
    """The smallest alphabet that holds the run; None for digits alone."""
    own = set(run)
    if own <= set(DIGITS):
        return None
    return next((name for name, a in ALPHABETS.items() if own <= set(a)), None)


def battery(run: str, encoding: str) -> float:
    """Whether the run could be random symbols: the smallest of three p-values, times three.

    Chi-squared uniformity of the alphabet (upper tail), runs above and below
    the middle symbol, and lag-one correlation (both two-sided).
    """
    alphabet = ALPHABETS[encoding]
    x = np.array([alphabet.index(c) for c in run])
    n, k = len(x), len(alphabet)
    chi = float((np.bincount(x, minlength=k) ** 2).sum()) * k / n - n
    # Wilson and Hilferty's cube root of a chi-squared value.
    p_chi = _tail(((max(chi, 0) / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))
    high = x >= k / 2
    a, b = int(high.sum()), n - int(high.sum())
    if a and b:
        mean = 2 * a * b / n + 1
        var = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        p_runs = 2 * _tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    square = float((d * d).sum())
    p_serial = 2 * _tail(abs(float((d[1:] * d[:-1]).sum()) / square + 1 / n) * math.sqrt(n)) if square else 0.0
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


def text_chance(run: str, encoding: str, letters: np.ndarray) -> float:
    """The chance that text with these letter counts (by ASCII code) makes so even a run of this length.

    It is the chance of using no symbol outside the alphabet, times that of so
    few equal pairs of symbols: the uniformity statistic again, seen from text.
    """
    weight = letters[[c for c in range(128) if _RUN[c]]].astype(float) + 0.5
    own = letters[[ord(c) for c in ALPHABETS[encoding]]].astype(float) + 0.5
    n = len(run)
    inside = n * math.log10(own.sum() / weight.sum())
    p = own / own.sum()
    q2, q3 = float((p**2).sum()), float((p**3).sum())
    pairs = sum(c * (c - 1) // 2 for c in map(run.count, set(run)))
    mean = n * (n - 1) / 2 * q2
    var = n * (n - 1) / 2 * (q2 - q2 * q2) + n * (n - 1) * (n - 2) * max(0.0, q3 - q2 * q2)
    even = _tail(-(pairs + 0.5 - mean) / math.sqrt(var))
    return min(1.0, 10 ** max(-300.0, min(0.0, inside) + math.log10(max(even, 1e-300))))


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """Leftmost non-overlapping matches of each pattern; the last two lie within runs."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [Span("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    for kind, pattern, least in (("access", ACCESS, MIN_ACCESS), ("hex", HEX, MIN_HEX)):
        for a, b in runs:
            if b - a >= least:
                out += [Span(kind, m.start(), m.end()) for m in pattern.finditer(text, a, b) if m.end() - m.start() >= least]
    return out


def _parts(text: str, runs: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the battery judges: whole runs with one alphabet that meet no pattern span.

    Of other runs, what lies outside the spans is cut at + / - _; parts of
    MIN_RUN code points or more count.
    """
    spans: list[list[int]] = []  # taken, those that meet as one
    for a, b in sorted(taken):
        if spans and a < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    out, first = [], 0
    for a, b in runs:
        if b - a < MIN_RUN:
            continue
        while first < len(spans) and spans[first][1] <= a:
            first += 1
        free, at, k = [], a, first
        while k < len(spans) and spans[k][0] < b:
            free.append((at, spans[k][0]))
            at = spans[k][1]
            k += 1
        if k == first and infer(text[a:b]) is not None:
            out.append((a, b))
        else:
            out += [m.span() for x, y in [*free, (at, b)] for m in _PART.finditer(text, x, y) if m.end() - m.start() >= MIN_RUN]
    return out


def scan_text(text: str | None) -> list[Span]:
    """Base spans, and every other part of a run that has an encoding, with what the battery and the text say of it."""
    text = text or ""
    runs = _runs(text, min(MIN_ACCESS, MIN_RUN))
    out = base_spans(text, runs)
    rest = _parts(text, runs, [(s.start, s.end) for s in out])
    if rest:
        letters = np.bincount(np.frombuffer(text.encode("ascii", "ignore"), np.uint8), minlength=128)
        for a, b in rest:
            letters = letters - np.bincount(np.frombuffer(text[a:b].encode(), np.uint8), minlength=128)
        for a, b in rest:
            run = text[a:b]
            encoding = infer(run)
            if encoding is not None:
                out.append(Span("random", a, b, encoding, text_chance(run, encoding, letters), battery(run, encoding)))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def length_class(n: int) -> int:
    return next(k for k, end in enumerate(LENGTH_CLASSES) if n < end)


def bin_of(p: float) -> int:
    """Smaller p-values have larger bins; a bin's largest p-value is 10 ** (-BIN * bin)."""
    return min(LAST_BIN, int(-math.log10(max(p, 1e-300)) / BIN))


def cut_offs(counts: dict[tuple[int, int], int], share: float = FALSE_SHARE) -> list[int]:
    """By length class the least bin whose runs are found, from the number of runs by (class, bin).

    Benjamini and Hochberg's step-up over binned p-values: the largest p with
    p * runs <= share * (runs up to p). LAST_BIN + 1 where there is none.
    """
    out = []
    for k in range(len(LENGTH_CLASSES)):
        own = {b: n for (c, b), n in counts.items() if c == k}
        total, seen, best = sum(own.values()), 0, LAST_BIN + 1
        for b in sorted(own, reverse=True):
            seen += own[b]
            if 10 ** (-BIN * b) * total <= share * seen:
                best = b
        out.append(best)
    return out


_KIND = "doc_id long, spans array<struct<kind string, start long, end long, encoding string, p double, battery double>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = FALSE_SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans (kind, start, end, encoding, p, battery) by start and kind.

    Offsets are code points, ends exclusive. Pattern spans always stay. A run
    of letters, digits and + / - _ is added as ``random`` if the battery does
    not reject randomness in its encoding and its chance in the document's own
    text passes the false-discovery control among all such runs of its length
    class in the corpus. Runs that mix the signs of two encodings, such as a
    key at the end of a path, and what pattern spans leave of a run are cut at
    these signs and judged part by part. Null and empty texts have no spans.
    Repeated rows are scanned alike. Other columns do not matter.
    """
    fields = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("p", pa.float64()), ("battery", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[vars(s) for s in scan_text(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(fields))], ["doc_id", "spans"])

    found = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, _KIND))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, p = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([length_class(x) for x in n], pa.int64()), pa.array([bin_of(x) for x in p], pa.int64())], ["class", "bin"])

    judged = found.select(F.explode(F.filter("spans", lambda s: s["kind"] == "random")).alias("s")).select((F.col("s.end") - F.col("s.start")).alias("n"), "s.p")
    bins = judged.mapInArrow(binned, "class long, bin long").groupBy("class", "bin").agg(F.count("*").alias("n"))
    least = cut_offs({(r["class"], r["bin"]): r["n"] for r in bins.collect()}, share)  # classes x bins rows at most

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[s for s in row if s["kind"] != "random" or s["battery"] >= ALPHA and bin_of(s["p"]) >= least[length_class(s["end"] - s["start"])]] for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(fields))], ["doc_id", "spans"])

    return found.mapInArrow(keep, _KIND)


def redact(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones as one, replaced."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, s.end)):
        if s.start >= at:
            out += [text[at : s.start], mark]
        at = max(at, s.end)
    return "".join(out) + text[at:]
