"""Toxicity: a convolutional classifier over hashed word embeddings, in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import lean, part_of, sampled

#: Labelled texts that the fit sees at most, about, half of them toxic where there are enough, and code points of the longest of them.
MAX_DOCS, FIT_CHARS = 8000, 20_000

#: One labelled id in so many is kept out of the fit, by hash; all of these set the thresholds.
CUT_FOLDS = 5

#: The thresholds come from counts of scores in steps of this size, between these bounds; rows of other languages that enter a language's counts.
SCORE_STEP, SCORE_BOUND, PRIOR = 0.01, 40.0, 5.0

#: Embedding size, filters of each width, documents a word has to occur in to get an embedding.
DIM, FILTERS, WIDTHS, MIN_DOCS = 8, 8, (1, 2, 3), 3
PREFIX = 4
EPOCHS, BATCH, RATE = 4, 32, 0.05

#: Words that one stretch of a text holds, and words that a worker remembers.
STRETCH, MEMO = 50_000, 250_000

#: Frequent function words that tell a text's language for the thresholds.
FUNCTION_WORDS = {
    "en": "the of and to is that it with for this was are by from".split(),
    "de": "der die das und ist nicht ein eine den dem zu von mit auf".split(),
    "fr": "le la les des et du est une pas pour par dans sur elle".split(),
    "es": "el la los las una por con para se del como su lo y".split(),
}
LANGUAGES = ["", *FUNCTION_WORDS]
_VOTES = {w: sum(1 << i for i, ws in enumerate(FUNCTION_WORDS.values()) if w in ws) for ws in FUNCTION_WORDS.values() for w in ws}
_WORD = re.compile(r"\w+")


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode())


def prefix_hash(word: str) -> int:
    return zlib.crc32(b"^" + word[:PREFIX].encode())


@dataclass
class Model:
    """Row 0 of each table stands for unknown and is zero; ``words`` and ``prefixes`` are sorted hashes of the others."""

    words: np.ndarray
    prefixes: np.ndarray
    word_vec: np.ndarray
    prefix_vec: np.ndarray
    filters: list[np.ndarray] = field(default_factory=list)  # by width: (width, DIM, FILTERS)
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)  # by language, '' for all others


class Reader:
    """Texts to rows of the embedding tables, and to a language by its function words."""

    def __init__(self, model: Model):
        self.words = {int(h): k + 1 for k, h in enumerate(model.words)}
        self.prefixes = {int(h): k + 1 for k, h in enumerate(model.prefixes)}
        self.memo: dict[str, int] = {}

    def _code(self, word: str) -> int:
        code = _VOTES.get(word, 0) << 48 | self.words.get(word_hash(word), 0) << 24 | self.prefixes.get(prefix_hash(word), 0)
        if len(self.memo) < MEMO:
            self.memo[word] = code
        return code

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, str]:
        own = _WORD.findall((text or "").lower())
        get = self.memo.get
        codes = np.fromiter((c if (c := get(w)) is not None else self._code(w) for w in own), np.int64, len(own))
        votes = codes >> 48
        votes = votes[votes > 0]
        counts = [int((votes >> k & 1).sum()) for k in range(len(FUNCTION_WORDS))]
        lang = LANGUAGES[1 + int(np.argmax(counts))] if any(counts) else ""
        return (codes >> 24 & 0xFFFFFF).astype(np.int32), (codes & 0xFFFFFF).astype(np.int32), lang


def _lay_out(docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts behind each other with padding between: word rows, prefix rows, starts of stretches, text of each stretch."""
    gap = max(WIDTHS)
    w, p, starts, owner, at = [], [], [], [], 0
    pad = np.zeros(gap, np.int32)
    for i, (a, b) in enumerate(docs):
        for low in range(0, max(1, len(a)), STRETCH):
            part = slice(low, low + STRETCH + gap - 1)  # windows over the cut are in the earlier stretch
            w += [a[part], pad]
            p += [b[part], pad]
            starts.append(at)
            owner.append(i)
            at += len(a[part]) + gap
    return np.concatenate(w), np.concatenate(p), np.array(starts), np.array(owner)


def _convolve(m: Model, x: np.ndarray) -> list[np.ndarray]:
    out = []
    for f in m.filters:
        y = np.zeros((len(x), f.shape[2]), np.float32)
        for j in range(len(f)):
            y[: len(x) - j] += x[j:] @ f[j]
        out.append(y)
    return out


def _logits(m: Model, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Max pooling over every window of a text, then a linear layer."""
    w, p, starts, owner = _lay_out(docs)
    maps = _convolve(m, m.word_vec[w] + m.prefix_vec[p])
    pooled = np.concatenate([np.maximum.reduceat(y, starts, axis=0) for y in maps], axis=1)
    if len(starts) > len(docs):
        best = np.full((len(docs), pooled.shape[1]), -np.inf, np.float32)
        np.maximum.at(best, owner, pooled)
        pooled = best
    return np.maximum(pooled + m.bias, 0) @ m.out + m.shift


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_odds(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How much oftener a hash's documents are toxic, in standard deviations; counts by class in columns."""
    c = counts + 0.5
    d = np.log(c[:, 1] / (n[1] + 1)) - np.log(c[:, 0] / (n[0] + 1))
    return d / np.sqrt(1 / c[:, 1] + 1 / c[:, 0])


def _known(hashes: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's distinct hashes those that occur in MIN_DOCS texts or more, and how toxic they are."""
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
    label = np.repeat(y, [len(h) for h in hashes])
    values, at = np.unique(every, return_inverse=True)
    counts = np.stack([np.bincount(at[label == k], minlength=len(values)) for k in (0, 1)], axis=1) if len(values) else np.zeros((0, 2))
    keep = counts.sum(axis=1) >= MIN_DOCS
    return values[keep], _log_odds(counts[keep], np.array([(y == 0).sum(), (y == 1).sum()]))


def fit(texts: list[str | None], labels: list[int], seed: int = 0) -> Model:
    """Fits the network; its thresholds are 0.

    The first embedding component starts as the hash's log odds, the others
    small and random; all are trained by Adagrad on the weighted log loss.
    Without a text of either class the model gives every text the more frequent one.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.int64)
    train = rng.permutation(len(y))
    own = lambda h: [np.unique(np.array([h(w) for w in set(_WORD.findall((texts[i] or "").lower()))], np.int64)) for i in train]
    words, word_z = _known(own(word_hash), y[train])
    prefixes, prefix_z = _known(own(prefix_hash), y[train])

    def table(z: np.ndarray) -> np.ndarray:
        v = rng.normal(0, 0.05, (len(z) + 1, DIM))
        v[1:, 0] = z / 4
        v[0] = 0
        return v.astype(np.float32)

    m = Model(words, prefixes, table(word_z), table(prefix_z), thresholds={"": 0.0})
    for width in WIDTHS:
        f = rng.normal(0, 0.2, (width, DIM, FILTERS))
        f[:, 0] = np.abs(f[:, 0]) + 0.3 / width
        m.filters.append(f.astype(np.float32))
    m.bias = np.full(FILTERS * len(WIDTHS), -0.2, np.float32)
    m.out = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
    positive = int((y[train] == 1).sum())
    if not positive or positive == len(train):
        m.out[:] = 0
        m.shift = 3.0 if len(train) and positive else -3.0
        return m
    reader = Reader(m)
    docs = [reader.read(t) for t in texts]
    weight = np.where(y == 1, min(10.0, (len(train) - positive) / positive), 1.0)
    squares = {k: np.full_like(v, 1e-3) for k, v in (("w", m.word_vec), ("p", m.prefix_vec), ("b", m.bias), ("o", m.out))}
    squares |= {f"f{k}": np.full_like(f, 1e-3) for k, f in enumerate(m.filters)}
    shift_square = 1e-3
    for _ in range(EPOCHS):
        for low in range(0, len(train), BATCH):
            part = train[low : low + BATCH]
            w, p, starts, owner = _lay_out([docs[i][:2] for i in part])
            x = m.word_vec[w] + m.prefix_vec[p]
            maps = _convolve(m, x)
            # Where each stretch has its largest value, then each text among its stretches.
            ends = np.append(starts[1:], len(x))
            arg = np.concatenate([np.stack([s + y_[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)]) for y_ in maps], axis=1)
            value = np.concatenate([np.take_along_axis(y_, arg[:, k * FILTERS : (k + 1) * FILTERS], axis=0) for k, y_ in enumerate(maps)], axis=1)
            best = np.array([[max(np.flatnonzero(owner == i), key=lambda s, c=c: value[s, c]) for c in range(value.shape[1])] for i in range(len(part))]) if len(starts) > len(part) else np.repeat(np.arange(len(part))[:, None], value.shape[1], 1)
            col = np.arange(value.shape[1])
            arg, value = arg[best, col], value[best, col]
            pooled = np.maximum(value + m.bias, 0)
            miss = (_sigmoid(pooled @ m.out + m.shift) - y[part]) * weight[part] / len(part)
            back = miss[:, None] * m.out * (pooled > 0)
            grads: dict[str, tuple[np.ndarray, np.ndarray]] = {"b": (m.bias, back.sum(axis=0)), "o": (m.out, pooled.T @ miss + 1e-4 * m.out)}
            gx: list[tuple[np.ndarray, np.ndarray]] = []
            for k, f in enumerate(m.filters):
                own, g = arg[:, k * FILTERS : (k + 1) * FILTERS], back[:, k * FILTERS : (k + 1) * FILTERS]
                gf = np.zeros_like(f)
                for j in range(len(f)):
                    at = np.minimum(own + j, len(x) - 1)
                    gf[j] = np.einsum("nfd,nf->df", x[at], g)
                    gx.append((at.ravel(), (g[:, :, None] * f[j].T[None]).reshape(-1, DIM)))
                grads[f"f{k}"] = (f, gf)
            for name, (value_, g) in grads.items():
                squares[name] += g * g
                value_ -= RATE * g / np.sqrt(squares[name])
            shift_square += float(miss.sum()) ** 2
            m.shift -= RATE * float(miss.sum()) / shift_square**0.5
            at = np.concatenate([a for a, _ in gx])
            g = np.concatenate([b for _, b in gx])
            for name, vec, rows in (("w", m.word_vec, w[at]), ("p", m.prefix_vec, p[at])):
                known = rows > 0
                uniq, inv = np.unique(rows[known], return_inverse=True)
                total = np.zeros((len(uniq), DIM), np.float32)
                np.add.at(total, inv, g[known])
                squares[name][uniq] += total * total
                vec[uniq] -= RATE * total / np.sqrt(squares[name][uniq])
        train = rng.permutation(train)
    return m


def _labelled(labels: DataFrame, id_col: str, label_col: str, keep) -> DataFrame:
    """id and y: one label for each id."""
    y = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    return y if keep is None else y.filter(keep(F.col("id")))


def _shares(y: DataFrame, max_docs: int) -> dict[int, float]:
    """The share of each class that the fit sees."""
    n = {r["y"]: r["n"] for r in y.filter(F.col("y").isin(0, 1)).groupBy("y").agg(F.count("*").alias("n")).collect()}
    return {k: part_of(n.get(k, 0), max_docs // 2) for k in (0, 1)}


def _for_cuts(doc_id: Column) -> Column:
    """Whether an id's labels set the thresholds instead of the network."""
    return F.pmod(F.xxhash64(F.lit(29), doc_id), F.lit(CUT_FOLDS)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS, keep=None) -> list[tuple[str | None, int]]:
    """A repeatable sample of about ``max_docs`` labelled texts of at most FIT_CHARS code points, repeats removed.

    The share of each class comes from its count over all labelled rows, and
    the sample follows a hash of the id; ids that set the thresholds are not in
    it. An id with several labels has the largest, one with several texts the
    first of them; null labels and ids do not count.
    """
    y = _labelled(labels, id_col, label_col, keep).filter(~_for_cuts(F.col("id")))
    share = _shares(y, max_docs)
    parts = [sampled(y.filter(F.col("y") == k), "id", share[k]) for k in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # about max_docs ids and labels at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.coalesce(F.char_length("text"), F.lit(0)) <= FIT_CHARS)
    got = rows.join(chosen, "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).collect()
    seen: dict[str | None, int] = {}
    for r in sorted(got, key=lambda r: r["id"]):
        seen.setdefault(r["text"], r["y"])
    return list(seen.items())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS, keep=None) -> Model:
    """Fits the network on a bounded sample of four fifths of the labelled ids; all rows of the last fifth set the thresholds.

    That holds at every size: the fifth has the classes and languages mixed as
    they are, and the network has seen none of its ids.
    """
    rows = training_rows(docs, labels, id_col, text_col, label_col, max_docs, keep)
    model = fit([t for t, _ in rows], [y for _, y in rows])
    model.thresholds = thresholds_of(score_counts(docs, _labelled(labels, id_col, label_col, keep), model, id_col, text_col, keep))
    return model


def score_counts(docs: DataFrame, y: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep=None) -> list[tuple[str, int, float, float]]:
    """(language, label, score, rows) of all rows of ``docs`` whose id has a label in ``y`` (id, y) and sets thresholds.

    Scores are counted in steps, so what reaches the driver does not grow with
    the rows. Rows are scored before they meet their labels, so no text is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        reader = Reader(m)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = [reader.read(t) for t in batch.column(1).slice(low, 64).to_pylist()]
                step = np.floor(np.clip(_logits(m, [d[:2] for d in part]), -SCORE_BOUND, SCORE_BOUND) / SCORE_STEP).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, 64), pa.array([d[2] for d in part], pa.string()), pa.array(step)], ["id", "lang", "step"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & _for_cuts(F.col("id")))
    rows = rows if keep is None else rows.filter(keep(F.col("id")))
    counts = rows.mapInArrow(lean(run), "id long, lang string, step int").join(y.filter(F.col("y").isin(0, 1)), "id").groupBy("lang", "y", "step").agg(F.count("*").alias("n")).collect()
    sent.unpersist()  # workers need not hold this model beside the one they score with
    return [(r["lang"], r["y"], (r["step"] + 0.5) * SCORE_STEP, float(r["n"])) for r in sorted(counts, key=lambda r: (r["lang"], r["y"], r["step"]))]


def thresholds_of(cells: list[tuple[str, int, float, float]]) -> dict[str, float]:
    """The cut with the best F1 for each language, and '' for all, from (language, label, score, rows).

    A language's rows count in full and all rows with a weight of
    PRIOR / (PRIOR + the rows of its rarer class): a language without a toxic
    row has nearly the common cut, one with many its own.
    """

    def cut(own: list[tuple[str, int, float, float]]) -> float:
        return best_weighted(np.array([c[2] for c in own]), np.array([c[1] for c in own]), np.array([c[3] for c in own]))

    out = {"": cut(cells)}
    for lang in FUNCTION_WORDS:
        own = [c for c in cells if c[0] == lang]
        rarer = min(sum(c[3] for c in own if c[1] == k) for k in (0, 1))
        share = PRIOR / (PRIOR + rarer)
        out[lang] = cut(own + [(*c[:3], c[3] * share) for c in cells])
    return out


def best_weighted(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the widest gap between scores among those with the best F1 of rows that count ``weight`` times; 0 if a class is missing."""
    if not (weight * (y == 1)).any() or not (weight * (y == 0)).any():
        return 0.0
    values, at = np.unique(-scores, return_inverse=True)
    hit = np.cumsum(np.bincount(at, weight * (y == 1), len(values)))
    taken = np.cumsum(np.bincount(at, weight, len(values)))
    f1 = 2 * hit / (taken + hit[-1])
    gap = np.append(np.diff(values), 1.0)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax(gap[best])]
    return float(-(values[k] + values[k + 1]) / 2 if k + 1 < len(values) else -values[k] - 0.5)


def _scores(model: Model, reader: Reader, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
    """Probabilities, one half at the threshold of the text's language."""
    out, langs = [], []
    for low in range(0, len(texts), 64):
        docs = [reader.read(t) for t in texts[low : low + 64]]
        own = [d[2] for d in docs]
        cut = np.array([model.thresholds.get(x, model.thresholds[""]) for x in own])
        out.append(_sigmoid(_logits(model, [d[:2] for d in docs]) - cut))
        langs += own
    return (np.concatenate(out) if out else np.zeros(0)), langs


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted, language.

    Only the whole text enters a score. 0.5 is the threshold found for the
    language that the text's function words show ('' if none). Null, empty and
    wordless texts get the score of a text without any known word. Repeated
    rows are scored alike. Other columns do not matter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                s, langs = _scores(sent.value, reader, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(s.astype(np.float64)), pa.array((s >= 0.5).astype(np.int32)), pa.array(langs, pa.string())], ["doc_id", "score", "predicted", "language"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, score double, predicted int, language string")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                s, _ = _scores(sent.value, reader, part.column(at).to_pylist())
                yield part.filter(pa.array(s < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
