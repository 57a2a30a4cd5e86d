"""Language identification: sparse multinomial regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled texts that the fit sees at most, about, shared evenly between languages.
MAX_DOCS = 3000

#: Hash buckets, the longest n-grams, code points that are hashed at once.
BUCKETS, LONGEST, STRETCH = 1 << 16, 3, 1 << 20

#: The regression: passes over the sample, learning rate, smoothing, L1 and L2 penalties.
EPOCHS, ALPHA, BETA, L1, L2 = 5, 1.0, 1.0, 0.02, 0.01

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # by bucket
    weights: np.ndarray  # bucket x language, mostly zero
    bias: np.ndarray
    temperature: float


def counts(text: str | None) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole lower-cased text; what is not a letter counts as a space."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = None
    for low in range(0, max(1, len(points)), STRETCH):
        part = points[low : low + STRETCH + LONGEST - 1].copy()
        part[(part < 97) | ((part > 122) & (part < 170))] = 32
        h, parts = np.zeros(len(part), np.uint32), []
        for n in range(LONGEST):  # the hash of n + 1 points goes on from that of n
            k = max(0, min(STRETCH, len(points) - low, len(part) - n))  # n-grams that begin in this stretch
            h = (h[: len(part) - n] ^ part[n:]) * _MULTIPLIERS[n]
            h ^= h >> np.uint32(15)
            parts.append(h[:k] >> np.uint32(16))
        own = np.bincount(np.concatenate(parts), minlength=BUCKETS)
        out = own if out is None else out + own
    return out


def vector(c: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their TF-IDF values, scaled to length one."""
    at = np.flatnonzero(c)
    x = (1 + np.log(c[at])) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], idf: np.ndarray, seed: int = 0) -> Model:
    """Follow-the-regularised-leader on the rows (buckets, values), then one temperature on a fifth kept apart."""
    languages = sorted(set(labels))
    place = {x: k for k, x in enumerate(languages)}
    y = np.array([place[x] for x in labels], np.int64)
    order = np.random.default_rng(seed).permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    c = len(languages)
    z, n = np.zeros((BUCKETS + 1, c)), np.zeros((BUCKETS + 1, c))  # the last row is the bias

    def weights(at: np.ndarray | slice) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= L1, 0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(seed + 1)
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            at, x = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(slice(None))
    m = Model(languages, idf, w[:-1], w[-1], 1.0)
    if len(held) and c > 1:
        logits = np.array([x @ m.weights[at] + m.bias for at, x in (rows[i] for i in held)])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
        m.temperature = float(grid[int(np.argmin(loss))])
    return m


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """bucket and df, the number of rows it occurs in; bucket -1 has the number of rows.

    A task adds its rows up first, so the shuffle gets at most BUCKETS rows a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                df += counts(text) > 0
                rows += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], rows))], ["bucket", "df"])

    return docs.select(text_col).mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", keep: Column | None = None, max_docs: int = MAX_DOCS) -> Model:
    """Fits on the rows with a language and, if given, ``keep``.

    Document frequencies come from all of them; the regression sees a
    repeatable sample of about ``max_docs``, as many for each language as far
    as there are. Languages are a few hundred at most.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = (rows.filter(keep) if keep is not None else rows).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = {r["bucket"]: r["df"] for r in document_frequencies(rows).collect()}  # BUCKETS + 1 rows at most
    total = found.pop(-1, 0)
    df = np.zeros(BUCKETS)
    df[list(found)] = list(found.values())
    idf = np.log((1 + total) / (1 + df)) + 1
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    each = max(1, max_docs // len(sizes))
    share = F.create_map(*[F.lit(v) for k, n in sorted(sizes.items()) for v in (k, int(min(1.0, each / n) * (1 << 30)))])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [counts(t) for t in b.column(1).to_pylist()]
            at = [np.flatnonzero(x) for x in c]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([x[a].astype(np.int32) for x, a in zip(c, at, strict=True)], pa.list_(pa.int32()))],
                ["id", "lang", "bucket", "n"],
            )

    some = rows.filter(F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")))
    got = some.select(F.col("id").cast("long").alias("id"), "text", "lang").mapInArrow(sparse, "id long, lang string, bucket array<int>, n array<int>").toArrow()
    order = np.lexsort((np.array([len(x) for x in got["bucket"]]), got["id"].fill_null(-1).to_numpy()))
    vectors, labels = [], []
    for i in order.tolist():
        at, n = got["bucket"][i].values.to_numpy(), got["n"][i].values.to_numpy()
        x = (1 + np.log(n)) * idf[at]
        vectors.append((at, x / max(np.sqrt((x * x).sum()), 1e-12)))
        labels.append(got["lang"][i].as_py())
    return fit(vectors, labels, idf)


def predict_text(m: Model, text: str | None) -> tuple[str, float]:
    """The language and its probability; ``und`` and 0 without a letter or a model."""
    if not m.languages or not _LETTER.search(text or ""):
        return UNKNOWN, 0.0
    at, x = vector(counts(text), m.idf)
    p = _softmax((x @ m.weights[at] + m.bias) / m.temperature)
    k = int(np.argmax(p))
    return m.languages[k], float(p[k])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (the calibrated probability).

    Only the whole text enters. Null, empty and letterless texts are ``und``
    with score 0. Ties go to the language first in order. Repeated rows are
    treated alike. Other columns do not matter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [predict_text(sent.value, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
