"""Embedding near-dedup: product quantisation over inverted lists, exact cosine last."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.llm.common import classes, part_of, sampled, stage
from kinetable.llm.trie import roots

#: Vectors that the quantisers are fitted on at most, about; vectors of one label in a list, about; lists at most.
FIT_ROWS, LIST_ROWS, MAX_LISTS = 20_000, 1024, 4096

#: Subspaces of a vector, codes of each, rounds of k-means.
PARTS, CODES, ROUNDS = 8, 64, 8

#: Rows of either side that one group holds, pairs that are compared exactly at once.
GROUP_ROWS, PAIRS = 1024, 1 << 16


@dataclass
class Quantiser:
    centres: np.ndarray  # list x dim
    books: list[np.ndarray]  # by subspace: code x its dims
    cuts: list[tuple[int, int]]

    def nearest(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to all centres, and the list of each vector."""
        d = (u * u).sum(axis=1)[:, None] - 2 * u @ self.centres.T + (self.centres**2).sum(axis=1)
        return np.maximum(d, 0), d.argmin(axis=1)

    def encode(self, u: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each vector is from what its codes say."""
        r = u - self.centres[lists]
        codes, error = np.empty((len(u), len(self.books)), np.uint8), np.zeros(len(u))
        for k, (book, (a, b)) in enumerate(zip(self.books, self.cuts, strict=True)):
            d = (r[:, a:b] ** 2).sum(axis=1)[:, None] - 2 * r[:, a:b] @ book.T + (book**2).sum(axis=1)
            codes[:, k] = d.argmin(axis=1)
            error += ((r[:, a:b] - book[codes[:, k]]) ** 2).sum(axis=1)
        return codes, np.sqrt(error)

    def probes(self, u: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list) of all lists that may hold a vector within ``reach``.

        A vector of another list lies beyond the plane halfway between the two
        centres, so lists whose plane is farther than ``reach`` hold none.
        """
        d, own = self.nearest(u)
        g = (self.centres**2).sum(axis=1)
        apart = np.sqrt(np.maximum(g[own][:, None] + g[None] - 2 * self.centres[own] @ self.centres.T, 1e-30))
        near = d - d[np.arange(len(u)), own][:, None] <= 2 * reach * apart + 1e-9
        near[np.arange(len(u)), own] = True
        return np.nonzero(near)

    def distances(self, u: np.ndarray, k: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of vectors to the coded vectors of list ``k``, summed from one table for each subspace."""
        r = u - self.centres[k]
        out = np.repeat((r * r).sum(axis=1)[:, None], len(codes), axis=1)
        for m, (book, (a, b)) in enumerate(zip(self.books, self.cuts, strict=True)):
            table = (book**2).sum(axis=1) - 2 * r[:, a:b] @ book.T
            out += table[:, codes[:, m]]
        return np.sqrt(np.maximum(out, 0))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        at = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(at, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return c


def fit(x: np.ndarray, lists: int, seed: int = 0) -> Quantiser:
    """Centres and codebooks from unit vectors."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    edges = np.linspace(0, dim, min(PARTS, dim) + 1).astype(int)
    cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    q = Quantiser(_kmeans(x, lists, rng), [], cuts)
    r = x - q.centres[q.nearest(x)[1]]
    q.books = [_kmeans(r[:, a:b], CODES, rng) for a, b in cuts]
    return q


def _unit(col: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, shorter ones filled up with zeros, and the same at length one."""
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = np.diff(np.asarray(flat.offsets))
    v = np.zeros((len(flat), dim))
    v[np.arange(dim)[None, :] < n[:, None]] = np.asarray(flat.flatten(), np.float64)
    scaled = v / np.abs(v).max(axis=1, keepdims=True, initial=1e-300)
    return v, scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _compare(model, least: float, reach: float, dim: int):
    schema = ["a", "b", "n"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Index rows against query rows of one list: (a, null, n) counts links of a, (a, b, 0) connects."""
        empty = pa.table({c: pa.array([], pa.int64()) for c in schema})
        if not left.num_rows or not right.num_rows:
            return empty
        q: Quantiser = model.value
        x, _ = _unit(left["v"], dim)
        y, u = _unit(right["v"], dim)
        codes = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(len(x), -1)
        error, weight = left["error"].to_numpy(), left["m"].to_numpy()
        rx, ry = left["rid"].to_numpy(), right["rid"].to_numpy()
        i, j = np.nonzero(q.distances(u, left["list"][0].as_py(), codes) <= reach + error[None, :] + 1e-7)
        apart = ry[i] != rx[j]
        i, j = i[apart], j[apart]
        keep = np.zeros(len(i), bool)
        for low in range(0, len(i), PAIRS):
            part = slice(low, low + PAIRS)
            keep[part] = exact(y[i[part]], x[j[part]]) >= least
        i, j = i[keep], j[keep]
        if not len(i):
            return empty
        n = np.bincount(i, weights=weight[j].astype(np.float64), minlength=len(y)).astype(np.int64)
        both = np.concatenate([ry, rx])
        root = roots(len(both), i, j + len(ry))
        tied = np.flatnonzero(root != np.arange(len(both)))
        has = np.flatnonzero(n)
        a, b = np.concatenate([ry[has], both[tied]]), np.concatenate([np.zeros(len(has), np.int64), both[root[tied]]])
        return pa.table({"a": pa.array(a), "b": pa.array(b, mask=np.arange(len(a)) < len(has)), "n": pa.array(np.concatenate([n[has], np.zeros(len(tied), np.int64)]))})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors of one label link at a cosine of ``least`` or more. component_id is
    the smallest vec_id reachable, kept whether it is the own. Null labels,
    null or empty vectors and those that are zero or have null or non-finite
    components link with nothing, nor do vectors of different lengths. Rows
    that repeat a vector link with each other. Null ids are left out of the
    minimum. Other columns do not matter.

    Equal vectors are compared once, weighted by how many there are. Every
    vector is in the list of its nearest centre and asks all lists that can
    hold a link; the bound on coded distances drops no link either, so what
    the exact cosines find is complete. Lists and queries meet in groups of
    bounded size, which pass on sums and spanning links, not pairs.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.elementType
    kind = kind if isinstance(kind, T.FloatType) else T.DoubleType()
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(T.ArrayType(kind)).alias("v"))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.forall("v", finite) & F.exists("v", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    apart = rows.filter(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.filter("good").drop("good")

    reps = rows.groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("m"))
    reps = stage(reps.select("label", "v", F.size("v").alias("dim"), "low", "m", F.monotonically_increasing_id().alias("rid")))
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n"), F.max("dim")).first()
    most, total, dim = (x or 0 for x in sizes)
    if not total:
        return apart
    sample = sampled(reps, "rid", part_of(total, FIT_ROWS)).sort("rid").select("v").toArrow()
    if not sample.num_rows:
        sample = reps.limit(1).select("v").toArrow()
    model = spark.sparkContext.broadcast(fit(_unit(sample["v"], dim)[1], min(MAX_LISTS, max(1, math.ceil(most / LIST_ROWS)))))
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _unit(b.column(1), dim)[1]
            _, own = model.value.nearest(u)
            codes, error = model.value.encode(u, own)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                ["label", "v", "dim", "m", "rid", "list", "codes", "error"],
            )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 1024):
                part = b.slice(low, 1024)
                i, k = model.value.probes(_unit(part.column(1), dim)[1], reach)
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), part.column(2).take(at), part.column(4).take(at), pa.array(k.astype(np.int32))], ["label", "v", "dim", "rid", "list"])

    label, vec = T.StructField("label", vectors.schema[label_col].dataType), T.StructField("v", T.ArrayType(kind))
    common = [label, vec, T.StructField("dim", T.IntegerType())]
    cols = reps.select("label", "v", "dim", "m", "rid")
    filed = stage(cols.mapInArrow(index, T.StructType([*common, T.StructField("m", T.LongType()), T.StructField("rid", T.LongType()), T.StructField("list", T.IntegerType()), T.StructField("codes", T.BinaryType()), T.StructField("error", T.DoubleType())])))
    asked = stage(cols.mapInArrow(ask, T.StructType([*common, T.StructField("rid", T.LongType()), T.StructField("list", T.IntegerType())])))

    key = ["label", "dim", "list"]
    blocks = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias(name))
    cells = stage(blocks(filed, "blocks").join(blocks(asked, "rounds"), key))
    spread = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = filed.join(cells, key).select(*key, "rid", "m", "v", "codes", "error", spread("blocks").alias("block"), every("rounds").alias("round"))
    right = asked.join(cells, key).select(*key, "rid", "v", every("blocks").alias("block"), spread("rounds").alias("round"))
    group = [*key, "block", "round"]
    found = stage(left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_compare(model, least, reach, dim), "a long, b long, n long"))

    links = found.filter("b IS NULL").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n"))
    root = classes(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rid")
    member = stage(reps.select("rid", "low", "m").join(root, "rid", "left").select("rid", "low", "m", F.coalesce("root", "rid").alias("root")))
    low = stage(member.groupBy("root").agg(F.min("low").alias("component_id")))
    member = member.join(low, "root").join(links, "rid", "left").select("rid", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    known = stage(reps.select("label", "v", "rid").join(member, "rid").drop("rid"))
    got = rows.join(known, ["label", "v"]).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return got.union(apart)
