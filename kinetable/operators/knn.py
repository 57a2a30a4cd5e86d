"""Exact nearest neighbours without emitting pairs.

Three plans, chosen by measured sizes:

* points small: they are broadcast as one matrix and every query row keeps
  its k best, no shuffle;
* queries small: they are broadcast and every partition of points keeps the k
  best per query, which are then merged;
* neither: points are grouped around pivots. Distances to the pivots bound
  every query's k-th distance (triangle inequality), so a query only visits
  cells that can hold a neighbour. Small cells are packed into blocks and large
  ones cut, as are the queries visiting them: a vector is sent once per block
  it meets, and a crowded cell is many tasks.

Only the k best per query and block ever leave a task. Ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest matrix that is broadcast, in bytes.
BROADCAST_BYTES = 64 << 20
#: Bytes of vectors per block side in the pivot plan, and number of pivots.
BLOCK_BYTES = 16 << 20
PIVOTS = 256
#: Distances held at once, and candidates whose vectors are.
STEP_CELLS, STEP_PAIRS = 2_000_000, 32_768

_OUT = "pool long, qid long, pid long, distance double"


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col]) if len(col) else np.zeros((0, 0))


def top_k(q: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, point id, distance) of the k nearest points per query row.

    A product formula finds candidates up to rounding; their distances are
    then taken directly, so the order is exact.
    """
    rows, ids, dist = [], [], []
    x2 = np.einsum("ij,ij->i", x, x)
    step = max(1, STEP_CELLS // max(1, len(x)))
    for a in range(0, len(q), step):
        b = q[a : a + step]
        approx = np.einsum("ij,ij->i", b, b)[:, None] - 2 * b @ x.T + x2[None]
        kk = min(k, len(x))
        kth = np.partition(approx, kk - 1, axis=1)[:, kk - 1]
        slack = 1e-9 * (1.0 + np.abs(x2).max() + np.einsum("ij,ij->i", b, b))
        r, c = np.nonzero(approx <= (kth + slack)[:, None])
        d = np.empty(len(r))
        for s in range(0, len(r), STEP_PAIRS):  # many equal vectors make many candidates
            e = slice(s, s + STEP_PAIRS)
            d[e] = np.sqrt(((b[r[e]] - x[c[e]]) ** 2).sum(axis=1))
        order = np.lexsort((xid[c], d, r))
        r, c, d = r[order], c[order], d[order]
        first = np.searchsorted(r, r)
        keep = np.arange(len(r)) - first < k
        rows.append(r[keep] + a)
        ids.append(xid[c[keep]])
        dist.append(d[keep])
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(dist)


def _by_pool(qp: np.ndarray, q: np.ndarray, qid: np.ndarray, xp: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> pd.DataFrame:
    def of(pools: np.ndarray, p: int) -> np.ndarray | slice:
        hit = pools == p
        return slice(None) if hit.all() else np.nonzero(hit)[0]  # a slice copies nothing

    out = []
    for p in np.unique(qp):
        qi, xi = of(qp, p), of(xp, p)
        if len(xid[xi]):
            r, i, d = top_k(q[qi], x[xi], xid[xi], k)
            out.append(pd.DataFrame({"pool": p, "qid": qid[qi][r], "pid": i, "distance": d}))
    return pd.concat(out) if out else pd.DataFrame({"pool": [], "qid": [], "pid": [], "distance": []}).astype("int64")


def _fits(df: DataFrame, dim: int) -> bool:
    limit = BROADCAST_BYTES // (8 * max(dim, 1))
    return df.limit(limit + 1).count() <= limit


def _collect(df: DataFrame, k: str, v: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pdf = df.select("pool", k, v).toPandas()
    return pdf["pool"].to_numpy(), _matrix(pdf[v]), pdf[k].to_numpy()


def _merge(parts: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("pool", "qid").orderBy("distance", "pid")
    return parts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _points_plan(q: DataFrame, x: DataFrame, k: int) -> DataFrame:
    side = q.sparkSession.sparkContext.broadcast(_collect(x, "pid", "x"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xp, xm, xi = side.value
        for pdf in it:
            out = _by_pool(pdf["pool"].to_numpy(), _matrix(pdf["q"]), pdf["qid"].to_numpy(), xp, xm, xi, k)
            out["rank"] = out.groupby(["pool", "qid"]).cumcount() + 1
            yield out

    return q.mapInPandas(run, _OUT + ", rank long")


def _queries_plan(q: DataFrame, x: DataFrame, k: int) -> DataFrame:
    side = q.sparkSession.sparkContext.broadcast(_collect(q, "qid", "q"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qp, qm, qi = side.value
        best = None
        for pdf in it:
            part = _by_pool(qp, qm, qi, pdf["pool"].to_numpy(), _matrix(pdf["x"]), pdf["pid"].to_numpy(), k)
            best = part if best is None else pd.concat([best, part])
            best = best.sort_values(["pool", "qid", "distance", "pid"]).groupby(["pool", "qid"]).head(k)
        if best is not None:
            yield best

    return _merge(x.mapInPandas(run, _OUT), k)


def _cells_plan(q: DataFrame, x: DataFrame, k: int, block: int, pivots: int, pooled: bool) -> DataFrame:
    sc = q.sparkSession.sparkContext
    sample = x.orderBy(F.xxhash64("pid"), "pid").limit(pivots).select("x").toPandas()
    piv = sc.broadcast(_matrix(sample["x"]))

    def to_pivots(m: np.ndarray) -> np.ndarray:
        p = piv.value
        return np.sqrt(np.maximum(0.0, (m * m).sum(1)[:, None] - 2 * m @ p.T + (p * p).sum(1)[None]))

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            d = to_pivots(_matrix(pdf["x"]))
            yield pdf.assign(cell=d.argmin(1), reach=d.min(1))

    placed = x.mapInPandas(place, "pool long, pid long, x array<double>, cell long, reach double")
    cells = placed.groupBy("pool", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach"))
    # cells of up to a block are packed into packs of up to two; each other cell is a pack of several blocks
    small, ahead = F.col("n") <= block, Window.partitionBy("pool").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum(F.when(small, F.col("n"))).over(ahead), F.lit(0))
    cells = cells.withColumn("pack", F.when(small, F.floor(filled / block)).otherwise(-1 - F.col("cell")))
    cells = cells.withColumn("xb", F.when(small, F.lit(1)).otherwise(F.ceil(F.col("n") / block)).cast("long"))
    names = ("cell", "n", "reach", "pack")
    by_pool = cells.groupBy("pool").agg(F.collect_list(F.struct(*names)).alias("_c"))  # <= pivots entries
    by_pool = by_pool.select("pool", *[F.col(f"_c.{c}").alias(f"{c}s") for c in names])

    def packs(d: np.ndarray, cell: np.ndarray, n: np.ndarray, reach: np.ndarray, pack: np.ndarray) -> list[int]:
        far, near = d[cell] + reach, d[cell] - reach
        order = np.argsort(far)
        full = np.searchsorted(np.cumsum(n[order]), k)
        bound = far[order][full] if full < len(order) else np.inf
        return np.unique(pack[near <= bound * (1 + 1e-9) + 1e-6]).tolist()

    if pooled:
        near, alike = q.join(by_pool, "pool"), None
    else:
        near, head = q, by_pool.drop("pool").first()
        alike = sc.broadcast([np.array(v) for v in head] if head else None)

    def visit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            d = to_pivots(_matrix(pdf["q"]))
            if alike is None:
                picks = [packs(*row) for row in zip(d, *[pdf[f"{c}s"] for c in names])]
            else:
                picks = [packs(row, *alike.value) if alike.value else [] for row in d]
            yield pd.DataFrame({"pool": pdf["pool"], "qid": pdf["qid"], "q": pdf["q"], "packs": picks})

    visits = (
        near.mapInPandas(visit, "pool long, qid long, q array<double>, packs array<long>")
        .select("pool", "qid", "q", F.explode("packs").alias("pack"))
    )
    sizes = cells.groupBy("pool", "pack").agg(F.max("xb").alias("xb")).join(
        visits.groupBy("pool", "pack").agg(F.ceil(F.count(F.lit(1)) / block).alias("qb")), ["pool", "pack"]
    )

    def cut(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        d = df.join(sizes, ["pool", "pack"])
        d = d.withColumn("_own", F.pmod(F.xxhash64(key), F.col(own)))
        return d.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))

    left = cut(visits, "qid", "qb", "xb").select("pool", "pack", F.col("_own").alias("a"), F.col("_other").alias("b"), "qid", "q")
    packed = placed.join(cells.select("pool", "cell", "pack"), ["pool", "cell"])
    right = cut(packed, "pid", "xb", "qb").select("pool", "pack", F.col("_other").alias("a"), F.col("_own").alias("b"), "pid", "x")

    def solve(ql: pd.DataFrame, xr: pd.DataFrame) -> pd.DataFrame:
        if not len(ql) or not len(xr):
            return pd.DataFrame({"pool": [], "qid": [], "pid": [], "distance": []}).astype("int64")
        return _by_pool(ql["pool"].to_numpy(), _matrix(ql["q"]), ql["qid"].to_numpy(), xr["pool"].to_numpy(), _matrix(xr["x"]), xr["pid"].to_numpy(), k)

    g = ["pool", "pack", "a", "b"]
    return _merge(left.groupBy(*g).cogroup(right.groupBy(*g)).applyInPandas(solve, _OUT), k)


def knn(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    qid: str,
    qvec: str,
    pid: str,
    pvec: str,
    pool: tuple[str, str] | None = None,
    plan: str = "auto",
    block: int | None = None,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(pool, qid, pid, distance, rank) of the k nearest points by L2.

    Ids are integers. ``pool`` names the columns that must be equal. ``plan``
    is auto, points, queries or cells; ``block`` is the rows of a block in the
    last one. Fewer than k points give fewer rows.
    """
    def side(df: DataFrame, i: str, v: str, p: str | None, ni: str, nv: str) -> DataFrame:
        pc: Column = F.lit(0) if p is None else F.col(p)
        return df.select(pc.cast("long").alias("pool"), F.col(i).cast("long").alias(ni), F.col(v).cast("array<double>").alias(nv))

    q = side(queries, qid, qvec, pool and pool[0], "qid", "q")
    x = side(points, pid, pvec, pool and pool[1], "pid", "x")
    head = x.select(F.size("x")).first()
    dim = max(head[0], 1) if head else 1
    if plan == "auto":
        plan = "points" if _fits(x, dim) else "queries" if _fits(q, dim) else "cells"
    if plan == "points":
        return _points_plan(q, x, k)
    if plan == "queries":
        return _queries_plan(q, x, k)
    return _cells_plan(q, x, k, block or max(1, BLOCK_BYTES // (8 * dim)), pivots, pool is not None)


def knn_blend(
    queries: DataFrame, points: DataFrame, k: int, qid: str, qvec: str, pid: str, pvec: str, value: str, inverse: bool = False
) -> DataFrame:
    """Weighted sum of the neighbours' value vectors. Weights are distance
    over total distance (farther counts more) or, with ``inverse``, 1/d."""
    nn = knn(queries, points, k, qid, qvec, pid, pvec)
    raw = 1.0 / F.greatest("distance", F.lit(1e-12)) if inverse else F.col("distance")
    d = nn.withColumn("_w", raw).join(points.select(F.col(pid).cast("long").alias("pid"), F.col(value).alias("_v")), "pid")
    tot = F.sum("_w")
    d = d.select("qid", "_w", F.posexplode("_v").alias("i", "v"))
    g = d.groupBy("qid", "i").agg((F.sum(F.col("_w") * F.col("v")) / tot).alias("v"))
    return g.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("blend"))


def snap(queries: DataFrame, points: DataFrame, radius: float, qid: str, qvec: str, pid: str, pvec: str) -> DataFrame:
    """Nearest point if closer than ``radius``, else null."""
    nn = knn(queries, points, 1, qid, qvec, pid, pvec)
    return nn.select("qid", F.when(F.col("distance") < radius, F.col("pid")).alias("pid"))


def vq_assign(points: DataFrame, codebook: DataFrame, pid: str, vec: str) -> DataFrame:
    """Nearest code per vector, the lowest code on ties. ``codebook`` has
    integer ``code`` and array ``vec``."""
    nn = knn(points, codebook, 1, pid, vec, "code", "vec")
    return nn.select(F.col("qid").alias(pid), F.col("pid").alias("code"), "distance")


def rvq_assign(points: DataFrame, codebook: DataFrame, layers: int, pid: str, vec: str) -> DataFrame:
    """Residual quantization: each layer codes what the former left over.

    ``codebook`` has ``layer``, ``code``, ``vec``. Returns pid, layer, code.
    """
    cur = points.select(pid, F.col(vec).cast("array<double>").alias("_r"))
    out = None
    for q in range(layers):
        book = codebook.where(F.col("layer") == q).select("code", "vec")
        hit = vq_assign(cur, book, pid, "_r").select(pid, "code")
        step = hit.withColumn("layer", F.lit(q)).select(pid, "layer", "code")
        out = step if out is None else out.unionByName(step)
        if q + 1 < layers:
            cur = cur.join(hit, pid).join(book, "code").select(pid, F.zip_with("_r", F.col("vec").cast("array<double>"), lambda a, b: a - b).alias("_r"))
    return out


def vq_decode(codes: DataFrame, codebook: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Sum the layers' code vectors; null codes add nothing."""
    book = codebook.select("layer", "code", F.posexplode("vec").alias("i", "v"))
    hit = codes.where(F.col("code").isNotNull()).join(book, ["layer", "code"])
    sums = hit.groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    vecs = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("vec"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return codes.select(*keys).distinct().join(vecs, keys, "left").withColumn("vec", F.coalesce("vec", zero))
