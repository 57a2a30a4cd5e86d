"""Errors between predicted and true motion.

Long tables hold one row per (clip, frame, joint) with px, py, pz and the true
gx, gy, gz; ``frame`` is dense per clip and joint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.functions import rotation as R
from kinetable.operators.blocks import Seq, neighbors

P, G = ("px", "py", "pz"), ("gx", "gy", "gz")


def join_pairs(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Rename x, y, z of both sides and join them on clip, frame, joint."""
    p = pred.select(*keys, *[F.col(c).alias(f"p{c}") for c in "xyz"])
    g = truth.select(*keys, *[F.col(c).alias(f"g{c}") for c in "xyz"])
    return p.join(g, keys)


def length3(a: tuple, b: tuple | None = None) -> Column:
    d = [F.col(x) if b is None else F.col(x) - F.col(y) for x, y in zip(a, b or a)]
    return F.sqrt(sum((c * c for c in d), F.lit(0.0)))


def _minus_center(df: DataFrame, frame_keys: list[str], joint: str, roots: list[int]) -> DataFrame:
    """Subtract the mean of the root joints, per frame and side.

    A frame has a fixed number of joints, so the frame grouping is bounded.
    """
    at = F.col(joint).isin(*roots)
    c = df.groupBy(*frame_keys).agg(*[F.avg(F.when(at, F.col(x))).alias(f"_c{x}") for x in P + G])
    d = df.join(c, frame_keys)
    return d.withColumns({x: F.col(x) - F.col(f"_c{x}") for x in P + G}).drop(*[f"_c{x}" for x in P + G])


def visible(df: DataFrame, sentinel: float = -2.0) -> DataFrame:
    """Drop joints whose true position is the missing sentinel."""
    return df.where(~((F.col("gx") == sentinel) & (F.col("gy") == sentinel) & (F.col("gz") == sentinel)))


def mpjpe(df: DataFrame, frame_keys: list[str], joint: str, roots: list[int] = [0], keys: list[str] | None = None) -> DataFrame:  # noqa: B006
    """Mean joint error after moving both roots to the origin."""
    d = _minus_center(df, frame_keys, joint, roots)
    return visible_mean(d, length3(P, G), keys, "mpjpe")


def visible_mean(df: DataFrame, value: Column, keys: list[str] | None, name: str) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(F.avg(value).alias(name))


def _second_diff(w, a: str, b: str) -> Column:
    d = lambda c: F.lead(c, 2).over(w) - 2 * F.lead(c, 1).over(w) + F.col(c)
    return d(a) - d(b)


def accel_rows(df: DataFrame, seq: Seq, fps: float | None = None) -> DataFrame:
    """``accel``: length of the acceleration difference, per row that has two
    successors."""
    stage = {f"_a{i}": (lambda w, a=a, b=b: _second_diff(w, a, b)) for i, (a, b) in enumerate(zip(P, G))}
    d = neighbors(df, seq, 0, 2, stage).where(F.col("_a0").isNotNull())
    k = 1.0 if fps is None else fps * fps
    return d.withColumn("accel", length3(("_a0", "_a1", "_a2")) * F.lit(k)).drop("_a0", "_a1", "_a2")


def accel_error(df: DataFrame, seq: Seq, fps: float | None = None, mask: Column | None = None) -> DataFrame:
    d = accel_rows(df, seq, fps)
    return (d if mask is None else d.where(mask)).agg(F.avg("accel").alias("accel_error"))


def jitter(df: DataFrame, seq: Seq, cols: tuple[str, ...] = P, fps: float = 30.0) -> DataFrame:
    """Mean length of the third difference times fps^3 / 10."""
    d3 = lambda w, c: F.lead(c, 3).over(w) - 3 * F.lead(c, 2).over(w) + 3 * F.lead(c, 1).over(w) - F.col(c)
    d = neighbors(df, seq, 0, 3, {f"_j{i}": (lambda w, c=c: d3(w, c)) for i, c in enumerate(cols)}).where(F.col("_j0").isNotNull())
    return d.agg((F.avg(length3(tuple(f"_j{i}" for i in range(len(cols))))) * F.lit(fps**3 / 10)).alias("jitter"))


def foot_sliding(df: DataFrame, seq: Seq, thr: float = 0.01) -> DataFrame:
    """Mean predicted step where the true step is below ``thr``."""
    step = lambda w, cs: F.sqrt(sum(((F.lead(c).over(w) - F.col(c)) ** 2 for c in cs), F.lit(0.0)))
    d = neighbors(df, seq, 0, 1, {"_p": lambda w: step(w, P), "_g": lambda w: step(w, G)})
    return d.where(F.col("_g") < thr).agg(F.coalesce(F.avg("_p"), F.lit(0.0)).alias("foot_sliding"))


def geodesic_error(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Mean rotation angle between two quaternion columns."""
    return df.agg(F.avg(R.relative_angle(a, b)).alias("geodesic"))


def worst_sequences(df: DataFrame, keys: list[str], value: Column, n: int = 10) -> DataFrame:
    """Highest per-sequence means; ``overall`` weighs sequences by frames."""
    overall = df.agg(F.avg(value).alias("o")).scalar()
    s = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("frames"))
    return s.orderBy(F.desc("mean"), *keys).limit(n).withColumn("overall", overall)


def similarity(moments: np.ndarray, scale: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """s, R, t per row from sums (n, Σp, Σg, Σ g pᵀ, Σ|p|²): g ≈ s R p + t."""
    n = moments[:, 0][:, None]
    mp, mg = moments[:, 1:4] / n, moments[:, 4:7] / n
    c = moments[:, 7:16].reshape(-1, 3, 3) / n[:, :, None] - mg[:, :, None] * mp[:, None, :]
    u, d, vt = np.linalg.svd(c)
    e = np.ones((len(c), 3))
    e[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    e[e == 0] = 1
    r = (u * e[:, None, :]) @ vt
    var = moments[:, 16] / n[:, 0] - (mp * mp).sum(1)
    s = np.where(var > 0, (d * e).sum(1) / np.where(var > 0, var, 1), 1.0) if scale else np.ones(len(c))
    return s, r, mg - s[:, None] * np.einsum("nij,nj->ni", r, mp)


def align_groups(df: DataFrame, keys: list[str], scale: bool = True, where: Column | None = None) -> DataFrame:
    """Best similarity (or rigid) transform of the predicted onto the true
    points per group: keys, s, rot (9), shift (3).

    The 17 sums are combined map-side, so a group of any size costs one row
    per task; only the sums go through the batched 3x3 decomposition.
    """
    d = df if where is None else df.where(where)
    sums = [F.count(F.lit(1)).cast("double").alias("m0")]
    exprs = [*P, *G] + [f"{g} * {p}" for g in G for p in P] + ["px * px + py * py + pz * pz"]
    sums += [F.sum(F.expr(e)).alias(f"m{i + 1}") for i, e in enumerate(exprs)]
    m = d.groupBy(*keys).agg(*sums)
    names = [f"m{i}" for i in range(17)]

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                s, r, t = similarity(pdf[names].to_numpy(float), scale)
                yield pdf[keys].assign(s=s, rot=list(r.reshape(-1, 9)), shift=list(t))

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", s double, rot array<double>, shift array<double>"
    return m.mapInPandas(solve, schema)


def apply_alignment(df: DataFrame, transforms: DataFrame, keys: list[str]) -> DataFrame:
    """Replace px, py, pz by s R p + t of their group."""
    d = df.join(transforms, keys)
    r, t = F.col("rot"), F.col("shift")
    out = {
        P[i]: F.col("s") * (F.get(r, F.lit(3 * i)) * F.col("px") + F.get(r, F.lit(3 * i + 1)) * F.col("py") + F.get(r, F.lit(3 * i + 2)) * F.col("pz")) + F.get(t, F.lit(i))
        for i in range(3)
    }
    return d.withColumns(out).drop("s", "rot", "shift")


def aligned(df: DataFrame, keys: list[str], scale: bool = True, where: Column | None = None) -> DataFrame:
    return apply_alignment(df, align_groups(df, keys, scale, where), keys)


def pa_mpjpe(df: DataFrame, frame_keys: list[str], keys: list[str] | None = None) -> DataFrame:
    """Mean error after the best similarity per frame."""
    return visible_mean(aligned(df, frame_keys), length3(P, G), keys, "pa_mpjpe")


def mr_metrics(df: DataFrame, seq: Seq, clip: list[str], frame: str, joint: str) -> DataFrame:
    """Pooled errors: MPJPE and PA-MPJPE over frames, acceleration over
    frames minus two per sequence."""
    fk = [*clip, frame]
    d = _minus_center(df, fk, joint, [0])
    a = d.agg(F.avg(length3(P, G)).alias("mpjpe"))
    b = aligned(d, fk).agg(F.avg(length3(P, G)).alias("v")).scalar()
    c = accel_rows(d, seq).agg(F.avg("accel").alias("v")).scalar()
    return a.withColumns({"pa_mpjpe": b, "accel": c})


def camera_metrics(df: DataFrame, frame_keys: list[str], joint: str, hips: list[int] = [1, 2]) -> DataFrame:  # noqa: B006
    """Per joint and overall error after aligning the hip midpoints, in
    millimetres. The row with a null joint is the overall mean."""
    d = _minus_center(df, frame_keys, joint, hips)
    return d.rollup(joint).agg((F.avg(length3(P, G)) * 1000).alias("error_mm"))


def global_metrics(df: DataFrame, clip: list[str], frame: str, chunk: int = 100) -> DataFrame:
    """Per 100-frame chunk: error after aligning its first two frames that are
    there, and after aligning the whole chunk, in millimetres per clip."""
    d = df.withColumn("chunk", F.floor(F.col(frame) / chunk))
    keys = [*clip, "chunk"]
    err = (F.avg(length3(P, G)) * 1000).alias
    nth = F.dense_rank().over(Window.partitionBy(*keys).orderBy(frame))  # a chunk's rows are bounded
    w2 = aligned(d.withColumn("_nth", nth), keys, True, F.col("_nth") <= 2).groupBy(*clip).agg(err("wa2_mpjpe"))
    wa = aligned(d, keys).groupBy(*clip).agg(err("waa_mpjpe"))
    return w2.join(wa, clip)


def root_translation_error(roots: DataFrame, seq: Seq) -> DataFrame:
    """Rigidly aligned root error over the true path length, in percent."""
    keys = list(seq.keys)
    step = lambda w: F.sqrt(sum(((F.lead(c).over(w) - F.col(c)) ** 2 for c in G), F.lit(0.0)))
    path = neighbors(roots, seq, 0, 1, {"_s": step}).groupBy(*keys).agg(F.sum("_s").alias("path"))
    err = aligned(roots, keys, scale=False).groupBy(*keys).agg(F.avg(length3(P, G)).alias("e"))
    return err.join(path, keys).select(*keys, (100 * F.col("e") / F.col("path")).alias("rte"))
