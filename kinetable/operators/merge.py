"""Bodies and faces of a scene to clean clips at one frame rate.

``merge_scenes`` attaches each face to its body and centers the scene;
``finish_clips`` drops bad clips, resamples, moves the origin and trims. All
rows of one body share the key (video, scene, body), and everything but the
assignment of a scene's few faces is a join, an aggregate or a blocked window.
Between the long stages the table is checkpointed to shared storage: a lost
executor repeats one stage, and no plan grows beyond what Catalyst handles well.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions import vectors as V
from kinetable.operators.blocks import Seq, WindowExpr, neighbors
from kinetable.operators.filters import nan_gate
from kinetable.operators.joins import assign_min_cost, face_body_cost, landmark_cost
from kinetable.operators.kinematics import center_on_camera, origin_shift
from kinetable.operators.resample import bracket, target_grid
from kinetable.operators.runs import renumber_kept, trim_flagged
from kinetable.operators.skeleton import from_matrices, map_rows, quat_mul, to_matrices
from kinetable.operators.smoothing import _EDGES, gaussian_weights, trailing_parts
from kinetable.session import cut

SCENE = ["video_id", "scene_id"]
BODY = Seq(("video_id", "scene_id", "body_id"), "frame")

# What a body without a face gets.
FACE_DEFAULTS = {"exp": 50, "jaw": 3, "emotions_conf": 7, "face_bbox": 4, "face_shape": 300}


def _middle(points: str) -> tuple[Column, Column]:
    """Mean x and y of a landmark list."""
    return V.mean(F.transform(points, lambda p: p["x"])), V.mean(F.transform(points, lambda p: p["y"]))


def match_faces(bodies: DataFrame, faces: DataFrame) -> DataFrame:
    """(scene, face_id, body_id): the cheapest 1:1 pairing by the distance of
    nose and eyes over common frames."""
    f = faces.select(*SCENE, "frame", "face_id", *[c.alias(f"{n}_{a}") for n in ("nose", "leye", "reye") for c, a in zip(_middle(f"{n}_2d"), "xy")])
    kp = {"nose": 0, "reye": 1, "leye": 2}
    b = bodies.select(*SCENE, "frame", "body_id", *[F.get("vitpose", F.lit(i))[a].alias(f"b{n}_{a}") for n, i in kp.items() for a in "xy"])
    at = lambda p, n: (F.col(f"{p}{n}_x"), F.col(f"{p}{n}_y"))
    cost = landmark_cost([at("", n) for n in kp], [at("b", n) for n in kp])
    return assign_min_cost(face_body_cost(f, b, SCENE, "frame", "face_id", "body_id", cost), SCENE, "face_id", "body_id")


def track_parts(cols: list[str], seq: Seq, island: int, sigma: float, edge: str = "reflect") -> tuple[int, list[dict[str, WindowExpr]], dict[str, Column]]:
    """How far :func:`smooth_track` reaches to both sides, its stages of bounded windows, and the means made from them.

    A non-zero run is shorter than ``island`` and touches no border where
    other rows stand on both sides of it within ``island`` rows.
    """
    r, place, near = int(4 * sigma + 0.5), _EDGES[edge], max(island - 1, 1)
    w = F.array(*[F.lit(x) for x in gaussian_weights(sigma, r)])
    on, clear, cleared, listed = {}, {}, {}, {"_b": lambda s: F.count(F.lit(1)).over(s.rowsBetween(-r, -1)).cast("int")}
    for i, c in enumerate(cols):
        off = F.when(~F.coalesce(F.col(f"_on{i}"), F.lit(False)), F.col(seq.order))
        run = lambda s, off=off: F.min(off).over(s.rowsBetween(1, near)) - F.max(off).over(s.rowsBetween(-near, -1)) - 1
        on[f"_on{i}"] = lambda s, c=c: F.exists(c, lambda v: v != 0)
        clear[f"_short{i}"] = lambda s, i=i, run=run: F.col(f"_on{i}") & (run(s) < island)
        cleared[c] = lambda s, i=i, c=c: F.when(F.col(f"_short{i}"), F.transform(c, lambda v: F.lit(0.0))).otherwise(F.col(c).cast("array<double>"))
        listed[f"_l{i}"] = lambda s, c=c: F.collect_list(F.struct(F.col(c).alias("v"))).over(s.rowsBetween(-r, r))

    def mean(rows: str) -> Column:
        value = lambda k: F.get(rows, place(F.col("_b") + k - r, F.size(rows)))["v"]
        known = F.filter(F.sequence(F.lit(0), F.lit(2 * r)), lambda k: value(k).isNotNull())
        share = F.aggregate(F.transform(known, lambda k: F.get(w, k)), F.lit(0.0), lambda a, v: a + v)
        zero = F.transform(F.coalesce(*[value(F.lit(k)) for k in range(r, 2 * r + 1)], *[value(F.lit(k)) for k in range(r)]), lambda v: F.lit(0.0))
        total = F.aggregate(known, zero, lambda acc, k: F.zip_with(acc, value(k), lambda a, v: a + v * F.get(w, k)))
        return F.when(F.size(known) == 2 * r + 1, total).otherwise(F.transform(total, lambda v: v / share))

    return r + near, [on, clear, cleared, listed], {c: mean(f"_l{i}") for i, c in enumerate(cols)}


def smooth_track(df: DataFrame, seq: Seq, col: str, island: int, sigma: float, edge: str = "reflect") -> DataFrame:
    """Clear short non-zero islands of a vector column, then smooth it over
    time with Gaussian weights. Null vectors keep their place and carry no
    weight."""
    return _smooth(df, seq, [col], None, 1, island, sigma, edge)


def _smooth(df: DataFrame, seq: Seq, cols: list[str], label: str | None, width: int, island: int, sigma: float, edge: str = "reflect") -> DataFrame:
    """:func:`smooth_track` of all ``cols``, and the trailing mode of ``label``, behind one shuffle."""
    reach, stages, made = track_parts(cols, seq, island, sigma, edge)
    if label:
        stage, mode = trailing_parts(label, width)
        stages, made = [*stages, stage], {**made, label: mode}
    before = max(reach, width - 1)
    seq = Seq(seq.keys, seq.order, max(seq.size, before), seq.ties)
    return neighbors(df, seq, before, reach, *stages).withColumns(made).select(*df.columns)


def merge_scenes(bodies: DataFrame, faces: DataFrame, smooth: bool = True, emotion_window: int = 20, island: int = 5, sigma: float = 1.0) -> DataFrame:
    """One row per body and frame with its face values.

    Bodies without a face, or frames beyond its end, carry zeros and the
    emotion ``unknown``. The jaw replaces its part of the pose; translations
    are relative to the camera over the scene's longest clean run.
    """
    pairs = match_faces(bodies, faces).select(*SCENE, "face_id", "body_id")
    f = faces.join(pairs, [*SCENE, "face_id"]).select(
        *BODY.keys, "frame", "exp", "jaw", "emotion", "emotions_conf", F.col("bbox").alias("face_bbox"), F.col("shape").alias("face_shape")
    )
    d = bodies.drop("vitpose").join(f, [*BODY.keys, "frame"], "left")
    d = d.withColumns({c: V.fit_dim(F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>")), n) for c, n in FACE_DEFAULTS.items()})
    d = d.withColumns({"emotion": F.coalesce("emotion", F.lit("unknown")), "flagged": F.coalesce("flagged", F.lit(False))})
    at = lambda c, i: F.get(c, F.lit(i)).cast("double")
    d = d.withColumns({f"_t{i}": at("trans", i) for i in range(3)} | {f"_c{i}": at("cam_transl", i) for i in range(3)})
    d = center_on_camera(d, BODY, SCENE, ~F.col("flagged"), ["_t0", "_t1", "_t2"], ["_c0", "_c1", "_c2"])
    d = d.withColumn("trans", F.array("_t0", "_t1", "_t2")).drop(*[f"_{a}{i}" for a in "tc" for i in range(3)])
    if smooth:
        d = _smooth(d, BODY, ["exp", "jaw"], "emotion", emotion_window, island, sigma)
    d = cut(d)
    pose = F.concat(F.slice("pose", 1, 66).cast("array<double>"), F.col("jaw"), F.slice("pose", 70, 96).cast("array<double>"))
    return d.withColumn("pose", pose).drop("jaw")


NUMERIC = ("trans", "exp", "cam_transl", "bbox_xyxy", "contacts", "emotions_conf", "face_bbox", "face_shape")


def resample_frames(df: DataFrame, seq: Seq, fps: str = "fps", target: float = 30.0, numeric: tuple[str, ...] = NUMERIC,
                    nearest: tuple[str, ...] = ("emotion", "flagged"), pose: str | None = "pose", width: float = 60.0) -> DataFrame:
    """All channels at ``target`` frames per second: vectors linearly, labels
    from the nearest frame (the earlier on ties), rotations on the shortest
    arc. Source and target times share one time line, so this is one shuffle.
    """
    keys = list(seq.keys)
    fixed = [c for c in df.columns if c not in (*keys, seq.order, *numeric, *nearest, pose)]
    cols = [*numeric, *nearest, *([pose] if pose else []), *fixed]
    src = df.withColumn("t", F.col(seq.order) / F.col(fps))
    grid = target_grid(src.groupBy(*keys).agg(F.max("t").alias("last")), keys, "last", target)
    d = bracket(src, grid, keys, "t", F.struct(F.col("t").cast("double").alias("t"), *cols), width)
    a, b = F.coalesce("prev", "following"), F.coalesce("following", "prev")
    d = d.withColumns({"_a": a, "_b": b})
    span = F.col("_b.t") - F.col("_a.t")
    d = d.withColumn("_w", F.when(span > 0, (F.col("t") - F.col("_a.t")) / span).otherwise(0.0))
    mix = lambda c: F.zip_with(
        F.col(f"_a.{c}"), F.col(f"_b.{c}"), lambda p, q: p.cast("double") + (q - p).cast("double") * F.col("_w")
    )
    pick = F.when(F.col("_w") <= 0.5, F.col("_a")).otherwise(F.col("_b"))
    out = [mix(c).alias(c) for c in numeric] + [pick[c].alias(c) for c in nearest] + [F.col("_a")[c].alias(c) for c in fixed]
    if pose:
        out += [F.col(f"_a.{pose}").cast("array<double>").alias("_pa"), F.col(f"_b.{pose}").cast("array<double>").alias("_pb"), "_w"]
    d = d.select(*keys, F.col("i").alias(seq.order), *out)
    if not pose:
        return d

    def turn(p: pd.DataFrame) -> dict:
        q = [from_matrices(to_matrices(np.stack([np.asarray(v, float) for v in p[c]]).reshape(len(p), -1, 3), "axis_angle"), "quaternion") for c in ("_pa", "_pb")]
        step = quat_mul(q[0] * np.array([1.0, -1.0, -1.0, -1.0]), q[1])
        angle = from_matrices(to_matrices(step, "quaternion"), "axis_angle") * p["_w"].to_numpy(float)[:, None, None]
        m = to_matrices(q[0], "quaternion") @ to_matrices(angle, "axis_angle")
        return {pose: list(from_matrices(m, "axis_angle").reshape(len(p), -1))}

    return map_rows(d, turn, {pose: "array<double>"}, ("_pa", "_pb", "_w"))


def finish_clips(merged: DataFrame, target: float = 30.0, moving: DataFrame | None = None) -> DataFrame:
    """Clips ready for use.

    Clips with a NaN are dropped, and with ``moving`` (keys of clips that
    move) all others. Channels are resampled, the scene is shifted to its
    first person's start (``ground``, the lowest joint height, puts that
    person on the floor), flagged borders are cut. Adds ``original_fps``,
    ``start`` and ``stop``.
    """
    keys = list(BODY.keys)
    bad = V.has_nan(F.col("pose")) | V.has_nan(F.col("trans")) | V.has_nan(F.col("exp"))
    d = nan_gate(merged, keys, bad)
    d = d if moving is None else d.join(moving.select(*keys), keys, "left_semi")
    if "ground" not in d.columns:
        d = d.withColumn("ground", F.lit(0.0))
    d = cut(resample_frames(d, BODY, "fps", target))
    d = d.withColumns({f"_t{i}": F.get("trans", F.lit(i)) for i in range(3)})
    d = origin_shift(d, SCENE, "frame", "body_id", ["_t0", "_t1", "_t2"], "ground")
    moved = F.array("_t0", "_t1", "_t2")
    cam = F.zip_with("cam_transl", F.zip_with(moved, "trans", lambda a, b: a - b), lambda c, s: c + s)
    d = d.withColumns({"cam_transl": cam, "trans": moved}).drop("_t0", "_t1", "_t2", "ground")
    kept = trim_flagged(d, BODY, F.col("flagged"), F.floor(F.col("fps") / 2))
    out = renumber_kept(d, BODY, kept).join(kept.select(*keys, "start", "stop"), keys)
    return out.withColumns({"original_fps": F.col("fps"), "fps": F.lit(int(target))})

