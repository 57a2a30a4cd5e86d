"""Skeleton jobs: kinematics, retargeting and motion features.

Frames are rows with joints as a flat array. All steps work row by row on
Arrow batches; what a row needs from its clip (lowest point, first frame) or
from its neighbour frame arrives by aggregates and blocked windows, so a clip
is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kinetable.functions import rotation as R
from kinetable.functions import vectors as V
from kinetable.operators.blocks import Seq, neighbors
from kinetable.operators.kinematics import local_velocity, yaw_integrate
from kinetable.operators.smoothing import gaussian_smooth


@dataclass(frozen=True)
class Skeleton:
    """A kinematic tree with raw unit offsets and the joints with a role.

    ``face``: four joints whose two differences span the body's width.
    ``legs``: two joints whose bones measure the leg.
    """

    chains: tuple[tuple[int, ...], ...]
    raw: tuple[tuple[int, int, int], ...]
    face: tuple[int, int, int, int]
    feet_left: tuple[int, int]
    feet_right: tuple[int, int]
    legs: tuple[int, int]
    foot_threshold: float

    @property
    def size(self) -> int:
        return len(self.raw)

    def parents(self) -> list[int]:
        p = [-1] * self.size
        for chain in self.chains:
            for a, b in zip(chain, chain[1:]):
                p[b] = a
        return p


# The two skeletons.
BODY_22 = Skeleton(
    chains=((0, 2, 5, 8, 11), (0, 1, 4, 7, 10), (0, 3, 6, 9, 12, 15), (9, 14, 17, 19, 21), (9, 13, 16, 18, 20)),
    raw=(
        (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, -1, 0), (0, 1, 0), (0, -1, 0), (0, -1, 0), (0, 1, 0), (0, 0, 1),
        (0, 0, 1), (0, 1, 0), (1, 0, 0), (-1, 0, 0), (0, 0, 1), (0, -1, 0), (0, -1, 0), (0, -1, 0), (0, -1, 0), (0, -1, 0), (0, -1, 0),
    ),
    face=(2, 1, 17, 16), feet_left=(7, 10), feet_right=(8, 11), legs=(5, 8), foot_threshold=0.002,
)
BODY_21 = Skeleton(
    chains=((0, 11, 12, 13, 14, 15), (0, 16, 17, 18, 19, 20), (0, 1, 2, 3, 4), (3, 5, 6, 7), (3, 8, 9, 10)),
    raw=(
        (0, 0, 0), (0, 1, 0), (0, 1, 0), (0, 1, 0), (0, 1, 0), (1, 0, 0), (0, -1, 0), (0, -1, 0), (-1, 0, 0), (0, -1, 0), (0, -1, 0),
        (1, 0, 0), (0, -1, 0), (0, -1, 0), (0, 0, 1), (0, 0, 1), (-1, 0, 0), (0, -1, 0), (0, -1, 0), (0, 0, 1), (0, 0, 1),
    ),
    face=(11, 16, 5, 8), feet_left=(19, 20), feet_right=(14, 15), legs=(17, 18), foot_threshold=0.05,
)


# ---- small batch helpers (leading axes are rows) ---------------------------


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(n > 0, n, 1.0)


def quat_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = a[..., :1] * b[..., :1] - (a[..., 1:] * b[..., 1:]).sum(-1, keepdims=True)
    return np.concatenate([w, a[..., :1] * b[..., 1:] + b[..., :1] * a[..., 1:] + np.cross(a[..., 1:], b[..., 1:])], -1)


def quat_conj(q: np.ndarray) -> np.ndarray:
    return q * np.array([1.0, -1.0, -1.0, -1.0])


def quat_rotate(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    u = np.cross(q[..., 1:], v)
    return v + 2 * (q[..., :1] * u + np.cross(q[..., 1:], u))


def quat_from_to(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.broadcast_arrays(a, b)
    w = np.sqrt((a * a).sum(-1) * (b * b).sum(-1)) + (a * b).sum(-1)
    return _unit(np.concatenate([w[..., None], np.cross(a, b)], -1))


def quat_to_mat(q: np.ndarray) -> np.ndarray:
    eye = np.eye(3)
    return np.stack([quat_rotate(q, np.broadcast_to(eye[i], (*q.shape[:-1], 3))) for i in range(3)], -1)


def sixd_to_mat(c: np.ndarray) -> np.ndarray:
    """Columns x, y stored; z and y are made orthogonal to x."""
    x = _unit(c[..., :3])
    z = _unit(np.cross(x, c[..., 3:]))
    return np.stack([x, np.cross(z, x), z], -1)


def body_forward(joints: np.ndarray, face: tuple[int, int, int, int]) -> np.ndarray:
    """Direction the kinematic solver calls forward, before smoothing."""
    across = joints[:, face[1]] - joints[:, face[0]] + joints[:, face[2]] - joints[:, face[3]]
    return np.cross(np.array([0.0, 1.0, 0.0]), _unit(across))


def root_rotation(forward: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """Rotation onto +z; the first frame of a clip keeps the identity."""
    q = quat_from_to(_unit(forward), np.array([0.0, 0.0, 1.0]))
    q[frame == 0] = R.IDENTITY
    return q


def solve_rotations(joints: np.ndarray, root: np.ndarray, sk: Skeleton) -> np.ndarray:
    """Local joint rotations that turn raw offsets into the bones."""
    out = np.zeros((*joints.shape[:2], 4))
    out[:, 0] = root
    raw = np.array(sk.raw, float)
    for chain in sk.chains:
        acc = root
        for a, b in zip(chain, chain[1:]):
            local = quat_mul(quat_conj(acc), quat_from_to(raw[b], _unit(joints[:, b] - joints[:, a])))
            out[:, b] = local
            acc = quat_mul(acc, local)
    return out


def place_joints(rot: np.ndarray, root: np.ndarray, offsets: np.ndarray, sk: Skeleton) -> np.ndarray:
    """Joint positions from local rotations (quaternions, or 6-D if the last
    axis has 6) and bone offsets."""
    six = rot.shape[-1] == 6
    mats = sixd_to_mat(rot) if six else quat_to_mat(rot)
    out = np.zeros((len(rot), sk.size, 3))
    out[:, 0] = root
    for chain in sk.chains:
        acc = mats[:, 0]
        for a, b in zip(chain, chain[1:]):
            acc = acc @ mats[:, b]
            out[:, b] = np.einsum("nij,nj->ni", acc, np.broadcast_to(offsets[..., b, :], (len(rot), 3))) + out[:, a]
    return out


def _cube(col: pd.Series, n: int, k: int) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in col]).reshape(len(col), n, k)


def _flat(a: np.ndarray) -> list[np.ndarray]:
    return list(a.reshape(len(a), -1))


#: Rows that exist as Python objects at a time.
MAP_ROWS = 1024


def map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], dict], new: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """Add or replace columns, computed for ``MAP_ROWS`` rows at a time. The
    other columns of an Arrow batch pass as they are."""
    keep = [f for f in df.schema.fields if f.name not in new and f.name not in drop]
    added = T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in new.items()))
    schema = T.StructType(keep + added.fields)
    kinds = {f.name: to_arrow_type(f.dataType) for f in added.fields}

    def column(values: list | np.ndarray | pd.Series, kind: pa.DataType) -> pa.Array:
        v = pd.Series(values)
        return pa.Array.from_pandas(v, mask=v.isnull(), type=kind)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for s in range(0, batch.num_rows, MAP_ROWS):
                part = batch.slice(s, MAP_ROWS)
                made = fn(part.to_pandas(integer_object_nulls=True, date_as_object=True))
                cols = [part.column(f.name) for f in keep] + [column(made[c], kind) for c, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(run, schema)


# ---- jobs ------------------------------------------------------------------


def inverse_kinematics_job(df: DataFrame, seq: Seq, joints: str, sk: Skeleton = BODY_22, smooth: bool = False) -> DataFrame:
    """Add ``quats`` (4 per joint). With ``smooth`` the facing direction is
    Gaussian-smoothed over time (sigma 20) first."""
    n = sk.size
    d = _forward_columns(df, seq, joints, sk, smooth)

    def solve(p: pd.DataFrame) -> dict:
        root = root_rotation(p[["_fx", "_fy", "_fz"]].to_numpy(float), p[seq.order].to_numpy())
        return {"quats": _flat(solve_rotations(_cube(p[joints], n, 3), root, sk))}

    return map_rows(d, solve, {"quats": "array<double>"}, ("_fx", "_fy", "_fz"))


def _forward_columns(df: DataFrame, seq: Seq, joints: str, sk: Skeleton, smooth: bool) -> DataFrame:
    def fwd(p: pd.DataFrame) -> dict:
        f = body_forward(_cube(p[joints], sk.size, 3), sk.face)
        return {"_fx": f[:, 0], "_fy": f[:, 1], "_fz": f[:, 2]}

    d = map_rows(df, fwd, {"_fx": "double", "_fy": "double", "_fz": "double"})
    return gaussian_smooth(d, seq, ["_fx", "_fy", "_fz"], 20.0, "nearest") if smooth else d


def forward_kinematics_job(df: DataFrame, rotations: str, root: str, offsets: str, sk: Skeleton = BODY_22, width: int = 4) -> DataFrame:
    """Add ``joints`` from rotations (4 or 6 numbers per joint), the root
    position (3) and bone offsets (3 per joint)."""
    n = sk.size

    def go(p: pd.DataFrame) -> dict:
        return {"joints": _flat(place_joints(_cube(p[rotations], n, width), _cube(p[root], 1, 3)[:, 0], _cube(p[offsets], n, 3), sk))}

    return map_rows(df, go, {"joints": "array<double>"})


def bone_offsets(joints: np.ndarray, sk: Skeleton) -> np.ndarray:
    """Raw offsets times bone lengths, per row."""
    p = sk.parents()
    length = np.linalg.norm(joints[:, 1:] - joints[:, p[1:]], axis=-1, keepdims=True)
    raw = np.array(sk.raw, float)
    return np.concatenate([np.zeros((len(joints), 1, 3)), length * raw[1:]], 1)


def retarget_job(df: DataFrame, seq: Seq, joints: str, target: list[float], sk: Skeleton = BODY_22) -> DataFrame:
    """Rebuild every clip on the target skeleton: the root path is scaled by
    the ratio of leg lengths of the clip's first frame, rotations are kept."""
    n = sk.size
    tgt = np.asarray(target, float).reshape(n, 3)
    leg = lambda o: np.abs(o[..., sk.legs[0], :]).max(-1) + np.abs(o[..., sk.legs[1], :]).max(-1)
    first = df.groupBy(*seq.keys).agg(F.min_by(joints, seq.order).alias("_first"))
    d = df.join(first, list(seq.keys))

    def go(p: pd.DataFrame) -> dict:
        x = _cube(p[joints], n, 3)
        scale = leg(tgt) / leg(bone_offsets(_cube(p["_first"], n, 3), sk))
        root = root_rotation(body_forward(x, sk.face), p[seq.order].to_numpy())
        return {joints: _flat(place_joints(solve_rotations(x, root, sk), x[:, 0] * scale[:, None], tgt, sk))}

    return map_rows(d, go, {joints: "array<double>"}, ("_first",))


def align_start(df: DataFrame, seq: Seq, joints: str, sk: Skeleton = BODY_22) -> DataFrame:
    """Lowest point at height 0, first root over the origin, first facing
    turned to -z."""
    n = sk.size
    y = F.filter(joints, lambda v, i: i % 3 == 1)
    clip = df.groupBy(*seq.keys).agg(F.min(F.array_min(y)).alias("_floor"), F.min_by(joints, seq.order).alias("_first"))
    d = df.join(clip, list(seq.keys))
    r_hip, l_hip, r_sho, l_sho = sk.face

    def go(p: pd.DataFrame) -> dict:
        x, f = _cube(p[joints], n, 3), _cube(p["_first"], n, 3)
        across = f[:, r_hip] - f[:, l_hip] + f[:, r_sho] - f[:, l_sho]
        ahead = _unit(np.cross(np.array([0.0, 1.0, 0.0]), _unit(across)))
        turn = quat_from_to(ahead, np.array([0.0, 0.0, -1.0]))
        shift = f[:, 0] * np.array([1.0, 0.0, 1.0]) + p["_floor"].to_numpy(float)[:, None] * np.array([0.0, 1.0, 0.0])
        return {joints: _flat(quat_rotate(turn[:, None], x - shift[:, None]))}

    return map_rows(d, go, {joints: "array<double>"}, ("_floor", "_first"))


def motion_features_263(
    df: DataFrame, seq: Seq, joints: str, sk: Skeleton = BODY_22, target: list[float] | None = None, align: bool = True, foot_threshold: float | None = None
) -> DataFrame:
    """Motion feature vectors, one per frame but the last of each clip.

    Layout: root yaw velocity, root x/z velocity, root height, local joint
    positions, 6-D rotations, local velocities, foot contacts left and right
    (263 numbers for 22 joints, 251 for 21).
    """
    n, thr = sk.size, sk.foot_threshold if foot_threshold is None else foot_threshold
    d = df if target is None else retarget_job(df, seq, joints, target, sk)
    d = align_start(d, seq, joints, sk) if align else d
    d = _forward_columns(d, seq, joints, sk, True)
    stage = {f"_n{c}": (lambda w, c=c: F.lead(c).over(w)) for c in (joints, "_fx", "_fy", "_fz")}
    d = neighbors(d, seq, 0, 1, stage).where(F.col(f"_n{joints}").isNotNull())

    def go(p: pd.DataFrame) -> dict:
        x, nx = _cube(p[joints], n, 3), _cube(p[f"_n{joints}"], n, 3)
        frame = p[seq.order].to_numpy()
        q = root_rotation(p[["_fx", "_fy", "_fz"]].to_numpy(float), frame)
        nq = root_rotation(p[["_n_fx", "_n_fy", "_n_fz"]].to_numpy(float), frame + 1)
        vel = quat_rotate(nq, nx[:, 0] - x[:, 0])
        yaw = np.arcsin(np.clip(quat_mul(nq, quat_conj(q))[:, 2], -1, 1))
        local = quat_rotate(q[:, None], x - x[:, :1] * np.array([1.0, 0.0, 1.0]))
        m = quat_to_mat(solve_rotations(x, q, sk))
        six = np.concatenate([m[..., 0], m[..., 1]], -1)
        step = quat_rotate(q[:, None], nx - x)
        moved = ((nx - x) ** 2).sum(-1)
        feet = (moved[:, list(sk.feet_left + sk.feet_right)] < thr).astype(float)
        rows = len(x)
        parts = [yaw[:, None], vel[:, [0, 2]], x[:, 0, 1:2], local[:, 1:].reshape(rows, -1), six[:, 1:].reshape(rows, -1), step.reshape(rows, -1), feet]
        return {"vec": list(np.concatenate(parts, 1))}

    return map_rows(d, go, {"vec": "array<double>"}, ("_fx", "_fy", "_fz", *stage, joints))


def features_to_joints(df: DataFrame, seq: Seq, vec: str = "vec", sk: Skeleton = BODY_22, offsets: list[float] | None = None) -> DataFrame:
    """Joint positions from feature vectors.

    The root path is integrated over time; joints then come from the local
    positions, or with ``offsets`` from the 6-D rotations by kinematics.
    """
    n = sk.size
    at = lambda i: F.get(vec, F.lit(i))
    d = df.withColumns({"_yv": at(0), "_vx": at(1), "_vz": at(2)})
    d = yaw_integrate(d, seq, "_yv", "_vx", "_vz")

    def go(p: pd.DataFrame) -> dict:
        x = np.stack([np.asarray(v, float) for v in p[vec]])
        a = p["heading"].to_numpy(float)
        q = np.stack([np.cos(a), 0 * a, np.sin(a), 0 * a], -1)
        root = np.stack([p["x"].to_numpy(float), x[:, 3], p["z"].to_numpy(float)], -1)
        if offsets is None:
            local = quat_rotate(quat_conj(q)[:, None], x[:, 4 : 4 + (n - 1) * 3].reshape(len(x), n - 1, 3))
            out = np.concatenate([root[:, None], local + root[:, None] * np.array([1.0, 0.0, 1.0])], 1)
        else:
            b = 4 + (n - 1) * 3
            m = quat_to_mat(q)
            six = np.concatenate([np.concatenate([m[..., 0], m[..., 1]], -1)[:, None], x[:, b : b + (n - 1) * 6].reshape(len(x), n - 1, 6)], 1)
            out = place_joints(six, root, np.asarray(offsets, float).reshape(n, 3), sk)
        return {"joints": _flat(out)}

    return map_rows(d, go, {"joints": "array<double>"}, ("_yv", "_vx", "_vz", "heading", "x", "z", vec))


def local_global_rotations(df: DataFrame, mats: str, sk: Skeleton = BODY_22, inverse: bool = False) -> DataFrame:
    """Accumulate local rotations along the tree (or undo it). ``mats`` holds
    nine numbers per joint."""
    n = sk.size

    def go(p: pd.DataFrame) -> dict:
        m = _cube(p[mats], n * 3, 3).reshape(len(p), n, 3, 3)
        out = m.copy()
        for chain in sk.chains:
            for a, b in zip(chain, chain[1:]):
                out[:, b] = np.swapaxes(m[:, a], -1, -2) @ m[:, b] if inverse else out[:, a] @ m[:, b]
        return {mats: _flat(out)}

    return map_rows(df, go, {mats: "array<double>"})


# ---- rotation tables ----------------------------------------------------------

#: Numbers per rotation in each representation.
WIDTH = {"quaternion": 4, "matrix": 9, "axis_angle": 3, "sixd": 6}


def to_matrices(a: np.ndarray, kind: str) -> np.ndarray:
    """Rotation matrices of the last axis. 6-D holds two matrix rows."""
    if kind == "matrix":
        return a.reshape(*a.shape[:-1], 3, 3)
    if kind == "sixd":
        x = _unit(a[..., :3])
        y = _unit(a[..., 3:] - (x * a[..., 3:]).sum(-1, keepdims=True) * x)
        return np.stack([x, y, np.cross(x, y)], -2)
    if kind == "axis_angle":
        t = np.linalg.norm(a, axis=-1, keepdims=True)
        a = np.concatenate([np.cos(t / 2), a * (0.5 * np.sinc(t / (2 * np.pi)))], -1)
    return quat_to_mat(a)


def from_matrices(m: np.ndarray, kind: str) -> np.ndarray:
    flat = m.reshape(*m.shape[:-2], 9)
    if kind == "matrix":
        return flat
    if kind == "sixd":
        return flat[..., :6]
    # 4 q qT; its longest row is the stablest quaternion
    x = [flat[..., i] for i in range(9)]
    k = np.stack(
        [
            np.stack([1 + x[0] + x[4] + x[8], x[7] - x[5], x[2] - x[6], x[3] - x[1]], -1),
            np.stack([x[7] - x[5], 1 + x[0] - x[4] - x[8], x[3] + x[1], x[2] + x[6]], -1),
            np.stack([x[2] - x[6], x[3] + x[1], 1 - x[0] + x[4] - x[8], x[5] + x[7]], -1),
            np.stack([x[3] - x[1], x[6] + x[2], x[7] + x[5], 1 - x[0] - x[4] + x[8]], -1),
        ],
        -2,
    )
    best = np.diagonal(k, axis1=-2, axis2=-1).argmax(-1)
    q = _unit(np.take_along_axis(k, best[..., None, None], -2)[..., 0, :])
    q = q * np.where(q[..., :1] < 0, -1.0, 1.0)
    if kind == "quaternion":
        return q
    n = np.linalg.norm(q[..., 1:], axis=-1, keepdims=True)
    return q[..., 1:] * np.where(n < 1e-9, 2.0, 2 * np.arctan2(n, q[..., :1]) / np.where(n < 1e-9, 1.0, n))


def _mats(col: pd.Series, kind: str = "axis_angle") -> np.ndarray:
    """(rows, rotations, 3, 3) of a flat column; every row has as many."""
    a = np.stack([np.asarray(v, float) for v in col])
    return to_matrices(a.reshape(len(a), -1, WIDTH[kind]), kind)


def convert_rotations(df: DataFrame, col: str, src: str, dst: str) -> DataFrame:
    """Convert a column of one or more rotations per row among quaternion,
    matrix, axis_angle and sixd, in Arrow batches. Single rotations can also
    be converted inside an expression: ``functions.rotation.convert``."""
    return map_rows(df, lambda p: {col: _flat(from_matrices(_mats(p[col], src), dst))}, {col: "array<double>"})


def average_rotations(df: DataFrame, a: str, b: str, out: str = "average") -> DataFrame:
    """Mean rotation per joint of two axis-angle poses: the matrices' mean,
    brought back to a rotation by its singular vectors."""

    def go(p: pd.DataFrame) -> dict:
        u, _, vt = np.linalg.svd((_mats(p[a]) + _mats(p[b])) / 2)
        return {out: _flat(from_matrices(u @ vt, "axis_angle"))}

    return map_rows(df, go, {out: "array<double>"})


# ---- frames of reference --------------------------------------------------------

# Axis-angle turns between vertical conventions.
TURNS = {
    "ay->ay": (0.0, 0.0, 0.0), "any->ay": (0.0, 0.0, float(np.pi)), "az->ay": (-float(np.pi) / 2, 0.0, 0.0), "ay->any": (0.0, 0.0, float(np.pi)),
}


def _rows3(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in col])


def _times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("nij,nj->ni", m, v)


def gravity_view(r_w2c: np.ndarray, gravity: tuple[float, float, float] = (0.0, 0.0, -1.0)) -> np.ndarray:
    """Camera to gravity-view rotation: y along gravity, x square to the
    camera axis (the camera's own x when they are parallel)."""
    y = r_w2c @ np.array(gravity)
    x = np.cross(y, np.array([0.0, 0.0, 1.0]))
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    x = np.where(n < 1e-5, np.array([1.0, 0.0, 0.0]), x / (n + 1e-5))
    return np.stack([x, y, np.cross(x, y)], -2)


def world_camera_job(df: DataFrame, r_w2c: str, t_w2c: str, orient: str = "orient", transl: str = "transl", offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Root track in the camera and gravity-view frames: adds ``orient_c``,
    ``transl_c``, ``r_c2gv`` and ``orient_gv``. ``offset`` is the root joint
    in the resting body."""
    off = np.array(offset)

    def go(p: pd.DataFrame) -> dict:
        r = _mats(p[r_w2c], "matrix")[:, 0]
        oc = r @ _mats(p[orient])[:, 0]
        gv = gravity_view(r)
        aa = lambda m: list(from_matrices(m, "axis_angle"))
        t = _times(r, _rows3(p[transl]) + off) + _rows3(p[t_w2c]) - off
        return {"orient_c": aa(oc), "transl_c": list(t), "r_c2gv": _flat(gv), "orient_gv": aa(gv @ oc)}

    return map_rows(df, go, {c: "array<double>" for c in ("orient_c", "transl_c", "r_c2gv", "orient_gv")})


def relating_transform(df: DataFrame, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Add the world-to-camera ``r_w2c`` and ``t_w2c`` that relate the track
    (orient, transl) to (orient_c, transl_c)."""
    off = np.array(offset)

    def go(p: pd.DataFrame) -> dict:
        r = _mats(p["orient_c"])[:, 0] @ np.swapaxes(_mats(p["orient"])[:, 0], -1, -2)
        return {"r_w2c": _flat(r), "t_w2c": list(_rows3(p["transl_c"]) + off - _times(r, _rows3(p["transl"]) + off))}

    return map_rows(df, go, {"r_w2c": "array<double>", "t_w2c": "array<double>"})


def reorient(df: DataFrame, turn: str = "ay->ay", orient: str = "orient", transl: str = "transl") -> DataFrame:
    """Root track after a fixed change of the vertical."""
    m = to_matrices(np.array(TURNS[turn]), "axis_angle")

    def go(p: pd.DataFrame) -> dict:
        return {orient: list(from_matrices(m @ _mats(p[orient])[:, 0], "axis_angle")), transl: list(_rows3(p[transl]) @ m.T)}

    return map_rows(df, go, {orient: "array<double>", transl: "array<double>"})


def pose_features_151(df: DataFrame, seq: Seq, mean: Column | None = None, std: Column | None = None) -> DataFrame:
    """126 + 10 + 6 + 6 + 3 numbers per frame.

    Columns: body_pose (63), betas (10), orient_c, r_c2gv (9), orient and
    transl of the world track.
    """
    d = local_velocity(df.withColumn("_q", R.axis_angle_to_quat(F.col("orient"))), seq, "transl", "_q")

    def go(p: pd.DataFrame) -> dict:
        oc = _mats(p["orient_c"])[:, 0]
        body = from_matrices(_mats(p["body_pose"]), "sixd").reshape(len(p), -1)
        gv = from_matrices(_mats(p["r_c2gv"], "matrix")[:, 0] @ oc, "sixd")
        return {"vec": list(np.concatenate([body, _rows3(p["betas"]), from_matrices(oc, "sixd"), gv, _rows3(p["local_vel"])], 1))}

    d = map_rows(d.select(*seq.keys, seq.order, "body_pose", "betas", "orient_c", "r_c2gv", "local_vel"), go, {"vec": "array<double>"})
    if mean is not None:
        d = d.withColumns({"_m": mean, "_s": std}).withColumn("vec", V.zscore(F.col("vec"), F.col("_m"), F.col("_s")))
    return d.select(*seq.keys, seq.order, "vec")


def pose_from_features_151(df: DataFrame, vec: str = "vec", mean: Column | None = None, std: Column | None = None) -> DataFrame:
    """Poses from feature vectors."""
    d = df
    if mean is not None:
        d = d.withColumns({"_m": mean, "_s": std}).withColumn(vec, V.inverse_zscore(F.col(vec), F.col("_m"), F.col("_s"))).drop("_m", "_s")

    def go(p: pd.DataFrame) -> dict:
        x = _rows3(p[vec])
        aa = lambda a, b: _flat(from_matrices(to_matrices(x[:, a:b].reshape(len(x), -1, 6), "sixd"), "axis_angle"))
        return {"body_pose": aa(0, 126), "betas": list(x[:, 126:136]), "orient_c": aa(136, 142), "orient_gv": aa(142, 148), "local_vel": list(x[:, 148:])}

    return map_rows(d, go, {c: "array<double>" for c in ("body_pose", "betas", "orient_c", "orient_gv", "local_vel")}, (vec,))


def pose_noise(df: DataFrame, pose: str, ids: list[str], degrees: float = 10.0, seed: int = 0) -> DataFrame:
    """Turn every joint of an axis-angle pose by a seeded random rotation:
    a normal angle about a random axis, applied in the joint's own frame."""
    n = (F.size(pose) / 3).cast("int")
    keys = [F.col(c) for c in ids]
    draw = lambda j: F.array(
        normal(*keys, j, seed + 1) * float(np.deg2rad(degrees)), *[uniform(*keys, j, seed + 2 + k) for k in range(3)]
    )
    d = df.withColumn("_n", F.flatten(F.transform(F.sequence(F.lit(0), n - 1), draw)))

    def go(p: pd.DataFrame) -> dict:
        a = _rows3(p["_n"]).reshape(len(p), -1, 4)
        return {pose: _flat(from_matrices(_mats(p[pose]) @ to_matrices(a[..., :1] * _unit(a[..., 1:]), "axis_angle"), "axis_angle"))}

    return map_rows(d, go, {pose: "array<double>"}, ("_n",))


# ---- noise augmentation ------------------------------------------------------

# Parents of the 17 keypoints; -1 has none, a pair needs both.
KEYPOINT_PARENTS = ((5, 6), (0,), (0,), (1,), (2,), (), (), (5,), (6,), (7,), (8,), (), (), (11,), (12,), (13,), (14,))


def uniform(*parts: Column | str | int) -> Column:
    """Seeded uniform number in [0, 1) from a hash of the parts."""
    h = F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def normal(*parts: Column | str | int) -> Column:
    """Seeded standard normal number (Box-Muller)."""
    u1, u2 = uniform(*parts, 1), uniform(*parts, 2)
    return F.sqrt(-2 * F.log(F.greatest(u1, F.lit(1e-300)))) * F.cos(2 * np.pi * u2)


def visibility(dropped: list[Column]) -> list[Column]:
    """Visible unless dropped itself or a parent is invisible."""
    out: list[Column] = []
    seen = [~d for d in dropped]
    for j, ps in enumerate(KEYPOINT_PARENTS):
        v = seen[j]
        for p in ps:
            v = v & seen[p]  # parents listed later are read before their own update
        seen[j] = v
        out.append(v)
    return out


def visibility_mask(df: DataFrame, ids: list[str], drop: Column, out: str = "visible") -> DataFrame:
    """``drop`` is an array of 17 booleans; the mask propagates it."""
    d = df.withColumn("_d", drop)
    return d.withColumn(out, F.array(*visibility([F.get("_d", F.lit(j)) for j in range(17)]))).drop("_d")


def noise_augment(df: DataFrame, clip: list[str], frame: str, points: str, scale: dict[str, list[float]], seed: int = 0,
                  s_jitter: float = 5e-2, s_bias: float = 1e-1, s_peak: float = 3e-1, s_peak_mask: float = 5e-3, s_mask: float = 0.03,
                  leg_prob: float = 0.03, length: str | None = None) -> DataFrame:
    """Noisy copy of 17 3-D keypoints per frame and their visibility.

    ``scale`` holds 17 factors each for jittering, bias, peak and pmask.
    Jitter is drawn per frame, bias per clip, peaks are rare; with ``length``
    (a column) both legs vanish for 30 to 90 frames in a few clips. All draws
    are hashes of (seed, clip, frame, joint), so a rerun of a lost task gives
    the same rows.
    """
    lit = {k: F.array(*[F.lit(float(x)) for x in v]) for k, v in scale.items()}
    ids = [F.col(c) for c in clip]

    def noisy(v: Column, i: Column) -> Column:
        j, axis = F.floor(i / 3).cast("int"), i % 3
        f = F.col(frame)
        jitter = normal(*ids, f, i, seed + 1) * F.get(lit["jittering"], j) * s_jitter
        bias = normal(*ids, i, seed + 2) * F.get(lit["bias"], j) * s_bias
        hit = uniform(*ids, f, j, seed + 3) * F.get(lit["pmask"], j) < s_peak_mask
        peak = F.when(hit, normal(axis, F.lit(seed + 4)) * F.get(lit["peak"], j) * s_peak).otherwise(0.0)
        return v + jitter + bias + peak

    drop = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: uniform(*ids, F.col(frame), j, seed + 5) < s_mask)
    d = df.withColumn("noisy", F.transform(points, noisy))
    d = visibility_mask(d, clip, drop)
    if length is not None:
        start = F.floor(uniform(*ids, seed + 6) * F.greatest(F.col(length) - 90, F.lit(1)))
        stop = start + 30 + F.floor(uniform(*ids, seed + 7) * 60)
        legs = (uniform(*ids, seed + 8) < leg_prob) & (F.col(frame) >= start) & (F.col(frame) < stop)
        d = d.withColumn("visible", F.transform("visible", lambda v, i: v & ~(legs & (i >= 11))))
    return d
