"""Derivatives, integrals and frame-of-reference steps on motion tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kinetable.functions import rotation as R
from kinetable.functions.vectors import vec
from kinetable.operators.blocks import Seq, neighbors, pipeline, scan
from kinetable.operators.joins import sequence_udf
from kinetable.operators.runs import longest_run
from kinetable.operators.smoothing import gaussian_parts, gaussian_radius, gaussian_smooth


def finite_diff(df: DataFrame, seq: Seq, cols: list[str], order: int = 1, fps: float = 1.0) -> DataFrame:
    """n-th forward difference times fps^n, kept at the first row it spans;
    the last ``order`` rows of a sequence are dropped."""
    binom = [1]
    for _ in range(order):
        binom = [a - b for a, b in zip([0, *binom], [*binom, 0])]

    def diff(c: str):
        return lambda w: sum(
            (F.lead(F.col(c).cast("double"), k).over(w) * float(binom[k]) for k in range(1, order + 1)),
            F.col(c).cast("double") * float(binom[0]),
        ) * float(fps) ** order

    d = neighbors(
        df, seq, 0, order, {f"d_{c}": diff(c) for c in cols} | {"_full": lambda w: F.lead(F.lit(1), order).over(w)}
    )
    return d.where(F.col("_full").isNotNull()).drop("_full")


def gradient(df: DataFrame, seq: Seq, cols: list[str], order: int = 1, dt: float = 1.0) -> DataFrame:
    """Central differences with one-sided ends, applied ``order`` times."""

    def step(src: str):
        def expr(w):
            a, b, x = F.lag(src).over(w), F.lead(src).over(w), F.col(src)
            g = F.when(a.isNull(), b - x).when(b.isNull(), x - a).otherwise((b - a) / 2)
            return g / F.lit(dt)

        return expr

    stages, src = [], {c: f"_g0_{i}" for i, c in enumerate(cols)}
    d = df.withColumns({n: F.col(c).cast("double") for c, n in src.items()})
    for k in range(1, order + 1):
        dst = {c: f"_g{k}_{i}" for i, c in enumerate(cols)}
        stages.append({dst[c]: step(src[c]) for c in cols})
        src = dst
    d = neighbors(d, seq, order, order, *stages)
    return d.select(*df.columns, *[F.col(n).alias(f"g_{c}") for c, n in src.items()])


def motion_step(df: DataFrame, seq: Seq, cols: list[str], out: str = "step") -> DataFrame:
    """Length of the displacement to the next row (null on the last)."""
    expr = lambda w: F.sqrt(sum(((F.lead(c).over(w) - F.col(c)) ** 2 for c in cols), F.lit(0.0)))
    return neighbors(df, seq, 0, 1, {out: expr})


def static_joint_mask(
    df: DataFrame, seq: Seq, cols: list[str], thr: float = 0.25, dt: float = 0.033, repeat_last: bool = False, sigma: float | None = None
) -> DataFrame:
    """Rows whose speed stays below ``thr``; optionally smooth positions first
    and give the last row the previous answer."""
    if sigma:
        df = gaussian_smooth(df, seq, cols, sigma, "replicate")
    d = motion_step(df, seq, cols, "_s").withColumn("is_static", F.col("_s") / F.lit(dt) < thr)
    if repeat_last:
        return neighbors(d, seq, 1, 0, {"_b": lambda w: F.lag("is_static").over(w)}).withColumn(
            "is_static", F.coalesce("is_static", "_b")
        ).drop("_s", "_b")
    return d.where(F.col("_s").isNotNull()).drop("_s")


def foot_contact(df: DataFrame, seq: Seq, cols: list[str], thr: float = 0.002) -> DataFrame:
    """1.0 where the squared step to the next row is below ``thr``."""
    d = motion_step(df, seq, cols, "_s").where(F.col("_s").isNotNull())
    return d.withColumn("contact", (F.col("_s") * F.col("_s") < thr).cast("double")).drop("_s")


def rollout(df: DataFrame, seq: Seq, cols: dict[str, Column]) -> DataFrame:
    """Cumulative sum shifted by one row: output starts at 0 per sequence."""
    return scan(df, seq, shifted_sums=cols)


def yaw_integrate(df: DataFrame, seq: Seq, yaw_vel: str, vx: str, vz: str, dt: float | None = None) -> DataFrame:
    """Heading angle and ground position from yaw and planar velocities.

    The heading of row i is the sum of the earlier yaw velocities; planar
    velocities are turned by minus the heading at the next row before they
    are summed. ``dt`` scales the yaw velocity.

    A block of rows is summed up as the turn and the path it adds, seen from
    its own start; the turns of earlier blocks turn its path, and turned paths
    add up. So both integrals need one shuffle of the rows and one carry.
    """
    k = 1.0 if dt is None else dt
    zero, first = F.lit(0.0), Window.unboundedPreceding
    step = F.col(yaw_vel) * k

    def turn(a: Column, x: Column, z: Column) -> tuple[Column, Column]:
        c, s = F.cos(2 * a), F.sin(2 * a)
        return c * x - s * z, s * x + c * z

    def local(d: DataFrame, w: WindowSpec) -> DataFrame:
        upto, prior = w.rowsBetween(first, 0), w.rowsBetween(first, -1)
        d = d.withColumns({"_a": F.coalesce(F.sum(step).over(prior), zero), "_turned": F.coalesce(F.sum(step).over(upto), zero)})
        # velocity i moves the body from row i to i + 1, whose heading is _turned
        wx, wz = turn(F.col("_turned"), F.col(vx), F.col(vz))
        d = d.withColumns({"_wx": wx, "_wz": wz})
        return d.withColumns({f"_s{c}": F.coalesce(F.sum(f"_w{c}").over(prior), zero) for c in "xz"}).drop("_turned")

    def keep(blocks: DataFrame, whole: WindowSpec, back: WindowSpec) -> DataFrame:
        d = blocks.withColumn("_a0", F.coalesce(F.sum("_ba").over(back), zero))
        x, z = turn(F.col("_a0"), F.col("_bx"), F.col("_bz"))
        d = d.withColumns({"_tx": x, "_tz": z})
        return d.withColumns({f"_{c}0": F.coalesce(F.sum(f"_t{c}").over(back), zero) for c in "xz"})

    def then(d: DataFrame, w: WindowSpec) -> DataFrame:
        x, z = turn(F.col("_a0"), F.col("_sx"), F.col("_sz"))
        out = {"heading": F.col("_a0") + F.col("_a"), "x": F.col("_x0") + x, "z": F.col("_z0") + z}
        return d.withColumns(out).drop("_a", "_wx", "_wz", "_sx", "_sz")

    summary = {"_ba": F.sum(step), "_bx": F.sum("_wx"), "_bz": F.sum("_wz")}
    return pipeline(df, seq, 0, 0, local=local, summary=summary, keep=keep, then=then, carried=("_a0", "_x0", "_z0"))


def delta_theta(df: DataFrame, seq: Seq, quat: str) -> DataFrame:
    """Angle from the previous row's rotation, 0 on the first row."""
    d = neighbors(df, seq, 1, 0, {"_q": lambda w: F.lag(quat).over(w)})
    return d.withColumn("dtheta", F.coalesce(R.relative_angle(F.col("_q"), F.col(quat)), F.lit(0.0))).drop("_q")


def camera_angvel(df: DataFrame, seq: Seq, mat: str) -> DataFrame:
    """6-D form of the rotation to the next row; the last row repeats."""
    d = neighbors(
        df, seq, 1, 1, {"_n": lambda w: F.lead(mat).over(w), "_p": lambda w: F.lag(mat).over(w)}
    )
    here = F.when(F.col("_n").isNotNull(), R.matmul(F.col("_n"), R.transpose(F.col(mat))))
    before = F.when(F.col("_p").isNotNull(), R.matmul(F.col(mat), R.transpose(F.col("_p"))))
    return d.withColumn("angvel", R.matrix_to_sixd(F.coalesce(here, before))).drop("_n", "_p")


def local_velocity(df: DataFrame, seq: Seq, pos: str, quat: str, heading_only: bool = False, height: str = "velocity") -> DataFrame:
    """Displacement to the next row in the body (or heading) frame; the last
    row repeats the displacement before it.

    ``height`` replaces the vertical entry: "cumulative" by the running sum of
    the vertical velocities, "absolute" by the height itself.
    """
    frame = R.heading_quat(F.col(quat)) if heading_only else F.col(quat)
    minus = lambda a, b: F.zip_with(a, b, lambda p, q: p - q)
    d = neighbors(df, seq, 1, 1, {"_n": lambda w: F.lead(pos).over(w), "_p": lambda w: F.lag(pos).over(w)})
    step = F.coalesce(minus(F.col("_n"), F.col(pos)), minus(F.col(pos), F.col("_p")), vec(0.0, 0.0, 0.0))
    d = d.withColumn("local_vel", R.qrot(R.qinv(frame), step)).drop("_n", "_p")
    if height == "velocity":
        return d
    if height == "cumulative":
        d = scan(d, seq, sums={"_y": F.get("local_vel", F.lit(1))})
    else:
        d = d.withColumn("_y", F.get(pos, F.lit(1)))
    return d.withColumn("local_vel", F.transform("local_vel", lambda v, i: F.when(i == 1, F.col("_y")).otherwise(v))).drop("_y")


def integrate_local_velocity(df: DataFrame, seq: Seq, vel: str, quat: str, heading_only: bool = False, height: str = "velocity") -> DataFrame:
    """Inverse of :func:`local_velocity`: positions from a start at the origin
    (at the stored height for ``height="absolute"``)."""
    frame = R.heading_quat(F.col(quat)) if heading_only else F.col(quat)
    d, v = df, F.col(vel)
    if height == "cumulative":
        d = neighbors(d, seq, 1, 0, {"_b": lambda w: F.coalesce(F.lag(F.get(vel, F.lit(1))).over(w), F.lit(0.0))})
        v = F.transform(vel, lambda x, i: F.when(i == 1, x - F.col("_b")).otherwise(x))
    elif height == "absolute":
        v = F.transform(vel, lambda x, i: F.when(i == 1, 0.0).otherwise(x))
    d = d.withColumn("_w", R.qrot(frame, v))
    d = rollout(d, seq, {f"_p{i}": F.get("_w", F.lit(i)) for i in range(3)})
    y = F.get(vel, F.lit(1)) if height == "absolute" else F.col("_p1")
    return d.withColumn("rolled", vec(F.col("_p0"), y, F.col("_p2"))).drop("_w", "_b", "_p0", "_p1", "_p2")


def per_sequence(df: DataFrame, keys: tuple[str, ...], **aggs: Column) -> DataFrame:
    """Attach per-sequence aggregates to every row.

    Aggregates are combined map-side; the result has one row per sequence and
    is joined back, so no sequence is gathered in one task. Null keys are a
    sequence like any other.
    """
    a = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    if not keys:
        return df.join(a)
    a = a.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys]
    return df.join(a, same).drop(*[f"_j_{k}" for k in keys])


def put_on_floor(df: DataFrame, keys: tuple[str, ...], y: str) -> DataFrame:
    return per_sequence(df, keys, _floor=F.min(y)).withColumn(y, F.col(y) - F.col("_floor")).drop("_floor")


def xz_origin(df: DataFrame, keys: tuple[str, ...], order: str, x: str, z: str, is_root: Column | None = None) -> DataFrame:
    """Subtract the first root position in the ground plane."""
    at = F.when(is_root, F.col(order)) if is_root is not None else F.col(order)
    d = per_sequence(df, keys, _first=F.min_by(F.struct(x, z), at))
    return d.withColumns({x: F.col(x) - F.col("_first")[x], z: F.col(z) - F.col("_first")[z]}).drop("_first")


def center_on_camera(df: DataFrame, seq: Seq, scene: list[str], clean: Column, trans: list[str], cam: list[str]) -> DataFrame:
    """Subtract the mean camera translation over the scene's longest run free
    of any flag, per body; the third axis is negated first.

    ``clean`` is the row's own (per body) cleanliness. A body without a clean
    row in the run uses the run's middle frame, or its own nearest to that.
    """
    o = F.col(seq.order)
    frames = df.groupBy(*scene, seq.order).agg(F.min(clean).alias("_ok"))
    best = longest_run(frames, Seq(tuple(scene), seq.order, seq.size), F.col("_ok"))
    all_scenes = df.select(*scene).distinct().join(best, scene, "left")
    all_scenes = all_scenes.select(
        *scene,
        F.coalesce("start", F.lit(0)).alias("_s"),
        F.coalesce("stop", F.lit(1)).alias("_e"),
        F.coalesce("middle", F.lit(0)).alias("_m"),
    )
    d = df.join(all_scenes, scene)
    inside = (o >= F.col("_s")) & (o < F.col("_e")) & clean
    off = d.groupBy(*seq.keys).agg(
        *[F.coalesce(F.avg(F.when(inside, F.col(c))), F.min_by(F.col(c), F.struct(F.abs(o - F.col("_m")), o))).alias(f"_o{i}") for i, c in enumerate(cam)]
    )
    out = df.join(off, list(seq.keys))
    signs = (1.0, 1.0, -1.0)
    return out.withColumns({c: F.col(c) - F.lit(signs[i]) * F.col(f"_o{i}") for i, c in enumerate(trans)}).drop("_o0", "_o1", "_o2")


def origin_shift(df: DataFrame, scene: list[str], order: str, person: str, trans: list[str], ground: str) -> DataFrame:
    """Move every person of a scene by person 0's first position, with its
    lowest point put at height 0. Scenes without person 0 stay as they are."""
    lead = F.col(person) == 0
    base = df.groupBy(*scene).agg(
        F.min_by(F.struct(*trans), F.when(lead, F.col(order))).alias("_b"),
        F.min(F.when(lead, F.col(ground))).alias("_g"),
    )
    d = df.join(base, scene)
    shift = [F.col("_b")[c] for c in trans]
    shift[1] = shift[1] + F.col("_g")
    return d.withColumns({c: F.col(c) - F.coalesce(s, F.lit(0.0)) for c, s in zip(trans, shift)}).drop("_b", "_g")


def contact_drift_correct(
    frames: DataFrame, joints: DataFrame, seq: Seq, joint: str, logit: str, sigma: float = 3.0
) -> DataFrame:
    """Remove the drift of joints that should stand still.

    ``frames``: keys, order, x, y, z. ``joints``: keys, order, joint id,
    jx, jy, jz and a contact logit. Per step the displacements of joints with
    a positive logit are averaged with softmax weights and taken out; x and z
    are smoothed and the lowest joint is put at height 0. Joints on frames
    that are not in ``frames`` are left out.

    A frame and its joints, bounded by the skeleton, become one row. Blocks of
    these hold halo rows for the step and the smoothing; what earlier blocks
    drift by and the lowest joint of all come from one carry row per block.
    """
    keys, o, r = list(seq.keys), seq.order, gaussian_radius(sigma)
    point = F.struct(F.col(joint).alias("j"), *[F.col(f"j{a}").cast("double").alias(a) for a in "xyz"], F.col(logit).cast("double").alias("e"))
    own = frames.select(*keys, o, F.struct(*"xyz").alias("_root"))
    rows = own.unionByName(joints.select(*keys, o, point.alias("_point")), allowMissingColumns=True)
    d = rows.groupBy(*keys, o).agg(F.max("_root").alias("_root"), F.collect_list("_point").alias("_points"))
    d = d.where(F.col("_root").isNotNull()).select(*keys, o, *[F.col("_root")[a].cast("double").alias(a) for a in "xyz"], "_points")
    zero, first = F.lit(0.0), Window.unboundedPreceding
    add = lambda a, v: a + v

    def local(d: DataFrame, w: WindowSpec) -> DataFrame:
        after = lambda p: F.get(F.filter("_next", lambda q: q["j"] == p["j"]), F.lit(0))
        d = d.withColumn("_next", F.lead("_points").over(w))
        moves = F.transform(F.filter("_points", lambda p: p["e"] > 0), lambda p: F.struct(p.alias("p"), after(p).alias("q"), F.exp(p["e"]).alias("e")))
        d = d.withColumn("_moves", F.filter(moves, lambda m: m["q"]["x"].isNotNull()))
        weight = F.aggregate(F.transform("_moves", lambda m: m["e"]), zero, add)
        mean = lambda a: F.aggregate(F.transform("_moves", lambda m: F.coalesce(m["e"] * (m["q"][a] - m["p"][a]), zero)), zero, add) / weight
        d = d.withColumns({f"_d{a}": F.when(F.size("_moves") > 0, mean(a)).otherwise(zero) for a in "xyz"})
        d = d.withColumns({f"_s{a}": F.coalesce(F.sum(f"_d{a}").over(w.rowsBetween(first, -1)), zero) for a in "xyz"})
        # steps of halo rows before the block are in the earlier blocks' sums already
        d = d.withColumns({f"_h{a}": F.when(F.col("_ahead"), F.col(f"_d{a}")) for a in "xyz"})
        low = F.when(~F.col("_halo"), F.array_min(F.transform("_points", lambda p: p["y"])) - F.col("_sy"))
        return d.withColumn("_low", low).drop("_next", "_moves")

    def keep(blocks: DataFrame, whole: WindowSpec, back: WindowSpec) -> DataFrame:
        d = blocks.withColumns({f"_c{a}": F.coalesce(F.sum(f"_b{a}").over(back), zero) - F.coalesce(f"_p{a}", zero) for a in "xyz"})
        return d.withColumn("_floor", F.coalesce(F.min(F.col("_lowest") - F.col("_cy")).over(whole), zero))

    stage, means = gaussian_parts(["x", "z"], sigma, "replicate")

    def then(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumns({a: F.col(a) - F.col(f"_s{a}") - F.col(f"_c{a}") for a in "xyz"})
        return d.withColumns({n: f(w) for n, f in stage.items()}).withColumns({**means, "y": F.col("y") - F.col("_floor")})

    summary = {f"_b{a}": F.sum(F.when(~F.col("_halo"), F.col(f"_d{a}"))) for a in "xyz"}
    summary |= {f"_p{a}": F.sum(f"_h{a}") for a in "xyz"} | {"_lowest": F.min("_low")}
    out = pipeline(d, seq, r, max(r, 1) + 1, local=local, summary=summary, keep=keep, then=then, carried=("_cx", "_cy", "_cz", "_floor"))
    return out.select(*keys, o, "x", "y", "z")


class Pull:
    """How a stretch of frames moves an offset of k steps, for every k at once.

    A frame adds a step to offsets up to one threshold and takes one from those
    from another on, so it keeps their order. What several frames do in a row
    is therefore a list of pieces, each of which moves all its k alike; a frame
    cuts two of them at most.
    """

    def __init__(self) -> None:
        self.starts = np.array([-(1 << 60)], np.int64)  # first k of each piece
        self.moves = np.zeros(1, np.int64)

    def add(self, up_to: int, down_from: int) -> None:
        """Puts a frame behind the others: offsets up to ``up_to`` go up a step, those from ``down_from`` on go down."""
        at = self._cut(up_to + 1), self._cut(down_from)
        i, j = np.searchsorted(self.starts, at)
        self.moves[:i] += 1
        self.moves[j:] -= 1
        same = np.append(False, self.moves[1:] == self.moves[:-1])
        if same.any():
            self.starts, self.moves = self.starts[~same], self.moves[~same]

    def _cut(self, value: int) -> int:
        """The first k that has come to ``value`` or more, made the start of a piece."""
        ends = np.append(self.starts[1:] - 1, 1 << 60) + self.moves  # where the last k of each piece has come to
        p = int(np.searchsorted(ends, value))
        k = max(int(self.starts[p]), value - int(self.moves[p]))
        if k != self.starts[p]:
            self.starts, self.moves = np.insert(self.starts, p + 1, k), np.insert(self.moves, p + 1, self.moves[p])
        return k

    def __call__(self, k: int) -> int:
        return k + int(self.moves[np.searchsorted(self.starts, k, side="right") - 1])


def camera_drift_correct(df: DataFrame, seq: Seq, joints: int = 6, far: float = 0.25, step: float = 0.02) -> DataFrame:
    """Pull a world track toward the camera track, then hold static joints.

    Columns: x, y, z (world root), rx, ry, rz (its root joint), cx, cy, cz
    (the camera track seen in the world), ``static_points`` (3 numbers per
    static joint), ``static_logits`` (per joint) and ``low`` (lowest joint
    height). Where the root is off by ``far`` (at least ``step``) or more on an
    axis, every later frame moves by ``step``; then the mean displacement of
    joints with contact probability above 0.8 is removed from the ground plane.
    A frame without a root or camera position pulls nothing.

    The pull depends on all earlier pulls. A block of frames is summed up as
    what it does to any offset (``Pull``); these maps, one row per block, give
    each block the offset it begins with and the frame before it, and all
    blocks of a clip are then corrected apart from each other. The holding
    part is a running sum.
    """
    if far < step:
        raise ValueError("far has to be at least step")
    keys, o = list(seq.keys), seq.order
    root, cam = ["rx", "ry", "rz"], ["cx", "cy", "cz"]
    own = df.withColumn("_blk", seq.block())
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    key_kinds = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def aims(pdf: pd.DataFrame) -> np.ndarray:
        return pdf[root].to_numpy(float) - pdf[cam].to_numpy(float)

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(o, kind="stable", na_position="first")
        aim = aims(pdf)
        starts, moves, begun = [], [], []
        for axis in range(3):
            pull, k = Pull(), 0
            for i, e in enumerate(aim[:, axis]):
                if np.isnan(e):
                    continue
                pull.add(int(np.floor((e - far) / step)), int(np.ceil((e + far) / step)))
                if i:  # the clip's first frame is not pulled
                    k += _pulls(e, k)
            starts.append(pull.starts.tolist())
            moves.append(pull.moves.tolist())
            begun.append(k)
        out = pdf[[*keys, "_blk"]].head(1).copy()
        out["_starts"], out["_moves"], out["_begun"] = [starts], [moves], [begun]
        out["_points"], out["_logits"] = [pdf["static_points"].iloc[-1]], [pdf["static_logits"].iloc[-1]]
        return out

    def _pulls(e: float, k: int) -> int:
        return 1 if k <= np.floor((e - far) / step) else -1 if k >= np.ceil((e + far) / step) else 0

    def handed_on(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk", na_position="first")
        k, points, logits, rows = None, None, None, []
        for r in pdf.to_dict("records"):
            rows.append((k if k is not None else [0, 0, 0], points, logits, k is None))
            if k is None:
                k = list(r["_begun"])
            else:
                k = [x + int(m[np.searchsorted(s, x, side="right") - 1]) for x, s, m in zip(k, r["_starts"], r["_moves"], strict=True)]
            points, logits = r["_points"], r["_logits"]
        out = pdf[[*keys, "_blk"]].copy()
        for name, column in zip(("_k", "_points", "_logits", "_first"), zip(*rows, strict=True), strict=True):
            out[name] = list(column)
        return out

    names = [*keys, o, "x", "y", "z", "_floor", "_slide_x", "_slide_z"]

    def corrected(pdf: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(o, kind="stable", na_position="first")
        state = carry.iloc[0]
        aim, n = aims(pdf), len(pdf)
        k = np.zeros((n, 3), np.int64)
        for axis in range(3):
            now = int(state["_k"][axis])
            for i, e in enumerate(aim[:, axis]):
                if not np.isnan(e) and (i or not state["_first"]):
                    now += _pulls(e, now)
                k[i, axis] = now
        pulled = k * step
        points = np.stack([np.asarray(v, float) for v in pdf["static_points"]]).reshape(n, joints, 3)
        on = 1 / (1 + np.exp(-np.stack([np.asarray(v, float) for v in pdf["static_logits"]]))) > 0.8
        here = points - pulled[:, None]
        if state["_first"]:
            before, was = np.concatenate([here[:1], here[:-1]]), np.concatenate([np.zeros_like(on[:1]), on[:-1]])
        else:
            last = np.asarray(state["_points"], float).reshape(1, joints, 3) - np.asarray(state["_k"], float) * step
            before = np.concatenate([last, here[:-1]])
            was = np.concatenate([1 / (1 + np.exp(-np.asarray(state["_logits"], float)[None])) > 0.8, on[:-1]])
        slide = ((here - before) * was[:, :, None]).sum(axis=1) / np.maximum(1, was.sum(axis=1))[:, None]
        out = pdf[[*keys, o]].copy()
        out[["x", "y", "z"]] = pdf[["x", "y", "z"]].to_numpy(float) - pulled
        out["_floor"], out["_slide_x"], out["_slide_z"] = pdf["low"].to_numpy(float) - pulled[:, 1], slide[:, 0], slide[:, 2]
        return out[names]

    blocks = own.groupBy(*keys, "_blk").applyInPandas(
        summed, f"{key_kinds}, _blk bigint, _starts array<array<bigint>>, _moves array<array<bigint>>, _begun array<bigint>, _points {kinds['static_points']}, _logits {kinds['static_logits']}"
    )
    carry = blocks.groupBy(*keys).applyInPandas(
        handed_on, f"{key_kinds}, _blk bigint, _k array<bigint>, _points {kinds['static_points']}, _logits {kinds['static_logits']}, _first boolean"
    )
    schema = ", ".join(f"`{c}` {kinds[c] if c in (*keys, o) else 'double'}" for c in names)
    d = own.groupBy(*keys, "_blk").cogroup(carry.groupBy(*keys, "_blk")).applyInPandas(corrected, schema)
    d = scan(d, seq, sums={"_held_x": F.col("_slide_x"), "_held_z": F.col("_slide_z")})
    d = d.withColumns({"x": F.col("x") - F.col("_held_x"), "z": F.col("z") - F.col("_held_z")}).drop("_held_x", "_held_z", "_slide_x", "_slide_z")
    return per_sequence(d, seq.keys, _g=F.min("_floor")).withColumn("y", F.col("y") - F.col("_g")).drop("_g", "_floor")
