"""Column functions on one frame's joints or pose vector.

Joints are an ``array<double>`` of x, y, z per joint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions.vectors import let

# Body parts of the 165-number pose vector (start, length).
POSE_PARTS = {
    "root": (0, 3), "body": (3, 63), "jaw": (66, 3), "left_eye": (69, 3), "right_eye": (72, 3),
    "left_hand": (75, 45), "right_hand": (120, 45),
}
# left/right partners of the 22 body joints.
MIRROR_22 = (0, 2, 1, 3, 5, 4, 6, 8, 7, 9, 11, 10, 12, 14, 13, 15, 17, 16, 19, 18, 21, 20)
# Left hand joints and their right partners in the 52-joint set.
LEFT_HAND = (22, 23, 24, 34, 35, 36, 25, 26, 27, 31, 32, 33, 28, 29, 30)
RIGHT_HAND = (43, 44, 45, 46, 47, 48, 40, 41, 42, 37, 38, 39, 49, 50, 51)
# Forearm extension of the left and right wrist.
HAND_RATIO = (0.3438, 0.3345)


def joint(c: Column, j: int) -> list[Column]:
    return [F.get(c, F.lit(3 * j + i)) for i in range(3)]


def permute_joints(c: Column, order: list[int] | tuple[int, ...], sign: tuple[float, float, float]) -> Column:
    return let(c, lambda s: F.array(*[F.get(s, F.lit(3 * j + i)) * sign[i] for j in order for i in range(3)]))


def mirror_order(n: int) -> list[int]:
    order = list(MIRROR_22) + list(range(22, n))
    if n > 24:
        for a, b in zip(LEFT_HAND, RIGHT_HAND):
            order[a], order[b] = b, a
    return order[:n]


def mirror_joints(c: Column, n: int = 22) -> Column:
    """Negate x and exchange left and right joints."""
    return permute_joints(c, mirror_order(n), (-1.0, 1.0, 1.0))


def flip_pose(c: Column) -> Column:
    """Mirror the axis-angle pose of the 22 body joints."""
    return permute_joints(c, MIRROR_22, (1.0, -1.0, -1.0))


def bone_extend(c: Column) -> Column:
    """22 joints to 24: hands beyond the wrists."""

    def go(s: Column) -> Column:
        extra = []
        for wrist, elbow, r in ((20, 18, HAND_RATIO[0]), (21, 19, HAND_RATIO[1])):
            extra += [a + r * (a - b) for a, b in zip(joint(s, wrist), joint(s, elbow))]
        return F.concat(F.slice(s, 1, 66), F.array(*extra))

    return let(c, go)


def _apply_rows(c: Column, n: int, rows: list[list[Column]], shift: list[Column]) -> Column:
    """rows @ (p - shift) for each joint."""
    out = []
    for j in range(n):
        p = [a - b for a, b in zip(joint(c, j), shift)]
        out += [r[0] * p[0] + r[1] * p[1] + r[2] * p[2] for r in rows]
    return F.array(*out)


def heading_normalize(c: Column, n: int = 22) -> Column:
    """Root-centered joints with the hip/shoulder axis as x (z is up)."""
    zero, one = F.lit(0.0), F.lit(1.0)

    def go(s: Column) -> Column:
        a = [(joint(s, 2)[i] - joint(s, 1)[i] + joint(s, 17)[i] - joint(s, 16)[i]) / 2 for i in range(2)]

        def turn(u: Column) -> Column:
            m = F.greatest(F.sqrt(u["x"] * u["x"] + u["y"] * u["y"]), F.lit(1e-12))
            return let(
                F.struct((u["x"] / m).alias("x"), (u["y"] / m).alias("y")),
                lambda d: _apply_rows(s, n, [[d["x"], d["y"], zero], [-d["y"], d["x"], zero], [zero, zero, one]], joint(s, 0)),
            )

        return let(F.struct(a[0].alias("x"), a[1].alias("y")), turn)

    return let(c, go)


def facing(c: Column) -> Column:
    """Struct (x, z) of the unit left axis in the ground plane (y is up);
    (1, 0) when hips and shoulders do not decide it."""

    def go(s: Column) -> Column:
        a = [joint(s, 1)[i] - joint(s, 2)[i] + joint(s, 16)[i] - joint(s, 17)[i] for i in (0, 2)]

        def unit(u: Column) -> Column:
            m2 = u["x"] * u["x"] + u["z"] * u["z"]
            m = F.sqrt(m2)
            x = F.when(m2 < 1e-4, 1.0).otherwise(u["x"] / m)
            z = F.when(m2 < 1e-4, 0.0).otherwise(u["z"] / m)
            return F.struct(x.alias("x"), z.alias("z"))

        return let(F.struct(a[0].alias("x"), a[1].alias("z")), unit)

    return let(c, go)


def to_facing_frame(c: Column, start: Column, n: int = 22) -> Column:
    """Joints seen from the start frame: origin under its root, z ahead."""
    zero, one = F.lit(0.0), F.lit(1.0)

    def go(s: Column) -> Column:
        x, z = s["f"]["x"], s["f"]["z"]
        r = joint(s["s"], 0)
        return _apply_rows(s["c"], n, [[x, zero, z], [zero, one, zero], [-z, zero, x]], [r[0], zero, r[2]])

    return let(F.struct(c.alias("c"), start.alias("s"), facing(start).alias("f")), go)


def from_facing_frame(c: Column, start: Column, n: int = 22) -> Column:
    """Inverse of :func:`to_facing_frame`."""
    zero, one = F.lit(0.0), F.lit(1.0)

    def go(s: Column) -> Column:
        x, z = s["f"]["x"], s["f"]["z"]
        r = joint(s["s"], 0)
        back = _apply_rows(s["c"], n, [[x, zero, -z], [zero, one, zero], [z, zero, x]], [zero, zero, zero])
        return F.transform(back, lambda v, i: v + F.when(i % 3 == 0, r[0]).when(i % 3 == 2, r[2]).otherwise(0.0))

    return let(F.struct(c.alias("c"), start.alias("s"), facing(start).alias("f")), go)


def face_forward(df: DataFrame, keys: list[str], frame: str, joints: str, n: int = 22, inverse: bool = False, start: str | None = None) -> DataFrame:
    """Put every clip into its first frame's facing frame.

    The first frame is found by a map-combined aggregate. The inverse needs
    that frame as the column ``start``.
    """
    if inverse:
        return df.withColumn(joints, from_facing_frame(F.col(joints), F.col(start), n))
    first = df.groupBy(*keys).agg(F.min_by(joints, frame).alias("start_joints"))
    return df.join(first, keys).withColumn(joints, to_facing_frame(F.col(joints), F.col("start_joints"), n))


def pose_slices(pose: Column) -> dict[str, Column]:
    """Parts of a 165-number pose; other sizes raise."""
    ok = F.when(F.size(pose) == 165, pose).otherwise(F.raise_error(F.concat(F.lit("unexpected pose dimension "), F.size(pose).cast("string"))).cast("array<double>"))
    return {n: F.slice(ok, a + 1, m) for n, (a, m) in POSE_PARTS.items()}


def compose_pose(parts: dict[str, Column]) -> Column:
    """Whole pose from parts; missing parts are zero."""
    return F.concat(*[parts.get(n, F.array_repeat(F.lit(0.0), m)) for n, (_, m) in POSE_PARTS.items()])


def skeleton_offsets(c: Column, parents: list[int], raw: list[tuple[int, int, int]]) -> Column:
    """Raw unit offset of every joint times its bone length."""

    def go(s: Column) -> Column:
        out = [F.lit(float(v)) for v in raw[0]]
        for j in range(1, len(raw)):
            d = [a - b for a, b in zip(joint(s, j), joint(s, parents[j]))]
            m = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
            out += [m * float(v) for v in raw[j]]
        return F.array(*out)

    return let(c, go)
