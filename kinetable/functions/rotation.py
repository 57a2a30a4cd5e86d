"""Rotations as native Column expressions on ``array<double>``.

Quaternions are (w, x, y, z); matrices are row-major 9-arrays; axis-angle is a
3-array; the 6-D form is the first two matrix rows (``rows=True``) or columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetable.functions.vectors import let, vec

IDENTITY = (1.0, 0.0, 0.0, 0.0)


def _e(a: Column, n: int) -> list[Column]:
    return [F.get(a, F.lit(i)) for i in range(n)]


def qmul(a: Column, b: Column) -> Column:
    def go(s: Column) -> Column:
        aw, ax, ay, az = _e(s["a"], 4)
        bw, bx, by, bz = _e(s["b"], 4)
        return F.array(
            aw * bw - ax * bx - ay * by - az * bz,
            aw * bx + ax * bw + ay * bz - az * by,
            aw * by - ax * bz + ay * bw + az * bx,
            aw * bz + ax * by - ay * bx + az * bw,
        )

    return let(F.struct(a.alias("a"), b.alias("b")), go)


def qinv(q: Column) -> Column:
    """Inverse of a unit quaternion."""
    return F.transform(q, lambda v, i: F.when(i == 0, v).otherwise(-v))


def qnormalize(q: Column) -> Column:
    return let(q, lambda s: let(F.sqrt(sum((x * x for x in _e(s, 4)), F.lit(0.0))), lambda n: F.transform(s, lambda v: v / n)))


def standardize(q: Column) -> Column:
    """The sign with non-negative real part."""
    return F.when(F.get(q, F.lit(0)) < 0, F.transform(q, lambda v: -v)).otherwise(q)


def qdot(a: Column, b: Column) -> Column:
    return sum((x * y for x, y in zip(_e(a, 4), _e(b, 4))), F.lit(0.0))


def qrot(q: Column, v: Column) -> Column:
    """Rotate the 3-vector ``v``: v + 2w(u×v) + 2u×(u×v)."""

    def go(s: Column) -> Column:
        w, x, y, z = _e(s["q"], 4)
        a, b, c = _e(s["v"], 3)
        ux, uy, uz = y * c - z * b, z * a - x * c, x * b - y * a
        return F.array(
            a + 2 * (w * ux + y * uz - z * uy),
            b + 2 * (w * uy + z * ux - x * uz),
            c + 2 * (w * uz + x * uy - y * ux),
        )

    return let(F.struct(q.alias("q"), v.alias("v")), go)


def quat_between(a: Column, b: Column) -> Column:
    """Shortest rotation taking direction ``a`` to ``b``."""

    def go(s: Column) -> Column:
        ax, ay, az = _e(s["a"], 3)
        bx, by, bz = _e(s["b"], 3)
        w = F.sqrt((ax * ax + ay * ay + az * az) * (bx * bx + by * by + bz * bz)) + ax * bx + ay * by + az * bz
        return qnormalize(F.array(w, ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx))

    return let(F.struct(a.alias("a"), b.alias("b")), go)


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Shortest-arc interpolation; nearly equal inputs fall back to lerp."""

    def go(s: Column) -> Column:
        d0 = qdot(s["a"], s["b"])

        def inner(u: Column) -> Column:
            d = F.least(F.abs(u["d"]), F.lit(1.0))
            sign = F.when(u["d"] < 0, -1.0).otherwise(1.0)
            th = F.acos(d)
            near = d > 0.9995
            wa = F.when(near, 1 - s["t"]).otherwise(F.sin((1 - s["t"]) * th) / F.sin(th))
            wb = sign * F.when(near, s["t"]).otherwise(F.sin(s["t"] * th) / F.sin(th))
            return let(F.struct(wa.alias("wa"), wb.alias("wb")), lambda k: F.zip_with(s["a"], s["b"], lambda p, q: p * k["wa"] + q * k["wb"]))

        return qnormalize(let(F.struct(d0.alias("d")), inner))

    return let(F.struct(a.alias("a"), b.alias("b"), t.cast("double").alias("t")), go)


def relative_angle(a: Column, b: Column) -> Column:
    """Angle of the rotation between two unit quaternions."""
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(qdot(a, b))))


def axis_angle_to_quat(r: Column) -> Column:
    def go(s: Column) -> Column:
        x, y, z = _e(s, 3)

        def inner(th: Column) -> Column:
            k = F.when(th < 1e-6, 0.5 - th * th / 48).otherwise(F.sin(th / 2) / th)
            return F.array(F.cos(th / 2), x * k, y * k, z * k)

        return let(F.sqrt(x * x + y * y + z * z), inner)

    return let(r, go)


def quat_to_axis_angle(q: Column) -> Column:
    def go(s: Column) -> Column:
        w, x, y, z = _e(s, 4)

        def inner(n: Column) -> Column:
            th = 2 * F.atan2(n, w)
            k = F.when(n < 1e-6, F.lit(2.0)).otherwise(th / n)
            return F.array(x * k, y * k, z * k)

        return let(F.sqrt(x * x + y * y + z * z), inner)

    return let(q, go)


def quat_to_matrix(q: Column) -> Column:
    def go(s: Column) -> Column:
        w, x, y, z = _e(s, 4)
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
            2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
            2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
        )

    return let(q, go)


def matrix_to_quat(m: Column) -> Column:
    """Uses the largest of the four candidate components, so it is stable
    near every half turn."""

    def go(s: Column) -> Column:
        a = _e(s, 9)
        squares = F.array(1 + a[0] + a[4] + a[8], 1 + a[0] - a[4] - a[8], 1 - a[0] + a[4] - a[8], 1 - a[0] - a[4] + a[8])
        sums = {
            0: lambda r: (r, a[7] - a[5], a[2] - a[6], a[3] - a[1]),
            1: lambda r: (a[7] - a[5], r, a[3] + a[1], a[2] + a[6]),
            2: lambda r: (a[2] - a[6], a[3] + a[1], r, a[5] + a[7]),
            3: lambda r: (a[3] - a[1], a[6] + a[2], a[7] + a[5], r),
        }

        def pick(sq: Column) -> Column:
            best = F.array_position(sq, F.array_max(sq)) - 1
            out = None
            for i, f in sums.items():
                r = F.get(sq, F.lit(i))
                cand = F.array(*[v / (2 * F.sqrt(r)) for v in f(r)])
                out = F.when(best == i, cand) if out is None else out.when(best == i, cand)
            return standardize(out)

        return let(squares, pick)

    return let(m, go)


def matmul(a: Column, b: Column) -> Column:
    def go(s: Column) -> Column:
        x, y = _e(s["a"], 9), _e(s["b"], 9)
        return F.array(*[sum((x[3 * i + k] * y[3 * k + j] for k in range(1, 3)), x[3 * i] * y[j]) for i in range(3) for j in range(3)])

    return let(F.struct(a.alias("a"), b.alias("b")), go)


def transpose(m: Column) -> Column:
    a = _e(m, 9)
    return F.array(*[a[3 * j + i] for i in range(3) for j in range(3)])


def sixd_to_matrix(r6: Column, rows: bool = True) -> Column:
    """Gram-Schmidt on the two stored directions."""

    def unit(a: Column) -> Column:
        return let(a, lambda s: let(F.sqrt(sum((x * x for x in _e(s, 3)), F.lit(0.0))), lambda n: F.transform(s, lambda v: v / n)))

    def cross(a: Column, b: Column) -> Column:
        p, q = _e(a, 3), _e(b, 3)
        return F.array(p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])

    def go(s: Column) -> Column:
        def second(b1: Column) -> Column:
            a2 = F.slice(s, 4, 3)
            d = sum((x * y for x, y in zip(_e(b1, 3), _e(a2, 3))), F.lit(0.0))
            b2 = unit(F.zip_with(a2, b1, lambda p, q: p - d * q))
            return let(F.struct(b1.alias("u"), b2.alias("v")), lambda k: F.concat(k["u"], k["v"], cross(k["u"], k["v"])))

        return let(unit(F.slice(s, 1, 3)), second)

    m = let(r6, go)
    return m if rows else let(m, transpose)


def matrix_to_sixd(m: Column, rows: bool = True) -> Column:
    return F.slice(m, 1, 6) if rows else let(m, lambda s: F.slice(transpose(s), 1, 6))


def euler_to_quat(angles: Column, axes: str = "XYZ") -> Column:
    """Intrinsic Euler angles (radians) about ``axes`` in order."""
    q = None
    for i, ax in enumerate(axes.upper()):
        half = F.get(angles, F.lit(i)) / 2
        parts = [F.cos(half)] + [F.sin(half) if ax == c else F.lit(0.0) for c in "XYZ"]
        one = F.array(*parts)
        q = one if q is None else qmul(q, one)
    return q


def quat_to_euler(q: Column, axes: str = "XYZ") -> Column:
    """Tait-Bryan angles (three different axes), inverse of
    :func:`euler_to_quat` away from gimbal lock."""
    i, j, k = ("XYZ".index(c) for c in axes.upper())
    if len({i, j, k}) != 3:
        raise ValueError("axes must be three different letters")
    parity = 1.0 if (j - i) % 3 == 1 else -1.0

    def go(m: Column) -> Column:
        a = _e(m, 9)

        def at(r: int, c: int) -> Column:
            return a[3 * r + c]

        mid = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), parity * at(i, k))))
        first = F.atan2(-parity * at(j, k), at(k, k))
        third = F.atan2(-parity * at(i, j), at(i, i))
        return F.array(first, mid, third)

    return let(quat_to_matrix(q), go)


def yaw(q: Column) -> Column:
    """Heading angle about the vertical (y) axis."""
    w, x, y, z = _e(q, 4)
    return F.atan2(2 * (x * z + w * y), 1 - 2 * (x * x + y * y))


def heading_quat(q: Column) -> Column:
    return let(yaw(q), lambda t: vec(F.cos(t / 2), 0.0, F.sin(t / 2), 0.0))


def remove_heading(q: Column) -> Column:
    return qmul(qinv(heading_quat(q)), q)


_TO_QUAT = {
    "quaternion": lambda c: c,
    "matrix": matrix_to_quat,
    "axis_angle": axis_angle_to_quat,
    "sixd": lambda c: matrix_to_quat(sixd_to_matrix(c)),
    "euler": euler_to_quat,
}
_FROM_QUAT = {
    "quaternion": lambda c: c,
    "matrix": quat_to_matrix,
    "axis_angle": quat_to_axis_angle,
    "sixd": lambda c: matrix_to_sixd(quat_to_matrix(c)),
    "euler": quat_to_euler,
}


def convert(c: Column, src: str, dst: str) -> Column:
    """Any of quaternion, matrix, axis_angle, sixd, euler to any other."""
    return _FROM_QUAT[dst](let(_TO_QUAT[src](c), lambda x: x))
