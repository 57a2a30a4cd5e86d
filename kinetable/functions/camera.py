"""Pinhole camera and ground-frame Column functions. Points are three doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec3 = tuple[Column, Column, Column]


def focal_length(width: Column, height: Column) -> Column:
    """Diagonal of the image: a field of view of about 53 degrees."""
    return F.sqrt(width * width + height * height)


def project(p: Vec3, f: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    return f * p[0] / p[2] + cx, f * p[1] / p[2] + cy


def unproject(u: Column, v: Column, depth: Column, f: Column, cx: Column, cy: Column) -> Vec3:
    return (u - cx) * depth / f, (v - cy) * depth / f, depth


def full_camera_translation(
    s: Column, tx: Column, ty: Column, bx: Column, by: Column, size: Column, f: Column, cx: Column, cy: Column
) -> Vec3:
    """Translation in the full image from a weak-perspective box camera."""
    sb = s * size
    return tx + 2 * (bx - cx) / sb, ty + 2 * (by - cy) / sb, 2 * f / sb


def box_camera(
    t: Vec3, bx: Column, by: Column, size: Column, f: Column, cx: Column, cy: Column
) -> Vec3:
    """Inverse of :func:`full_camera_translation`: (s, tx, ty)."""
    sb = 2 * f / t[2]
    return sb / size, t[0] - 2 * (bx - cx) / sb, t[1] - 2 * (by - cy) / sb


def bbox_info(bx: Column, by: Column, size: Column, f: Column, cx: Column, cy: Column) -> Vec3:
    """Box position and size relative to the focal length."""
    return (bx - cx) / f, (by - cy) / f, size / f


def in_fov(u: Column, v: Column, width: Column | float, height: Column | float) -> Column:
    return (u >= 0) & (u < width) & (v >= 0) & (v < height)


def rotate3(r: list[Column], p: Vec3) -> Vec3:
    """Row-major 3x3 ``r`` times ``p``."""
    return tuple(r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] for i in range(3))


def rigid_transform(r: list[Column], t: Vec3, p: Vec3) -> Vec3:
    q = rotate3(r, p)
    return q[0] + t[0], q[1] + t[1], q[2] + t[2]
