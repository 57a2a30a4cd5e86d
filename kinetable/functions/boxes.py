"""Column functions for boxes and 2-D keypoints.

A box is four double columns. Corner boxes are x1, y1, x2, y2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetable.functions import vectors as V

# left/right partners of the 17 body keypoints.
FLIP_17 = (0, 2, 1, 4, 3, 6, 5, 8, 7, 10, 9, 12, 11, 14, 13, 16, 15)

Box = tuple[Column, Column, Column, Column]


def iou(a: Box, b: Box, inclusive: bool = False) -> Column:
    """Overlap of corner boxes; ``inclusive`` counts border pixels."""
    one = F.lit(1.0 if inclusive else 0.0)
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + one)
    h = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + one)
    inter = w * h
    union = (a[2] - a[0] + one) * (a[3] - a[1] + one) + (b[2] - b[0] + one) * (b[3] - b[1] + one) - inter
    return F.when(union > 0, inter / union).otherwise(zero)


def corner_from_xywh(x: Column, y: Column, w: Column, h: Column, center: bool = False) -> Box:
    """xywh to corners; ``center`` reads x, y as the middle."""
    if center:
        return x - w / 2, y - h / 2, x + w / 2, y + h / 2
    return x, y, x + w, y + h


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def area_ratio(a: Box, b: Box) -> Column:
    return F.when(area(b) != 0, area(a) / area(b)).otherwise(F.lit(0.0))


def from_points(kps: Column, thr: float = 0.0) -> Box:
    """Bounds of the keypoints with confidence above ``thr``."""
    good = F.filter(kps, lambda k: k["conf"] > thr)
    xs, ys = F.transform(good, lambda k: k["x"]), F.transform(good, lambda k: k["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def mask_box_ratio(mask_area: Column, b: Box) -> Column:
    """Share of a box that a mask covers; 0 for a box without area."""
    return F.when(area(b) > 0, mask_area / area(b)).otherwise(F.lit(0.0))


def center_size(b: Box, aspect: float = 192 / 256, enlarge: float = 1.2) -> tuple[Column, Column, Column]:
    """Center and side length of the square-able box: the box is first widened
    to ``aspect`` (width/height), its height is the size."""
    w, h = b[2] - b[0], b[3] - b[1]
    size = F.greatest(w / F.lit(aspect), h) * F.lit(enlarge)
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, size


def from_center_size(cx: Column, cy: Column, size: Column) -> Box:
    return cx - size / 2, cy - size / 2, cx + size / 2, cy + size / 2


def flip(b: Box, width: Column | float) -> Box:
    """Mirror about the vertical middle of an image of ``width``."""
    w = width if isinstance(width, Column) else F.lit(float(width))
    return w - b[2], b[1], w - b[0], b[3]


def valid(b: Box, width: Column | float, height: Column | float) -> Column:
    ok = (b[0] >= 0) & (b[1] >= 0) & (b[2] <= width) & (b[3] <= height) & (b[0] < b[2]) & (b[1] < b[3])
    for c in b:
        ok = ok & ~F.isnan(c.cast("double")) & (c == F.floor(c))
    return F.coalesce(ok, F.lit(False))


def keypoint_shift(a: Column, b: Column) -> Column:
    """Mean distance between two keypoint arrays of structs (x, y)."""
    d = F.zip_with(a, b, lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])))
    return V.mean(d)


def mean_confidence(kps: Column) -> Column:
    return V.mean(F.transform(kps, lambda k: k["conf"].cast("double")))


def upside_down(kps: Column, thr: float = 0.65) -> Column:
    """Nose lower in the image than a confident ankle (keypoints 0, 15, 16)."""
    nose = F.get(kps, F.lit(0))

    def below(i: int) -> Column:
        ankle = F.get(kps, F.lit(i))
        return (nose["conf"] > thr) & (ankle["conf"] > thr) & (nose["y"] > ankle["y"])

    return F.coalesce(below(15), F.lit(False)) | F.coalesce(below(16), F.lit(False))


def normalize_keypoints(kps: Column, cx: Column, cy: Column, size: Column) -> Column:
    """Map to [-1, 1] in the box; confidence 0 outside it."""

    def one(k: Column) -> Column:
        x, y = (k["x"] - cx) * 2 / size, (k["y"] - cy) * 2 / size
        inside = (F.abs(x) <= 1) & (F.abs(y) <= 1)
        return F.struct(x.alias("x"), y.alias("y"), F.when(inside, k["conf"]).otherwise(F.lit(0.0)).alias("conf"))

    return F.transform(kps, one)


def flip_keypoints(kps: Column, width: float, order: tuple[int, ...] = FLIP_17) -> Column:
    """Mirror x and exchange left and right entries."""
    idx = F.array(*[F.lit(i) for i in order])
    return F.transform(
        idx,
        lambda i: F.struct(
            (F.lit(float(width)) - F.get(kps, i)["x"]).alias("x"),
            F.get(kps, i)["y"].alias("y"),
            F.get(kps, i)["conf"].alias("conf"),
        ),
    )
