"""Label smoothing and weighted moving windows with edge rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from kinetable.operators.blocks import Seq, WindowExpr, neighbors


def list_mode(labels: Column) -> Column:
    """Most frequent entry; the one seen first wins ties. Null is an entry
    like any other, and the mode of an empty list."""
    kinds = F.array_distinct(labels)
    counts = F.transform(kinds, lambda k: F.size(F.filter(labels, lambda x: x.eqNullSafe(k))))
    return F.get(kinds, F.array_position(counts, F.array_max(counts)).cast("int") - 1)


def trailing_parts(label: str, width: int) -> tuple[dict[str, WindowExpr], Column]:
    """The bounded window that a majority of the last ``width`` labels reads, and the majority made from it."""
    stage = {"_ls": lambda w: F.collect_list(F.struct(F.col(label).alias("v"))).over(w.rowsBetween(-(width - 1), 0))}
    return stage, list_mode(F.transform("_ls", lambda x: x["v"]))


def trailing_mode(df: DataFrame, seq: Seq, label: str, width: int = 20, out: str = "smoothed") -> DataFrame:
    """Majority label of the last ``width`` rows including the current one.
    Rows without a label count as the label null."""
    stage, mode = trailing_parts(label, width)
    return neighbors(df, seq, width - 1, 0, stage).withColumn(out, mode).drop(*stage)


def gaussian_weights(sigma: float, radius: int) -> list[float]:
    raw = [math.exp(-0.5 * (j / sigma) ** 2) for j in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def _mirror(i: Column, m: Column) -> Column:
    """Half-sample symmetric index: … 1 0 | 0 1 … m-1 | m-1 …"""
    p = F.pmod(i, 2 * m)
    return F.when(p < m, p).otherwise(2 * m - 1 - p)


def _clamp(i: Column, m: Column) -> Column:
    return F.greatest(F.lit(0), F.least(i, m - 1))


_EDGES = {"reflect": _mirror, "replicate": _clamp, "nearest": _clamp}


def gaussian_radius(sigma: float, radius: int | None = None) -> int:
    return int(4 * sigma + 0.5) if radius is None else radius


def gaussian_parts(cols: list[str], sigma: float, edge: str = "reflect", radius: int | None = None) -> tuple[dict[str, WindowExpr], dict[str, Column]]:
    """The bounded windows that a Gaussian mean of ``cols`` reads, and the means made from them."""
    r = gaussian_radius(sigma, radius)
    place = _EDGES[edge]
    weights = F.array(*[F.lit(x) for x in gaussian_weights(sigma, r)])
    names = {c: f"_w{i}" for i, c in enumerate(cols)}
    stage = {n: (lambda w, c=c: F.collect_list(F.struct(F.col(c).cast("double").alias("v"))).over(w.rowsBetween(-r, r))) for c, n in names.items()}
    stage["_before"] = lambda w: F.count(F.lit(1)).over(w.rowsBetween(-r, -1)).cast("int")

    def smooth(n: str) -> Column:
        m = F.size(n)
        value = lambda k: F.get(F.col(n), place(F.col("_before") + k - r, m))["v"]
        steps = F.sequence(F.lit(0), F.lit(2 * r))
        known = F.filter(steps, lambda k: value(k).isNotNull())
        add = lambda a, v: a + v
        total = F.aggregate(F.transform(known, lambda k: F.get(weights, k) * value(k)), F.lit(0.0), add)
        share = F.aggregate(F.transform(known, lambda k: F.get(weights, k)), F.lit(0.0), add)
        return F.when(F.size(known) == 2 * r + 1, total).when(F.size(known) > 0, total / share)

    return stage, {c: smooth(n) for c, n in names.items()}


def gaussian_smooth(
    df: DataFrame, seq: Seq, cols: list[str], sigma: float, edge: str = "reflect", radius: int | None = None
) -> DataFrame:
    """Gaussian-weighted mean over ``radius`` rows to each side.

    Near a sequence border the window list is shorter and its missing places
    are read through the edge rule. Null rows keep their place and carry no
    weight: the mean is over the others, null if there are none.
    """
    r = gaussian_radius(sigma, radius)
    stage, means = gaussian_parts(cols, sigma, edge, radius)
    return neighbors(df, seq, r, r, stage).withColumns(means).drop(*stage)


def mean_reach(width: int, edge: str) -> tuple[int, int]:
    """Rows before and after that a mean over ``width`` rows reads."""
    hi = (width - 1) // 2 if edge == "zero" else width // 2
    return (width - 1 - hi if edge == "zero" else width // 2), hi


def mean_window(c: str, width: int, edge: str) -> WindowExpr:
    lo, hi = mean_reach(width, edge)

    def expr(w: WindowSpec) -> Column:
        f = w.rowsBetween(-lo, hi)
        x = F.col(c).cast("double")
        s = F.sum(x).over(f)
        if edge == "replicate":
            left = F.lit(lo) - F.count(F.lit(1)).over(w.rowsBetween(-lo, -1))
            right = F.lit(hi) - F.count(F.lit(1)).over(w.rowsBetween(1, hi))
            s = s + left * F.first(x).over(f) + right * F.last(x).over(f)
        return s / F.lit(float(lo + hi + 1))

    return expr


def moving_average(df: DataFrame, seq: Seq, cols: list[str], width: int, edge: str = "zero") -> DataFrame:
    """Mean over ``width`` rows. ``zero`` pads with zeros (for even widths the
    window reaches one row further back); ``replicate`` repeats border rows."""
    lo, hi = mean_reach(width, edge)
    stage = {f"_m{i}": mean_window(c, width, edge) for i, c in enumerate(cols)}
    d = neighbors(df, seq, lo, hi, stage)
    return d.withColumns({c: F.col(f"_m{i}") for i, c in enumerate(cols)}).drop(*stage)
