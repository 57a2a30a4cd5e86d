"""Time grids, as-of joins and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions import rotation as R
from kinetable.operators.blocks import Seq, grid, neighbors, scan


def target_grid(df: DataFrame, keys: list[str], last_t: str, fps: float) -> DataFrame:
    """Rows ``t = i / fps`` up to ``last_t`` (+1e-9) for every key."""
    last = F.floor((F.col(last_t) + 1e-9) * fps)
    g = grid(df, keys, F.lit(0).cast("long"), last, "i")
    return g.withColumn("t", F.col("i") / F.lit(float(fps)))


def densify(df: DataFrame, seq: Seq, spans: DataFrame) -> DataFrame:
    """Put sparse rows on the full frame grid. ``spans`` holds the keys and
    the inclusive ``first``/``last`` frame of every sequence."""
    g = grid(spans, seq.keys, F.col("first"), F.col("last"), seq.order)
    return g.join(df, [*seq.keys, seq.order], "left")


def between(o: Column, x: Column, a: Column, b: Column) -> Column:
    """``x``, or the line at ``o`` through the known samples (t, v) before and after it."""
    lerp = a["v"] + (b["v"] - a["v"]) * (o - a["t"]) / (b["t"] - a["t"])
    return F.when(x.isNotNull(), x.cast("double")).otherwise(F.coalesce(lerp, a["v"], b["v"]))


def interpolate_gaps(df: DataFrame, seq: Seq, cols: list[str]) -> DataFrame:
    """Linear inside gaps, held at both ends."""
    o = F.col(seq.order)
    pick = {c: F.when(F.col(c).isNotNull(), F.struct(o.alias("t"), F.col(c).cast("double").alias("v"))) for c in cols}
    d = scan(df, seq, last={f"_l{i}": pick[c] for i, c in enumerate(cols)}, next={f"_n{i}": pick[c] for i, c in enumerate(cols)})

    out = {c: between(o, F.col(c), F.col(f"_l{i}"), F.col(f"_n{i}")) for i, c in enumerate(cols)}
    return d.withColumns(out).drop(*[f"_{p}{i}" for p in "ln" for i in range(len(cols))])


def bracket(src: DataFrame, dst: DataFrame, keys: list[str], t: str, payload: Column, width: float) -> DataFrame:
    """Give every ``dst`` row the source samples at or before and after it.

    Both sides are put on one time line and scanned, so no pair of rows is
    ever joined by range. Times of ``dst`` may repeat; those of ``src`` may not.
    """
    d = dst.select(*keys, F.col(t).cast("double").alias("_t"), F.struct(*dst.columns).alias("_row"))
    s = src.select(*keys, F.col(t).cast("double").alias("_t"), payload.alias("_s"))
    both = s.unionByName(d, allowMissingColumns=True).withColumn("_kind", F.col("_row").isNotNull())
    seq = Seq(tuple(keys), "_t", width, ties=("_kind",))  # samples come before equal-time rows
    out = scan(both, seq, last={"prev": F.col("_s")}, next={"following": F.col("_s")})
    return out.where(F.col("_row").isNotNull()).select("_row.*", "prev", "following")


def asof_nearest(
    src: DataFrame, dst: DataFrame, keys: list[str], t: str, cols: list[str], width: float = 3600.0
) -> DataFrame:
    """Nearest source sample for each destination time; the earlier on ties.

    ``width`` is the span of time one task holds.
    """
    pay = F.struct(F.col(t).cast("double").alias("t"), *cols)
    d = bracket(src, dst, keys, t, pay, width)
    tt = F.col(t).cast("double")
    left = F.col("following").isNull() | (tt - F.col("prev.t") <= F.col("following.t") - tt)
    chosen = F.when(F.col("prev").isNotNull() & left, F.col("prev")).otherwise(F.col("following"))
    return d.select(*dst.columns, *[chosen[c].alias(c) for c in cols])


def asof_linear(
    src: DataFrame, dst: DataFrame, seq: Seq, t: str, cols: list[str], width: float = 3600.0
) -> DataFrame:
    """Linear interpolation between bracketing samples, extrapolated from the
    two border samples outside. ``seq`` numbers the source rows densely."""
    keys = list(seq.keys)
    pair = F.struct(F.col(t).cast("double").alias("t"), *[F.col(c).cast("double").alias(c) for c in cols])
    s = neighbors(
        src.withColumn("_p", pair), seq, 1, 1, {"_b": lambda w: F.lag("_p").over(w), "_a": lambda w: F.lead("_p").over(w)}
    )
    d = bracket(s, dst, keys, t, F.struct(F.col("_p").alias("p"), F.col("_b").alias("b"), F.col("_a").alias("a")), width)
    tt = F.col(t).cast("double")
    lo = F.coalesce(F.when(F.col("following").isNull(), F.coalesce("prev.b", "prev.p")), F.col("prev.p"), F.col("following.p"))
    hi = F.coalesce(F.when(F.col("prev").isNull(), F.coalesce("following.a", "following.p")), F.col("following.p"), F.col("prev.p"))
    d = d.withColumns({"_lo": lo, "_hi": hi})
    span = F.col("_hi.t") - F.col("_lo.t")
    frac = F.when(span != 0, (tt - F.col("_lo.t")) / span).otherwise(0.0)
    return d.select(
        *dst.columns, *[(F.col("_lo")[c] + (F.col("_hi")[c] - F.col("_lo")[c]) * frac).alias(c) for c in cols]
    )


def sign_continuity(df: DataFrame, seq: Seq, quat: str) -> DataFrame:
    """Flip quaternions so that successive ones have non-negative dot."""
    d = neighbors(df, seq, 1, 0, {"_q": lambda w: F.lag(quat).over(w)})
    flips = F.when(R.qdot(F.col("_q"), F.col(quat)) < 0, 1).otherwise(0)
    d = scan(d, seq, sums={"_k": flips})
    flipped = F.when(F.col("_k") % 2 == 1, F.transform(quat, lambda v: -v)).otherwise(F.col(quat))
    return d.withColumn(quat, flipped).drop("_q", "_k")


def resample_rotations(
    src: DataFrame, dst: DataFrame, seq: Seq, t: str, quat: str, width: float = 3600.0
) -> DataFrame:
    """Slerp between bracketing samples after sign continuity. One row per
    joint and frame: put the joint into ``seq.keys``."""
    s = sign_continuity(src, seq, quat)
    d = bracket(s, dst, list(seq.keys), t, F.struct(F.col(t).cast("double").alias("t"), F.col(quat).alias("q")), width)
    a, b = F.coalesce("prev", "following"), F.coalesce("following", "prev")
    d = d.withColumns({"_a": a, "_b": b})
    span = F.col("_b.t") - F.col("_a.t")
    frac = F.when(span != 0, (F.col(t).cast("double") - F.col("_a.t")) / span).otherwise(0.0)
    return d.select(*dst.columns, R.slerp(F.col("_a.q"), F.col("_b.q"), frac).alias(quat))
