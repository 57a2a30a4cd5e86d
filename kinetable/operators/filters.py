"""Row, track, clip and group filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions import boxes as B
from kinetable.functions import camera as C
from kinetable.functions import vectors as V


def min_duration(df: DataFrame, start: str, end: str, seconds: float = 4.0) -> DataFrame:
    return df.where(F.col(end) - F.col(start) >= seconds)


def drop_short_segments(df: DataFrame, frames: str, fps: Column, seconds: float = 2.0) -> DataFrame:
    return df.where(F.col(frames) >= F.floor(fps * seconds))


def min_length_gate(df: DataFrame, keys: list[str], window: int = 64) -> DataFrame:
    """Rows of clips with at least ``window`` rows. Counting is map-side and
    only clip keys travel to the semi join."""
    ok = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= window).select(*keys)
    return df.join(ok, keys, "left_semi")


def nan_gate(df: DataFrame, keys: list[str], bad: Column) -> DataFrame:
    """Rows of sequences in which no row is ``bad`` (usually has_nan)."""
    return df.join(df.where(bad).select(*keys).distinct(), keys, "left_anti")


def finite_filter(df: DataFrame, col: str) -> DataFrame:
    return df.where(V.is_finite(F.col(col)))


def track_conf_gate(df: DataFrame, keys: list[str], conf: Column, thr: float = 0.55) -> DataFrame:
    """Tracks whose mean over frames and joints reaches ``thr``. ``conf`` is
    the array of joint confidences."""
    s = df.groupBy(*keys).agg((F.sum(V.total(conf)) / F.sum(F.size(conf))).alias("mean_conf"))
    return s.where(F.col("mean_conf") >= thr)


def low_conf_frames(df: DataFrame, conf: Column, thr: float = 0.5) -> DataFrame:
    return df.withColumn("low_conf", V.mean(conf) < thr)


def static_clip_filter(df: DataFrame, keys: list[str], dtheta: Column, jerk: Column, a: float = 0.02, b: float = 0.05) -> DataFrame:
    """Keys of clips that move: dropped only when both means are low."""
    s = df.groupBy(*keys).agg(F.avg(dtheta).alias("mean_dtheta"), F.avg(jerk).alias("mean_jerk"))
    return s.where(~((F.col("mean_dtheta") < a) & (F.col("mean_jerk") < b)))


def crowd_flag(df: DataFrame, keys: list[str], frame: str, n: int = 7) -> DataFrame:
    per = df.groupBy(*keys, frame).agg(F.count(F.lit(1)).alias("_c"))
    return per.groupBy(*keys).agg(F.max(F.col("_c") > n).alias("crowded"))


def upside_down_flag(df: DataFrame, keys: list[str], kps: Column, thr: float = 0.65) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(B.upside_down(kps, thr)).alias("upside_down"))


def human_present(df: DataFrame, keys: list[str], conf: Column, thr: float = 0.5) -> DataFrame:
    """Per frame: is there a detection with mean confidence above ``thr``?"""
    return df.groupBy(*keys).agg(F.max(conf > thr).alias("human"))


def small_bbox(df: DataFrame, keys: list[str], area: Column, thr: float = 60000.0) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(area).alias("max_area")).withColumn("too_small", F.col("max_area") < thr)


def valid_box(df: DataFrame, box: B.Box, width: Column | float, height: Column | float) -> DataFrame:
    return df.where(B.valid(box, width, height))


def face_present(expr: Column, strict: bool = True) -> Column:
    """Mean absolute expression above 1e-6; the loose form only asks for a
    non-zero mean."""
    return V.mean_abs(expr) > 1e-6 if strict else V.mean(expr) != 0


def has_format(formats: Column, height: int = 720) -> Column:
    """Any format with video, without audio, of at least ``height``."""
    return F.coalesce(
        F.exists(formats, lambda f: (f["vcodec"] != "none") & (f["acodec"] == "none") & (f["height"] >= height)), F.lit(False)
    )


def exactly_n_persons(df: DataFrame, scene: list[str], person: str, n: int = 2) -> DataFrame:
    """Scenes with exactly ``n`` persons."""
    people = df.select(*scene, person).distinct()
    return people.groupBy(*scene).agg(F.count(F.lit(1)).alias("persons")).where(F.col("persons") == n)


def sample_scenes(scenes: DataFrame, order: list[Column | str], n: int = 10) -> DataFrame:
    """``n`` scenes in a seeded order; a distributed top-n, not a full sort."""
    return scenes.orderBy(*order).limit(n)


def fov_category(df: DataFrame, keys: list[str], frame: str, u: Column, v: Column, width: float, height: float) -> DataFrame:
    """1 fully visible, 2 partly, 3 partly out, 4 fully out, per clip."""
    inside = C.in_fov(u, v, width, height)
    per = df.groupBy(*keys, frame).agg(F.min(inside).alias("_all"), F.max(inside).alias("_any"))
    g = per.groupBy(*keys).agg(F.min("_all").alias("_a"), F.min("_any").alias("_e"), F.max("_any").alias("_s"))
    cat = F.when(F.col("_a"), 1).when(F.col("_e"), 2).when(~F.col("_s"), 4).otherwise(3)
    return g.select(*keys, cat.alias("category"))


def complete_groups(expected: DataFrame, done: DataFrame, group: list[str], item: list[str]) -> DataFrame:
    """Groups all of whose items are in ``done``."""
    d = done.select(*item).distinct().withColumn("_done", F.lit(True))
    return (
        expected.join(d, item, "left")
        .groupBy(*group)
        .agg(F.min(F.coalesce("_done", F.lit(False))).alias("_ok"))
        .where("_ok")
        .select(*group)
    )


def stride(df: DataFrame, frame: str, n: int) -> DataFrame:
    return df.where(F.col(frame) % n == 0)


def stride_for(fps: float, target: float) -> int:
    return max(1, int(fps / target))


def truncate(df: DataFrame, frame: str, n: int = 500) -> DataFrame:
    return df.where(F.col(frame) < n)


def box_nearby(points: DataFrame, bounds_of: DataFrame, keys: list[str], cols: list[str], pad: float) -> DataFrame:
    """Points within the padded bounds of another set, per key."""
    b = bounds_of.groupBy(*keys).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols]
    )
    near = F.lit(True)
    for c in cols:
        near = near & F.col(c).between(F.col(f"_lo_{c}") - pad, F.col(f"_hi_{c}") + pad)
    return points.join(b, keys).where(near).select(*points.columns)
