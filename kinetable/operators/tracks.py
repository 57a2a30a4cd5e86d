"""Detection tracks: cleaning, identity repair, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kinetable.functions import boxes as B
from kinetable.operators.blocks import Seq, grid, neighbors, pipeline, scan
from kinetable.operators.resample import between
from kinetable.operators.runs import max_gap
from kinetable.operators.smoothing import mean_reach, mean_window


def track_gate(df: DataFrame, seq: Seq, present: Column, max_missing: int = 60, min_duration: int = 30) -> DataFrame:
    """Keys of tracks without a long gap and of sufficient duration. ``df`` is
    already on the full grid, so border gaps count."""
    g = max_gap(df, seq, present)
    return g.where((F.col("max_gap") <= max_missing) & (F.col("duration") >= min_duration)).select(*seq.keys)


def clean_tracks(
    detections: DataFrame,
    spans: DataFrame,
    seq: Seq,
    cols: list[str],
    anomaly: Column | None = None,
    max_missing: int = 60,
    min_duration: int = 30,
    width: int = 5,
) -> DataFrame:
    """Densify, drop bad tracks, interpolate, smooth twice, flag.

    Flags mark interpolated frames and, through ``anomaly`` (an expression on
    ``prev_<col>`` and ``<col>``), frames that jump. All steps share one
    shuffle of the detections; see :func:`kinetable.operators.blocks.pipeline`.
    A null key is a key of its own.
    """
    o = F.col(seq.order)
    frames = grid(spans, seq.keys, F.col("first"), F.col("last"), seq.order).withColumn("_grid", F.lit(True))
    rows = frames.unionByName(detections.withColumn("_grid", F.lit(False)), allowMissingColumns=True)
    lo, hi = mean_reach(width, "replicate")
    present = F.col(cols[0]).isNotNull()

    def densified(d: DataFrame, w: WindowSpec) -> DataFrame:
        """Detections on the grid, and grid frames without one."""
        at = Window.partitionBy("_g", seq.order)
        d = d.withColumns({"_on": F.max("_grid").over(at), "_seen": F.min("_grid").over(at)})
        d = d.where(F.col("_on") & (F.col("_seen") | ~F.col("_grid"))).drop("_on", "_seen")
        mine = F.when(present & ~F.col("_halo"), o)
        return d.withColumn("_gap", mine - F.last(mine, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) - 1)

    here = F.when(~F.col("_halo"), o)
    summary = {
        "_a": F.min(here), "_z": F.max(here), "_p": F.min(F.when(present, here)), "_q": F.max(F.when(present, here)), "_m": F.max("_gap"),
    }

    def good(blocks: DataFrame, whole: WindowSpec, back: WindowSpec) -> DataFrame:
        lead = F.col("_p") - F.coalesce(F.max("_q").over(back), F.min("_a").over(whole) - 1) - 1
        tail = F.max("_z").over(whole) - F.max("_q").over(whole)
        d = blocks.withColumns({"_lead": lead, "_tail": tail, "_long": F.max("_q").over(whole) - F.min("_p").over(whole) + 1})
        d = d.withColumn("_worst", F.max(F.greatest("_m", "_lead", "_tail")).over(whole))
        return d.where((F.col("_worst") <= max_missing) & (F.col("_long") >= min_duration))

    def smoothed(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("interpolated", ~present).withColumns({c: between(o, F.col(c), F.col(f"_l{i}"), F.col(f"_n{i}")) for i, c in enumerate(cols)})
        for _ in range(2):
            d = d.withColumns({f"_s{i}": mean_window(c, width, "replicate")(w) for i, c in enumerate(cols)})
            d = d.withColumns({c: F.col(f"_s{i}") for i, c in enumerate(cols)})
        if anomaly is None:
            return d.withColumn("flagged", F.col("interpolated"))
        d = d.withColumns({f"prev_{c}": F.lag(c).over(w) for c in cols})
        return d.withColumn("flagged", F.col("interpolated") | F.coalesce(anomaly, F.lit(False)))

    known = {c: F.when(F.col(c).isNotNull(), F.struct(o.alias("t"), F.col(c).cast("double").alias("v"))) for c in cols}
    last, following = ({f"_{p}{i}": known[c] for i, c in enumerate(cols)} for p in "ln")
    d = pipeline(rows, seq, 2 * lo + 1, 2 * hi, last, following, densified, summary, good, smoothed)
    return d.select(*seq.keys, seq.order, *[c for c in detections.columns if c not in (*seq.keys, seq.order)], "interpolated", "flagged")


def variation_anomalies(df: DataFrame, seq: Seq, step: Column, size: Column, ratio: float = 0.2) -> DataFrame:
    """Rows whose ``step`` (on ``prev_<col>`` columns) exceeds ratio * size."""
    cols = [c for c in df.columns if c not in seq.keys and c != seq.order]
    d = neighbors(df, seq, 1, 0, {f"prev_{c}": (lambda w, c=c: F.lag(c).over(w)) for c in cols})
    return d.where(step > ratio * size).drop(*[f"prev_{c}" for c in cols])


def track_summary(df: DataFrame, keys: list[str], frame: str, area: Column) -> DataFrame:
    """First and last frame, length, summed area, and rank by area."""
    s = df.groupBy(*keys).agg(
        F.min(frame).alias("first"), F.max(frame).alias("last"), F.count(F.lit(1)).alias("length"), F.sum(area).alias("area")
    )
    w = Window.partitionBy(*keys[:-1]).orderBy(F.desc("area"), keys[-1])
    return s.withColumn("rank", F.row_number().over(w).cast("long")) if keys[:-1] else s


def target_ids(df: DataFrame, keys: list[str], frame: str, score: str, fps: int, thr: float = 0.65) -> DataFrame:
    """Tracks whose mean score over the first second beats ``thr``."""
    s = df.where(F.col(frame) < fps).groupBy(*keys).agg(F.avg(score).alias("score"))
    return s.where(F.col("score") > thr)


def reidentify(df: DataFrame, seq: Seq, box: list[str], kps: str | None = None, iou_min: float = 0.3,
               ratio: tuple[float, float] = (0.66, 1.5), shift: float = 300.0, center: bool = False) -> DataFrame:
    """Open a new identity where a track jumps between successive rows.

    ``box`` names x, y, w, h. ``part`` numbers the identities of a track.
    """
    stage = {f"_p{i}": (lambda w, c=c: F.lag(c).over(w)) for i, c in enumerate(box)}
    if kps:
        stage["_pk"] = lambda w: F.lag(kps).over(w)
    d = neighbors(df, seq, 1, 0, stage)
    cur = B.corner_from_xywh(*[F.col(c) for c in box], center=center)
    old = B.corner_from_xywh(*[F.col(f"_p{i}") for i in range(4)], center=center)
    r = B.area_ratio(cur, old)
    jump = (B.iou(cur, old) < iou_min) | ~r.between(*ratio)
    if kps:
        jump = jump | (B.keypoint_shift(F.col(kps), F.col("_pk")) > shift)
    has = F.col("_p0").isNotNull()
    d = scan(d, seq, sums={"part": (has & F.coalesce(jump, F.lit(False))).cast("long")})
    return d.drop("_pk", *[f"_p{i}" for i in range(4)])


def align_person_timelines(df: DataFrame, group: list[str], person: str, frame: str, defaults: dict[str, Column]) -> DataFrame:
    """Give every person of a group a row on every frame of the group; rows
    without a detection carry the default values."""
    span = df.groupBy(*group).agg(F.min(frame).alias("_a"), F.max(frame).alias("_z"))
    people = df.select(*group, person).distinct().join(span, group)
    g = grid(people, [*group, person], F.col("_a"), F.col("_z"), frame)
    d = g.join(df.withColumn("detected", F.lit(True)), [*group, person, frame], "left")
    d = d.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})
    return d.withColumn("detected", F.coalesce("detected", F.lit(False)))
