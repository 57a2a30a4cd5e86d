"""Chunks, crops, padding, numbering and stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.operators.blocks import grid, number_rows


def chunk(df: DataFrame, keys: list[str], frame: str, size: int, overlap: int = 0, drop_short: bool = True) -> DataFrame:
    """Copy rows into fixed chunks that start every ``size - overlap`` frames.

    A row belongs to at most ceil(size / step) chunks, found by arithmetic.
    Short chunks at the end are dropped (or kept).
    """
    step = size - overlap
    f = F.col(frame)
    first = F.greatest(F.lit(0), F.ceil((f - size + 1) / F.lit(step)))
    d = df.withColumn("chunk", F.explode(F.sequence(first.cast("long"), F.floor(f / F.lit(step)).cast("long"))))
    d = d.withColumn("chunk_frame", f - F.col("chunk") * step)
    if not drop_short:
        return d
    n = df.groupBy(*keys).agg((F.max(frame) + 1).alias("_n"))
    return d.join(n, keys).where(F.col("chunk") * step + size <= F.col("_n")).drop("_n")


def crop_window(df: DataFrame, keys: list[str], frame: str, width: int, pick: Column) -> DataFrame:
    """One window of ``width`` frames per clip; ``pick`` is a non-negative
    integer per clip (a seeded hash), taken modulo the free room."""
    n = df.groupBy(*keys).agg((F.max(frame) + 1).alias("_n")).where(F.col("_n") >= width)
    n = n.withColumn("_s", F.pmod(pick, F.col("_n") - width + 1))
    f = F.col(frame)
    d = df.join(n, keys).where((f >= F.col("_s")) & (f < F.col("_s") + width))
    return d.withColumn("crop_frame", f - F.col("_s")).drop("_n", "_s")


def clip_lengths(df: DataFrame, keys: list[str], frame: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.max(frame) + 1).alias("length"))


def _fit(df: DataFrame, keys: list[str], frame: str, n: int, source: Column) -> DataFrame:
    g = grid(clip_lengths(df, keys, frame), [*keys, "length"], F.lit(0).cast("long"), F.lit(n - 1).cast("long"), "out_frame")
    g = g.withColumn(frame, source).withColumn("is_valid", F.col("out_frame") < F.col("length"))
    return g.join(df, [*keys, frame]).drop("length")


def pad_to(df: DataFrame, keys: list[str], frame: str, n: int, cut: bool = False) -> DataFrame:
    """Exactly ``n`` rows per clip, the last row repeated; ``is_valid`` is the
    length mask. A longer clip is an error unless ``cut`` is asked for."""
    last = F.least(F.col("out_frame"), F.col("length") - 1)
    if not cut:
        text = F.concat(F.lit("a clip of "), F.col("length").cast("string"), F.lit(f" rows does not fit into {n}"))
        last = F.when(F.col("length") > n, F.raise_error(text).cast("long")).otherwise(last)
    return _fit(df, keys, frame, n, last)


def loop_to(df: DataFrame, keys: list[str], frame: str, n: int) -> DataFrame:
    """Exactly ``n`` rows per clip by wrapping around."""
    return _fit(df, keys, frame, n, F.col("out_frame") % F.col("length"))


def length_mask(lengths: DataFrame, keys: list[str], length: str, n: int) -> DataFrame:
    g = grid(lengths, [*keys, length], F.lit(0).cast("long"), F.lit(n - 1).cast("long"), "frame")
    return g.select(*keys, "frame", (F.col("frame") < F.col(length)).alias("is_valid"))


def renumber_segments(df: DataFrame, video: list[str], start: str, bucket: Column, ties: list[str]) -> DataFrame:
    """Number segments 1..n by start within their video."""
    return number_rows(df, video, [start, *ties], bucket, "_n").withColumn("number", F.col("_n") + 1).drop("_n")


def assign_video_numbers(new: DataFrame, existing: DataFrame, number: str, order: list[str], bucket: Column) -> DataFrame:
    """Continue the stored counter for new videos."""
    last = existing.agg(F.coalesce(F.max(number), F.lit(0)).alias("m")).scalar()
    d = number_rows(new, [], order, bucket, "_n")
    return d.withColumn(number, (F.col("_n") + 1 + last).cast("long")).drop("_n")


def interval_stamp(df: DataFrame, first: str, last: str, fps: Column, offset: Column) -> DataFrame:
    return df.withColumns({"start_s": F.col(first) / fps + offset, "end_s": F.col(last) / fps + offset})
