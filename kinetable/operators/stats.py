"""Dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions import text as X
from kinetable.operators.percentiles import QUARTILES, percentiles


def distinct_per_group(df: DataFrame, group: list[str], item: list[str], out: str) -> DataFrame:
    """Distinct items per group as two map-combined aggregations."""
    return df.select(*group, *item).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias(out))


def count_summary(counts: DataFrame, col: str) -> DataFrame:
    """Sum, mean and quartiles of a count column."""
    q = percentiles(counts, [], col, QUARTILES)
    s = counts.agg(F.sum(col).alias("total"), F.avg(col).alias("mean"))
    return s.select("*", *[q.select(p).scalar().alias(p) for p in QUARTILES])


def multi_person_scenes(df: DataFrame, scene: list[str], person: list[str], n: int = 2) -> DataFrame:
    return distinct_per_group(df, scene, person, "persons").where(F.col("persons") >= n)


def dataset_totals(df: DataFrame, frames: Column, faces: Column, fps: float = 30.0) -> DataFrame:
    s = df.agg(F.sum(frames).alias("frames"), F.sum(faces).alias("face_frames"))
    sec = F.col("frames") / fps
    return s.withColumns(
        {
            "face_percent": F.when(F.col("frames") > 0, 100.0 * F.col("face_frames") / F.col("frames")),
            "seconds": sec,
            "minutes": sec / 60,
            "hours": sec / 3600,
        }
    )


def scene_totals_max(df: DataFrame, scene: list[str], frames: Column, faces: Column, fps: float = 30.0) -> DataFrame:
    """Totals with each scene counted once: its longest person."""
    per = df.groupBy(*scene).agg(F.max(frames).alias("_f"), F.max(faces).alias("_h"))
    return dataset_totals(per, F.col("_f"), F.col("_h"), fps)


def length_stats(df: DataFrame, dataset: str, seconds: str) -> DataFrame:
    """Clip count, total, extremes and quartiles per dataset."""
    s = df.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("total"), F.min(seconds).alias("shortest"), F.max(seconds).alias("longest")
    )
    return s.join(percentiles(df, [dataset], seconds, QUARTILES), dataset)


def length_histogram(lengths: DataFrame, length: str) -> DataFrame:
    """Clips per exact length; lengths 0 and 1 are rejected."""
    return lengths.where(F.col(length) > 1).groupBy(length).agg(F.count(F.lit(1)).alias("clips"))


def binned_counts(df: DataFrame, col: str, edges: list[float], labels: list[str]) -> DataFrame:
    """Counts in right-closed bins; empty bins are kept, values outside
    dropped. The bin is computed by expression, so nothing is range-joined."""
    x = F.col(col)
    at = F.lit(None).cast("int")
    for i in reversed(range(len(labels))):
        at = F.when((x > edges[i]) & (x <= edges[i + 1]), F.lit(i)).otherwise(at)
    got = df.select(at.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.range(len(labels)).select(
        F.col("id").cast("int").alias("bin"), F.get(F.array(*[F.lit(s) for s in labels]), F.col("id").cast("int")).alias("label")
    )
    return bins.join(got, "bin", "left").select("bin", "label", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, col: str, bins: int, density: bool = False) -> DataFrame:
    """Equal-width bins between min and max, the last one closed."""
    lim = df.agg(F.min(col).cast("double").alias("a"), F.max(col).cast("double").alias("b"), F.count(col).alias("n"))
    a, b, n = (lim.select(c).scalar() for c in "abn")
    width = (b - a) / bins
    d = df.where(F.col(col).isNotNull())
    at = F.when(width > 0, F.least(F.floor((F.col(col) - a) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    got = d.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    out = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left")
    c = F.coalesce("_c", F.lit(0))
    out = out.withColumn("left_edge", a + F.col("bin") * width)
    return out.withColumn("density", c / (n * width)).drop("_c") if density else out.withColumn("n", c).drop("_c")


def moments(df: DataFrame, keys: list[str], col: str, ps: dict[str, float]) -> DataFrame:
    s = df.groupBy(*keys).agg(F.avg(col).alias("mean"), F.var_pop(col).alias("variance"))
    return s.join(percentiles(df, keys, col, ps), keys)


def amplitude(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Length of the per-axis range over each group."""
    return df.groupBy(*keys).agg(
        F.sqrt(sum(((F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in cols), F.lit(0.0))).alias("amplitude")
    )


def element_counts(df: DataFrame, json_col: str) -> DataFrame:
    """Entries per JSON object document; 0 when unreadable."""
    n = F.coalesce(F.size(F.json_object_keys(json_col)), F.lit(0))
    return df.withColumn("entries", n)


def word_counts(df: DataFrame, text: str, stopwords: list[str], n: int | None = None, min_len: int = 2) -> DataFrame:
    """Word frequencies without stopwords; counting is combined map-side, so
    very common words cost one row per task."""
    w = df.select(F.explode(X.words(F.col(text), stopwords, min_len)).alias("word"))
    c = w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return c if n is None else c.orderBy(F.desc("n"), "word").limit(n)


def movement_counts(df: DataFrame, block: Column) -> DataFrame:
    return df.withColumn("movements", X.closed_tags(block))


def stage_timing(df: DataFrame, stage: str, seconds: Column) -> DataFrame:
    return df.groupBy(stage).agg(F.sum(seconds).alias("total"), F.count(F.lit(1)).alias("calls"), F.avg(seconds).alias("mean"))


def dataset_rollup(df: DataFrame, levels: list[str], **aggs: Column) -> DataFrame:
    """Totals at every level of the hierarchy at once."""
    return df.rollup(*levels).agg(F.grouping_id().alias("level"), *[c.alias(n) for n, c in aggs.items()])
