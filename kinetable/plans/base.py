"""How the driver tables play the roles of motion records.

* an event's user is a track and its rank in time the frame;
* the same events averaged over 6-hour buckets form a track with real gaps;
* customers, orders and lines are videos, scenes and persons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.operators.blocks import Seq, fit_bucket, number_rows
from kinetable.plans.registry import table

EV = Seq(("user_id",), "pos")
GRID = Seq(("user_id",), "frame")
EPOCH_GRID = "2024-01-01"

#: Averages of two-decimal values often end exactly on a rounding tie, which
#: two engines may break differently; both sides shift by this before rounding.
OFF_TIE = 3.14159e-8

#: Events with their frame number, for oracle SQL.
EV_SQL = """ev AS (
  SELECT user_id, event_type, value, props, ts, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
  FROM events)"""

#: Events averaged over 6-hour frames 0..119 of the month.
GRID_SQL = """obs AS (
  SELECT user_id, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 21600) AS BIGINT) AS frame,
         avg(value) AS v
  FROM events GROUP BY 1, 2),
dense AS (
  SELECT u.user_id, f.frame, o.v
  FROM (SELECT DISTINCT user_id FROM obs) u
  CROSS JOIN (SELECT unnest(range(0, 120)) AS frame) f
  LEFT JOIN obs o ON o.user_id = u.user_id AND o.frame = f.frame)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_track(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    d = events(spark, sf).select("user_id", "ts", "event_id", *[c for c in cols if c not in ("ts", "event_id")])
    d = number_rows(d, ["user_id"], ["ts", "event_id"], fit_bucket(d, ["user_id"], F.unix_micros("ts")))
    return d.select("user_id", "pos", *cols)


def observed_grid(spark: SparkSession, sf: str) -> DataFrame:
    d = events(spark, sf)
    start = F.unix_micros(F.lit(f"{EPOCH_GRID} 00:00:00").cast("timestamp"))
    frame = F.floor((F.unix_micros("ts") - start) / F.lit(21_600_000_000))
    return d.groupBy("user_id", frame.alias("frame")).agg(F.avg("value").alias("v"))


def grid_spans(obs: DataFrame) -> DataFrame:
    return obs.select("user_id").distinct().select(
        "user_id", F.lit(0).cast("long").alias("first"), F.lit(119).cast("long").alias("last")
    )


EMB_SQL = """emb AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos
  FROM embeddings)"""

#: 21 joints per embedding; the truth is the same vector with rotated axes.
JOINT_SQL = f"""{EMB_SQL},
jt AS (
  SELECT label AS clip, pos AS frame, j AS joint, e[3*j+1] AS px, e[3*j+2] AS py, e[3*j+3] AS pz,
         e[3*j+2] AS gx, e[3*j+3] AS gy, e[3*j+1] AS gz
  FROM emb CROSS JOIN (SELECT unnest(range(0, 21)) AS j))"""

CLIP = Seq(("label",), "pos")
JOINT = Seq(("clip", "joint"), "frame")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "embeddings")
    return d.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def clip_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as frames: the label is the clip, the rank the frame."""
    return number_rows(embeddings(spark, sf), ["label"], ["vec_id"], F.floor(F.col("vec_id") / 4096))


def joint_table(spark: SparkSession, sf: str) -> DataFrame:
    j = F.sequence(F.lit(0), F.lit(20))
    d = clip_frames(spark, sf).select(F.col("label").alias("clip"), F.col("pos").alias("frame"), "e", F.explode(j).alias("joint"))
    at = lambda i: F.get("e", 3 * F.col("joint") + i)
    return d.select(
        "clip", "frame", "joint", at(0).alias("px"), at(1).alias("py"), at(2).alias("pz"), at(1).alias("gx"), at(2).alias("gy"), at(0).alias("gz")
    )


#: Planar joints whose truth is no similar copy of the prediction, so that
#: alignments leave an error; in a plane the best one has a closed form.
PLANAR_SQL = f"""{EMB_SQL},
jt AS (
  SELECT label AS clip, pos AS frame, j AS joint, e[3*j+1] AS px, e[3*j+2] AS py, 0.0 AS pz,
         2 * e[3*j+2] + 0.5 * e[3*j+3] AS gx, 2 * e[3*j+3] - e[3*j+1] AS gy, 0.0 AS gz
  FROM emb CROSS JOIN (SELECT unnest(range(0, 21)) AS j))"""


def planar_table(spark: SparkSession, sf: str) -> DataFrame:
    d = joint_table(spark, sf)
    zero = F.lit(0.0)
    return d.withColumns({"gx": 2 * F.col("py") + 0.5 * F.col("pz"), "gy": 2 * F.col("pz") - F.col("px"), "gz": zero, "pz": zero})


def planar_fit(keys: str, src: str = "jt", where: str = "true", scale: bool = True, name: str = "fit") -> str:
    """Common tables with the best planar similarity of each group: s, r00..r11, tx, ty."""
    return f"""{name}_m AS (
  SELECT {keys}, avg(px) AS mpx, avg(py) AS mpy, avg(gx) AS mgx, avg(gy) AS mgy,
         avg(px*gx) - avg(px)*avg(gx) AS a, avg(px*gy) - avg(px)*avg(gy) AS b, avg(py*gx) - avg(py)*avg(gx) AS c, avg(py*gy) - avg(py)*avg(gy) AS d,
         avg(px*px + py*py) - avg(px)*avg(px) - avg(py)*avg(py) AS v
  FROM {src} WHERE {where} GROUP BY {keys}),
{name}_r AS (
  SELECT *, CASE WHEN a*d - b*c >= 0 THEN 1 ELSE -1 END AS turn, sqrt(power(a + turn*d, 2) + power(b - turn*c, 2)) AS h,
         {"h / v" if scale else "1.0::DOUBLE"} AS s, (a + turn*d) / h AS r00, (b - turn*c) / h AS r10, -turn * r10 AS r01, turn * r00 AS r11
  FROM {name}_m),
{name} AS (SELECT *, mgx - s*(r00*mpx + r01*mpy) AS tx, mgy - s*(r10*mpx + r11*mpy) AS ty FROM {name}_r)"""


#: Distance to the truth after a planar fit.
PLANAR_ERROR = "sqrt(power(gx - s*(r00*px + r01*py) - tx, 2) + power(gy - s*(r10*px + r11*py) - ty, 2))"
