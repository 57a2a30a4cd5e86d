"""The scene merge on embeddings read as bodies and faces."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions import vectors as V
from kinetable.operators import merge as M
from kinetable.plans.base import clip_frames
from kinetable.plans.q_filters import keypoints
from kinetable.plans.registry import query


def bodies_and_faces(spark, sf):
    """A label is a video with one scene; its frames are dealt to 3 bodies.

    Faces are the bodies' own head points, listed in reverse order, so the
    assignment has one right answer.
    """
    d = clip_frames(spark, sf)
    head = [F.col("label").cast("long").alias("video_id"), F.lit(0).alias("scene_id")]
    frame, b = F.floor(F.col("pos") / 3).cast("int"), (F.col("pos") % 3).cast("int")
    part = lambda a, n: F.slice("e", a, n).cast("array<float>")
    kp = keypoints()
    bodies = d.select(
        *head, b.alias("body_id"), frame.alias("frame"), kp.alias("vitpose"), part(1, 3).alias("trans"), part(4, 3).alias("cam_transl"),
        F.slice(F.concat("e", "e", "e"), 1, 165).cast("array<float>").alias("pose"), part(7, 10).alias("betas"), part(17, 4).alias("bbox_xyxy"),
        part(21, 6).alias("contacts"), (F.get("e", F.lit(0)) > 0.2).alias("flagged"), F.lit(15).alias("fps"),
    )
    pt = lambda i: F.array(F.struct(F.get("k", F.lit(i))["x"].alias("x"), F.get("k", F.lit(i))["y"].alias("y")))
    faces = d.withColumn("k", kp).select(
        *head, (9 - b).alias("face_id"), frame.alias("frame"), part(30, 4).alias("bbox"), pt(0).alias("nose_2d"), pt(2).alias("leye_2d"), pt(1).alias("reye_2d"),
        part(34, 3).alias("jaw"), F.slice("e", 1, 50).cast("array<float>").alias("exp"), F.when(F.get("e", F.lit(1)) > 0, "happy").otherwise("calm").alias("emotion"),
        part(40, 7).alias("emotions_conf"), F.array_repeat(F.lit(0.1), 300).cast("array<float>").alias("shape"),
    )
    return bodies, faces


@query(
    "match_faces",
    "SELECT video_id, 9 - body_id AS face_id, body_id FROM (SELECT DISTINCT CAST(label AS BIGINT) AS video_id, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 3 AS INT) AS body_id FROM embeddings)",
)
def match_faces(spark, sf):
    return M.match_faces(*bodies_and_faces(spark, sf)).select("video_id", "face_id", "body_id")


def summary(d):
    s = lambda c: F.round(V.total(c), 4).alias(c)
    return d.select("video_id", "body_id", "frame", "emotion", "flagged", s("trans"), s("exp"), s("pose"))


@query("merge_scenes")
def merge_scenes(spark, sf):
    return summary(M.merge_scenes(*bodies_and_faces(spark, sf)))


@query("finish_clips")
def finish_clips(spark, sf):
    return summary(M.finish_clips(M.merge_scenes(*bodies_and_faces(spark, sf))))
