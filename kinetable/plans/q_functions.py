"""Box, camera, vector and pose functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions import boxes as B
from kinetable.functions import camera as C
from kinetable.functions import pose as PO
from kinetable.functions import vectors as V
from kinetable.plans.base import EMB_SQL, clip_frames, embeddings
from kinetable.plans.q_filters import BOX_SQL, boxes, keypoints
from kinetable.plans.registry import query

KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


def box():
    return tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))


def r6(c, name):
    return F.round(c, 6).alias(name)


@query(
    "iou",
    f"""WITH {BOX_SQL}, n AS (SELECT l_orderkey, l_linenumber, l_partkey, x1, x2, y1, y2, (x2-x1)*(y2-y1) AS s,
  greatest(0, least(x2, 60) - greatest(x1, 20)) * greatest(0, least(y2, 30) - greatest(y1, 5)) AS n,
  greatest(0, least(x2, 60) - greatest(x1, 20) + 1) * greatest(0, least(y2, 30) - greatest(y1, 5) + 1) AS m FROM bx)
SELECT l_orderkey, l_linenumber, l_partkey, round(n / (s + 1000 - n), 6) AS corner, round(m / ((x2-x1+1)*(y2-y1+1) + 41*26 - m), 6) AS inclusive, round(s / 1000, 6) AS ratio FROM n""",
)
def iou(spark, sf):
    other = tuple(F.lit(v) for v in (20.0, 5.0, 60.0, 30.0))
    return boxes(spark, sf).select(*KEY, r6(B.iou(box(), other), "corner"), r6(B.iou(box(), other, True), "inclusive"), r6(B.area_ratio(box(), other), "ratio"))


@query(
    "box_convert",
    f"""WITH {BOX_SQL}, c AS (SELECT *, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, greatest((x2-x1)/0.75, y2-y1)*1.2 AS s FROM bx)
SELECT l_orderkey, l_linenumber, l_partkey, round(cx, 6) AS cx, round(cy, 6) AS cy, round(s, 6) AS size, round(cx - s/2, 6) AS left_x, round(100 - x2, 6) AS flip_x FROM c""",
)
def box_convert(spark, sf):
    cx, cy, s = B.center_size(box())
    return boxes(spark, sf).select(*KEY, r6(cx, "cx"), r6(cy, "cy"), r6(s, "size"), r6(B.from_center_size(cx, cy, s)[0], "left_x"), r6(B.flip(box(), 100.0)[0], "flip_x"))


KP_SQL = f"""{EMB_SQL}, kp AS (SELECT vec_id, i, e[(3*i) % 64 + 1] AS x, e[(3*i+1) % 64 + 1] AS y, abs(e[(3*i+2) % 64 + 1] * 8) AS conf FROM emb CROSS JOIN (SELECT unnest(range(0, 17)) AS i))"""


@query(
    "keypoint_shift",
    f"WITH {KP_SQL} SELECT a.vec_id, round(avg(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))), 6) AS shift FROM kp a JOIN kp b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY 1",
)
def keypoint_shift(spark, sf):
    k = embeddings(spark, sf).select("vec_id", keypoints().alias("k"))
    n = k.select((F.col("vec_id") - 1).alias("vec_id"), F.col("k").alias("n"))
    return k.join(n, "vec_id").select("vec_id", r6(B.keypoint_shift(F.col("k"), F.col("n")), "shift"))


@query(
    "box_from_points",
    f"""WITH {KP_SQL} SELECT vec_id, round(min(x) FILTER (conf > 0.3), 6) AS x1, round(max(y) FILTER (conf > 0.3), 6) AS y2,
  round(0.01 / ((max(x) FILTER (conf > 0.3) - min(x) FILTER (conf > 0.3)) * (max(y) FILTER (conf > 0.3) - min(y) FILTER (conf > 0.3))), 6) AS covered FROM kp GROUP BY 1""",
)
def box_from_points(spark, sf):
    b = B.from_points(F.col("k"), 0.3)
    d = embeddings(spark, sf).select("vec_id", keypoints().alias("k"))
    return d.select("vec_id", r6(b[0], "x1"), r6(b[3], "y2"), r6(B.mask_box_ratio(F.lit(0.01), b), "covered"))


@query(
    "normalize_keypoints",
    f"""WITH {KP_SQL} SELECT vec_id, i, round((x - 0.05) * 2 / 0.3, 6) AS x, round((y + 0.02) * 2 / 0.3, 6) AS y,
  round(CASE WHEN abs((x - 0.05) * 2 / 0.3) <= 1 AND abs((y + 0.02) * 2 / 0.3) <= 1 THEN conf ELSE 0 END, 6) AS conf FROM kp""",
)
def normalize_keypoints(spark, sf):
    d = embeddings(spark, sf).select("vec_id", B.normalize_keypoints(keypoints(), F.lit(0.05), F.lit(-0.02), F.lit(0.3)).alias("k"))
    d = d.select("vec_id", F.posexplode("k").alias("i", "p"))
    return d.select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("p.x"), "x"), r6(F.col("p.y"), "y"), r6(F.col("p.conf"), "conf"))


@query(
    "flip_keypoints",
    f"""WITH {KP_SQL} SELECT vec_id, CASE WHEN i = 0 THEN 0 WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END AS i, round(2 - x, 6) AS x, round(y, 6) AS y FROM kp""",
)
def flip_keypoints(spark, sf):
    d = embeddings(spark, sf).select("vec_id", F.posexplode(B.flip_keypoints(keypoints(), 2.0)).alias("i", "p"))
    return d.select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("p.x"), "x"), r6(F.col("p.y"), "y"))


@query(
    "camera_projection",
    f"""WITH {BOX_SQL}, f AS (SELECT *, (x1+x2)/2 AS bx_, (y1+y2)/2 AS by_, x2-x1 AS s, sqrt(640.0*640+480.0*480) AS f FROM bx)
SELECT l_orderkey, l_linenumber, l_partkey, round(f, 6) AS focal, round(f * x1 / (y1 + 10) + 320, 6) AS u, round((x1 - 320) * 5 / f, 6) AS back_x,
  round((bx_ - 320) / f, 6) AS info_x, round(0.1 + 2 * (bx_ - 320) / (0.9 * s), 6) AS tx, round(2 * f / (0.9 * s), 6) AS tz, 0.9::DOUBLE AS scale_back FROM f""",
)
def camera_projection(spark, sf):
    """focal length, project, unproject, box info, full camera translation
    and its inverse."""
    cx, cy = F.lit(320.0), F.lit(240.0)
    d = boxes(spark, sf).withColumns({"f": C.focal_length(F.lit(640.0), F.lit(480.0)), "bx": (F.col("x1") + F.col("x2")) / 2, "by": (F.col("y1") + F.col("y2")) / 2, "s": F.col("x2") - F.col("x1")})
    f, bx, by, s = (F.col(c) for c in ("f", "bx", "by", "s"))
    t = C.full_camera_translation(F.lit(0.9), F.lit(0.1), F.lit(0.2), bx, by, s, f, cx, cy)
    u, _ = C.project((F.col("x1"), F.col("y1"), F.col("y1") + 10), f, cx, cy)
    return d.select(
        *KEY, r6(f, "focal"), r6(u, "u"), r6(C.unproject(F.col("x1"), F.col("y1"), F.lit(5.0), f, cx, cy)[0], "back_x"),
        r6(C.bbox_info(bx, by, s, f, cx, cy)[0], "info_x"), r6(t[0], "tx"), r6(t[2], "tz"), r6(C.box_camera(t, bx, by, s, f, cx, cy)[0], "scale_back"),
    )


@query(
    "cosine_distance",
    f"""WITH {EMB_SQL} SELECT a.vec_id, round(CASE WHEN b.e IS NULL THEN 1 ELSE 1 - list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e)) + 1e-6) END, 6) AS d
FROM emb a LEFT JOIN emb b ON b.vec_id = a.vec_id + 1""",
)
def cosine_distance(spark, sf):
    e = embeddings(spark, sf).select("vec_id", "e")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("n"))
    return e.join(n, "vec_id", "left").select("vec_id", r6(V.cosine_distance(F.col("e"), F.col("n")), "d"))


@query(
    "vector_helpers",
    f"""WITH {EMB_SQL}, s AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n, list_max(e) AS m FROM emb),
x AS (SELECT *, list_transform(e, lambda v: exp(v - m)) AS x FROM s)
SELECT vec_id, i AS dim, round(e[i+1] / n, 6) AS unit, round(x[i+1] / list_sum(x), 8) AS soft, list_position(e, m) - 1 = i AS is_top,
  round(CASE WHEN i < 60 THEN e[i+1] END, 6) AS fitted FROM x CROSS JOIN (SELECT unnest(range(0, 64)) AS i)""",
)
def vector_helpers(spark, sf):
    """l2_normalize, softmax, argmax and fit_dim side by side."""
    e = F.col("e")
    d = embeddings(spark, sf).withColumns({"unit": V.l2_normalize(e), "soft": V.softmax(e), "top": V.argmax_index(e), "fitted": V.fit_dim(e, 60)})
    d = d.select("vec_id", "top", F.posexplode(F.arrays_zip("unit", "soft", "fitted")).alias("dim", "v"))
    return d.select("vec_id", F.col("dim").cast("long").alias("dim"), r6(F.col("v.unit"), "unit"), F.round("v.soft", 8).alias("soft"), (F.col("top") == F.col("dim")).alias("is_top"), r6(F.col("v.fitted"), "fitted"))


J22_SQL = f"""{EMB_SQL}, j22 AS (SELECT vec_id, label, pos, list_concat(e, e[1:2]) AS a FROM emb)"""


def joints22(spark, sf):
    return clip_frames(spark, sf).select("vec_id", "label", "pos", F.concat("e", F.slice("e", 1, 2)).alias("a"))


def long3(d, n):
    d = d.select("vec_id", F.posexplode("o").alias("i", "v"))
    return d.select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("v"), "v"))


@query(
    "mirror_joints",
    f"""WITH {J22_SQL}, p AS (SELECT unnest([{','.join(map(str, PO.MIRROR_22))}]) AS src, unnest(range(0, 22)) AS dst)
SELECT vec_id, dst * 3 + k AS i, round(a[src*3 + k + 1] * CASE WHEN k = 0 THEN -1 ELSE 1 END, 6) AS v FROM j22 CROSS JOIN p CROSS JOIN (SELECT unnest(range(0, 3)) AS k)""",
)
def mirror_joints(spark, sf):
    return long3(joints22(spark, sf).withColumn("o", PO.mirror_joints(F.col("a"))), 66)


@query(
    "flip_pose",
    f"""WITH {J22_SQL}, p AS (SELECT unnest([{','.join(map(str, PO.MIRROR_22))}]) AS src, unnest(range(0, 22)) AS dst)
SELECT vec_id, dst * 3 + k AS i, round(a[src*3 + k + 1] * CASE WHEN k = 0 THEN 1 ELSE -1 END, 6) AS v FROM j22 CROSS JOIN p CROSS JOIN (SELECT unnest(range(0, 3)) AS k)""",
)
def flip_pose(spark, sf):
    return long3(joints22(spark, sf).withColumn("o", PO.flip_pose(F.col("a"))), 66)


@query(
    "bone_extend",
    f"""WITH {J22_SQL} SELECT vec_id, i, round(CASE WHEN i < 66 THEN a[i+1] WHEN i < 69 THEN a[i-5] + 0.3438 * (a[i-5] - a[i-11]) ELSE a[i-5] + 0.3345 * (a[i-5] - a[i-11]) END, 6) AS v
FROM j22 CROSS JOIN (SELECT unnest(range(0, 72)) AS i)""",
)
def bone_extend(spark, sf):
    return long3(joints22(spark, sf).withColumn("o", PO.bone_extend(F.col("a"))), 72)


@query(
    "heading_normalize",
    f"""WITH {J22_SQL}, d AS (SELECT *, (a[7]-a[4]+a[52]-a[49])/2 AS dx, (a[8]-a[5]+a[53]-a[50])/2 AS dy FROM j22), u AS (SELECT *, dx/sqrt(dx*dx+dy*dy) AS x, dy/sqrt(dx*dx+dy*dy) AS y FROM d)
SELECT vec_id, j*3 + k AS i, round(CASE k WHEN 0 THEN x*(a[3*j+1]-a[1]) + y*(a[3*j+2]-a[2]) WHEN 1 THEN x*(a[3*j+2]-a[2]) - y*(a[3*j+1]-a[1]) ELSE a[3*j+3]-a[3] END, 6) AS v
FROM u CROSS JOIN (SELECT unnest(range(0, 22)) AS j) CROSS JOIN (SELECT unnest(range(0, 3)) AS k)""",
)
def heading_normalize(spark, sf):
    return long3(joints22(spark, sf).withColumn("o", PO.heading_normalize(F.col("a"))), 66)


@query(
    "face_forward",
    f"""WITH {J22_SQL}, s AS (SELECT label, a AS s FROM j22 WHERE pos = 0), d AS (SELECT vec_id, a, s, s[4]-s[7]+s[49]-s[52] AS dx, s[6]-s[9]+s[51]-s[54] AS dz FROM j22 JOIN s USING (label)),
u AS (SELECT *, dx/sqrt(dx*dx+dz*dz) AS x, dz/sqrt(dx*dx+dz*dz) AS z FROM d)
SELECT vec_id, j*3 + k AS i, round(CASE k WHEN 0 THEN x*(a[3*j+1]-s[1]) + z*(a[3*j+3]-s[3]) WHEN 1 THEN a[3*j+2] ELSE x*(a[3*j+3]-s[3]) - z*(a[3*j+1]-s[1]) END, 6) AS v, round(a[3*j+k+1], 6) AS back
FROM u CROSS JOIN (SELECT unnest(range(0, 22)) AS j) CROSS JOIN (SELECT unnest(range(0, 3)) AS k)""",
)
def face_forward(spark, sf):
    """Into the start frame and back again."""
    d = PO.face_forward(joints22(spark, sf), ["label"], "pos", "a")
    d = d.withColumn("back", PO.from_facing_frame(F.col("a"), F.col("start_joints")))
    d = d.select("vec_id", F.posexplode(F.arrays_zip("a", "back")).alias("i", "p"))
    return d.select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("p.a"), "v"), r6(F.col("p.back"), "back"))


@query(
    "rigid_transform",
    f"""WITH {EMB_SQL} SELECT vec_id, round(e[1]*e[10]+e[2]*e[11]+e[3]*e[12]+e[13], 6) AS x, round(e[4]*e[10]+e[5]*e[11]+e[6]*e[12]+e[14], 6) AS y, round(e[7]*e[10]+e[8]*e[11]+e[9]*e[12]+e[15], 6) AS z FROM emb""",
)
def rigid_transform(spark, sf):
    at = lambda i: F.get("e", F.lit(i))
    out = C.rigid_transform([at(i) for i in range(9)], (at(12), at(13), at(14)), (at(9), at(10), at(11)))
    return embeddings(spark, sf).select("vec_id", *[r6(c, n) for c, n in zip(out, "xyz")])


@query(
    "pose_slices",
    f"""WITH {EMB_SQL}, p AS (SELECT vec_id, list_concat(e, e, e[1:37]) AS p FROM emb)
SELECT vec_id, round(list_sum(p[1:3]), 6) AS root, round(list_sum(p[4:66]), 6) AS body, round(list_sum(p[67:69]), 6) AS jaw, round(list_sum(p[121:165]), 6) AS right_hand,
  round(list_sum(p) - list_sum(p[70:165]), 6) AS composed FROM p""",
)
def pose_slices(spark, sf):
    p = F.concat("e", "e", F.slice("e", 1, 37))
    s = PO.pose_slices(p)
    whole = PO.compose_pose({n: s[n] for n in ("root", "body", "jaw")})
    d = embeddings(spark, sf)
    return d.select("vec_id", *[r6(V.total(s[n]), n) for n in ("root", "body", "jaw", "right_hand")], r6(V.total(whole), "composed"))
