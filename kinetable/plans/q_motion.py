"""Motion metrics on 21 joints per embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions import rotation as R
from kinetable.functions import vectors as V
from kinetable.operators import motion_metrics as MM
from kinetable.operators import stats as ST
from kinetable.operators.blocks import Seq
from kinetable.plans.base import EMB_SQL, JOINT, JOINT_SQL, PLANAR_ERROR, PLANAR_SQL, clip_frames, joint_table, planar_fit, planar_table
from kinetable.plans.registry import query

FRAME = ["clip", "frame"]
DIST = "sqrt((px-gx)*(px-gx)+(py-gy)*(py-gy)+(pz-gz)*(pz-gz))"
_ROOTED = """, rt AS (
  SELECT j.clip, j.frame, j.joint, j.px - r.px AS px, j.py - r.py AS py, j.pz - r.pz AS pz, j.gx - r.gx AS gx, j.gy - r.gy AS gy, j.gz - r.gz AS gz
  FROM jt j JOIN jt r ON r.clip = j.clip AND r.frame = j.frame AND r.joint = 0)"""
ROOTED_SQL, PLANAR_ROOTED_SQL = JOINT_SQL + _ROOTED, PLANAR_SQL + _ROOTED


def rounded(d, n=6):
    return d.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


@query("mpjpe", f"WITH {ROOTED_SQL} SELECT clip, round(avg({DIST}), 6) AS mpjpe FROM rt GROUP BY 1")
def mpjpe(spark, sf):
    d = joint_table(spark, sf)
    pred = d.select(*FRAME, "joint", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    true = d.select(*FRAME, "joint", F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gz").alias("z"))
    pairs = MM.join_pairs(pred, true, [*FRAME, "joint"])
    return rounded(MM.mpjpe(MM.visible(pairs), FRAME, "joint", keys=["clip"]))


@query("pa_mpjpe", f"WITH {PLANAR_SQL}, {planar_fit('clip, frame')} SELECT clip, round(avg({PLANAR_ERROR}), 6) AS pa_mpjpe FROM jt JOIN fit USING (clip, frame) GROUP BY 1")
def pa_mpjpe(spark, sf):
    return rounded(MM.pa_mpjpe(planar_table(spark, sf), FRAME, ["clip"]))


ACC_SQL = """SELECT clip, joint, frame,
    lead(px, 2) OVER w - 2 * lead(px) OVER w + px - (lead(gx, 2) OVER w - 2 * lead(gx) OVER w + gx) AS ax,
    lead(py, 2) OVER w - 2 * lead(py) OVER w + py - (lead(gy, 2) OVER w - 2 * lead(gy) OVER w + gy) AS ay,
    lead(pz, 2) OVER w - 2 * lead(pz) OVER w + pz - (lead(gz, 2) OVER w - 2 * lead(gz) OVER w + gz) AS az
  FROM {src} WINDOW w AS (PARTITION BY clip, joint ORDER BY frame)"""


@query(
    "accel_error",
    f"WITH {JOINT_SQL}, a AS ({ACC_SQL.format(src='jt')}) SELECT round(avg(sqrt(ax*ax+ay*ay+az*az)) * 900, 4) AS accel_error FROM a",
)
def accel_error(spark, sf):
    return rounded(MM.accel_error(joint_table(spark, sf), JOINT, 30.0), 4)


@query(
    "mr_metrics",
    f"""WITH {PLANAR_ROOTED_SQL}, a AS ({ACC_SQL.format(src='rt')}), {planar_fit('clip, frame', 'rt')}
SELECT (SELECT round(avg({DIST}), 6) FROM rt) AS mpjpe, (SELECT round(avg({PLANAR_ERROR}), 6) FROM rt JOIN fit USING (clip, frame)) AS pa_mpjpe, round(avg(sqrt(ax*ax+ay*ay+az*az)), 6) AS accel FROM a""",
)
def mr_metrics(spark, sf):
    return rounded(MM.mr_metrics(planar_table(spark, sf), JOINT, ["clip"], "frame", "joint"))


@query(
    "camera_metrics",
    f"""WITH {JOINT_SQL}, c AS (SELECT clip, frame, avg(px) AS a, avg(py) AS b, avg(pz) AS c, avg(gx) AS d, avg(gy) AS e, avg(gz) AS f FROM jt WHERE joint IN (1, 2) GROUP BY 1, 2),
m AS (SELECT joint, sqrt(power(px-a-gx+d, 2)+power(py-b-gy+e, 2)+power(pz-c-gz+f, 2)) * 1000 AS e FROM jt JOIN c USING (clip, frame))
SELECT CAST(joint AS INT) AS joint, round(avg(e), 4) AS error_mm FROM m GROUP BY ROLLUP (joint)""",
)
def camera_metrics(spark, sf):
    return rounded(MM.camera_metrics(joint_table(spark, sf), FRAME, "joint"), 4)


@query(
    "global_metrics",
    f"""WITH {PLANAR_SQL}, ch AS (SELECT *, CAST(floor(frame / 10) AS BIGINT) AS chunk FROM jt),
{planar_fit('clip, chunk', 'ch', 'frame % 10 < 2', name='two')}, {planar_fit('clip, chunk', 'ch', name='whole')},
w2 AS (SELECT clip, round(avg({PLANAR_ERROR}) * 1000, 4) AS wa2_mpjpe FROM ch JOIN two USING (clip, chunk) GROUP BY 1),
wa AS (SELECT clip, round(avg({PLANAR_ERROR}) * 1000, 4) AS waa_mpjpe FROM ch JOIN whole USING (clip, chunk) GROUP BY 1)
SELECT * FROM w2 JOIN wa USING (clip)""",
)
def global_metrics(spark, sf):
    return rounded(MM.global_metrics(planar_table(spark, sf), ["clip"], "frame", 10), 4)


@query(
    "root_translation_error",
    f"""WITH {PLANAR_SQL}, ro AS (SELECT * FROM jt WHERE joint = 0), {planar_fit('clip', 'ro', scale=False)},
st AS (SELECT clip, sqrt(power(lead(gx) OVER w - gx, 2) + power(lead(gy) OVER w - gy, 2)) AS d FROM ro WINDOW w AS (PARTITION BY clip ORDER BY frame)),
pl AS (SELECT clip, sum(d) AS path FROM st GROUP BY 1),
er AS (SELECT clip, avg({PLANAR_ERROR}) AS e FROM ro JOIN fit USING (clip) GROUP BY 1)
SELECT clip, round(100 * e / path, 6) AS rte FROM er JOIN pl USING (clip)""",
)
def root_translation_error(spark, sf):
    return rounded(MM.root_translation_error(planar_table(spark, sf).where("joint = 0"), Seq(("clip",), "frame")))


def align_sql(scale: bool) -> str:
    return f"WITH {PLANAR_SQL}, {planar_fit('clip', scale=scale)} SELECT clip, round(s, 6) + 0.0 AS s, round(tx, 6) + 0.0 AS tx, round(ty, 6) + 0.0 AS ty, round(r00, 6) + 0.0 AS r00, round(r01, 6) + 0.0 AS r01 FROM fit"


def alignment(d):
    at = lambda c, i, name: (F.round(F.get(c, F.lit(i)), 6) + 0.0).alias(name)
    return d.select("clip", (F.round("s", 6) + 0.0).alias("s"), at("shift", 0, "tx"), at("shift", 1, "ty"), at("rot", 0, "r00"), at("rot", 1, "r01"))


@query("align_rigid_job", align_sql(False))
def align_rigid_job(spark, sf):
    return alignment(MM.align_groups(planar_table(spark, sf), ["clip"], scale=False))


@query("align_similarity_job", align_sql(True))
def align_similarity_job(spark, sf):
    return alignment(MM.align_groups(planar_table(spark, sf), ["clip"]))


@query(
    "jitter",
    f"""WITH {JOINT_SQL}, a AS (SELECT
    lead(px, 3) OVER w - 3 * lead(px, 2) OVER w + 3 * lead(px) OVER w - px AS x,
    lead(py, 3) OVER w - 3 * lead(py, 2) OVER w + 3 * lead(py) OVER w - py AS y,
    lead(pz, 3) OVER w - 3 * lead(pz, 2) OVER w + 3 * lead(pz) OVER w - pz AS z
  FROM jt WINDOW w AS (PARTITION BY clip, joint ORDER BY frame))
SELECT round(avg(sqrt(x*x+y*y+z*z)) * 2700, 4) AS jitter FROM a""",
)
def jitter(spark, sf):
    return rounded(MM.jitter(joint_table(spark, sf), JOINT), 4)


@query(
    "foot_sliding",
    f"""WITH {JOINT_SQL}, a AS (SELECT
    sqrt(power(lead(px) OVER w - px, 2) + power(lead(py) OVER w - py, 2) + power(lead(pz) OVER w - pz, 2)) AS p,
    sqrt(power(lead(gx) OVER w - gx, 2) + power(lead(gy) OVER w - gy, 2) + power(lead(gz) OVER w - gz, 2)) AS g
  FROM jt WINDOW w AS (PARTITION BY clip, joint ORDER BY frame))
SELECT round(avg(p), 6) AS foot_sliding FROM a WHERE g < 0.2""",
)
def foot_sliding(spark, sf):
    return rounded(MM.foot_sliding(joint_table(spark, sf), JOINT, 0.2))


@query(
    "worst_sequences",
    f"""WITH {JOINT_SQL} SELECT clip, round(avg({DIST}), 6) AS mean, count(*) AS frames, (SELECT round(avg({DIST}), 6) FROM jt) AS overall
FROM jt GROUP BY 1 ORDER BY avg({DIST}) DESC, clip LIMIT 3""",
)
def worst_sequences(spark, sf):
    return rounded(MM.worst_sequences(joint_table(spark, sf), ["clip"], MM.length3(MM.P, MM.G), 3))


@query(
    "amplitude",
    f"""WITH {JOINT_SQL} SELECT clip, CAST(joint AS INT) AS joint,
  round(sqrt(power(max(px)-min(px), 2) + power(max(py)-min(py), 2) + power(max(pz)-min(pz), 2)), 6) AS amplitude FROM jt GROUP BY 1, 2""",
)
def amplitude(spark, sf):
    return rounded(ST.amplitude(joint_table(spark, sf), ["clip", "joint"], ["px", "py", "pz"]))


def quats(spark, sf):
    d = clip_frames(spark, sf)
    q = lambda a: V.l2_normalize(F.slice("e", a, 4))
    return d.select("label", "pos", "vec_id", q(1).alias("qa"), q(5).alias("qb"), F.slice("e", 9, 3).alias("va"), F.slice("e", 12, 3).alias("vb"))


QUAT_SQL = f"""{EMB_SQL}, qs AS (
  SELECT label, pos, vec_id, list_transform(e[1:4], lambda v: v / sqrt(list_inner_product(e[1:4], e[1:4]))) AS a,
    list_transform(e[5:8], lambda v: v / sqrt(list_inner_product(e[5:8], e[5:8]))) AS b, e[9:11] AS v, e[12:14] AS u FROM emb)"""


@query(
    "geodesic_error",
    f"WITH {QUAT_SQL} SELECT round(avg(2 * acos(least(1.0, abs(list_inner_product(a, b))))), 6) AS geodesic FROM qs",
)
def geodesic_error(spark, sf):
    return rounded(MM.geodesic_error(quats(spark, sf), F.col("qa"), F.col("qb")))


def four(c):
    return [F.round(F.get(c, F.lit(i)), 6).alias(f"{n}") for i, n in enumerate("wxyz")]


@query(
    "quaternion_algebra",
    f"""WITH {QUAT_SQL}, m AS (SELECT vec_id, v, a,
  a[1]*b[1]-a[2]*b[2]-a[3]*b[3]-a[4]*b[4] AS w, a[1]*b[2]+a[2]*b[1]+a[3]*b[4]-a[4]*b[3] AS x,
  a[1]*b[3]-a[2]*b[4]+a[3]*b[1]+a[4]*b[2] AS y, a[1]*b[4]+a[2]*b[3]-a[3]*b[2]+a[4]*b[1] AS z FROM qs)
SELECT vec_id, round(w, 6) AS w, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z,
  round((1-2*(a[3]*a[3]+a[4]*a[4]))*v[1] + 2*(a[2]*a[3]-a[1]*a[4])*v[2] + 2*(a[2]*a[4]+a[1]*a[3])*v[3], 6) AS rx,
  round(a[1], 6) AS iw, round(-a[2], 6) AS ix FROM m""",
)
def quaternion_algebra(spark, sf):
    """Multiply, rotate and invert as native expressions."""
    d = quats(spark, sf).withColumns({"m": R.qmul(F.col("qa"), F.col("qb")), "r": R.qrot(F.col("qa"), F.col("va")), "i": R.qinv(F.col("qa"))})
    return d.select("vec_id", *four("m"), F.round(F.get("r", F.lit(0)), 6).alias("rx"), F.round(F.get("i", F.lit(0)), 6).alias("iw"), F.round(F.get("i", F.lit(1)), 6).alias("ix"))


@query(
    "slerp_pairs",
    f"""WITH {QUAT_SQL}, d AS (SELECT *, list_inner_product(a, b) AS d FROM qs), t AS (SELECT *, acos(least(abs(d), 1.0)) AS th, CASE WHEN d < 0 THEN -1 ELSE 1 END AS s FROM d),
k AS (SELECT *, CASE WHEN abs(d) > 0.9995 THEN 0.7 ELSE sin(0.7 * th) / sin(th) END AS wa, s * CASE WHEN abs(d) > 0.9995 THEN 0.3 ELSE sin(0.3 * th) / sin(th) END AS wb FROM t),
q AS (SELECT vec_id, list_transform(list_zip(a, b), lambda p: p[1] * wa + p[2] * wb) AS q FROM k), n AS (SELECT *, sqrt(list_inner_product(q, q)) AS n FROM q)
SELECT vec_id, round(q[1] / n, 6) AS w, round(q[2] / n, 6) AS x, round(q[3] / n, 6) AS y, round(q[4] / n, 6) AS z FROM n""",
)
def slerp_pairs(spark, sf):
    return quats(spark, sf).withColumn("s", R.slerp(F.col("qa"), F.col("qb"), F.lit(0.3))).select("vec_id", *four("s"))


@query(
    "rotation_between",
    f"""WITH {QUAT_SQL}, r AS (SELECT vec_id, sqrt(list_inner_product(v, v) * list_inner_product(u, u)) + list_inner_product(v, u) AS w,
  v[2]*u[3]-v[3]*u[2] AS x, v[3]*u[1]-v[1]*u[3] AS y, v[1]*u[2]-v[2]*u[1] AS z FROM qs), n AS (SELECT *, sqrt(w*w+x*x+y*y+z*z) AS n FROM r)
SELECT vec_id, round(w/n, 6) AS w, round(x/n, 6) AS x, round(y/n, 6) AS y, round(z/n, 6) AS z FROM n""",
)
def rotation_between(spark, sf):
    return quats(spark, sf).withColumn("s", R.quat_between(F.col("va"), F.col("vb"))).select("vec_id", *four("s"))


@query(
    "heading",
    f"""WITH {QUAT_SQL}, h AS (SELECT vec_id, a, atan2(2*(a[2]*a[4]+a[1]*a[3]), 1-2*(a[2]*a[2]+a[3]*a[3])) AS t FROM qs)
SELECT vec_id, round(t, 6) AS yaw, round(cos(t/2), 6) AS hw, round(sin(t/2), 6) AS hy,
  round(cos(t/2)*a[1] + sin(t/2)*a[3], 6) AS w, round(cos(t/2)*a[2] - sin(t/2)*a[4], 6) AS x,
  round(cos(t/2)*a[3] - sin(t/2)*a[1], 6) AS y, round(cos(t/2)*a[4] + sin(t/2)*a[2], 6) AS z FROM h""",
)
def heading(spark, sf):
    d = quats(spark, sf).withColumns({"t": R.yaw(F.col("qa")), "h": R.heading_quat(F.col("qa")), "s": R.remove_heading(F.col("qa"))})
    return d.select("vec_id", F.round("t", 6).alias("yaw"), F.round(F.get("h", F.lit(0)), 6).alias("hw"), F.round(F.get("h", F.lit(2)), 6).alias("hy"), *four("s"))
