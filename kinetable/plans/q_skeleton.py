"""Motion sequences and skeleton jobs on embeddings read as poses."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions import pose as PO
from kinetable.functions import rotation as R
from kinetable.functions import vectors as V
from kinetable.operators import kinematics as K
from kinetable.operators import resample as RS
from kinetable.operators import skeleton as SK
from kinetable.operators.blocks import Seq
from kinetable.plans.base import CLIP, EV_SQL, JOINT, JOINT_SQL, event_track, joint_table
from kinetable.plans.q_functions import J22_SQL, joints22
from kinetable.plans.q_motion import QUAT_SQL, quats, rounded
from kinetable.plans.registry import query, table

#: Target bone offsets: the raw directions at a third of a unit.
TARGET = [v * 0.33 for o in SK.BODY_22.raw for v in o]


@query(
    "delta_theta",
    f"""WITH {QUAT_SQL} SELECT label, pos, round(coalesce(2 * acos(least(1.0, abs(list_inner_product(a, p)))), 0), 6) AS dtheta FROM (
  SELECT *, lag(a) OVER (PARTITION BY label ORDER BY pos) AS p FROM qs)""",
)
def delta_theta(spark, sf):
    return K.delta_theta(quats(spark, sf), CLIP, "qa").select("label", "pos", F.round("dtheta", 6).alias("dtheta"))


@query(
    "sign_continuity",
    f"""WITH {QUAT_SQL}, f AS (SELECT label, pos, a, CASE WHEN list_inner_product(a, lag(a) OVER (PARTITION BY label ORDER BY pos)) < 0 THEN 1 ELSE 0 END AS f FROM qs),
k AS (SELECT label, pos, a, sum(f) OVER (PARTITION BY label ORDER BY pos) % 2 AS k FROM f)
SELECT label, pos, round(CASE WHEN k = 1 THEN -a[1] ELSE a[1] END, 6) AS w, round(CASE WHEN k = 1 THEN -a[4] ELSE a[4] END, 6) AS z FROM k""",
)
def sign_continuity(spark, sf):
    d = RS.sign_continuity(quats(spark, sf), CLIP, "qa")
    return d.select("label", "pos", F.round(F.get("qa", F.lit(0)), 6).alias("w"), F.round(F.get("qa", F.lit(3)), 6).alias("z"))


@query(
    "resample_rotations",
    f"""WITH {QUAT_SQL}, n AS (SELECT label, max(pos) AS m FROM qs GROUP BY 1), g AS (SELECT label, unnest(range(0, CAST(floor(m / 1.5 + 1e-6) AS BIGINT) + 1)) AS i FROM n),
b AS (SELECT g.label, i, i * 1.5 - floor(i * 1.5) AS t, p.a, coalesce(q.a, p.a) AS c FROM g JOIN qs p ON p.label = g.label AND p.pos = CAST(floor(i * 1.5) AS BIGINT)
  LEFT JOIN qs q ON q.label = g.label AND q.pos = CAST(floor(i * 1.5) AS BIGINT) + 1),
d AS (SELECT *, list_inner_product(a, c) AS d FROM b), h AS (SELECT *, acos(least(abs(d), 1.0)) AS th, CASE WHEN d < 0 THEN -1 ELSE 1 END AS s FROM d),
k AS (SELECT *, CASE WHEN abs(d) > 0.9995 THEN 1 - t ELSE sin((1 - t) * th) / sin(th) END AS wa, s * CASE WHEN abs(d) > 0.9995 THEN t ELSE sin(t * th) / sin(th) END AS wb FROM h),
q AS (SELECT label, i, list_transform(list_zip(a, c), lambda p: p[1] * wa + p[2] * wb) AS q FROM k), z AS (SELECT *, sqrt(list_inner_product(q, q)) * CASE WHEN q[1] < 0 THEN -1 ELSE 1 END AS n FROM q)
SELECT label, i, round(q[1] / n, 6) AS w, round(q[2] / n, 6) AS x, round(q[3] / n, 6) AS y, round(q[4] / n, 6) AS z FROM z""",
)
def resample_rotations(spark, sf):
    """From 30 to 20 frames per second; shown with non-negative w."""
    q = quats(spark, sf).select("label", "pos", (F.col("pos") / 30.0).alias("t"), "qa")
    last = q.groupBy("label").agg(F.max("t").alias("last"))
    d = RS.resample_rotations(q, RS.target_grid(last, ["label"], "last", 20.0), CLIP, "t", "qa", 60.0)
    d = d.withColumn("qa", R.standardize(F.col("qa")))
    return d.select("label", "i", *[F.round(F.get("qa", F.lit(k)), 6).alias(n) for k, n in enumerate("wxyz")])


@query(
    "camera_angvel",
    f"""WITH {QUAT_SQL}, p AS (SELECT label, pos, coalesce(lead(a) OVER w, a) AS n, CASE WHEN lead(a) OVER w IS NULL THEN lag(a) OVER w ELSE a END AS c FROM qs WINDOW w AS (PARTITION BY label ORDER BY pos)),
r AS (SELECT label, pos, n[1]*c[1]+n[2]*c[2]+n[3]*c[3]+n[4]*c[4] AS w, -n[1]*c[2]+n[2]*c[1]-n[3]*c[4]+n[4]*c[3] AS x, -n[1]*c[3]+n[2]*c[4]+n[3]*c[1]-n[4]*c[2] AS y, -n[1]*c[4]-n[2]*c[3]+n[3]*c[2]+n[4]*c[1] AS z FROM p)
SELECT label, pos, round(1-2*(y*y+z*z), 6) AS r0, round(2*(x*y-z*w), 6) AS r1, round(2*(x*z+y*w), 6) AS r2, round(2*(x*y+z*w), 6) AS r3, round(1-2*(x*x+z*z), 6) AS r4, round(2*(y*z-x*w), 6) AS r5 FROM r""",
)
def camera_angvel(spark, sf):
    d = K.camera_angvel(quats(spark, sf).withColumn("m", R.quat_to_matrix(F.col("qa"))), CLIP, "m")
    return d.select("label", "pos", *[F.round(F.get("angvel", F.lit(k)), 6).alias(f"r{k}") for k in range(6)])


@query(
    "local_velocity",
    f"""WITH {QUAT_SQL}, d AS (SELECT label, pos, a, CASE WHEN lead(v) OVER w IS NULL THEN list_transform(list_zip(v, lag(v) OVER w), lambda p: p[1] - p[2])
  ELSE list_transform(list_zip(lead(v) OVER w, v), lambda p: p[1] - p[2]) END AS s FROM qs WINDOW w AS (PARTITION BY label ORDER BY pos))
SELECT label, pos, round((1-2*(a[3]*a[3]+a[4]*a[4]))*s[1] + 2*(a[2]*a[3]+a[1]*a[4])*s[2] + 2*(a[2]*a[4]-a[1]*a[3])*s[3], 6) AS vx, 0.0::DOUBLE AS drift FROM d""",
)
def local_velocity(spark, sf):
    """Velocities in the body frame, and the path rebuilt from them."""
    d = K.local_velocity(quats(spark, sf), CLIP, "va", "qa")
    d = K.integrate_local_velocity(d, CLIP, "local_vel", "qa")
    first = d.groupBy("label").agg(F.min_by("va", "pos").alias("s"))
    d = d.join(first, "label").withColumn("drift", V.distance(V.sub(F.col("va"), F.col("s")), F.col("rolled")))
    return d.select("label", "pos", F.round(F.get("local_vel", F.lit(0)), 6).alias("vx"), F.round("drift", 6).alias("drift"))


@query(
    "local_velocity_height",
    f"""WITH {QUAT_SQL}, d AS (SELECT label, pos, v, lead(v) OVER w AS n, lag(v) OVER w AS p FROM qs WINDOW w AS (PARTITION BY label ORDER BY pos)),
s AS (SELECT label, pos, v, coalesce(n[1] - v[1], v[1] - p[1], 0) AS x, coalesce(n[2] - v[2], v[2] - p[2], 0) AS y, coalesce(n[3] - v[3], v[3] - p[3], 0) AS z FROM d),
r AS (SELECT *, first_value(v) OVER (PARTITION BY label ORDER BY pos) AS o, sum(y) OVER (PARTITION BY label ORDER BY pos) AS up FROM s)
SELECT label, pos, round(cos(pos * 1.4) * x - sin(pos * 1.4) * z, 6) AS vx, round(sin(pos * 1.4) * x + cos(pos * 1.4) * z, 6) AS vz, round(up, 6) AS cumulative, round(v[2], 6) AS absolute,
  round(v[1] - o[1], 6) AS path_x, round(v[2] - o[2], 6) AS path_y, round(v[3] - o[3], 6) AS path_z, round(v[2], 6) AS path_height FROM r""",
)
def local_velocity_height(spark, sf):
    """Velocities in the frame of a body that turns about the vertical, with both kinds of height, and the paths rebuilt from them."""
    turn = F.col("pos") * 0.7
    d = quats(spark, sf).select("label", "pos", "va", F.array(F.cos(turn), F.lit(0.0), F.sin(turn), F.lit(0.0)).alias("q"))
    at = lambda c, i: F.round(F.get(c, F.lit(i)), 6)
    out = None
    for kind in ("cumulative", "absolute"):
        v = K.local_velocity(d, CLIP, "va", "q", True, kind)
        v = K.integrate_local_velocity(v, CLIP, "local_vel", "q", True, kind)
        path = {"path_x": at("rolled", 0), "path_y": at("rolled", 1), "path_z": at("rolled", 2)} if kind == "cumulative" else {"path_height": at("rolled", 1)}
        own = {"vx": at("local_vel", 0), "vz": at("local_vel", 2)} if kind == "cumulative" else {}
        v = v.select("label", "pos", at("local_vel", 1).alias(kind), *[c.alias(n) for n, c in {**own, **path}.items()])
        out = v if out is None else out.join(v, ["label", "pos"])
    return out


@query(
    "put_on_floor",
    f"WITH {JOINT_SQL} SELECT clip, frame, CAST(joint AS INT) AS joint, round(py - min(py) OVER (PARTITION BY clip), 6) AS y FROM jt",
)
def put_on_floor(spark, sf):
    d = K.put_on_floor(joint_table(spark, sf), ("clip",), "py")
    return d.select("clip", "frame", "joint", F.round("py", 6).alias("y"))


@query(
    "xz_origin",
    f"""WITH {JOINT_SQL} SELECT clip, frame, CAST(joint AS INT) AS joint,
       round(px - min(px) FILTER (frame = 0 AND joint = 0) OVER (PARTITION BY clip), 6) AS x, round(pz - min(pz) FILTER (frame = 0 AND joint = 0) OVER (PARTITION BY clip), 6) AS z FROM jt""",
)
def xz_origin(spark, sf):
    d = K.xz_origin(joint_table(spark, sf), ("clip",), "frame", "px", "pz", F.col("joint") == 0)
    return d.select("clip", "frame", "joint", F.round("px", 6).alias("x"), F.round("pz", 6).alias("z"))


@query(
    "origin_shift",
    f"""WITH {JOINT_SQL}, b AS (SELECT clip, px AS bx, py AS by_, pz AS bz FROM jt WHERE joint = 0 AND frame = 0), g AS (SELECT clip, min(gy) AS g FROM jt WHERE joint = 0 GROUP BY 1)
SELECT clip, frame, CAST(joint AS INT) AS joint, round(px - bx, 6) AS x, round(py - by_ - g, 6) AS y, round(pz - bz, 6) AS z FROM jt JOIN b USING (clip) JOIN g USING (clip)""",
)
def origin_shift(spark, sf):
    """Joints stand for persons; their second track for the ground."""
    d = K.origin_shift(joint_table(spark, sf), ["clip"], "frame", "joint", ["px", "py", "pz"], "gy")
    return d.select("clip", "frame", "joint", F.round("px", 6).alias("x"), F.round("py", 6).alias("y"), F.round("pz", 6).alias("z"))


@query(
    "center_on_camera",
    f"""WITH {JOINT_SQL}, c AS (SELECT *, abs(gx) < 0.25 AS ok FROM jt), f AS (SELECT clip, frame, bool_and(ok) AS ok FROM c GROUP BY 1, 2),
r AS (SELECT clip, min(frame) AS s, max(frame) AS e, count(*) AS n FROM (SELECT clip, frame, frame - row_number() OVER (PARTITION BY clip ORDER BY frame) AS g FROM f WHERE ok) GROUP BY clip, g),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY n DESC, s) AS k FROM r) WHERE k = 1),
l AS (SELECT clips.clip, coalesce(s, 0) AS s, coalesce(e, 0) AS e FROM (SELECT DISTINCT clip FROM jt) clips LEFT JOIN b USING (clip)),
o AS (SELECT c.clip, joint, coalesce(avg(gx) FILTER (ok AND frame BETWEEN s AND e), max(gx) FILTER (frame = (s + e) // 2)) AS ox,
   coalesce(avg(gz) FILTER (ok AND frame BETWEEN s AND e), max(gz) FILTER (frame = (s + e) // 2)) AS oz FROM c JOIN l USING (clip) GROUP BY 1, 2)
SELECT clip, frame, CAST(joint AS INT) AS joint, round(px - ox, 6) AS x, round(pz + oz, 6) AS z FROM jt JOIN o USING (clip, joint)""",
)
def center_on_camera(spark, sf):
    """Joints stand for bodies; a large camera x flags a frame."""
    d = K.center_on_camera(joint_table(spark, sf), JOINT, ["clip"], F.abs("gx") < 0.25, ["px", "py", "pz"], ["gx", "gy", "gz"])
    return d.select("clip", "frame", "joint", F.round("px", 6).alias("x"), F.round("pz", 6).alias("z"))


@query(
    "contact_drift_correct",
    f"""WITH {JOINT_SQL}, m AS (SELECT *, lead(px) OVER w AS nx, lead(py) OVER w AS ny, lead(pz) OVER w AS nz FROM jt WINDOW w AS (PARTITION BY clip, joint ORDER BY frame)),
d AS (SELECT clip, frame, sum(exp(gx) * (nx - px)) / sum(exp(gx)) AS dx, sum(exp(gx) * (ny - py)) / sum(exp(gx)) AS dy, sum(exp(gx) * (nz - pz)) / sum(exp(gx)) AS dz FROM m WHERE nx IS NOT NULL AND gx > 0 GROUP BY 1, 2),
r AS (SELECT jt.clip, jt.frame, px AS x, py AS y, pz AS z, coalesce(dx, 0) AS dx, coalesce(dy, 0) AS dy, coalesce(dz, 0) AS dz FROM jt LEFT JOIN d ON d.clip = jt.clip AND d.frame = jt.frame WHERE joint = 0),
c AS (SELECT clip, frame, y AS oy, x - coalesce(sum(dx) OVER p, 0) AS x, y - coalesce(sum(dy) OVER p, 0) AS y, z - coalesce(sum(dz) OVER p, 0) AS z FROM r
  WINDOW p AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT clip, count(*) AS n FROM c GROUP BY 1), off AS (SELECT k, exp(-0.5 * k * k / 9.0) / sum(exp(-0.5 * k * k / 9.0)) OVER () AS w FROM (SELECT unnest(range(-12, 13)) AS k)),
s AS (SELECT c.clip, c.frame, sum(w * b.x) AS x, sum(w * b.z) AS z FROM c JOIN n USING (clip) CROSS JOIN off JOIN c b ON b.clip = c.clip AND b.frame = greatest(0, least(n - 1, c.frame + k)) GROUP BY 1, 2),
g AS (SELECT jt.clip, min(py + c.y - c.oy) AS g FROM jt JOIN c ON c.clip = jt.clip AND c.frame = jt.frame GROUP BY 1)
SELECT c.clip, c.frame, round(s.x, 6) AS x, round(c.y - g, 6) AS y, round(s.z, 6) AS z FROM c JOIN s USING (clip, frame) JOIN g USING (clip)""",
)
def contact_drift_correct(spark, sf):
    j = joint_table(spark, sf)
    roots = j.where("joint = 0").select("clip", "frame", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    js = j.select("clip", "frame", "joint", F.col("px").alias("jx"), F.col("py").alias("jy"), F.col("pz").alias("jz"), F.col("gx").alias("logit"))
    return rounded(K.contact_drift_correct(roots, js, Seq(("clip",), "frame"), "joint", "logit"))


def _drift_sql() -> str:
    """The offset, in steps of 0.02 an axis, frame by frame; joints are held by a running sum."""
    move = lambda i: f"""p.k{i} + CASE WHEN p.k{i} <= floor((f.a[{i + 1}] - f.a[{i + 4}] - 0.1) / 0.02) THEN 1
  WHEN p.k{i} >= ceil((f.a[{i + 1}] - f.a[{i + 4}] + 0.1) / 0.02) THEN -1 ELSE 0 END"""  # noqa: E731
    held = "1 / (1 + exp(-20 * b[25 + j])) > 0.8"
    slide = lambda c, k: f"""coalesce(list_sum(list_transform(range(0, 6), lambda j: CASE WHEN {held}
  THEN a[{c} + 3 * j] - {k} * 0.02 - (b[{c} + 3 * j] - l{k} * 0.02) ELSE 0 END)) / greatest(1, len(list_filter(range(0, 6), lambda j: {held}))), 0)"""  # noqa: E731
    return f"""WITH RECURSIVE {J22_SQL},
pull AS (
  SELECT label, pos, 0 AS k0, 0 AS k1, 0 AS k2 FROM j22 WHERE pos = 0
  UNION ALL SELECT f.label, f.pos, {move(0)}, {move(1)}, {move(2)} FROM pull p JOIN j22 f ON f.label = p.label AND f.pos = p.pos + 1),
q AS (
  SELECT f.label, f.pos, a, k0, k1, k2, lag(a) OVER w AS b, lag(k0) OVER w AS lk0, lag(k2) OVER w AS lk2
  FROM j22 f JOIN pull USING (label, pos) WINDOW w AS (PARTITION BY f.label ORDER BY f.pos)),
s AS (SELECT *, {slide(7, "k0")} AS sx, {slide(9, "k2")} AS sz FROM q)
SELECT label, pos, round(a[1] - k0 * 0.02 - sum(sx) OVER up, 6) AS x, round(a[2] - k1 * 0.02 - min(list_min(a) - k1 * 0.02) OVER (PARTITION BY label), 6) AS y,
       round(a[3] - k2 * 0.02 - sum(sz) OVER up, 6) AS z
FROM s WINDOW up AS (PARTITION BY label ORDER BY pos)"""


@query("camera_drift_correct", _drift_sql())
def camera_drift_correct(spark, sf):
    at = lambda i: F.get("a", F.lit(i))
    d = joints22(spark, sf).select(
        "label", "pos", *[at(i).alias(n) for i, n in enumerate("xyz")], *[at(i).alias(f"r{n}") for i, n in enumerate("xyz")],
        *[at(i + 3).alias(f"c{n}") for i, n in enumerate("xyz")], F.slice("a", 7, 18).alias("static_points"),
        F.transform(F.slice("a", 25, 6), lambda v: v * 20).alias("static_logits"), F.array_min("a").alias("low"),
    )
    return rounded(K.camera_drift_correct(d, CLIP, 6, 0.1))


@query(
    "skeleton_offsets",
    f"""WITH {J22_SQL}, p AS (SELECT unnest([{','.join(str(x) for x in SK.BODY_22.parents())}]) AS p, unnest(range(0, 22)) AS j, unnest([{','.join(f'[{a},{b},{c}]' for a, b, c in SK.BODY_22.raw)}]) AS o)
SELECT vec_id, j*3 + k AS i, round(CASE WHEN j = 0 THEN 0 ELSE o[k+1] * sqrt(power(a[3*j+1]-a[3*p+1], 2) + power(a[3*j+2]-a[3*p+2], 2) + power(a[3*j+3]-a[3*p+3], 2)) END, 6) AS v
FROM j22 CROSS JOIN p CROSS JOIN (SELECT unnest(range(0, 3)) AS k)""",
)
def skeleton_offsets(spark, sf):
    from kinetable.plans.q_functions import long3

    o = PO.skeleton_offsets(F.col("a"), SK.BODY_22.parents(), list(SK.BODY_22.raw))
    return long3(joints22(spark, sf).withColumn("o", o), 66)


def digest(d, keys, vec, digits=5):
    """Size, sum and weighted sum of a vector column."""
    s = F.aggregate(vec, F.lit(0.0), lambda a, v: a + v)
    w = V.total(F.transform(vec, lambda v, i: v * (i + 1)))
    return d.select(*keys, F.size(vec).alias("n"), F.round(s, digits).alias("total"), F.round(w, digits).alias("weighted"))


def base(spark, sf):
    return joints22(spark, sf).drop("vec_id")


@query("inverse_kinematics_job")
def inverse_kinematics_job(spark, sf):
    return digest(SK.inverse_kinematics_job(base(spark, sf), CLIP, "a"), ["label", "pos"], "quats")


@query(
    "forward_kinematics_job",
    f"""WITH {J22_SQL} SELECT label, pos, 0.0::DOUBLE AS gap,
  round(sqrt(list_sum(list_transform(range(1, 67), lambda i: power(a[i] - a[(i - 1) % 3 + 1], 2)))), 6) AS stretched FROM j22""",
)
def forward_kinematics_job(spark, sf):
    """Offsets and rotations from the joints give the joints back; offsets
    twice as long move each joint by its distance from the root."""
    d = SK.inverse_kinematics_job(base(spark, sf), CLIP, "a").withColumn(
        "o", PO.skeleton_offsets(F.col("a"), SK.BODY_22.parents(), list(SK.BODY_22.raw))
    )
    d = d.withColumn("root", F.slice("a", 1, 3))
    gap = F.round(V.distance(F.col("joints"), F.col("a")), 6)
    long = SK.forward_kinematics_job(d.withColumn("o", F.transform("o", lambda v: v * 2)), "quats", "root", "o").select("label", "pos", gap.alias("stretched"))
    d = SK.forward_kinematics_job(d, "quats", "root", "o").select("label", "pos", gap.alias("gap"))
    return d.join(long, ["label", "pos"])


@query("retarget_job")
def retarget_job(spark, sf):
    return digest(SK.retarget_job(base(spark, sf), CLIP, "a", TARGET), ["label", "pos"], "a")


@query("motion_features_263")
def motion_features_263(spark, sf):
    return digest(SK.motion_features_263(base(spark, sf), CLIP, "a", target=TARGET), ["label", "pos"], "vec")


@query("motion_features_251")
def motion_features_251(spark, sf):
    """The 21-joint skeleton, without retargeting."""
    d = base(spark, sf).withColumn("a", F.slice("a", 1, 63))
    return digest(SK.motion_features_263(d, CLIP, "a", SK.BODY_21), ["label", "pos"], "vec")


@query("features_to_joints")
def features_to_joints(spark, sf):
    f = SK.motion_features_263(base(spark, sf), CLIP, "a", target=TARGET)
    return digest(SK.features_to_joints(f, CLIP), ["label", "pos"], "joints")


@query("features_to_joints_rotation")
def features_to_joints_rotation(spark, sf):
    f = SK.motion_features_263(base(spark, sf), CLIP, "a", target=TARGET)
    return digest(SK.features_to_joints(f, CLIP, offsets=TARGET), ["label", "pos"], "joints")


def body_params(spark, sf):
    e = F.col("a")
    return base(spark, sf).select(
        "label", "pos", F.slice(e, 4, 63).alias("body_pose"), F.slice(e, 20, 10).alias("betas"), V.scale(F.slice(e, 1, 3), 3.0).alias("orient"),
        F.slice(e, 30, 3).alias("transl"), R.quat_to_matrix(V.l2_normalize(F.slice(e, 40, 4))).alias("r_w2c"), F.slice(e, 50, 3).alias("t_w2c"),
    )


@query("world_camera_job")
def world_camera_job(spark, sf):
    d = SK.world_camera_job(body_params(spark, sf), "r_w2c", "t_w2c")
    all_ = F.concat("orient_c", "transl_c", "r_c2gv", "orient_gv")
    return digest(d.withColumn("v", all_), ["label", "pos"], "v")


@query("pose_features_151")
def pose_features_151(spark, sf):
    """Encoded and decoded again; ``gap`` is the pose difference."""
    d = SK.world_camera_job(body_params(spark, sf), "r_w2c", "t_w2c")
    f = SK.pose_features_151(d, CLIP)
    back = SK.pose_from_features_151(f).select("label", "pos", F.col("body_pose").alias("b"))
    out = digest(f, ["label", "pos"], "vec").join(back, ["label", "pos"]).join(d.select("label", "pos", "body_pose"), ["label", "pos"])
    return out.select("label", "pos", "n", "total", F.round(V.distance(F.col("b"), F.col("body_pose")), 5).alias("gap"))


@query("local_global_rotations")
def local_global_rotations(spark, sf):
    """Accumulated along the tree and undone; ``gap`` is what is lost."""
    d = SK.convert_rotations(base(spark, sf).withColumnRenamed("a", "m"), "m", "axis_angle", "matrix").withColumn("was", F.col("m"))
    g = SK.local_global_rotations(d, "m").withColumn("world", F.col("m"))
    back = SK.local_global_rotations(g, "m", inverse=True).withColumn("gap", F.round(V.distance(F.col("m"), F.col("was")), 6))
    return digest(back, ["label", "pos", "gap"], "world")


@query(
    "average_rotations",
    f"""WITH {J22_SQL} SELECT label, pos, CAST(len(a) AS INT) AS n, round(1.5 * list_sum(a), 5) AS total,
  round(1.5 * list_inner_product(a, list_transform(range(1, 67), lambda i: i::DOUBLE)), 5) AS weighted FROM j22""",
)
def average_rotations(spark, sf):
    """Rotations about one axis by a and 2a average to 1.5 a."""
    d = base(spark, sf).withColumn("b", V.scale(F.col("a"), 2.0))
    return digest(SK.average_rotations(d, "a", "b"), ["label", "pos"], "average")


@query(
    "convert_rotations",
    f"""WITH {QUAT_SQL} SELECT vec_id, 0.0::DOUBLE AS matrix, 0.0::DOUBLE AS axis_angle, 0.0::DOUBLE AS sixd, 0.0::DOUBLE AS euler,
  round(2 * acos(least(1.0, abs(a[1]))), 6) AS angle, round(2 * (a[2]*a[3] - a[1]*a[4]), 6) AS m01, round(1 - 2 * (a[3]*a[3] + a[4]*a[4]), 6) AS m00 FROM qs""",
)
def convert_rotations(spark, sf):
    """Every representation reached from a quaternion and back, and what a
    matrix and an axis with its angle hold on the way."""
    d = quats(spark, sf).select("vec_id", R.standardize(F.col("qa")).alias("q"))
    zero = F.array(*[F.lit(0.0)] * 3)
    seen = {"matrix": {"m00": F.get("matrix", F.lit(0)), "m01": F.get("matrix", F.lit(1))}, "axis_angle": {"angle": V.distance(F.col("axis_angle"), zero)}}
    for k in ("matrix", "axis_angle", "sixd"):
        there = SK.convert_rotations(d.withColumn(k, F.col("q")), k, "quaternion", k).withColumns(seen.get(k, {}))
        d = SK.convert_rotations(there, k, k, "quaternion")
    e = R.standardize(R.euler_to_quat(R.quat_to_euler(F.col("q"))))
    d = d.withColumn("euler", e)
    return d.select("vec_id", *[F.round(V.distance(F.col(k), F.col("q")), 6).alias(k) for k in ("matrix", "axis_angle", "sixd", "euler")], *[F.round(k, 6).alias(k) for k in ("angle", "m00", "m01")])


@query("pose_noise")
def pose_noise(spark, sf):
    d = base(spark, sf).withColumn("was", F.col("a"))
    return digest(SK.pose_noise(d, "a", ["label", "pos"], 10.0, 3), ["label", "pos"], "a")


@query(
    "noise_visibility",
    """WITH h AS (SELECT event_id, list_transform(range(0, 17), lambda j: (event_id * 31 + j * 17) % 23 < 2) AS d FROM events)
SELECT event_id, CAST(list_sum(list_transform([NOT (d[1] OR d[6] OR d[7]), NOT (d[1] OR d[2] OR d[6] OR d[7]), NOT (d[1] OR d[3] OR d[6] OR d[7]),
  NOT (d[1] OR d[2] OR d[4] OR d[6] OR d[7]), NOT (d[1] OR d[3] OR d[5] OR d[6] OR d[7]), NOT d[6], NOT d[7], NOT (d[6] OR d[8]), NOT (d[7] OR d[9]),
  NOT (d[6] OR d[8] OR d[10]), NOT (d[7] OR d[9] OR d[11]), NOT d[12], NOT d[13], NOT (d[12] OR d[14]), NOT (d[13] OR d[15]), NOT (d[12] OR d[14] OR d[16]), NOT (d[13] OR d[15] OR d[17])],
  lambda v: CAST(v AS INT))) AS BIGINT) AS visible FROM h""",
)
def noise_visibility(spark, sf):
    """The mask part of the augmentation with arithmetic draws."""
    drop = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: (F.col("event_id") * 31 + j * 17) % 23 < 2)
    d = SK.visibility_mask(table(spark, sf, "events").select("event_id"), ["event_id"], drop)
    return d.select("event_id", F.size(F.filter("visible", lambda v: v)).cast("long").alias("visible"))


@query("noise_augment")
def noise_augment(spark, sf):
    ones = {k: [1.0] * 17 for k in ("jittering", "bias", "peak", "pmask")}
    d = base(spark, sf).withColumns({"p": F.slice("a", 1, 51), "len": F.lit(200)})
    d = SK.noise_augment(d, ["label"], "pos", "p", ones, seed=7, length="len")
    return d.select("label", "pos", F.round(V.distance(F.col("noisy"), F.col("p")), 6).alias("moved"), F.size(F.filter("visible", lambda v: v)).alias("visible"))


@query(
    "sequence_udf",
    f"WITH {EV_SQL} SELECT user_id, count(*) AS n, round(sum(value * pos), 4) AS moment FROM ev GROUP BY 1",
)
def sequence_udf(spark, sf):
    """A user function that reads its sequence in chunks."""
    import pandas as pd

    from kinetable.operators.joins import sequence_udf as run

    def moment(parts):
        n, m, user = 0, 0.0, None
        for pdf in parts:
            user = pdf["user_id"].iloc[0]
            n += len(pdf)
            m += float((pdf["value"] * pdf["pos"]).sum())
        yield pd.DataFrame({"user_id": [user], "n": [n], "moment": [m]})

    d = run(event_track(spark, sf, "value"), ["user_id"], "pos", moment, "user_id long, n long, moment double")
    return d.withColumn("moment", F.round("moment", 4))
