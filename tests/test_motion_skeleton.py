import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.functions import pose as PO
from kinetable.functions import rotation as R
from kinetable.functions import vectors as V
from kinetable.operators import motion_metrics as MM
from kinetable.operators import skeleton as SK
from kinetable.operators.blocks import Seq


def rotation(seed):
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else q[:, [1, 0, 2]]


def pairs(spark, move):
    r = np.random.default_rng(0)
    rows = []
    for c in range(2):
        for f in range(12):
            for j in range(5):
                p = r.normal(size=3)
                g = move(p, c, f)
                rows.append((c, f, j, *map(float, p), *map(float, g)))
    return spark.createDataFrame(rows, "clip int, frame int, joint int, px double, py double, pz double, gx double, gy double, gz double")


def test_alignment_recovers_a_similarity(spark):
    rot, t = rotation(1), np.array([1.0, -2.0, 3.0])
    d = pairs(spark, lambda p, c, f: 2.5 * rot @ p + t)
    row = MM.align_groups(d, ["clip"]).first()
    assert abs(row["s"] - 2.5) < 1e-9
    np.testing.assert_allclose(np.reshape(row["rot"], (3, 3)), rot, atol=1e-9)
    np.testing.assert_allclose(row["shift"], t, atol=1e-9)
    assert MM.pa_mpjpe(d, ["clip", "frame"]).first()[0] < 1e-9
    g = MM.global_metrics(d, ["clip"], "frame", 5).collect()
    assert all(r["wa2_mpjpe"] < 1e-6 and r["waa_mpjpe"] < 1e-6 for r in g)


def test_alignment_never_mirrors(spark):
    d = pairs(spark, lambda p, c, f: p * np.array([-1, 1, 1]))
    for r in MM.align_groups(d, ["clip"]).collect():
        assert np.linalg.det(np.reshape(r["rot"], (3, 3))) > 0


def test_root_translation_error(spark):
    rot = rotation(2)
    d = pairs(spark, lambda p, c, f: rot @ p + 5).where("joint = 0")
    assert all(r["rte"] < 1e-6 for r in MM.root_translation_error(d, Seq(("clip",), "frame", 4)).collect())


def test_visible_drops_the_sentinel(spark):
    d = pairs(spark, lambda p, c, f: np.full(3, -2.0) if f == 0 else p)
    assert MM.visible(d).count() == 2 * 11 * 5


def walk(n=40, j=22, seed=0):
    """A plausible moving body: the raw skeleton plus motion and noise."""
    r = np.random.default_rng(seed)
    sk = SK.BODY_22
    rest = np.zeros((j, 3))
    for c in sk.chains:
        for a, b in zip(c, c[1:]):
            rest[b] = rest[a] + (0.6 if b in (13, 14) else 0.3) * np.array(sk.raw[b])  # shoulders wider than hips
    t = np.arange(n)[:, None, None] / 30
    x = rest[None] + np.concatenate([0.4 * t, 0.05 * np.sin(6 * t), 0.2 * t], -1) + 0.02 * r.normal(size=(n, j, 3))
    x[..., 1] += 1.0
    return x


def as_table(spark, **clips):
    rows = [(k, i, f.reshape(-1).tolist()) for k, x in clips.items() for i, f in enumerate(x)]
    return spark.createDataFrame(rows, "clip string, frame long, joints array<double>")


def arrays(d, c, clip="a"):
    return np.stack([r[c] for r in d.where(F.col("clip") == clip).orderBy("frame").collect()])


SEQ = Seq(("clip",), "frame", 100)


def test_kinematics_round_trip(spark):
    x = walk()
    d = SK.inverse_kinematics_job(as_table(spark, a=x), SEQ, "joints")
    d = d.withColumn("off", PO.skeleton_offsets(F.col("joints"), SK.BODY_22.parents(), list(SK.BODY_22.raw)))
    d = SK.forward_kinematics_job(d.withColumn("root", F.slice("joints", 1, 3)).withColumnRenamed("joints", "was"), "quats", "root", "off")
    np.testing.assert_allclose(arrays(d, "joints"), x.reshape(len(x), -1), atol=1e-9)


def test_retarget_keeps_target_bones(spark):
    target = (0.5 * np.array(SK.BODY_22.raw, float)).reshape(-1)
    d = SK.retarget_job(as_table(spark, a=walk()), SEQ, "joints", target.tolist())
    got = SK.bone_offsets(arrays(d, "joints").reshape(-1, 22, 3), SK.BODY_22)
    np.testing.assert_allclose(got, np.broadcast_to(target.reshape(1, 22, 3), got.shape), atol=1e-9)


@pytest.mark.parametrize("size", [85, 1000])
def test_features_round_trip(spark, size):
    x = walk(120)
    seq = Seq(("clip",), "frame", size)
    d = as_table(spark, a=x, b=walk(5, seed=1))
    feats = SK.motion_features_263(d, seq, "joints", align=False)
    v = arrays(feats, "vec")
    assert v.shape == (119, 263) and len(arrays(feats, "vec", "b")) == 4
    back = arrays(SK.features_to_joints(feats, seq), "joints").reshape(-1, 22, 3)
    want = x[:-1] - x[0, 0] * np.array([1.0, 0.0, 1.0])
    np.testing.assert_allclose(back, want, atol=1e-6)
    assert set(np.unique(v[:, -4:])) <= {0.0, 1.0}


def test_features_do_not_depend_on_place_or_block(spark):
    x = walk(100)
    moved = x + np.array([3.0, 7.0, -2.0])
    d = SK.motion_features_263(as_table(spark, a=x, b=moved), Seq(("clip",), "frame", 90), "joints")
    np.testing.assert_allclose(arrays(d, "vec"), arrays(d, "vec", "b"), atol=1e-9)
    e = SK.motion_features_263(as_table(spark, a=x), SEQ, "joints")
    np.testing.assert_allclose(arrays(d, "vec"), arrays(e, "vec"), atol=1e-9)


def test_rotation_identities(spark):
    r = np.random.default_rng(3)
    q = r.normal(size=(50, 4))
    q[:4] = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [1e-9, 0, 0, 1]]
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "i int, q array<double>")
    c = F.col("q")
    m = R.quat_to_matrix(c)
    d = d.select("i", m.alias("m"), R.qmul(c, R.qinv(c)).alias("one"), R.qrot(c, V.vec(1.0, 2.0, 3.0)).alias("v"),
                 *[R.convert(R.convert(c, "quaternion", k), k, "matrix").alias(k) for k in ("axis_angle", "sixd", "matrix")],
                 R.slerp(c, c, F.lit(0.3)).alias("s"))
    for row in d.orderBy("i").collect():
        want = SK.quat_to_mat(q[row["i"]][None])[0].reshape(-1)
        np.testing.assert_allclose(row["m"], want, atol=1e-12)
        np.testing.assert_allclose(row["one"], [1, 0, 0, 0], atol=1e-12)
        np.testing.assert_allclose(row["v"], want.reshape(3, 3) @ [1, 2, 3], atol=1e-12)
        np.testing.assert_allclose(row["s"], q[row["i"]], atol=1e-9)
        for k in ("axis_angle", "sixd", "matrix"):
            np.testing.assert_allclose(row[k], want, atol=1e-7)


@pytest.mark.parametrize("axes", ["XYZ", "XZY", "YXZ", "YZX", "ZXY", "ZYX"])
def test_euler_round_trip(spark, axes):
    a = [0.3, -0.7, 1.1]
    d = spark.createDataFrame([(a,)], "a array<double>").select(R.euler_to_quat(F.col("a"), axes).alias("q"))
    np.testing.assert_allclose(d.select(R.quat_to_euler(F.col("q"), axes)).first()[0], a, atol=1e-12)


def test_slerp_half_way(spark):
    d = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0])], "a array<double>, b array<double>")
    got = d.select(R.slerp(F.col("a"), F.col("b"), F.lit(0.5))).first()[0]
    np.testing.assert_allclose(got, [np.sqrt(0.5), np.sqrt(0.5), 0, 0], atol=1e-12)


def test_world_camera_relation(spark):
    r = np.random.default_rng(4)
    m = rotation(5)
    rows = [(i, (r.normal(size=3)).tolist(), r.normal(size=3).tolist(), m.reshape(-1).tolist(), [0.1, 0.2, 0.3]) for i in range(10)]
    d = spark.createDataFrame(rows, "i int, orient array<double>, transl array<double>, r array<double>, t array<double>")
    d = SK.world_camera_job(d, "r", "t", offset=(0.0, 0.1, 0.0))
    d = SK.relating_transform(d, (0.0, 0.1, 0.0))
    for row in d.collect():
        np.testing.assert_allclose(row["r_w2c"], m.reshape(-1), atol=1e-9)
        np.testing.assert_allclose(row["t_w2c"], [0.1, 0.2, 0.3], atol=1e-9)
        g = np.reshape(row["r_c2gv"], (3, 3))
        np.testing.assert_allclose(g[1], m @ [0, 0, -1], atol=1e-9)
        np.testing.assert_allclose(g @ g.T, np.eye(3), atol=1e-4)
    flat = SK.reorient(SK.reorient(d, "az->ay"), "ay->ay").first()
    turn = np.array([[1, 0, 0], [0, 0, 1], [0, -1, 0]])
    np.testing.assert_allclose(flat["transl"], turn @ d.first()["transl"], atol=1e-9)


@pytest.mark.parametrize("kind", ["quaternion", "axis_angle", "sixd"])
def test_rotation_tables(spark, kind):
    r = np.random.default_rng(6)
    q = r.normal(size=(20, 2, 4))
    q[0] = [[0, 1, 0, 0], [1, 0, 0, 0]]
    q /= np.linalg.norm(q, axis=-1, keepdims=True)
    d = spark.createDataFrame([(i, x.reshape(-1).tolist()) for i, x in enumerate(q)], "i int, q array<double>")
    want = np.stack([x["q"] for x in SK.convert_rotations(d, "q", "quaternion", "matrix").orderBy("i").collect()])
    there = SK.convert_rotations(d, "q", "quaternion", kind)
    got = np.stack([x["q"] for x in SK.convert_rotations(there, "q", kind, "matrix").orderBy("i").collect()])
    np.testing.assert_allclose(got, want, atol=1e-9)
    native = d.select("i", R.quat_to_matrix(F.slice("q", 1, 4)).alias("m")).orderBy("i").collect()
    np.testing.assert_allclose(np.stack([x["m"] for x in native]), want[:, :9], atol=1e-12)


def test_pose_noise_has_the_asked_size(spark):
    d = spark.range(300).select("id", F.array_repeat(F.lit(0.0), 6).alias("p"))
    x = np.stack([r["p"] for r in SK.pose_noise(d, "p", ["id"], 10.0, seed=2).collect()]).reshape(-1, 3)
    assert abs(np.rad2deg(np.sqrt((x**2).sum(1).mean())) - 10) < 1


def test_average_rotation_and_noise(spark):
    d = spark.createDataFrame([("c", 0, [0.2, 0.0, 0.0] * 2, [0.6, 0.0, 0.0] * 2)], "c string, f long, a array<double>, b array<double>")
    np.testing.assert_allclose(SK.average_rotations(d, "a", "b").first()["average"], [0.4, 0, 0] * 2, atol=1e-9)
    p = spark.range(400).select(F.lit("c").alias("c"), F.col("id").alias("f"), F.array_repeat(F.lit(0.0), 51).alias("p"))
    ones = {k: [1.0] * 17 for k in ("jittering", "bias", "peak", "pmask")}
    n = SK.noise_augment(p, ["c"], "f", "p", ones, seed=1, s_bias=0.0, s_peak=0.0).cache()
    x = np.stack([r["noisy"] for r in n.collect()])
    assert abs(x.std() - 0.05) < 0.003 and abs(x.mean()) < 0.003
    again = SK.noise_augment(p.repartition(3), ["c"], "f", "p", ones, seed=1, s_bias=0.0, s_peak=0.0)
    assert n.exceptAll(again).count() == 0


def test_mirror_twice_is_identity(spark):
    x = walk(3)
    d = as_table(spark, a=x).withColumn("joints", PO.mirror_joints(PO.mirror_joints(F.col("joints"))))
    np.testing.assert_allclose(arrays(d, "joints"), x.reshape(3, -1))
    assert sorted(PO.mirror_order(52)) == list(range(52))


def test_pose_dimension_is_checked(spark):
    d = spark.createDataFrame([([0.0] * 7,)], "p array<double>")
    with pytest.raises(Exception, match="pose dimension"):
        d.select(PO.pose_slices(F.col("p"))["root"]).collect()


def test_map_rows_holds_few_rows_and_passes_the_rest(spark):
    d = spark.range(0, 5000, 1, 1).select("id", F.when(F.col("id") % 2 == 0, F.col("id").cast("int")).alias("half"), F.array(F.col("id").cast("double")).alias("v"))
    got = SK.map_rows(d, lambda p: {"n": [len(p)] * len(p), "v": [a * 2 for a in p["v"]]}, {"n": "long", "v": "array<double>"}).collect()
    assert [(r.id, r.half, r.v) for r in got] == [(i, None if i % 2 else i, [2.0 * i]) for i in range(5000)]
    assert max(r.n for r in got) <= SK.MAP_ROWS < 5000
