"""Faces meet bodies, and clips come out at one frame rate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable import schemas
from kinetable.operators import merge as M
from kinetable.operators.blocks import Seq

N = 20


def body(b, f, flagged=False, fps=15):
    x = 100.0 * b
    kp = [(x, 10.0, 1.0), (x + 5, 5.0, 1.0), (x - 5, 5.0, 1.0)] + [(0.0, 0.0, 0.0)] * 14
    pose = [0.0] * 165
    pose[1] = 0.1 * f
    return (1, 1, b, f, kp, [float(f), 1.0, 2.0 + b], [0.5, 0.25, 2.0], pose, [0.0] * 10, [x, 0.0, x + 10, 20.0], [0.0] * 6, flagged, fps)


def face(i, x, f, emotion):
    pt = lambda dx, dy, n: [(x + dx, dy)] * n
    return (1, 1, i, f, [x, 0.0, x + 9, 9.0], pt(0, 10.0, 3), pt(-5, 5.0, 5), pt(5, 5.0, 5), [0.3, 0.0, 0.0], [1.0] * 50, emotion, [1.0] + [0.0] * 6, [0.1] * 300)


@pytest.fixture(scope="module")
def tables(spark):
    bodies = [body(b, f, flagged=b == 2 and f < 3) for b in range(3) for f in range(N)]
    faces = [face(7, 200.0, f, "happy" if f != 10 else "sad") for f in range(N)] + [face(8, 3.0, f, "calm") for f in range(N - 5)]
    return spark.createDataFrame(bodies, schemas.BODIES), spark.createDataFrame(faces, schemas.FACES)


def test_matching(tables):
    got = {(r["face_id"], r["body_id"]) for r in M.match_faces(*tables).collect()}
    assert got == {(7, 2), (8, 0)}


def rows(d, b):
    return d.where(F.col("body_id") == b).orderBy("frame").collect()


def test_merge(tables):
    d = M.merge_scenes(*tables, island=3).cache()
    assert d.count() == 3 * N
    zero, one, two = (rows(d, b) for b in range(3))
    assert {r["emotion"] for r in one} == {"unknown"} and all(r["exp"] == [0.0] * 50 for r in one)
    assert {r["emotion"] for r in two} == {"happy"}  # one odd frame is voted down
    np.testing.assert_allclose([r["exp"][0] for r in two], 1.0)
    assert zero[-1]["exp"][0] == 0.0 and 0 < zero[N - 5]["exp"][0] < 1  # the face ended; its edge is smoothed
    assert abs(two[4]["pose"][66] - 0.3) < 1e-6 and two[4]["pose"][1] == pytest.approx(0.4)
    # trans minus the mean camera translation, third axis negated
    np.testing.assert_allclose(one[6]["trans"], [5.5, 0.75, 5.0])
    assert len(two[0]["face_shape"]) == 300 and len(one[0]["emotions_conf"]) == 7


def test_finish(tables):
    d = M.finish_clips(M.merge_scenes(*tables, island=3)).cache()
    zero, two = rows(d, 0), rows(d, 2)
    n30 = 2 * (N - 1) + 1
    assert len(zero) == n30 and zero[0]["fps"] == 30 and zero[0]["original_fps"] == 15
    np.testing.assert_allclose([r["trans"][0] for r in zero], np.arange(n30) / 2, atol=1e-9)
    np.testing.assert_allclose(zero[0]["trans"], [0, 0, 0], atol=1e-9)
    np.testing.assert_allclose([r["pose"][1] for r in zero], 0.05 * np.arange(n30), atol=1e-6)
    # flags cover source frames 0..2; half-way samples go to the earlier frame; then 7 // 2 more rows
    assert (two[0]["start"], two[0]["stop"]) == (6 + 3, n30) and two[0]["frame"] == 0
    assert [r["frame"] for r in two] == list(range(n30 - 9))


def test_nan_clips_are_dropped(spark, tables):
    bodies, faces = tables
    bad = bodies.withColumn("trans", F.when((F.col("body_id") == 1) & (F.col("frame") == 4), F.array(*[F.lit(float("nan")).cast("float")] * 3)).otherwise(F.col("trans")))
    d = M.finish_clips(M.merge_scenes(bad, faces, smooth=False))
    assert {r["body_id"] for r in d.select("body_id").distinct().collect()} == {0, 2}


def test_smooth_track_equals_columns(spark):
    from kinetable.operators.smoothing import gaussian_smooth

    v = np.random.default_rng(0).normal(size=(30, 2))
    d = spark.createDataFrame([("a", i, x.tolist(), float(x[0]), float(x[1])) for i, x in enumerate(v)], "k string, frame long, v array<double>, p double, q double")
    s = Seq(("k",), "frame", 7)
    a = np.stack([r["v"] for r in M.smooth_track(d, s, "v", 2, 1.0).orderBy("frame").collect()])
    b = gaussian_smooth(d, s, ["p", "q"], 1.0).orderBy("frame").toPandas()[["p", "q"]].to_numpy()
    np.testing.assert_allclose(a, b, atol=1e-12)


@pytest.mark.parametrize("size", [9, 64, 3840])
def test_short_islands_are_cleared_before_smoothing(spark, size):
    """As by runs of whole sequences, whatever the block size; borders and islands of the width stay."""
    from kinetable.operators.runs import remove_islands
    from kinetable.operators.smoothing import gaussian_smooth

    r = np.random.default_rng(3)
    v = np.concatenate([[1.5, 0], np.repeat(1.25 * (r.random(40) < 0.5), r.integers(1, 8, 40)), [0, 2.5]])
    d = spark.createDataFrame([("a", i, [float(x)], float(x)) for i, x in enumerate(v)], "k string, frame long, v array<double>, p double")
    s = Seq(("k",), "frame", size)
    got = [x["v"][0] for x in M.smooth_track(d, s, "v", 4, 1.0).orderBy("frame").collect()]
    want = [x["p"] for x in gaussian_smooth(remove_islands(d, s, ["p"], 4), s, ["p"], 1.0).orderBy("frame").collect()]
    np.testing.assert_allclose(got, want, atol=1e-12)
    assert 0 < sum(x == 0 for x in remove_islands(d, s, ["p"], 4).toPandas()["p"]) - (v == 0).sum()


def test_wide_rows_are_shuffled_once(spark, tables):
    """Smoothing has one shuffle, and the trim sends flags only."""
    from kinetable.operators.runs import trim_flagged
    from tests.test_pipeline_blocks import exchanges

    d = spark.createDataFrame([(1, 1, 1, i, [1.0, 0.0], [0.5], "happy", i < 3) for i in range(12)],
                              "video_id long, scene_id int, body_id int, frame int, exp array<double>, jaw array<double>, emotion string, flagged boolean")
    plan = trim_flagged(d, M.BODY, F.col("flagged"), 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "emotion#" not in plan.split("RepartitionByExpression", 1)[1].split("LogicalRDD")[0]
    assert exchanges(M._smooth(d, M.BODY, ["exp", "jaw"], "emotion", 5, 3, 1.0)) == 1
