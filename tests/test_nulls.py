"""Null keys, orders and values keep every row."""

import pytest
from pyspark.sql import functions as F

from kinetable.operators import budget as BU
from kinetable.operators import frames as FR
from kinetable.operators import joins as J
from kinetable.operators import kinematics as K
from kinetable.operators import merge as M
from kinetable.operators import motion_metrics as MM
from kinetable.operators import resample as RS
from kinetable.operators import runs as RU
from kinetable.operators import smoothing as SM
from kinetable.operators.blocks import Seq, fit_bucket, number_rows, scan
from kinetable.session import shared_base
from kinetable.sources.writers import write_dataset

ROWS = [("a", 0, 1.0), ("a", None, 2.0), (None, 0, 3.0), (None, 1, 4.0), ("a", 1, None), (None, None, 5.0)]


@pytest.fixture(scope="module")
def d(spark):
    return spark.createDataFrame(ROWS, "k string, pos long, v double")


def test_number_rows(d):
    for bucket in (F.floor(F.col("pos") / 1), fit_bucket(d, ["k"], F.col("pos")), F.lit(0)):
        got = {(r.k, r.pos): r.n for r in number_rows(d, ["k"], ["pos"], bucket, "n").collect()}
        assert got == {("a", None): 0, ("a", 0): 1, ("a", 1): 2, (None, None): 0, (None, 0): 1, (None, 1): 2}


@pytest.mark.parametrize("size", [1, 2, 100])
def test_scan(d, size):
    v = F.col("v")
    got = scan(d, Seq(("k",), "pos", size), sums={"s": v}, last={"l": v}, next={"n": v}).collect()
    assert {(r.k, r.pos): (r.s, r.l, r.n) for r in got} == {
        ("a", None): (2.0, 2.0, 2.0), ("a", 0): (3.0, 1.0, 1.0), ("a", 1): (3.0, 1.0, None),
        (None, None): (5.0, 5.0, 5.0), (None, 0): (8.0, 3.0, 3.0), (None, 1): (12.0, 4.0, 4.0),
    }


def test_operators_keep_every_row(d):
    seq = Seq(("k",), "pos", 10)
    on = d.withColumn("v", F.coalesce("v", F.lit(0.0)))
    assert RU.remove_islands(on.withColumn("f", (F.col("v") > 2).cast("int")), seq, "f", 2).count() == len(ROWS)
    assert RS.interpolate_gaps(d, seq, ["v"]).count() == len(ROWS)
    assert K.rollout(on, seq, {"x": F.col("v")}).count() == len(ROWS)
    assert FR.renumber_segments(d, ["k"], "pos", F.col("pos"), ["v"]).count() == len(ROWS)
    assert BU.split(d, ["v"], key=F.col("v")).count() == len(ROWS)
    assert BU.split(d, ["k", "pos"]).count() == len(ROWS)
    assert SM.trailing_mode(d.withColumn("l", F.lit(None).cast("string")), seq, "l", 3).where("smoothed IS NULL").count() == len(ROWS)


def test_trailing_mode_counts_null_as_a_label(spark):
    d = spark.createDataFrame([(0, i, x) for i, x in enumerate(["a", None, None, "b", "b"])], "k int, pos long, l string")
    got = [r.smoothed for r in SM.trailing_mode(d, Seq(("k",)), "l", 3).orderBy("pos").collect()]
    assert got == ["a", "a", None, None, "b"]


def test_gaussian_keeps_the_place_of_nulls(spark):
    d = spark.createDataFrame([(0, i, None if i == 4 else float(i)) for i in range(9)], "k int, pos long, v double")
    got = [r.v for r in SM.gaussian_smooth(d, Seq(("k",)), ["v"], 0.5).orderBy("pos").collect()]
    full = d.withColumn("v", F.col("pos").cast("double"))
    want = [r.v for r in SM.gaussian_smooth(full, Seq(("k",)), ["v"], 0.5).orderBy("pos").collect()]
    assert got[4] == pytest.approx(4.0)  # what lies around it is symmetric
    assert got[:2] + got[7:] == pytest.approx(want[:2] + want[7:])
    none = SM.gaussian_smooth(d.withColumn("v", F.lit(None).cast("double")), Seq(("k",)), ["v"], 0.5)
    assert none.where("v IS NULL").count() == 9


def test_smooth_track_keeps_the_place_of_nulls(spark):
    d = spark.createDataFrame([(0, i, None if i == 4 else [float(i + 1), 1.0]) for i in range(9)], "k int, pos long, v array<double>")
    got = [r.v for r in M.smooth_track(d, Seq(("k",)), "v", 2, 0.5).orderBy("pos").collect()]
    assert got[4] == pytest.approx([5.0, 1.0])
    assert all(x[1] == pytest.approx(1.0) for x in got)


def test_pad_to_refuses_longer_clips(spark):
    d = spark.createDataFrame([("c", i, float(i)) for i in range(5)], "k string, f long, v double")
    with pytest.raises(Exception, match="does not fit"):
        FR.pad_to(d, ["k"], "f", 4).collect()
    assert FR.pad_to(d, ["k"], "f", 4, cut=True).count() == 4
    assert FR.pad_to(d, ["k"], "f", 6).count() == 6


def test_pad_to_query_takes_users_of_any_length(spark, tmp_path):
    from kinetable.plans.q_joins import pad_to

    rows = [(u, i, u, float(i)) for u, n in ((1, 130), (2, 30)) for i in range(n)]
    d = spark.createDataFrame(rows, "u long, event_id long, user_id long, value double")
    d.select((F.timestamp_seconds(F.col("event_id") * 60)).alias("ts"), "event_id", "user_id", "value").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.user_id, r.out_frame): (r.value, r.is_valid) for r in pad_to(spark, str(tmp_path)).collect()}
    assert got == {(u, f): (float(min(f, n - 1)), f < n) for u, n in ((1, 130), (2, 30)) for f in range(100)}


def test_center_on_camera_uses_the_nearest_frame(spark):
    rows = [("s", 0, i, 1.0, 10.0 + i, True) for i in range(5)] + [("s", 1, i, 1.0, 20.0 + i, False) for i in (0, 1)]
    d = spark.createDataFrame(rows, "scene string, body int, frame long, t double, c double, ok boolean")
    d = d.withColumns({f"{a}{i}": F.col(a) for a in "tc" for i in range(3)})
    got = K.center_on_camera(d, Seq(("scene", "body"), "frame"), ["scene"], F.col("ok"), ["t0", "t1", "t2"], ["c0", "c1", "c2"])
    assert got.where("t0 IS NULL OR t2 IS NULL").count() == 0


def test_global_metrics_without_the_first_frames(spark):
    rows = [("a", f, j, float(f + j), float(j * j), float(f * j)) for f in range(10) if f not in (5, 6) for j in range(4)]
    d = spark.createDataFrame(rows, "clip string, frame long, joint int, px double, py double, pz double")
    d = d.withColumns({"gx": F.col("px") + F.when(F.col("frame") == 9, 1.0).otherwise(0.0), "gy": F.col("py"), "gz": F.col("pz")})
    got = MM.global_metrics(d, ["clip"], "frame", 5).first()
    # Of 32 rows the 4 of frame 9 are one metre off once the first two frames of each chunk are aligned.
    assert got.wa2_mpjpe == pytest.approx(1000 * 4 / 32, rel=1e-6)


def test_assignment_ignores_null_costs(spark):
    d = spark.createDataFrame([("s", 0, 0, None), ("s", 0, 1, 2.0)], "scene string, l int, r int, cost double")
    assert [(r.l, r.r) for r in J.assign_min_cost(d, ["scene"], "l", "r").collect()] == [(0, 1)]


def test_write_dataset_knows_null_keys(spark, tmp_path):
    d = spark.createDataFrame([("a", None, 1), ("a", 2, 2), (None, 2, 3)], "p string, k int, v int")
    path = str(tmp_path / "t")
    for _ in range(2):
        write_dataset(d, path, ["p", "k"], ["p"])
    assert spark.read.parquet(path).count() == 3


def test_storage_has_to_be_shared():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master, applicationId = "spark://cluster:7077", "app"
        getConf = staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_base(Session)


def test_package_for_the_workers(spark):
    import zipfile

    from kinetable.session import ship_package

    names = zipfile.ZipFile(ship_package(spark)).namelist()
    assert "kinetable/operators/blocks.py" in names


def test_oracles_need_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.oracle_sql()) > 200)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True).stdout.strip() == "True"
