import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetable.operators import ledger as LE
from kinetable.operators import segments as SG
from kinetable.operators.blocks import Seq
from kinetable.streaming import state as ST

RULES = SG.SegmentRules(fps=4.0, min_segment=0.5, longest=30, box_area=10.0, high=0.9, low=0.05, frozen=4)
SEQ = Seq(("video",), "frame", 16)


def signals(seed, n=300, videos=2):
    r = np.random.default_rng(seed)
    rows = []
    for v in range(videos):
        human = np.repeat(r.random(n) < 0.7, r.integers(1, 6, n))[:n]
        for f in range(n):
            rows.append(
                (v, f, bool(human[f]), float(r.choice([5, 20, 30])), float(r.random()) if f % 2 == 0 else None, bool(r.random() < 0.3),
                 bool(r.random() < 0.8), bool(r.random() < 0.9), bool(r.random() < 0.02), bool(r.random() < 0.02))
            )
    return pd.DataFrame(rows, columns=["video", *SG.SIGNALS])


def direct(pdf, rules):
    out = []
    for v, g in pdf.groupby("video"):
        s, got = SG.SegmentState(), []
        for row in g.sort_values("frame").to_dict("records"):
            if x := SG.segment_step(s, row, rules):
                got.append(x)
        if x := SG.segment_end(s, rules):
            got.append(x)
        out += [(v, *x[1:]) for x in got]
    return sorted(map(repr, out))


SCHEMA = "video long, frame long, human boolean, max_area double, flow double, is_repeat boolean, target_visible boolean, has_targets boolean, crowded boolean, odd_pose boolean"


def to_spark(spark, pdf):
    rows = [tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in pdf.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_split_pieces_give_the_same_segments(spark, seed):
    pdf = signals(seed)
    d = to_spark(spark, pdf)
    assert SG.split_at_silence(SG.signal_runs(d, SEQ, RULES), SEQ, RULES).agg(F.max("piece")).first()[0] > 3
    got = SG.segment_scenes(d, SEQ, RULES).toPandas()
    rows = sorted(repr((r.video, r.start, r.frames, r.crowded, r.odd_pose, list(r.reasons))) for r in got.itertuples())
    assert rows == direct(pdf, RULES)
    for _, g in got.groupby("video"):
        assert sorted(g["number"]) == list(range(1, len(g) + 1))


def test_strict_mode_runs_whole_videos(spark):
    rules = SG.SegmentRules(**{**RULES.__dict__, "strict_ref": True})
    pdf = signals(7)
    got = SG.segment_scenes(to_spark(spark, pdf), SEQ, rules).toPandas()
    assert sorted(repr((r.video, r.start, r.frames, r.crowded, r.odd_pose, list(r.reasons))) for r in got.itertuples()) == direct(pdf, rules)


def runs_of(rows, rules, most):
    """Rows in runs of at most ``most`` frames, as plain loops form them."""
    out = []
    for row in rows:
        h, flow = row["human"], row["flow"]
        kind = 0 if flow is None or flow != flow else 1 if flow > rules.high else -1 if flow < rules.low else 0
        v = {"human": h, "small": h and row["max_area"] < rules.box_area, "flow": kind if h else 0, "target_visible": row["target_visible"]}
        v |= {c: h and row[c] for c in ("is_repeat", "has_targets", "crowded", "odd_pose")}
        if out and out[-1]["length"] < most and {k: out[-1][k] for k in v} == v:
            out[-1]["length"] += 1
        else:
            out.append({"frame": row["frame"], "length": 1, **v})
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_runs_give_what_frames_give(strict):
    """Long runs, every rule, and runs cut anywhere; the state is the same at the end of each run."""
    r = np.random.default_rng(21)
    fired, steps, frames = set(), 0, 0
    for _ in range(150):
        rules = SG.SegmentRules(
            fps=float(r.choice([4.0, 7.5, 30.0])), min_segment=0.0, no_human=float(r.choice([0.2, 0.5, 2.0])), small_box=float(r.choice([0.5, 2.0])), static_flow=1.0, high_flow=1.5,
            margin=float(r.choice([0.0, 1.0, 2.0])), box_area=10.0, high=0.9, low=0.05, frozen=int(r.choice([3, 10])), longest=int(r.choice([20, 200])), strict_ref=strict,
        )
        rows = []
        while len(rows) < 400:
            one = dict(
                human=bool(r.random() < 0.8), max_area=float(r.choice([5, 20, 30])), flow=[None, float("nan"), 0.01, 0.5, 0.95][r.integers(5)], is_repeat=bool(r.random() < 0.2),
                target_visible=bool(r.random() < 0.8), has_targets=bool(r.random() < 0.8), crowded=bool(r.random() < 0.1), odd_pose=bool(r.random() < 0.1),
            )
            rows += [{**one, "frame": len(rows) + i} for i in range(int(r.integers(1, 80)))]
        a, b, got, want, k = SG.SegmentState(), SG.SegmentState(), [], [], 0
        for run in runs_of(rows, rules, int(r.choice([5, 1000]))):
            got += SG.segment_run(a, run, rules)
            for _ in range(run["length"]):
                want += [x for x in [SG.segment_step(b, rows[k], rules)] if x]
                k += 1
            assert a == b
        assert got == want and k == len(rows)
        fired |= {x for w in want for x in w[-1]}
    assert fired == {"frozen", "small box", "high flow", "static", "no target", "too long", "no human"}


def test_runs_are_formed_by_spark(spark):
    pdf = signals(4, 200)
    pdf["max_area"], pdf["is_repeat"], pdf["target_visible"], pdf["crowded"], pdf["odd_pose"] = 20.0, False, True, False, False
    got = SG.signal_runs(to_spark(spark, pdf), Seq(("video",), "frame", 1000), RULES).orderBy("video", "frame").collect()
    want = []
    for v, g in pdf.groupby("video"):
        want += [{"video": v, **x} for x in runs_of([{**x, "flow": x["flow"]} for x in g.to_dict("records")], RULES, 10**9)]
    assert [x.asDict() for x in got] == want
    nulls = spark.createDataFrame([(None, 0, None, None, None, None, None, None, None, None), (None, 1, True, None, None, None, None, None, None, None), (None, 5, True, None, None, None, None, None, None, None)], SCHEMA)
    got = SG.signal_runs(nulls, SEQ, RULES).orderBy("frame").collect()
    assert [(x.frame, x.length, x.human, x.small, x.flow, x.target_visible) for x in got] == [(0, 1, False, False, 0, False), (1, 1, True, False, 0, False), (5, 1, True, False, 0, False)]
    assert SG.segment_scenes(nulls.limit(0), SEQ, RULES).collect() == []


def test_simple_segment():
    rules = SG.SegmentRules(fps=10.0)
    s, got = SG.SegmentState(), []
    for f in range(60):
        row = dict(frame=f, human=f < 40, max_area=1e6, flow=None, is_repeat=False, target_visible=True, has_targets=True, crowded=f == 5, odd_pose=False)
        if x := SG.segment_step(s, row, rules):
            got.append(x)
    # five silent frames close it and are cut from the end
    assert got == [(1, 1, 40, True, False, ["no human"])]


def stream_of(spark, df, tmp_path, key, parts=3):
    """Write rows in ``key`` order as several files and stream them one by one."""
    path = str(tmp_path / "in")
    lim = df.agg(F.max(key)).first()[0] + 1
    for i in range(parts):
        lo, hi = lim * i // parts, lim * (i + 1) // parts
        df.where((F.col(key) >= lo) & (F.col(key) < hi)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_segment_stream_equals_batch(spark, tmp_path):
    pdf = signals(11, 120)
    d = to_spark(spark, pdf)
    end = d.groupBy("video").agg(F.lit(120).cast("long").alias("frame"))
    feed = d.unionByName(end, allowMissingColumns=True)
    s = ST.segment_scenes_stream(stream_of(spark, feed, tmp_path, "frame"), ["video"], "frame", RULES)
    got = ST.run_available(s, str(tmp_path / "run")).toPandas()
    assert sorted(repr((r.video, r.start, r.frames, r.crowded, r.odd_pose, list(r.reasons))) for r in got.itertuples()) == direct(pdf, RULES)


def faces(spark, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for f in [*range(0, 12), *range(40, 50)]:  # the silence empties the tracker
        for p in range(2):
            if r.random() < 0.85:
                x = 100.0 * p + 2 * f
                rows.append((1, f, x, 10.0, x + 50, 70.0, [1.0 - p, float(p)]))
    return spark.createDataFrame(rows, "video int, frame int, x1 double, y1 double, x2 double, y2 double, embedding array<double>")


def test_face_tracks_follow_people(spark, tmp_path):
    d = faces(spark)
    got = SG.track_faces(d, ["video"], "frame").toPandas()
    assert len(got) == d.count()
    assert set(got["piece"]) == {0, 1}
    for _, g in got.groupby(["piece", "face_id"]):
        assert ((g["x1"] - 2 * g["frame"]).max() - (g["x1"] - 2 * g["frame"]).min()) < 40
    assert got.groupby("piece")["face_id"].nunique().tolist() == [2, 2]
    s = ST.track_faces_stream(stream_of(spark, d, tmp_path, "frame"), ["video"], "frame")
    live = ST.run_available(s, str(tmp_path / "run")).toPandas()
    # both go on counting identities after the silence
    key = ["frame", "x1"]
    a, b = got.sort_values(key), live.sort_values(key)
    assert a["face_id"].tolist() == b["face_id"].tolist()
    np.testing.assert_allclose(a[["x1", "y2"]], b[["x1", "y2"]])


def test_trailing_mode_stream_over_batches(spark, tmp_path):
    r = np.random.default_rng(2)
    labels = r.choice(list("abc"), 60)
    d = spark.createDataFrame([(1, i, str(x)) for i, x in enumerate(labels)], "k int, i int, l string")
    s = ST.trailing_mode_stream(stream_of(spark, d, tmp_path, "i"), ["k"], "i", "l", 7)
    got = ST.run_available(s, str(tmp_path / "run")).orderBy("i").toPandas()["smoothed"].tolist()
    from kinetable.operators.smoothing import trailing_mode

    want = trailing_mode(d, Seq(("k",), "i", 16), "l", 7).orderBy("i").toPandas()["smoothed"].tolist()
    assert got == want


T0 = dt.datetime(2024, 1, 1)


def ledger(spark):
    m = lambda x: T0 + dt.timedelta(minutes=x)
    rows = [("a", "o1", "in_progress", m(0)), ("b", "o2", "in_progress", m(100)), ("c", "o1", "in_progress", m(10)), ("c", "o1", "processed", m(20)), ("d", "o3", "in_progress", m(190))]
    beats = [("o2", m(110)), ("o3", m(195))]
    return spark.createDataFrame(rows, "item string, owner string, state string, ts timestamp"), spark.createDataFrame(beats, "owner string, ts timestamp"), F.lit(m(200))


def test_lease_rules(spark):
    ev, beats, now = ledger(spark)
    s = LE.ledger_state(ev)
    assert {r["item"]: r["state"] for r in s.collect()} == {"a": "in_progress", "b": "in_progress", "c": "processed", "d": "in_progress"}
    gone = {r["item"] for r in LE.expired_leases(s, beats, now).collect()}
    assert gone == {"a", "b"}  # a by age, b by its silent owner
    items = spark.createDataFrame([(x,) for x in "abcde"], "item string")
    assert {r["item"] for r in LE.available_work(items, s, beats, now).collect()} == {"a", "b", "e"}
    left = LE.release_owner(s, spark.createDataFrame([("o3",)], "owner string"))
    assert {r["item"] for r in left.collect()} == {"a", "b", "c"}


def test_lease_stream_expires_by_event_time(spark, tmp_path):
    ev, _, _ = ledger(spark)
    path = str(tmp_path / "in")
    ev.coalesce(1).write.parquet(path)
    late = spark.createDataFrame([("z", "o9", "in_progress", T0 + dt.timedelta(hours=9))], ev.schema)
    late.coalesce(1).write.mode("append").parquet(path)
    feed = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = ST.run_available(ST.expire_leases_stream(feed), str(tmp_path / "run"))
    assert {r["item"] for r in got.collect()} == {"a", "b", "d"}


def test_face_identities_count_on_after_silence(spark):
    rows = [("v", f, float(x), 0.0, x + 50.0, 50.0) for f in (0, 1, 2, 100, 101, 300) for x in (0, 500)] + [(None, 7, 0.0, 0.0, 9.0, 9.0)]
    d = spark.createDataFrame(rows, "k string, frame long, x1 double, y1 double, x2 double, y2 double").withColumn("embedding", F.lit(None).cast("array<double>"))
    got = SG.track_faces(d, ["k"], "frame").collect()
    ids = {f: sorted(r.face_id for r in got if r.frame == f and r.k == "v") for f in (0, 100, 300)}
    assert ids == {0: [1, 2], 100: [3, 4], 300: [5, 6]}
    assert [r.face_id for r in got if r.k is None] == [1]


def test_tracker_equals_the_matrix_filter():
    f, h, r = np.eye(7) + np.eye(7, k=4) * (np.arange(7)[:, None] < 3), np.eye(4, 7), np.random.default_rng(4)
    t = SG.FaceTracker(max_miss=10**9)
    box = np.array([10.0, 20.0, 70.0, 90.0])
    t.step(box[None], [None])
    mean, cov = np.array([*t.measure(box.tolist()), 0.0, 0.0, 0.0]), np.eye(7) * 10
    for n in range(40):
        mean, cov = f @ mean, f @ cov @ f.T + np.eye(7) * 0.01
        if n % 3:
            t.step(np.zeros((0, 4)), [])
            continue
        box = box + r.normal(0, 0.5, 4)
        t.step(box[None], [None])
        gain = np.linalg.solve(h @ cov @ h.T + np.eye(4), h @ cov).T
        mean, left = mean + gain @ (np.array(t.measure(box.tolist())) - h @ mean), np.eye(7) - gain @ h
        cov = left @ cov @ left.T + gain @ gain.T
    assert len(t.tracks) == 1
    np.testing.assert_allclose(t.tracks[0].mean, mean, rtol=1e-9)
    for i in range(3):
        np.testing.assert_allclose(t.tracks[0].cov[i], cov[np.ix_([i, 4 + i], [i, 4 + i])].ravel(), rtol=1e-9)
    np.testing.assert_allclose(t.tracks[0].cov[3], [cov[3, 3]], rtol=1e-9)
    for shape in ((1, 5), (5, 1)):
        c = r.integers(0, 3, shape).astype(float)
        i, j = np.indices(shape).reshape(2, -1)
        k = SG.solve_assignment(i, j, c.ravel())
        assert SG.FaceTracker._pairs(c) == list(zip(i[k], j[k]))
