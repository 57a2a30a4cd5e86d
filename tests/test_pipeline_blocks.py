"""Fused block pipelines: equal to plain loops at every block size, and few shuffles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.operators import kinematics as K
from kinetable.operators import runs as RU
from kinetable.operators import tracks as TR
from kinetable.operators.blocks import Seq, scan


def seq(size):
    return Seq(("k",), "pos", size)


def exchanges(df):
    """Shuffles of the final plan; one used again counts once."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return sum("Exchange " in x and "ReusedExchange" not in x for x in plan.splitlines())


def tracks():
    """Observed frames of each key; spans are 0..79."""
    r = np.random.default_rng(5)
    seen = {
        "whole": range(80), "ends": [0, *range(9, 62, 3)], "late": range(12, 80), "gap": [*range(20), *range(52, 80)],
        "hole": [1, 40, 41, 79], "short": range(30, 36), "one": [7], None: [*range(5, 70, 2)],
    }
    return {k: {i: r.normal(size=2) for i in f} for k, f in seen.items()}


def plain(known, n=80, max_missing=20, min_duration=10, width=5):
    """(x, y, interpolated, flagged) per frame, or None for a bad track."""
    t = sorted(known)
    gaps = [t[0], n - 1 - t[-1], *(b - a - 1 for a, b in zip(t, t[1:]))]
    if max(gaps) > max_missing or t[-1] - t[0] + 1 < min_duration:
        return None
    out = []
    for c in (0, 1):
        v = np.interp(np.arange(n), t, [known[i][c] for i in t])
        for _ in range(2):
            v = np.convolve(np.pad(v, width // 2, mode="edge"), np.ones(width) / width, "valid")
        out.append(v)
    x, y = out
    filled = np.array([i not in known for i in range(n)])
    jump = np.concatenate([[False], np.abs(np.diff(x)) > 0.3])
    return x, y, filled, filled | jump


@pytest.mark.parametrize("size", [3, 5, 8, 25, 4096])
def test_clean_tracks_by_plain_loops(spark, size):
    data = tracks()
    rows = [(k, i, float(v[0]), float(v[1]), "c") for k, f in data.items() for i, v in f.items()]
    # a frame beyond the span, and a key without one, are no part of the grid
    rows += [("whole", 200, 1.0, 1.0, "c"), ("nospan", 3, 1.0, 1.0, "c")]
    obs = spark.createDataFrame(rows, "k string, pos long, x double, y double, cam string")
    spans = spark.createDataFrame([(k, 0, 79) for k in data], "k string, first long, last long")
    jump = F.abs(F.col("x") - F.col("prev_x")) > 0.3
    d = TR.clean_tracks(obs, spans, seq(size), ["x", "y"], jump, 20, 10)
    assert d.columns == ["k", "pos", "x", "y", "cam", "interpolated", "flagged"]
    got = d.toPandas()
    want = {k: p for k, f in data.items() if (p := plain(f)) is not None}
    assert None in want and set(want) >= {"whole", "ends", "late"} and not {"gap", "hole", "short", "one"} & set(want)
    assert len(got) == 80 * len(want)
    for k, (x, y, filled, flagged) in want.items():
        g = got[got["k"].isna() if k is None else got["k"] == k].sort_values("pos")
        np.testing.assert_allclose(g["x"], x, atol=1e-12)
        np.testing.assert_allclose(g["y"], y, atol=1e-12)
        assert g["interpolated"].tolist() == filled.tolist() and g["flagged"].tolist() == flagged.tolist()
        assert g["cam"].isna().tolist() == filled.tolist()


def test_clean_tracks_of_nothing(spark):
    obs = spark.createDataFrame([], "k string, pos long, x double")
    spans = spark.createDataFrame([("a", 0, 9)], "k string, first long, last long")
    assert TR.clean_tracks(obs, spans, seq(4), ["x"]).count() == 0
    assert TR.clean_tracks(obs, spans.limit(0), seq(4), ["x"]).count() == 0


def bridged(v, w):
    """Zero and null runs filled by a loop over runs; null is a kind of its own."""
    kind = ["none" if x is None else "zero" if x == 0 else "full" for x in v]
    out, a = [], 0
    while a < len(v):
        b = a
        while b < len(v) and kind[b] == kind[a]:
            b += 1
        if kind[a] == "full":
            out += v[a:b]
        else:
            lv = next((x for x in reversed(v[:a]) if x), None)
            rv = next((x for x in v[b:] if x), None)
            n = b - a
            for i in range(1, n + 1):
                j, s = n - i + 1, min(n, w)
                if lv is not None and rv is not None:
                    x = lv + (rv - lv) * i / (n + 1) if n <= w else rv * (w - j) / w if j <= w else lv * (w - i) / w if i <= w else 0.0
                elif lv is not None:
                    x = lv * (s - i) / s if i <= s else 0.0
                elif rv is not None:
                    x = rv * (s - j) / s if j <= s else 0.0
                else:
                    x = 0.0
                out.append(x)
        a = b
    return out


@pytest.mark.parametrize("size", [2, 7, 4096])
def test_fill_zero_gaps_with_nulls(spark, size):
    r = np.random.default_rng(2)
    v = [None if p < 0.15 else 0.0 if p < 0.6 else float(x) for p, x in zip(r.random(70), r.normal(size=70))]
    cases = {"a": v, "b": [0.0, 0.0, 3.0], "c": [2.0, None, 0.0, 0.0, 0.0, 0.0, 0.0], "d": [None, None], None: [0.0, 1.0, 0.0, 0.0, 4.0]}
    d = spark.createDataFrame([(k, i, x) for k, s in cases.items() for i, x in enumerate(s)], "k string, pos long, v double")
    got = RU.fill_zero_gaps(d, seq(size), "v", 3).toPandas()
    for k, s in cases.items():
        g = got[got["k"].isna() if k is None else got["k"] == k].sort_values("pos")
        np.testing.assert_allclose(g["v"], bridged(s, 3), atol=1e-12)


@pytest.mark.parametrize("size", [2, 5, 100])
def test_scan_reads_bounded_windows(spark, size):
    v = [3, 3, 4, 4, 4, 1, 3, 3, 3, 3]
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, pos long, v long")
    new = F.col("p").isNull() | (F.col("p") != F.col("v"))
    out = scan(d, seq(size), sums={"run": new.cast("long")}, ends=("lo", "hi"), near=(1, 0, {"p": lambda w: F.lag("v").over(w)}))
    got = out.orderBy("pos").collect()
    assert [r["run"] for r in got] == [1, 1, 2, 2, 2, 3, 4, 4, 4, 4]
    assert {(r["lo"], r["hi"]) for r in got} == {(0, 9)} and [r["p"] for r in got] == [None, *v[:-1]]


def test_shuffles(spark, tmp_path):
    """Of the operators alone: their input lies in a file."""
    rows = [(k, i, float(i % 7)) for k in "abc" for i in range(300)]
    spark.createDataFrame(rows, "k string, pos long, v double").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(k, 0, 299) for k in "abc"], "k string, first long, last long").write.parquet(str(tmp_path / "s"))
    d, spans = (spark.read.parquet(str(tmp_path / x)) for x in "ds")
    jump = F.col("v") > F.col("prev_v")
    assert exchanges(TR.clean_tracks(d, spans, seq(64), ["v"], jump)) <= 3
    assert exchanges(RU.fill_zero_gaps(d, seq(64), "v", 3)) <= 3
    assert exchanges(RU.true_runs(d, seq(64), F.col("v") > 3)) <= 3


def path_data():
    r = np.random.default_rng(8)
    return {"a": r.normal(size=(41, 3)), "b": r.normal(size=(1, 3)), None: r.normal(size=(13, 3))}


@pytest.mark.parametrize("size", [2, 7, 4096])
def test_yaw_integrate_by_a_plain_loop(spark, size):
    want = {}
    for k, v in path_data().items():
        a = x = z = 0.0
        for i, (yaw, vx, vz) in enumerate(v):
            want[k, i] = (a, x, z)
            a += yaw * 0.5
            x, z = x + np.cos(2 * a) * vx - np.sin(2 * a) * vz, z + np.sin(2 * a) * vx + np.cos(2 * a) * vz
    rows = [(k, i, *map(float, r), i) for k, v in path_data().items() for i, r in enumerate(v)]
    d = K.yaw_integrate(spark.createDataFrame(rows, "k string, pos long, yaw double, vx double, vz double, more long"), seq(size), "yaw", "vx", "vz", 0.5)
    assert d.columns == ["k", "pos", "yaw", "vx", "vz", "more", "heading", "x", "z"]
    got = {(r.k, r.pos): (r.heading, r.x, r.z) for r in d.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_yaw_integrate_keeps_null_values_and_orders(spark):
    rows = [("a", None, 1.0, 1.0, 1.0), ("a", 0, None, 1.0, 0.0), ("a", 1, 0.5, None, 2.0), ("a", 5, 0.5, 1.0, 0.0)]
    got = {r.pos: (r.heading, r.x, r.z) for r in K.yaw_integrate(spark.createDataFrame(rows, "k string, pos long, yaw double, vx double, vz double"), seq(2), "yaw", "vx", "vz").collect()}
    t = (np.cos(2) - np.sin(2), np.sin(2) + np.cos(2))  # null orders come first; a null step adds nothing
    u = (t[0] + np.cos(2), t[1] + np.sin(2))
    assert {k: pytest.approx(v) for k, v in got.items()} == {None: (0, 0, 0), 0: (1, *t), 1: (1, *u), 5: (1.5, *u)}


def drift_data():
    r = np.random.default_rng(3)
    return {k: (r.normal(size=(n, 3)), r.normal(size=(n, 4, 3)), r.normal(size=(n, 4))) for k, n in (("a", 50), ("b", 2), (None, 17))}


@pytest.mark.parametrize("size", [3, 12, 4096])
def test_contact_drift_by_a_plain_loop(spark, size):
    sigma, radius = 1.0, 4
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    want, frames, joints = {}, [], []
    for k, (root, j, logit) in drift_data().items():
        p, off = [], np.zeros(3)
        for i in range(len(root)):
            p.append(root[i] - off)
            on = logit[i] > 0
            if i + 1 < len(root) and on.any():
                e = np.exp(logit[i][on])
                off = off + (e[:, None] * (j[i + 1][on] - j[i][on])).sum(0) / e.sum()
        p = np.array(p)
        floor = (j[:, :, 1] + (p[:, 1] - root[:, 1])[:, None]).min()
        flat = [np.convolve(np.pad(p[:, c], radius, mode="edge"), w / w.sum(), "valid") for c in (0, 2)]
        want |= {(k, i): (flat[0][i], p[i, 1] - floor, flat[1][i]) for i in range(len(root))}
        frames += [(k, i, *map(float, root[i])) for i in range(len(root))]
        joints += [(k, i, q, *map(float, j[i, q]), float(logit[i, q])) for i in range(len(root)) for q in range(4)]
    joints.append(("elsewhere", 0, 0, 0.0, -9.0, 0.0, 1.0))  # no frame of that name
    f = spark.createDataFrame(frames, "k string, pos long, x double, y double, z double")
    d = K.contact_drift_correct(f, spark.createDataFrame(joints, "k string, pos long, joint int, jx double, jy double, jz double, logit double"), seq(size), "joint", "logit", sigma)
    got = {(r.k, r.pos): (r.x, r.y, r.z) for r in d.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_integrals_take_few_shuffles(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("pos"), *[F.rand(i).alias(c) for i, c in enumerate(("x", "y", "z", "e"))])
    rows.write.parquet(str(tmp_path / "d"))
    rows = spark.read.parquet(str(tmp_path / "d"))
    assert exchanges(K.yaw_integrate(rows, seq(64), "e", "x", "y")) <= 3
    joints = rows.select("k", "pos", F.lit(0).alias("joint"), *[F.col(c).alias(f"j{c}") for c in "xyz"], "e")
    assert exchanges(K.contact_drift_correct(rows.select("k", "pos", "x", "y", "z"), joints, seq(64), "joint", "e")) <= 5
