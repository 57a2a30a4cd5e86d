import numpy as np
import pandas as pd
import pytest
from collections import Counter
from pyspark.sql import functions as F

from kinetable.operators import kinematics as K
from kinetable.operators import resample as RS
from kinetable.operators import runs as RU
from kinetable.operators import smoothing as SM
from kinetable.operators import tracks as TR
from kinetable.operators.blocks import Seq

SIZES = [25, 4096]


def series(seed, n=60, zeros=0.0):
    r = np.random.default_rng(seed)
    v = r.normal(size=n)
    v[r.random(n) < zeros] = 0.0
    return v


def table(spark, **seqs):
    rows = [(k, i, float(x)) for k, v in seqs.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "k string, pos long, v double")


def col(d, c="v", k="a"):
    p = d.where(F.col("k") == k).toPandas().sort_values("pos")
    return p[c].to_numpy()


def seq(size):
    return Seq(("k",), "pos", size)


@pytest.mark.parametrize("size", SIZES)
def test_gaussian_reflect_and_replicate(spark, size):
    v, short = series(0), series(1, 3)
    for edge, mode in (("reflect", "symmetric"), ("replicate", "edge")):
        d = SM.gaussian_smooth(table(spark, a=v, b=short), seq(size), ["v"], 1.0, edge)
        w = SM.gaussian_weights(1.0, 4)
        for k, x in (("a", v), ("b", short)):
            np.testing.assert_allclose(col(d, k=k), np.convolve(np.pad(x, 4, mode=mode), w, "valid"), atol=1e-12)


def test_smoothing_keeps_constants(spark):
    d = table(spark, a=np.full(40, 2.5))
    for s in (SM.gaussian_smooth(d, seq(8), ["v"], 1.0), SM.moving_average(d, seq(8), ["v"], 5, "replicate")):
        np.testing.assert_allclose(col(s), 2.5)


@pytest.mark.parametrize("w", [4, 5])
def test_moving_average_zero_pad(spark, w):
    v = series(2)
    d = SM.moving_average(table(spark, a=v), seq(16), ["v"], w, "zero")
    np.testing.assert_allclose(col(d), np.convolve(v, np.ones(w) / w, "same"), atol=1e-12)


@pytest.mark.parametrize("size", SIZES)
def test_trailing_mode(spark, size):
    r = np.random.default_rng(3)
    labels = r.integers(0, 3, 50).astype(float)
    d = SM.trailing_mode(table(spark, a=labels), seq(size), "v", 20)
    want = []
    for i in range(50):
        c = Counter(labels[max(0, i - 19) : i + 1])
        want.append(max(c, key=c.get))
    assert col(d, "smoothed").tolist() == want


def islands(v, w):
    out, i = v.copy(), 0
    while i < len(v):
        if v[i] == 0:
            i += 1
            continue
        j = i
        while j < len(v) and v[j] != 0:
            j += 1
        if i > 0 and j < len(v) and j - i < w:
            out[i:j] = 0
        i = j
    return out


@pytest.mark.parametrize("size", [3, 4096])
def test_remove_islands(spark, size):
    v, all_on = series(4, 80, 0.4), series(5, 4)
    d = RU.remove_islands(table(spark, a=v, b=all_on), seq(size), ["v"], 3)
    np.testing.assert_array_equal(col(d), islands(v, 3))
    np.testing.assert_array_equal(col(d, k="b"), all_on)


def ramps(v, w):
    out, n = v.copy(), len(v)
    zero = np.flatnonzero(v == 0)
    for run in np.split(zero, np.flatnonzero(np.diff(zero) > 1) + 1) if len(zero) else []:
        a, b = run[0], run[-1] + 1
        left = v[a - 1] if a > 0 else None
        right = v[b] if b < n else None
        gap = b - a
        if left is not None and right is not None and gap <= w:
            out[a:b] = np.interp(np.arange(1, gap + 1), [0, gap + 1], [left, right])
        else:
            k = min(gap, w)
            if left is not None:
                out[a : a + k] = left * (1 - np.arange(1, k + 1) / k)
            if right is not None:
                out[b - k : b] = right * np.arange(k) / k
    return out


@pytest.mark.parametrize("size", [4, 4096])
def test_fill_zero_gaps(spark, size):
    v = series(6, 90, 0.6)
    d = RU.fill_zero_gaps(table(spark, a=v, b=np.zeros(5)), seq(size), "v", 3)
    np.testing.assert_allclose(col(d), ramps(v, 3), atol=1e-12)
    np.testing.assert_array_equal(col(d, k="b"), np.zeros(5))


def trim(flags, gap):
    n, start, stop = len(flags), 0, len(flags)

    def prefix(f):
        if not f[0]:
            return 0
        clean = 0
        for i, x in enumerate(f):
            clean = 0 if x else clean + 1
            if clean > gap:
                return i - clean + 1
        return n

    start = prefix(flags)
    stop = n - prefix(flags[::-1])
    start = min(start + gap // 2, n) if start else 0
    stop = max(stop - gap // 2, 0) if stop != n else n
    return (start, stop) if stop > start else None


@pytest.mark.parametrize("seed", range(4))
def test_trim_flagged(spark, seed):
    r = np.random.default_rng(seed)
    cases = {f"c{i}": (r.random(40) < (0.1, 0.3, 0.6, 1.0)[i % 4]).astype(float) for i in range(12)}
    cases["inner"] = np.array([0, 1, 1, 0, 0, 0.0])
    got = {r["k"]: (r["start"], r["stop"]) for r in RU.trim_flagged(table(spark, **cases), seq(6), F.col("v") > 0, 4).collect()}
    assert got == {k: t for k, f in cases.items() if (t := trim(f > 0, 4))}


@pytest.mark.parametrize("size", SIZES)
def test_gradient_and_differences(spark, size):
    v = series(7)
    d = K.gradient(table(spark, a=v), seq(size), ["v"], 3, 0.5)
    want = v
    for _ in range(3):
        want = np.gradient(want, 0.5)
    np.testing.assert_allclose(col(d, "g_v"), want, atol=1e-9)
    np.testing.assert_allclose(col(K.finite_diff(table(spark, a=v), seq(size), ["v"], 2, 10.0), "d_v"), np.diff(v, 2) * 100, atol=1e-9)


def test_interpolate_and_track_gate(spark):
    rows = [("a", i, float(i * i)) for i in (2, 3, 7, 8, 30)] + [("b", i, 1.0) for i in (0, 1)]
    obs = spark.createDataFrame(rows, "k string, pos long, v double")
    spans = spark.createDataFrame([("a", 0, 39), ("b", 0, 39)], "k string, first long, last long")
    dense = RS.densify(obs, seq(6), spans)
    d = RS.interpolate_gaps(dense, seq(6), ["v"])
    np.testing.assert_allclose(col(d), np.interp(np.arange(40), [2, 3, 7, 8, 30], [4, 9, 49, 64, 900]))
    kept = TR.track_gate(dense, seq(6), F.col("v").isNotNull(), 25, 20).collect()
    assert [r["k"] for r in kept] == ["a"]


def test_asof(spark):
    t, v = np.array([0.0, 1.0, 2.5, 4.0]), np.array([1.0, 3.0, -1.0, 5.0])
    q = np.array([-1.0, 0.0, 0.4, 0.5, 0.6, 1.0, 1.75, 3.9, 4.0, 6.0])
    src = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate(zip(t, v))], "k string, pos long, t double, v double")
    dst = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(q)], "k string, pos long, t double")
    near = col(RS.asof_nearest(src.drop("pos"), dst, ["k"], "t", ["v"], 1.5))
    right = np.clip(np.searchsorted(t, q), 0, 3)
    left = np.clip(right - 1, 0, 3)
    pick = np.where(np.abs(q - t[left]) <= np.abs(t[right] - q), left, right)
    np.testing.assert_array_equal(near, v[pick])
    lin = col(RS.asof_linear(src, dst, Seq(("k",), "pos", 2), "t", ["v"], 1.5))
    want = np.interp(q, t, v)
    want[0], want[-1] = 1 + 2 * -1, 5 + 4 * 2
    np.testing.assert_allclose(lin, want)


def test_resampling_to_the_same_rate_is_identity(spark):
    v = series(8, 20)
    src = table(spark, a=v).withColumn("t", F.col("pos") / 30.0)
    g = RS.target_grid(src.groupBy("k").agg(F.max("t").alias("last")), ["k"], "last", 30.0).withColumnRenamed("i", "pos")
    np.testing.assert_allclose(col(RS.asof_linear(src, g, seq(7), "t", ["v"], 0.2)), v, atol=1e-9)


def test_camera_drift(spark):
    """Off by 0.3: pulled 0.02 per frame until within 0.25; y is grounded."""
    n = 6
    rows = [("a", i, 0.3, 1.0, 0.0, 0.3, 1.0, 0.0, 0.0, 1.0, 0.0, [0.3, 1.0, 0.0] * 6, [-9.0] * 6, 0.2) for i in range(n)]
    d = spark.createDataFrame(rows, "k string, pos long, x double, y double, z double, rx double, ry double, rz double, cx double, cy double, cz double, static_points array<double>, static_logits array<double>, low double")
    out = K.camera_drift_correct(d, seq(4))
    np.testing.assert_allclose(col(out, "x"), 0.3 - np.minimum(np.arange(n) * 0.02, 0.06), atol=1e-9)
    np.testing.assert_allclose(col(out, "y"), 0.8)


def test_local_velocity_heights(spark):
    r = np.random.default_rng(9)
    q = r.normal(size=(12, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    p = r.normal(size=(12, 3))
    d = spark.createDataFrame([("a", i, p[i].tolist(), q[i].tolist()) for i in range(12)], "k string, pos long, p array<double>, q array<double>")
    for height in ("velocity", "cumulative", "absolute"):
        e = K.local_velocity(d, seq(5), "p", "q", True, height)
        out = K.integrate_local_velocity(e, seq(5), "local_vel", "q", True, height)
        got = np.stack(col(out, "rolled"))
        want = p - p[0]
        if height == "absolute":
            want[:, 1] = p[:, 1]
        np.testing.assert_allclose(got, want, atol=1e-9)


def pulled_by_rows(rows, joints, far=0.25, step=0.02):
    """Frame by frame, with the offset counted in steps."""
    k, held, last, frozen, out = np.zeros(3, int), np.zeros(3), None, None, []
    for r in rows:
        pts = np.array(r["static_points"]).reshape(joints, 3)
        on = 1 / (1 + np.exp(-np.array(r["static_logits"]))) > 0.8
        if last is not None:
            e = np.array([r["rx"], r["ry"], r["rz"]]) - np.array([r["cx"], r["cy"], r["cz"]])
            k = k + np.where(k <= np.floor((e - far) / step), 1, np.where(k >= np.ceil((e + far) / step), -1, 0))
        here = pts - k * step
        if last is not None:
            held = held + ((here - last) * frozen[:, None]).sum(0) / max(1, frozen.sum()) * np.array([1.0, 0.0, 1.0])
        last, frozen = here, on
        out.append((*(np.array([r["x"], r["y"], r["z"]]) - k * step - held), r["low"] - k[1] * step))
    out = np.array(out)
    out[:, 1] -= out[:, 3].min()
    return out[:, :3]


@pytest.mark.parametrize("size", [7, 64, 3840])
def test_camera_drift_in_blocks_is_the_row_loop(spark, size):
    rng = np.random.default_rng(size)
    rows = []
    for clip, n in ((1, 400), (2, 1), (None, 90)):
        drift = np.cumsum(rng.normal(0, 0.08, (n, 3)), axis=0)
        for i in range(n):
            p = rng.normal(0, 1, 3)
            rows.append({"clip": clip, "pos": i, **dict(zip("xyz", p.tolist())), **dict(zip(("rx", "ry", "rz"), (p + drift[i]).tolist())), **dict(zip(("cx", "cy", "cz"), p.tolist())),
                         "static_points": rng.normal(0, 1, 6).tolist(), "static_logits": rng.normal(1, 2, 2).tolist(), "low": float(p[1] - 1)})
    kind = "clip long, pos long, x double, y double, z double, rx double, ry double, rz double, cx double, cy double, cz double, static_points array<double>, static_logits array<double>, low double"
    df = spark.createDataFrame([tuple(r.values()) for r in rng.permutation(np.array(rows, object)).tolist()], kind)
    out = K.camera_drift_correct(df, Seq(("clip",), "pos", size), 2)
    assert sorted(out.columns) == ["clip", "pos", "x", "y", "z"]
    got = {(r.clip, r.pos): (r.x, r.y, r.z) for r in out.collect()}
    assert len(got) == len(rows)
    for clip in (1, 2, None):
        own = [r for r in rows if r["clip"] == clip]
        np.testing.assert_allclose([got[clip, r["pos"]] for r in own], pulled_by_rows(own, 2), atol=1e-9)


def test_pull_maps_every_offset():
    rng = np.random.default_rng(5)
    for _ in range(50):
        pull, frames = K.Pull(), []
        for _ in range(int(rng.integers(0, 60))):
            a = int(rng.integers(-20, 20))
            frames.append((a, a + int(rng.integers(2, 12))))
            pull.add(*frames[-1])
        for k in range(-90, 91):
            now = k
            for a, b in frames:
                now += 1 if now <= a else -1 if now >= b else 0
            assert pull(k) == now
