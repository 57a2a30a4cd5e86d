import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.functions import vectors as V
from kinetable.operators import budget as BU
from kinetable.operators import stats as ST
from kinetable.operators import vector_metrics as VM
from kinetable.operators.percentiles import percentiles


def vecs(spark, n=200, d=5, seed=0, shift=0.0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) @ r.normal(size=(d, d)) + shift
    return spark.createDataFrame([(i, i % 4, x[i].tolist()) for i in range(n)], "id long, label int, v array<double>").repartition(7), x


def test_stats_and_covariance(spark):
    df, x = vecs(spark, shift=1000.0)
    st = VM.feature_stats(df, "v").toPandas().sort_values("dim")
    np.testing.assert_allclose(st["mean"], x.mean(0))
    np.testing.assert_allclose(st["std"], x.std(0), rtol=1e-6)
    c = np.cov(x, rowvar=False)
    for r in VM.activation_stats(df, "v").collect():
        assert abs(r["cov"] - c[r["i"], r["j"]]) < 1e-9


def test_frechet(spark):
    df, x = vecs(spark)
    assert abs(VM.frechet_distance(df, df, "v").first()[0]) < 1e-8
    moved = df.withColumn("v", F.transform("v", lambda a: a + 2.0))
    assert abs(VM.frechet_distance(df, moved, "v").first()[0] - 4.0 * 5) < 1e-8
    twice = df.withColumn("v", F.transform("v", lambda a: a * 2.0))
    want = (x.mean(0) ** 2).sum() + np.trace(np.cov(x, rowvar=False))
    assert abs(VM.frechet_distance(df, twice, "v").first()[0] - want) < 1e-8


def test_r_precision_of_identical_vectors_is_one(spark):
    df, _ = vecs(spark, 100)
    d = VM.make_pools(df, "id", 32)
    row = VM.r_precision(d, d, "id", "v", "v", "pool", 3).first()
    assert tuple(row) == (1.0, 1.0, 1.0)
    assert d.groupBy("pool").count().agg(F.max("count")).first()[0] == 32


def test_kernel_distance_is_near_zero_for_one_source(spark):
    df, _ = vecs(spark, 400)
    d = VM.kernel_distance(df, df, "id", "v", subsets=2, size=100, seed=3)
    assert d.count() == 2


def test_kernel_distance_draws_each_subset_from_all_rows(spark):
    df, _ = vecs(spark, 25)
    shifted = df.withColumn("v", F.transform("v", lambda x: x + 3))
    got = VM.kernel_distance(df, shifted, "id", "v", subsets=5, size=10, seed=3).collect()
    assert sorted(r["subset"] for r in got) == list(range(5)) and all(r["mmd2"] > 0.5 for r in got)
    one = df.where("id = 0")
    few = VM.kernel_distance(one, one, "id", "v", subsets=2, size=10).collect()
    assert [r["mmd2"] for r in few] == [None, None]


def test_kernel_subsets_by_plain_loops(spark):
    """The sketch takes the rows of smallest key, ties by id; the SQL of the query checks the variance."""
    r = np.random.default_rng(4)
    a, b = r.normal(size=(23, 5)), r.normal(size=(31, 5)) + 0.3
    make = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(7)
    got = VM.kernel_distance(make(a), make(b), "id", "v", subsets=3, size=9, key=lambda s: (F.col("id") * 5 + s * 3) % 8).collect()
    for row in got:
        own = [sorted(range(len(x)), key=lambda i: ((i * 5 + row.subset * 3) % 8, i))[:9] for x in (a, b)]
        x, y = a[own[0]], b[own[1]]
        kern = lambda p, q: (p @ q / 5 + 1) ** 3
        mixed = [kern(x[i], y[j]) for i in range(9) for j in range(9)]
        inner = lambda p: sum(kern(p[i], p[j]) for i in range(9) for j in range(9) if i != j) / 72
        assert row.mmd2 == pytest.approx(inner(x) + inner(y) - 2 * np.mean(mixed))
        assert row.variance is not None and np.isfinite(row.variance)
    assert [r.subset for r in sorted(got)] == [0, 1, 2]
    uneven = VM.kernel_distance(make(a[:4]), make(b), "id", "v", subsets=1, size=9).first()
    assert uneven.mmd2 is not None and uneven.variance is None


def test_pca_matches_numpy(spark):
    df, x = vecs(spark)
    got = np.stack([r["pc"] for r in VM.pca(df, "v", 2).orderBy("id").collect()])
    w, v = np.linalg.eigh(np.cov(x, rowvar=False))
    want = (x - x.mean(0)) @ v[:, ::-1][:, :2]
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_standard_scale_of_constant_dimension(spark):
    d = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id long, v array<double>")
    assert [r["v"] for r in VM.standard_scale(d, "v").orderBy("id").collect()] == [[-1.0, 0.0], [1.0, 0.0]]


@pytest.mark.parametrize("blocks", [4, 64])
def test_percentiles_exact_with_ties_and_skew(spark, blocks):
    r = np.random.default_rng(5)
    rows = [("hot", float(round(v, 1))) for v in r.normal(size=900)] + [("same", 7.0)] * 50 + [("one", 3.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    ps = {"lo": 0.0, "q1": 0.25, "m": 0.5, "p99": 0.99, "hi": 1.0}
    got = {x["k"]: x for x in percentiles(df, ["k"], "v", ps, blocks).collect()}
    for k in ("hot", "same", "one", "two"):
        v = [b for a, b in rows if a == k]
        for n, p in ps.items():
            assert abs(got[k][n] - np.quantile(v, p)) < 1e-9


def test_split_is_exact_seeded_and_keeps_groups(spark):
    df = spark.range(100).select("id", F.floor(F.col("id") / 2).alias("g"))
    s = BU.split(df, ["id"], seed=4)
    n = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert n == {"test": 15, "val": 5, "train": 80}
    assert s.exceptAll(BU.split(df.repartition(5), ["id"], seed=4)).count() == 0
    g = BU.split(df, ["id"], seed=4, group=["g"])
    assert g.groupBy("g").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0] == 1


def test_budget_reserve_and_weights(spark):
    d = spark.createDataFrame([(i, 10.0) for i in range(10)], "o long, d double")
    got = BU.duration_budget(d, "o", "d", 35.0, spent=10.0).orderBy("o").collect()
    assert [r["granted"] for r in got] == [10.0, 10.0, 5.0]
    a = spark.createDataFrame([("f", i) for i in range(5)] + [("g", 9)], "folder string, i long")
    s = spark.createDataFrame([("f", 2), ("g", 0)], "folder string, free int")
    assert BU.reserve(a, s, "folder", "i", 5).count() == 2
    free = spark.createDataFrame([("f", 8), ("g", 0)], "folder string, free int")
    assert BU.reserve(a, free, "folder", "i", 50).count() == 5
    assert abs(BU.sampling_weights(d, "d").agg(F.sum("weight")).first()[0] - 1) < 1e-12
    assert BU.subsample(d, ["o"], 0.01).count() == 1


def test_binned_counts_keep_empty_bins(spark):
    d = spark.createDataFrame([(1,), (2,), (3,), (9,)], "n int")
    got = ST.binned_counts(d, "n", [0, 1, 3, 5], ["1", "2-3", "4-5"]).orderBy("bin").collect()
    assert [r["n"] for r in got] == [1, 2, 0]


def test_histogram_matches_numpy(spark):
    v = np.random.default_rng(0).normal(size=300)
    d = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = [r["n"] for r in ST.histogram(d, "v", 10).orderBy("bin").collect()]
    assert got == np.histogram(v, 10)[0].tolist()
    dens = [r["density"] for r in ST.histogram(d, "v", 10, True).orderBy("bin").collect()]
    np.testing.assert_allclose(dens, np.histogram(v, 10, density=True)[0])


def test_codebook_step_reseeds_unused_codes(spark):
    st = spark.createDataFrame([(0, [1.0], 1.0), (1, [4.0], 0.5)], "code int, code_sum array<double>, code_count double")
    x = spark.createDataFrame([(0, [3.0]), (0, [5.0])], "code int, v array<double>")
    fresh = spark.createDataFrame([(0, [-1.0]), (1, [-2.0])], "code int, seed_vec array<double>")
    got = {r["code"]: r["value"] for r in VM.codebook_ema_step(x, st, "v", 0.5, fresh).collect()}
    assert got == {0: 4.5 / 1.5, 1: -2.0}


def test_vector_functions(spark):
    d = spark.createDataFrame([([3.0, 4.0], None)], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    r = d.select(
        V.cosine_distance(a, b).alias("c"), V.l2_normalize(a).alias("n"), V.fit_dim(a, 3).alias("f"), V.fit_dim(a, 1).alias("g"),
        V.argmax_label(a, ["x", "y"]).alias("l"), V.softmax(a).alias("s"),
    ).first()
    assert r["c"] == 1.0 and r["f"] == [3.0, 4.0, 0.0] and r["g"] == [3.0] and r["l"] == "y"
    np.testing.assert_allclose(r["n"], [0.6, 0.8])
    assert abs(sum(r["s"]) - 1) < 1e-12


def test_metric_set(spark):
    ms = VM.MetricSet().add("m", lambda a: F.avg(a), 2.0, ("x",)).add("n", lambda a: F.max(a), 1.0, ("y",))
    d = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    with pytest.raises(ValueError):
        ms.compute(d)
    ms.activate("n", False)
    row = ms.record(ms.compute(d))
    assert row == {"m": 2.0, "m_weighted": 4.0, "total": 4.0} and ms.history["total"] == [4.0]


def test_reconstruction_report_by_plain_loops(spark):
    r = np.random.default_rng(8)
    n, runs, size = 75, 3, 8
    real = r.normal(size=(n, 4))
    pred, cond = real + r.normal(size=(n, 4)), real + 0.4 * r.normal(size=(n, 4))
    pred[10] = pred[11] = pred[12]  # ties go to the lower id
    df = spark.createDataFrame([(i, *(v[i].tolist() for v in (real, pred, cond))) for i in range(n)] + [(n, None, [0.0] * 4, [0.0] * 4)],
                               "id long, t array<double>, p array<double>, c array<double>")
    key = lambda m, p: (lambda run: (F.col("id") * m + run * 31) % p)
    plain = lambda m, p, run: sorted(range(n), key=lambda i: ((i * m + run * 31) % p, i))
    want = {}
    for run in range(runs):
        order = plain(17, 101, run)
        pools = [sorted(order[a : a + size]) for a in range(0, n, size)]
        for kind, x in (("real", real), ("pred", pred)):
            ranks = []
            for pool in pools:
                for i in pool:
                    near = sorted(pool, key=lambda j: (np.sqrt(((cond[i] - x[j]) ** 2).sum()), j))
                    ranks.append(near.index(i))
            for k in (1, 2, 3):
                want.setdefault(f"r_precision_{k}_{kind}", []).append(np.mean([a < k for a in ranks]))
            want.setdefault(f"matching_{kind}", []).append(np.sqrt(((cond - x) ** 2).sum(1)).mean())
            a, b = plain(23, 103, run)[:20], plain(29, 107, run)[:20]
            want.setdefault(f"diversity_{kind}", []).append(np.sqrt(((x[a] - x[b]) ** 2).sum(1)).mean())
    d = VM.reconstruction_report(df, "id", "t", "p", "c", size, 20, runs, order=(key(17, 101), lambda run: F.floor(key(17, 101)(run) / 9)),
                                 draws=(key(23, 103), key(29, 107)))
    got = {x["metric"]: (x["mean"], x["ci"]) for x in d.collect()}
    assert got.pop("frechet")[1] == 0 and set(got) == set(want)
    for m, v in want.items():
        np.testing.assert_allclose(got[m], (np.mean(v), 1.96 * np.std(v) / np.sqrt(runs)), atol=1e-9)
    assert got["r_precision_1_real"][1] > 0 and got["diversity_pred"][1] > 0
    alone = {x["metric"] for x in VM.reconstruction_report(df, "id", "t", "p", pool_size=size, n=20, runs=2).collect()}
    assert alone == {"frechet", "matching_pred", "diversity_real", "diversity_pred", *(f"r_precision_{k}_pred" for k in (1, 2, 3))}
    empty = VM.reconstruction_report(df.limit(0), "id", "t", "p", "c", frechet=False)
    assert empty.count() == 0


def test_pools_are_dealt_by_many_tasks(spark):
    d = spark.range(0, 40_000, 1, 4).select((F.col("id") + 20_000).alias("id"))
    got = VM.make_pools(d, "id", 32)
    assert got.where(F.col("pool") != F.floor((F.col("id") - 20_000) / 32)).count() == 0
    blocks = d.select(F.floor(F.col("id") / VM.POOL_BLOCK)).distinct().count()
    assert blocks > 1  # no task has to sort all rows
