import itertools
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.operators import joins as J
from kinetable.operators import knn as N


def points(spark, n, d, seed, pools=1):
    r = np.random.default_rng(seed)
    x = r.integers(0, 4, (n, d)).astype(float)  # many equal distances
    pool = np.where(r.random(n) < 0.6, 0, r.integers(0, pools, n))
    df = spark.createDataFrame([(i, int(pool[i]), x[i].tolist()) for i in range(n)], "id long, pool int, v array<double>")
    return df, x, pool


@pytest.mark.parametrize("plan", ["points", "queries", "cells"])
def test_knn_equals_brute_force(spark, plan):
    q, qx, qp = points(spark, 60, 3, 0, 3)
    x, xx, xp = points(spark, 150, 3, 1, 3)
    got = N.knn(q, x, 5, "id", "v", "id", "v", ("pool", "pool"), plan=plan, block=16, pivots=7).collect()
    by = {}
    for r in got:
        by.setdefault(r["qid"], {})[r["rank"]] = (r["pid"], r["distance"])
    for i in range(60):
        d = np.sqrt(((xx - qx[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(150), d)) if xp[j] == qp[i]][:5]
        assert [by[i][k + 1][0] for k in range(len(order))] == order
        np.testing.assert_allclose([by[i][k + 1][1] for k in range(len(order))], d[order])


def test_cells_plan_sends_vectors_once_per_block(spark):
    q, _, _ = points(spark, 64, 3, 4)
    d = N.knn(q, q, 2, "id", "v", "id", "v", plan="cells", block=64, pivots=16)
    assert {(r.qid, r.rank): r.pid for r in d.collect()} == {(r.qid, r.rank): r.pid for r in N.knn(q, q, 2, "id", "v", "id", "v").collect()}
    rows = re.search(r"FlatMapCoGroupsInPandas.*", d._jdf.queryExecution().optimizedPlan().toString())
    assert rows and "pack#" in rows.group() and "cell#" not in rows.group()  # one group for all cells that fit into a block


def test_top_k_of_many_equal_vectors_stays_small():
    x = np.ones((3000, 64))
    tracemalloc.start()
    r, i, d = N.top_k(x[:600], x, np.arange(3000), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert i.reshape(600, 3).tolist() == [[0, 1, 2]] * 600 and not d.any()
    assert peak < 500e6  # 1.8 million candidates with their vectors are 1.8 GB


def test_knn_fewer_points_than_k(spark):
    q, _, _ = points(spark, 4, 2, 2)
    x, _, _ = points(spark, 3, 2, 3)
    for plan in ("points", "queries", "cells"):
        assert N.knn(q, x, 10, "id", "v", "id", "v", plan=plan).count() == 12


def test_snap_and_vq_ties(spark):
    book = spark.createDataFrame([(1, [0.0, 0.0]), (0, [2.0, 0.0])], "code int, vec array<double>")
    p = spark.createDataFrame([(7, [1.0, 0.0]), (8, [9.0, 0.0])], "id long, v array<double>")
    assert {r["id"]: r["code"] for r in N.vq_assign(p, book, "id", "v").collect()} == {7: 0, 8: 0}
    s = N.snap(p, book.withColumnRenamed("code", "c"), 1.5, "id", "v", "c", "vec")
    assert {r["qid"]: r["pid"] for r in s.collect()} == {7: 0, 8: None}


def test_rvq_and_decode(spark):
    book = spark.createDataFrame(
        [(0, 0, [0.0, 0.0]), (0, 1, [4.0, 4.0]), (1, 0, [0.0, 0.0]), (1, 1, [1.0, 0.0])], "layer int, code int, vec array<double>"
    )
    p = spark.createDataFrame([(1, [5.1, 4.0]), (2, [0.1, 0.0])], "id long, v array<double>")
    codes = N.rvq_assign(p, book, 2, "id", "v")
    assert {(r["id"], r["layer"]): r["code"] for r in codes.collect()} == {(1, 0): 1, (1, 1): 1, (2, 0): 0, (2, 1): 0}
    gone = codes.withColumn("code", F.when(F.col("id") == 1, F.col("code")))
    got = {r["id"]: r["vec"] for r in N.vq_decode(gone, book, ["id"], 2).collect()}
    assert got == {1: [5.0, 4.0], 2: [0.0, 0.0]}


@pytest.mark.parametrize("shape", [(1, 1), (2, 5), (5, 2), (4, 4), (6, 7), (7, 6)])
def test_assignment_is_optimal(shape):
    r = np.random.default_rng(sum(shape))
    i, j = (x.ravel() for x in np.indices(shape))
    for _ in range(20):
        c = r.integers(-4, 9, shape).astype(float)
        k = J.solve_assignment(i, j, c.ravel())
        assert len(set(i[k])) == len(set(j[k])) == len(k) == min(shape)
        m = c if shape[0] <= shape[1] else c.T
        best = min(m[range(m.shape[0]), list(p)].sum() for p in itertools.permutations(range(m.shape[1]), m.shape[0]))
        assert c.ravel()[k].sum() == best


def test_sparse_assignment_is_the_cheapest_of_the_largest():
    r = np.random.default_rng(5)
    for _ in range(150):
        n, m = r.integers(1, 6, 2)
        i, j = np.nonzero(r.random((n, m)) < 0.5)
        c = r.integers(0, 9, len(i)).astype(float)
        k = J.solve_assignment(i, j, c)
        assert len(set(i[k])) == len(set(j[k])) == len(k)
        fits = [s for n_ in range(len(i) + 1) for s in itertools.combinations(range(len(i)), n_) if n_ <= 5 and len(set(i[list(s)])) == len(set(j[list(s)])) == n_]
        assert (-len(k), c[k].sum()) == min((-len(s), c[list(s)].sum()) for s in fits)


def test_assignment_follows_the_pairs():
    n = 30_000  # a dense matrix of this many persons would not fit
    i = np.concatenate([np.arange(n), np.arange(n - 1)])
    j = np.concatenate([np.arange(n), np.arange(1, n)])
    k = J.solve_assignment(i, j, np.concatenate([np.full(n, 2.0), np.full(n - 1, 1.0)]))
    assert len(k) == n and set(k) == set(range(n))


def test_assign_groups_and_cutoff(spark):
    rows = [("s", 0, 0, 1.0), ("s", 0, 1, 2.0), ("s", 1, 0, 1.5), ("s", 1, 1, 9.0), ("t", 5, 6, 3.0)]
    d = spark.createDataFrame(rows, "scene string, face int, body int, cost double")
    got = {(r["scene"], r["face"], r["body"]) for r in J.assign_min_cost(d, ["scene"], "face", "body").collect()}
    assert got == {("s", 0, 1), ("s", 1, 0), ("t", 5, 6)}
    got = {(r["scene"], r["face"], r["body"]) for r in J.assign_min_cost(d, ["scene"], "face", "body", cutoff=2.0).collect()}
    assert got == {("s", 1, 0)}


def test_not_treated_and_quarantine(spark):
    c = spark.createDataFrame([("1", "A | b"), ("2", "new"), ("3", "other")], "id string, title string")
    s = spark.createDataFrame([("3", None), (None, "a  B")], "id string, title string")
    assert [r["id"] for r in J.not_treated(c, s, "id", "title").orderBy("id").collect()] == ["2"]
    good, bad = J.quarantine(c, {"no_title": F.col("title").isNull(), "new": F.col("title") == "new"})
    assert good.count() == 2 and [r["reason"] for r in bad.collect()] == ["new"]


def test_vip_precedence(spark):
    w = spark.createDataFrame([("left", "ADJ"), ("walk", "VERB"), ("zzz", "NOUN")], "word string, pos string")
    v = spark.createDataFrame([("left", "Loc_VIP", 0), ("left", "Desc_VIP", 4)], "word string, class string, rank int")
    k = spark.createDataFrame([("walk",)], "word string")
    assert {r["word"]: r["class"] for r in J.vip_tag(w, v, "word", "pos", k).collect()} == {"left": "Loc_VIP", "walk": "VERB", "zzz": "OTHER"}


def test_sequence_udf_streams_chunks_in_order(spark):
    import pandas as pd

    d = spark.range(5000).select((F.col("id") % 3).alias("k"), (5000 - F.col("id")).alias("t"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:

        def fn(parts):
            last, n, k, chunks = -1, 0, None, 0
            for p in parts:
                assert p["t"].is_monotonic_increasing and p["t"].iloc[0] > last
                last, n, k, chunks = p["t"].iloc[-1], n + len(p), p["k"].iloc[0], chunks + 1
            yield pd.DataFrame({"k": [k], "n": [n], "chunks": [chunks]})

        got = J.sequence_udf(d, ["k"], "t", fn, "k long, n long, chunks long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(r["n"] for r in got) == [1666, 1667, 1667] and all(r["chunks"] > 10 for r in got)
