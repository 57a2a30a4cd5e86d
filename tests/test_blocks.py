"""Blocked windows must equal plain ones whatever the block size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetable.operators.blocks import Seq, grid, neighbors, number_rows, scan, with_runs


def frame(seed=0, n=200, keys=3):
    r = np.random.default_rng(seed)
    p = np.array([0.75, *([0.25 / (keys - 1)] * (keys - 1))])  # one hot key
    k = r.choice(keys, n, p=p)
    return pd.DataFrame({"k": k, "t": np.arange(n) * 3 + r.integers(0, 3, n), "v": r.integers(0, 4, n).astype(float)})


def numbered(pdf):
    pdf = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    pdf["pos"] = pdf.groupby("k").cumcount()
    return pdf


@pytest.mark.parametrize("width", [5, 40, 10_000])
def test_number_rows(spark, width):
    pdf = frame()
    d = number_rows(spark.createDataFrame(pdf), ["k"], ["t"], F.floor(F.col("t") / width))
    got = d.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    assert got["pos"].tolist() == numbered(pdf)["pos"].tolist()


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_neighbors(spark, size):
    pdf = numbered(frame(1))
    d = neighbors(
        spark.createDataFrame(pdf), Seq(("k",), "pos", size), 3, 2,
        {"a": lambda w: F.lag("v", 3).over(w), "b": lambda w: F.lead("v", 2).over(w), "s": lambda w: F.sum("v").over(w.rowsBetween(-2, 1))},
    )
    got = d.toPandas().sort_values(["k", "pos"]).reset_index(drop=True)
    g = pdf.groupby("k")["v"]
    pd.testing.assert_series_equal(got["a"], g.shift(3), check_names=False)
    pd.testing.assert_series_equal(got["b"], g.shift(-2), check_names=False)
    want = pdf.groupby("k")["v"].transform(lambda x: sum(x.shift(i).fillna(0) for i in (-1, 0, 1, 2)))
    np.testing.assert_allclose(got["s"], want)


@pytest.mark.parametrize("limit", [5, 1000])
def test_fit_bucket(spark, limit):
    from kinetable.operators.blocks import fit_bucket

    pdf = frame(4)
    d = spark.createDataFrame(pdf)
    b = fit_bucket(d, ["k"], F.col("t"), limit)
    assert (d.select(b.alias("b")).distinct().count() > 20) == (limit == 5)
    got = number_rows(d, ["k"], ["t"], b).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    assert got["pos"].tolist() == numbered(pdf)["pos"].tolist()


def test_neighbors_refuses_too_long_reach(spark):
    with pytest.raises(ValueError):
        neighbors(spark.createDataFrame(numbered(frame())), Seq(("k",), "pos", 4), 5, 0, {})


@pytest.mark.parametrize("size", [2, 9, 1000])
def test_scan(spark, size):
    pdf = numbered(frame(2))
    some = F.when(F.col("v") == 0, F.col("pos"))
    d = scan(spark.createDataFrame(pdf), Seq(("k",), "pos", size), sums={"s": F.col("v")}, shifted_sums={"z": F.col("v")}, last={"l": some}, next={"n": some})
    got = d.toPandas().sort_values(["k", "pos"]).reset_index(drop=True)
    c = pdf.groupby("k")["v"].cumsum()
    np.testing.assert_allclose(got["s"], c)
    np.testing.assert_allclose(got["z"], c - pdf["v"])
    mark = pdf["pos"].where(pdf["v"] == 0)
    np.testing.assert_array_equal(got["l"].to_numpy(float), mark.groupby(pdf["k"]).ffill().to_numpy())
    np.testing.assert_array_equal(got["n"].to_numpy(float), mark.groupby(pdf["k"]).bfill().to_numpy())


@pytest.mark.parametrize("size", [2, 5, 1000])
def test_runs(spark, size):
    pdf = numbered(frame(3))
    got = with_runs(spark.createDataFrame(pdf), Seq(("k",), "pos", size), F.col("v") > 1).toPandas().sort_values(["k", "pos"])
    for _, g in got.groupby("k"):
        on = (g["v"] > 1).to_numpy()
        i = 0
        while i < len(on):
            j = i
            while j + 1 < len(on) and on[j + 1] == on[i]:
                j += 1
            part = g.iloc[i : j + 1]
            assert set(part["run_start"]) == {i} and set(part["run_end"]) == {j}
            assert set(part["touches_start"]) == {i == 0} and set(part["touches_end"]) == {j == len(on) - 1}
            i = j + 1


def test_grid(spark):
    d = spark.createDataFrame([(1, 0, 10), (2, 5, 5), (3, 4, 3)], "k int, a long, z long")
    got = grid(d, ["k"], F.col("a"), F.col("z"), "i", size=4).toPandas()
    assert sorted(got[got.k == 1]["i"]) == list(range(11))
    assert got[got.k == 2]["i"].tolist() == [5]
    assert not len(got[got.k == 3])


def test_scan_reads_each_row_once(spark):
    """A frame up to the last row is read anew for every row: quadratic in a block, with the whole value each time."""
    d = spark.createDataFrame(numbered(frame())).withColumn("x", F.when(F.col("v") > 1, F.col("pos") * 10 + F.col("v")))
    out = scan(d, Seq(("k",), "pos", 50), last={"before": F.col("x")}, next={"after": F.col("x")})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()
    shuffled = [x for x in plan.splitlines() if "RepartitionByExpression" in x]
    assert shuffled and "_i_" not in plan[plan.index(shuffled[0]):].split("Aggregate")[0]  # the value is sent once
    got = out.toPandas().sort_values(["k", "pos"])
    known = got["x"].groupby(got["k"])
    np.testing.assert_array_equal(got["after"], known.bfill())
    np.testing.assert_array_equal(got["before"], known.ffill())


def test_scan_takes_the_next_of_equal_places_in_their_order(spark):
    rows = [("a", 0, None), ("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, None), (None, None, 5.0), (None, 3, None), (None, 4, 6.0)]
    d = spark.createDataFrame(rows, "k string, pos long, v double").coalesce(1)
    got = {(r.k, r.pos, r.v): r.after for r in scan(d, Seq(("k",), "pos", 2), next={"after": F.col("v")}).collect()}
    assert got[("a", 1, 1.0)] == 1.0 and got[("a", 1, 2.0)] == 2.0 and got[("a", 2, None)] is None
    assert got[("a", 0, None)] in (1.0, 2.0)
    assert got[(None, None, 5.0)] == 5.0 and got[(None, 3, None)] == 6.0
