"""Selection against sorting, and splits and samples against the ranked form."""

import random

import pytest
from pyspark.sql import functions as F

from kinetable.operators import budget as BU
from kinetable.operators import selection as S


def keyed(r):
    return tuple((v is not None, v) if v is not None else (False, 0) for v in r)


@pytest.mark.parametrize("few", [10_000, 3])
def test_cut_at_is_the_sorted_row(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "BITS", 3)
    rng = random.Random(few)
    rows = [(rng.choice([None, -(2**63), 2**63 - 1, 0, 5, rng.getrandbits(40)]), rng.choice([1, 2, None]), rng.choice("abc")) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b int, s string").cache()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2]))
    for rank in (0, 1, 57, 120, 199):
        cut = S.cut_at(df, ["a", "b", "s"], rank)
        assert cut.values == want[rank]
        assert cut.equal == want.count(want[rank]) and cut.before == rank - want.index(want[rank])
        assert df.filter(cut.above()).count() == want.index(want[rank]) and df.filter(cut.here()).count() == cut.equal
    assert S.cut_at(df, ["a"], 200) is None and S.cut_at(df.limit(0), ["a"], 0) is None


def ranked(ids, key, parts):
    order = sorted(ids, key=lambda i: (key(i), i))
    t, v = int(len(ids) * parts[0]), int(len(ids) * parts[1])
    return {i: "test" if k < t else "val" if k < t + v else "train" for k, i in enumerate(order)}


@pytest.mark.parametrize("n, few", [(0, 10), (1, 10), (7, 10), (3000, 10), (3000, 10_000)])
def test_split_and_subsample_by_rank(spark, monkeypatch, n, few):
    monkeypatch.setattr(S, "FEW", few)
    df = spark.range(n).select(F.col("id").alias("o"), F.lit("x").alias("_r"))
    key = (F.col("o") * 7919) % 101
    got = {r.o: r.split for r in BU.split(df, ["o"], key=key).collect()}
    assert got == ranked(range(n), lambda i: i * 7919 % 101, (0.15, 0.05))
    some = [r.o for r in BU.subsample(df, ["o"], 0.1, key=key).collect()]
    assert sorted(some) == sorted(sorted(range(n), key=lambda i: (i * 7919 % 101, i))[: max(1, int(n * 0.1))])
    seeded = BU.split(df, ["o"], seed=3)
    assert seeded.columns == ["o", "_r", "split"] and seeded.filter("split = 'test'").count() == int(n * 0.15)


def test_rows_that_repeat_and_groups(spark):
    df = spark.createDataFrame([(1, k) for k in range(10)] + [(2, k) for k in range(10)], "o long, x long")
    parts = BU.split(df, ["o"], test=0.25, val=0.5).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"test": 5, "val": 10, "train": 5}
    assert BU.subsample(df, ["o"], 0.35).count() == 7
    clips = spark.createDataFrame([(g, m) for g in range(40) for m in ("", "M")], "g long, m string")
    out = BU.split(clips, ["g", "m"], test=0.5, val=0.25, group=["g"]).collect()
    by = {}
    for r in out:
        by.setdefault(r.g, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values()) and sorted(v for s in by.values() for v in s).count("test") == 20


def test_no_row_is_moved(spark):
    df = spark.range(5000).select(F.col("id").alias("o"))
    for out in (BU.split(df, ["o"]), BU.subsample(df, ["o"], 0.1)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
