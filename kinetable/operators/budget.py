"""Exact global ranks, budgets, quotas, samples and splits.

A global rank never sorts the table in one task: rows are bucketed by a
monotone function of the sort key, counted per bucket, and ranked inside the
bucket (:func:`kinetable.operators.blocks.number_rows`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from kinetable.operators.blocks import Seq, fit_bucket, number_rows, scan
from kinetable.operators.selection import Cut, cut_at

#: Order units per task for whole-table scans.
GLOBAL_BLOCK = 1 << 20


def seeded_key(ids: list[str], seed: int) -> Column:
    return F.xxhash64(*ids, F.lit(seed))


def seeded_rank(df: DataFrame, keys: list[str], ids: list[str], seed: int = 0, key: Column | None = None,
                bucket: Column | None = None, out: str = "rank") -> DataFrame:
    """0-based rank in a seeded order, per ``keys``.

    Pass ``key`` for an order of your own and ``bucket``, a non-decreasing
    function of it, to spread the ranking; without one, buckets are cut from
    the range of a numeric key.
    """
    if key is None:
        key = seeded_key(ids, seed)
        bucket = F.shiftright(F.col("_k"), 48)
    d = df.withColumn("_k", key)
    if bucket is None:
        numeric = isinstance(d.schema["_k"].dataType, NumericType)
        bucket = fit_bucket(d, keys, F.col("_k")) if numeric else F.col("_k")
    return number_rows(d, keys, ["_k", *ids], bucket, out).drop("_k")


def table_count(df: DataFrame) -> Column:
    """Row count as a scalar subquery: usable in any expression."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def duration_budget(df: DataFrame, order: str, duration: str, limit: float, spent: float = 0.0) -> DataFrame:
    """Items in order until the budget is used; the last is clipped.

    ``spent`` carries what earlier queries used.
    """
    d = scan(df, Seq((), order, GLOBAL_BLOCK), shifted_sums={"used_before": F.col(duration)})
    left = F.lit(float(limit) - float(spent)) - F.col("used_before")
    return d.where(left > 0).withColumn("granted", F.least(F.col(duration), left))


def quota(df: DataFrame, order: list[str], n: int = 90) -> DataFrame:
    return df.orderBy(*order).limit(n)


def reserve(available: DataFrame, slots: DataFrame, folder: str, order: str, batch: int) -> DataFrame:
    """Up to ``batch`` items, folder by folder, each folder bounded by its
    free slots. ``slots`` has the folder and ``free``. No folder gives more
    than ``batch`` items, so ranking keeps only that many rows per map task."""
    w = Window.partitionBy(folder).orderBy(order)
    d = available.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= batch)
    d = d.join(slots, folder).where(F.col("_r") <= F.col("free"))
    return d.orderBy(folder, order).limit(batch).drop("_r", "free")


def top_n_by(df: DataFrame, order: list[Column | str], n: int, keys: list[str] | None = None) -> DataFrame:
    """Largest n overall or per key (ranks are pruned before the shuffle)."""
    if not keys:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def _first_rows(d: DataFrame, order: list[str], counts: list[int]) -> list[Cut | None] | None:
    """For each of ``counts`` the cut that so many rows of ``d`` come before, None if all do.

    None in place of the list if a cut runs through rows that are equal in
    ``order``: then only a rank can tell them apart.
    """
    cuts = [cut_at(d, order, n) for n in counts]
    return None if any(c is not None and c.before for c in cuts) else cuts


def subsample(df: DataFrame, ids: list[str], frac: float, seed: int = 0, key: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Exactly max(1, int(frac * n)) rows without replacement.

    The row that ends the sample is found by counting; rows are then compared
    with it where they are, so none is moved.
    """
    d = df.withColumn("_k", seeded_key(ids, seed) if key is None else key)
    cuts = _first_rows(d, ["_k", *ids], [max(1, int(d.count() * frac))])
    if cuts is None:
        n = F.greatest(F.lit(1), F.floor(table_count(df) * F.lit(frac)))
        return seeded_rank(df, [], ids, seed, key, bucket, "_r").where(F.col("_r") < n).drop("_r")
    return (d if cuts[0] is None else d.where(cuts[0].above())).drop("_k")


def trim_and_sample(df: DataFrame, seq: Seq, keep: float = 0.3, seed: int = 0, key: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Skip the first and last tenth of each clip, sample int(keep*0.8*N)."""
    keys = list(seq.keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    o = F.col(seq.order)
    d = df.join(sizes, keys).where((o >= F.floor(F.col("_n") * 0.1)) & (o < F.floor(F.col("_n") * 0.9)))
    d = seeded_rank(d, keys, [*keys, seq.order], seed, key, bucket, "_r")
    return d.where(F.col("_r") < F.floor(F.lit(keep * 0.8) * F.col("_n"))).drop("_r", "_n")


def split(df: DataFrame, ids: list[str], test: float = 0.15, val: float = 0.05, seed: int = 0,
          group: list[str] | None = None, key: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Label rows test (first int(test*n)), val (next int(val*n)) or train.

    With ``group`` whole groups (a clip and its mirrored copy) are ranked, so
    they stay together; ``key`` is then a function of the group. The rows
    that end the parts are found by counting, and rows are labelled by
    comparison with them: no row is moved.
    """
    own = group or ids
    d = df.withColumn("_k", seeded_key(own, seed) if key is None else key)
    units = d.select("_k", *own).distinct() if group else d
    n = units.count()
    t, v = int(n * test), int(n * val)
    cuts = _first_rows(units, ["_k", *own], [t, t + v])
    if cuts is None:
        r = seeded_rank(df, [], ids, seed, key, bucket, "_r")
        return r.withColumn("split", F.when(F.col("_r") < t, "test").when(F.col("_r") < t + v, "val").otherwise("train")).drop("_r")
    first, second = (F.lit(True) if c is None else c.above() for c in cuts)
    return d.withColumn("split", F.when(first, "test").when(second, "val").otherwise("train")).drop("_k")


def sampling_weights(df: DataFrame, length: str) -> DataFrame:
    total = df.agg(F.sum(length).alias("t")).scalar()
    return df.withColumn("weight", F.col(length) / total)
