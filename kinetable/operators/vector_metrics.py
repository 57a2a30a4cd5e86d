"""Statistics and distances of embedding tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.functions import vectors as V
from kinetable.operators.blocks import number_rows
from kinetable.operators.knn import knn

#: Order units per task when rows with their vectors are dealt to pools.
POOL_BLOCK = 1 << 14
#: Partial sums are folded to this many rows before their final grouping.
FOLD = 32


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col])


def feature_stats(df: DataFrame, vec: str) -> DataFrame:
    """Per-dimension mean and population standard deviation.

    Every partition sends one row (count, means, squared deviations); these
    are merged exactly by the parallel variance rule.
    """

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mu, m2 = 0, 0.0, 0.0
        for pdf in it:
            if not len(pdf):
                continue
            x = _stack(pdf["x"])
            bn, bm = len(x), x.mean(0)
            d = bm - mu
            m2 = m2 + ((x - bm) ** 2).sum(0) + d * d * n * bn / (n + bn)
            mu = mu + d * bn / (n + bn)
            n += bn
        if n:
            yield pd.DataFrame({"n": [n], "mu": [mu.tolist()], "m2": [m2.tolist()]})

    p = df.select(F.col(vec).alias("x")).mapInPandas(part, "n long, mu array<double>, m2 array<double>")
    d = p.select("n", F.posexplode(F.arrays_zip("mu", "m2")).alias("dim", "s")).select("n", "dim", "s.mu", "s.m2")
    g = d.groupBy("dim").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("mu")) / F.sum("n")).alias("mean"),
        F.sum("m2").alias("within"),
        F.sum(F.col("n") * F.col("mu") * F.col("mu")).alias("sq"),
    )
    var = (F.col("within") + F.greatest(F.col("sq") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))) / F.col("n")
    return g.select("dim", "mean", F.sqrt(var).alias("std"), "n")


def stats_vectors(stats: DataFrame) -> tuple[Column, Column]:
    """Mean and std vectors as scalar subqueries (one row of D numbers)."""
    def pack(c: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct("dim", c)))
        return stats.agg(F.transform(pairs, lambda s: s[c]).alias("v")).scalar()

    return pack("mean"), pack("std")


def standard_scale(df: DataFrame, vec: str) -> DataFrame:
    """Zero mean, unit population deviation; constant dimensions stay 0."""
    mu, sd = stats_vectors(feature_stats(df, vec).withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)))
    d = df.withColumns({"_m": mu, "_s": sd})
    return d.withColumn(vec, V.zscore(F.col(vec), F.col("_m"), F.col("_s"))).drop("_m", "_s")


def compose_stats(blocks: DataFrame, choice: DataFrame) -> DataFrame:
    """Concatenate mean/std blocks. ``blocks``: source, block, mean, std
    (arrays); ``choice``: block, source, position."""
    d = choice.join(blocks, ["block", "source"])
    rows = F.array_sort(F.collect_list(F.struct("position", "mean", "std")))
    return d.agg(
        F.flatten(F.transform(rows, lambda r: r["mean"])).alias("mean"), F.flatten(F.transform(rows, lambda r: r["std"])).alias("std")
    )


def _co_moments(df: DataFrame, vec: str, mean: list[float]) -> DataFrame:
    """Per (i, j) with i <= j the sum of centered products.

    A task sums all its input into one matrix, and tasks are as many as the
    cluster runs in two waves, not as many as the input has splits; matrices
    are then folded in two steps before the (i, j) grouping. So the shuffle
    follows the cores times D squared and not the data.
    """
    mu = np.asarray(mean)
    tasks = max(FOLD, 2 * df.sparkSession.sparkContext.defaultParallelism)

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros((len(mu), len(mu)))
        for pdf in it:
            if len(pdf):
                x = _stack(pdf["x"]) - mu
                c += x.T @ x
        yield pd.DataFrame({"i": np.arange(len(mu)), "row": list(c)})

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for pdf in it:
            for i, r in zip(pdf["i"], pdf["row"]):
                acc[i] = acc.get(i, 0.0) + np.asarray(r)
        if acc:
            yield pd.DataFrame({"i": list(acc), "row": list(acc.values())})

    schema = "i int, row array<double>"
    p = df.select(F.col(vec).alias("x")).coalesce(tasks).mapInPandas(part, schema)
    if tasks > FOLD:
        p = p.repartition(max(FOLD, int(tasks**0.5))).mapInPandas(fold, schema)
    p = p.repartition(FOLD, "i").mapInPandas(fold, schema)
    d = p.select("i", F.posexplode("row").alias("j", "v")).where("i <= j")
    return d.groupBy("i", "j").agg(F.sum("v").alias("s"))


def activation_stats(df: DataFrame, vec: str) -> DataFrame:
    """Covariance (ddof 1) of every pair i <= j with both means."""
    st = feature_stats(df, vec)
    rows = st.orderBy("dim").select("dim", "mean", "n").collect()  # D rows
    n = rows[0]["n"]
    m = df.sparkSession.createDataFrame([(r["dim"], r["mean"]) for r in rows], "dim int, mean double")
    c = _co_moments(df, vec, [r["mean"] for r in rows])
    c = c.select("i", "j", (F.col("s") / F.lit(float(n - 1))).alias("cov"))
    a = m.select(F.col("dim").alias("i"), F.col("mean").alias("mean_i"))
    b = m.select(F.col("dim").alias("j"), F.col("mean").alias("mean_j"))
    return c.join(a, "i").join(b, "j")


def _moments_matrix(df: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray]:
    rows = activation_stats(df, vec).collect()  # D(D+1)/2 numbers, independent of the data size
    d = max(r["j"] for r in rows) + 1
    mu, c = np.zeros(d), np.zeros((d, d))
    for r in rows:
        c[r["i"], r["j"]] = c[r["j"], r["i"]] = r["cov"]
        mu[r["i"]], mu[r["j"]] = r["mean_i"], r["mean_j"]
    return mu, c


def _psd_sqrt(c: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh(c)
    return (v * np.sqrt(np.maximum(w, 0.0))) @ v.T


def frechet_between(mu1: np.ndarray, c1: np.ndarray, mu2: np.ndarray, c2: np.ndarray, eps: float = 1e-6) -> float:
    """|m1-m2|^2 + tr(C1 + C2 - 2 sqrt(C1 C2)); the trace of the square root
    is taken from the symmetric product, with ``eps`` on singular input."""
    r = _psd_sqrt(c1)
    w = np.linalg.eigvalsh(r @ c2 @ r)
    if not np.isfinite(w).all():
        e = np.eye(len(c1)) * eps
        r = _psd_sqrt(c1 + e)
        w = np.linalg.eigvalsh(r @ (c2 + e) @ r)
    d = mu1 - mu2
    return float(d @ d + np.trace(c1) + np.trace(c2) - 2 * np.sqrt(np.maximum(w, 0.0)).sum())


def frechet_distance(a: DataFrame, b: DataFrame, vec: str, standardize: bool = False) -> DataFrame:
    """Distance of the two tables' Gaussian fits, as a one-row table.

    ``standardize`` scales both by the first table's mean and deviation. Only
    D by D moments reach the driver.
    """
    (m1, c1), (m2, c2) = _moments_matrix(a, vec), _moments_matrix(b, vec)
    if standardize:
        s = np.sqrt(np.maximum(np.diag(c1), 0.0)) + 1e-8
        m1, m2, c1, c2 = (m1 - m1) / s, (m2 - m1) / s, c1 / np.outer(s, s), c2 / np.outer(s, s)
    return a.sparkSession.createDataFrame([(frechet_between(m1, c1, m2, c2),)], "frechet double")


def smallest_keys(df: DataFrame, keys: Column, subsets: int, size: int) -> DataFrame:
    """For each of ``subsets`` numbers in the array ``keys`` the ``size`` smallest of all rows: subset, key.

    Every task keeps a bottom-k sketch, of at most ``size`` numbers a subset;
    sketches are merged in two steps, so no merge reads those of all tasks.
    Null comes first and NaN last, as Spark orders them.
    """
    low = F.transform(keys, lambda k: F.coalesce(k.cast("double"), F.lit(float("-inf"))))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, subsets))
        for b in batches:
            held = np.concatenate([held, b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, subsets)])
            if len(held) > size:
                held = np.partition(held, size - 1, axis=0)[:size]
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(subsets, dtype=np.int32), len(held))), pa.array(held.T.ravel())], ["subset", "key"])

    d = df.select(low.alias("k")).mapInArrow(sketch, "subset int, key double").withColumn("_part", F.spark_partition_id() % 64)
    for group in (["subset", "_part"], ["subset"]):
        d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("key"))).where(F.col("_r") <= size)
    return d.select("subset", "key")


def kernel_distance(a: DataFrame, b: DataFrame, ident: str, vec: str, subsets: int = 50, size: int = 1000, seed: int = 0,
                    key: Callable[[Column], Column] | None = None, degree: int = 3, coef: float = 1.0, var_at: int | None = None) -> DataFrame:
    """Unbiased polynomial MMD^2 per random subset of ``size`` rows each, and its variance: subset, mmd2, variance.

    Every subset is drawn anew from the whole table, without replacement: the
    rows smallest by ``key`` (a function of the subset's number, a seeded hash
    if not given; a number). A sketch of the keys, made from ids alone, gives
    the largest that each subset takes; one scan of the vectors then keeps
    the rows that some subset takes, and they make one bounded task a subset.
    A table of fewer rows gives all of them, and one of fewer than two a null.

    ``variance`` is the unbiased estimate for samples of ``var_at`` rows (of
    the smaller table's, if not given); null if the two draws differ in size
    or have fewer than three rows.
    """
    every = F.sequence(F.lit(0), F.lit(subsets - 1))

    def draw(df: DataFrame, side: int) -> DataFrame:
        one = (lambda s: F.xxhash64(F.col(ident), F.lit(seed + side), s)) if key is None else key
        keys = F.transform(every, one)
        last = smallest_keys(df.select(ident), keys, subsets, size).groupBy("subset").agg(F.max("key").alias("key"))
        last = last.agg(F.map_from_entries(F.collect_list(F.struct("subset", "key"))).alias("m")).scalar()  # one entry for each subset
        rows = df.select(ident, F.col(vec).cast("array<double>").alias("x"), keys.alias("_keys"), last.alias("_last"))
        value = lambda s: F.coalesce(F.get("_keys", s).cast("double"), F.lit(float("-inf")))
        near = rows.withColumn("subset", F.explode(F.filter(every, lambda s: value(s) <= F.try_element_at("_last", s))))
        rank = F.row_number().over(Window.partitionBy("subset").orderBy(F.get("_keys", F.col("subset")), ident))
        return near.withColumn("_r", rank).where(F.col("_r") <= size).select("subset", F.lit(side).alias("side"), "x")

    def mmd(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf["x"][pdf["side"] == i] for i in (0, 1)]
        value, z1, z2 = None, None, None
        if min(map(len, sides)) > 1:
            x, y = map(_stack, sides)
            kern = lambda p, q: (p @ q.T / p.shape[1] + coef) ** degree
            cross = kern(x, y)
            value, parts = -2 * float(cross.mean()), []
            for own, over in ((kern(x, x), cross), (kern(y, y), cross.T)):
                np.fill_diagonal(own, 0.0)
                m = len(own)
                value += float(own.sum()) / (m * (m - 1))
                if len(x) == len(y) > 2:
                    parts.append(_spread(own, over))
            if parts:
                z1, z2 = (float(sum(p)) for p in zip(*parts, strict=True))
        return pd.DataFrame({"subset": [int(pdf["subset"].iloc[0])], "mmd2": [value], "z1": [z1], "z2": [z2]})

    d = draw(a, 0).unionByName(draw(b, 1)).groupBy("subset").applyInPandas(mmd, "subset int, mmd2 double, z1 double, z2 double")
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    m = (F.least(count(a), count(b)) if var_at is None else F.lit(var_at)).cast("double")
    return d.select("subset", "mmd2", ((4 * (m - 2) * F.col("z1") + 2 * F.col("z2")) / (m * (m - 1))).alias("variance"))


def _spread(own: np.ndarray, over: np.ndarray) -> tuple[float, float]:
    """One side's share of the variances of the kernel's mean given one row, and given two rows.

    ``own``: the kernel of m rows without its diagonal; ``over``: that of the
    rows with the m of the other side.
    """
    m = len(own)
    pairs = m * (m - 1)
    near, far = own.sum(axis=1), over.sum(axis=1)
    square, far_square, both = float((own**2).sum()), float((over**2).sum()), float(near @ far) / (m * pairs)
    a, r = float(near.sum()) / pairs, float(far.sum()) / m**2
    centre = a * a + r * r - 2 * a * r  # of the own and the crossed mean
    one = (float(near @ near) - square) / (pairs * (m - 2)) + (float(far @ far) - far_square) / (m * pairs) - 2 * both - centre
    two = square / pairs + far_square / m**2 - 4 * both - centre + 2 * a * r
    return one, two


def kernel_summary(per_subset: DataFrame) -> DataFrame:
    return per_subset.agg(F.avg("mmd2").alias("mean"), F.stddev_pop("mmd2").alias("std"))


def diversity(df: DataFrame, ident: str, vec: str, n: int, first: Column, second: Column) -> DataFrame:
    """Mean distance between two draws of ``n`` rows, paired by draw order.

    ``first``/``second`` are seeded order keys; both draws are distributed
    top-n selections, so only 2n rows are ever ordered.
    """
    def draw(key: Column, name: str) -> DataFrame:
        d = df.select(F.col(ident), F.col(vec).alias(name), key.alias("_k")).orderBy("_k", ident).limit(n)
        return d.select(name, F.row_number().over(Window.orderBy("_k", ident)).alias("draw"))

    pairs = draw(first, "a").join(draw(second, "b"), "draw")
    return pairs.agg(F.avg(V.distance(F.col("a"), F.col("b"))).alias("diversity"))


def condition_distances(df: DataFrame, cond: str, ident: str, vec: str, n: int, first: Column, second: Column) -> DataFrame:
    """Per condition the mean distance of two draws of up to ``n`` rows. The
    rank filter is applied before the shuffle, so a hot condition sends at
    most ``n`` rows per map task."""
    def draw(key: Column, name: str) -> DataFrame:
        d = df.select(F.col(cond), F.col(ident), F.col(vec).alias(name), key.alias("_k"))
        w = Window.partitionBy(cond).orderBy("_k", ident)
        return d.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= n).select(cond, name, "draw")

    pairs = draw(first, "a").join(draw(second, "b"), [cond, "draw"])
    return pairs.groupBy(cond).agg(F.avg(V.distance(F.col("a"), F.col("b"))).alias("distance"), F.count(F.lit(1)).alias("draws"))


def multimodality(df: DataFrame, cond: str, ident: str, vec: str, n: int, first: Column, second: Column) -> DataFrame:
    d = condition_distances(df, cond, ident, vec, n, first, second)
    return d.agg((F.sum(F.col("distance") * F.col("draws")) / F.sum("draws")).alias("multimodality"))


def label_diversity(df: DataFrame, label: str, ident: str, vec: str, n: int, quota: int, first: Column, second: Column) -> DataFrame:
    """Overall diversity and the within-label distance with a quota of pairs
    per label, averaged over pairs."""
    d = diversity(df, ident, vec, n, first, second)
    m = condition_distances(df, label, ident, vec, quota, first, second)
    labels = df.select(label).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    m = m.agg((F.sum(F.col("distance") * F.col("draws")) / (F.lit(quota) * labels)).alias("m")).scalar()
    return d.withColumn("multimodality", m)


def make_pools(df: DataFrame, order: str, size: int = 32, out: str = "pool") -> DataFrame:
    """Cut the table into consecutive pools of ``size`` rows."""
    d = number_rows(df, [], [order], F.floor(F.col(order) / POOL_BLOCK), "_n")
    return d.withColumn(out, F.floor(F.col("_n") / size).cast("long")).drop("_n")


def r_precision(pred: DataFrame, truth: DataFrame, ident: str, pvec: str, tvec: str, pool: str, k: int = 3) -> DataFrame:
    """Share of rows whose own partner is among the 1..k nearest of its pool.

    Uses the exact k-nearest join, so no pool is expanded to pairs.
    """
    nn = knn(pred, truth, k, ident, pvec, ident, tvec, (pool, pool))
    own = nn.where("qid = pid").groupBy("rank").agg(F.count(F.lit(1)).alias("c"))
    n = pred.agg(F.count(F.lit(1)).alias("n")).scalar()
    return own.agg(*[(F.coalesce(F.sum(F.when(F.col("rank") <= i, F.col("c"))), F.lit(0)) / n).alias(f"top_{i}") for i in range(1, k + 1)])


def matching_score(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.agg(F.avg(V.distance(F.col(a), F.col(b))).alias("matching_score"))


def confidence(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and 1.96 sigma / sqrt(n) over repeated runs."""
    return values.groupBy(*keys).agg(
        F.avg(value).alias("mean"), (F.lit(1.96) * F.stddev_pop(value) / F.sqrt(F.count(F.lit(1)))).alias("ci")
    )


def pooled_matches(df: DataFrame, run: str, pool: str, ident: str, cond: str, vecs: dict[str, str], k: int = 3, batch: int = 64) -> DataFrame:
    """Per run and kind of vector: rows, rows whose own vector is the 1..k nearest to
    their condition within the pool, and the summed distance to it.

    ``vecs`` names the vector column of each kind. Ties go to the lower id.
    ``batch`` pools meet in one task and leave one row a kind; a pool is small by
    its definition.
    """
    near = [f"near_{i}" for i in range(1, k + 1)]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = {kind: np.zeros(k + 2) for kind in vecs}
        for _, g in pdf.groupby(pool):
            g = g.sort_values(ident)
            c = _stack(g[cond])
            for kind, col in vecs.items():
                x = _stack(g[col])
                d = np.sqrt(((c[:, None, :] - x[None, :, :]) ** 2).sum(-1))
                own = np.diag(d)
                before = np.tril(np.ones(d.shape, dtype=bool), -1)  # candidates of a lower id
                rank = (d < own[:, None]).sum(1) + ((d == own[:, None]) & before).sum(1)
                sums[kind] += [len(g), own.sum(), *((rank < i).sum() for i in range(1, k + 1))]
        return pd.DataFrame([[pdf[run].iloc[0], kind, int(v[0]), v[1], *v[2:].astype(int)] for kind, v in sums.items()])

    schema = f"run int, kind string, n long, dist double, {', '.join(f'{c} long' for c in near)}"
    d = df.select(F.col(run).cast("int").alias(run), pool, ident, cond, *vecs.values()).withColumn("_many", F.floor(F.col(pool) / batch))
    parts = d.groupBy(run, "_many").applyInPandas(meet, schema)
    return parts.groupBy("run", "kind").agg(*[F.sum(c).alias(c) for c in ("n", "dist", *near)])


def reconstruction_report(
    pairs: DataFrame, ident: str, real: str, pred: str, cond: str | None = None, pool_size: int = 32, n: int = 300, runs: int = 3, seed: int = 0,
    frechet: bool = True, order: tuple[Callable[[Column], Column], Callable[[Column], Column]] | None = None,
    draws: tuple[Callable[[Column], Column], Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Distribution and matching metrics of real and predicted vectors over
    repeated pools and draws: metric, mean, ci.

    ``cond`` is the vector both sides are matched against (of the caption); without
    one the predictions are matched against the real vectors. All runs go through one
    pass: the table is numbered once per run in a seeded order and cut into pools.
    ``order`` gives that order as a key and a bucket of it, both functions of the run,
    and ``draws`` the two keys of the diversity draws. Rows with a null vector are left
    out. A value that needs no draw, such as the Fréchet distance, has the interval 0.
    """
    used = [c for c in (real, pred, cond) if c]
    known = pairs.select(ident, *dict.fromkeys(used))
    for c in used:
        known = known.where(F.col(c).isNotNull())
    d = known.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    r = F.col("run")
    if order is None:
        hashed = lambda run: F.xxhash64(ident, F.lit(seed), run)
        order = hashed, lambda run: F.shiftright(hashed(run), 48)
    if draws is None:
        draws = tuple((lambda run, s=s: F.xxhash64(F.col(ident), F.lit(seed + s), run)) for s in (1, 2))
    placed = number_rows(d.withColumn("_k", order[0](r)), ["run"], ["_k", ident], order[1](r), "_o")
    placed = placed.withColumn("pool", F.floor(F.col("_o") / pool_size))
    kinds = {"real": real, "pred": pred} if cond else {"pred": pred}
    m = pooled_matches(placed, "run", "pool", ident, cond or real, kinds, 3)
    each = {"matching": F.col("dist") / F.col("n"), **{f"r_precision_{i}": F.col(f"near_{i}") / F.col("n") for i in (1, 2, 3)}}
    named = F.explode(F.map_from_arrays(F.array(*[F.concat(F.lit(f"{name}_"), "kind") for name in each]), F.array(*each.values())))
    rows = m.select(named.alias("metric", "value"))
    def drawn(key: Callable[[Column], Column], name: str) -> DataFrame:
        k = F.row_number().over(Window.partitionBy("run").orderBy(key(r), ident)).alias("draw")
        return d.select("run", k, F.struct(F.col(real).alias("real"), F.col(pred).alias("pred")).alias(name)).where(F.col("draw") <= n)

    both = drawn(draws[0], "a").join(drawn(draws[1], "b"), ["run", "draw"])
    far = both.groupBy("run").agg(*[F.avg(V.distance(F.col(f"a.{c}"), F.col(f"b.{c}"))).alias(f"diversity_{c}") for c in ("real", "pred")])
    rows = rows.unionByName(far.unpivot("run", ["diversity_real", "diversity_pred"], "metric", "value").select("metric", "value"))
    if frechet:
        fid = frechet_distance(known.select(F.col(real).alias("v")), known.select(F.col(pred).alias("v")), "v")
        rows = rows.unionByName(fid.select(F.lit("frechet").alias("metric"), F.col("frechet").alias("value")))
    return confidence(rows, ["metric"], "value")


def code_perplexity(codes: DataFrame, code: str) -> DataFrame:
    c = codes.where(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("c"))
    t = c.agg(F.sum("c").alias("t")).scalar()
    p = F.col("c") / t
    return c.agg(F.exp(-F.sum(p * F.log(p + 1e-7))).alias("perplexity"))


def codebook_ema_step(assigned: DataFrame, state: DataFrame, vec: str, mu: float = 0.99, reseed: DataFrame | None = None) -> DataFrame:
    """One moving-average update of a codebook.

    ``assigned``: code and vector per row; ``state``: code, code_sum (array),
    code_count; ``reseed``: code, seed_vec, used for codes whose averaged
    count falls below 1. Sums are combined map-side per (code, dimension).
    """
    x = assigned.select("code", F.posexplode(vec).alias("i", "v"))
    new = x.groupBy("code", "i").agg(F.sum(F.col("v").cast("double")).alias("s"))
    n = assigned.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    old = state.select("code", "code_count", F.posexplode("code_sum").alias("i", "o"))
    d = old.join(new, ["code", "i"], "left").join(n, "code", "left")
    cs = F.lit(mu) * F.col("o") + F.lit(1 - mu) * F.coalesce("s", F.lit(0.0))
    cc = F.lit(mu) * F.col("code_count") + F.lit(1 - mu) * F.coalesce("n", F.lit(0))
    d = d.select("code", "i", cs.alias("code_sum"), cc.alias("code_count"))
    fresh = F.lit(None).cast("double")
    if reseed is not None:
        d = d.join(reseed.select("code", F.posexplode("seed_vec").alias("i", "fresh")), ["code", "i"], "left")
        fresh = F.col("fresh").cast("double")
    return d.withColumn("value", F.when(F.col("code_count") >= 1, F.col("code_sum") / F.col("code_count")).otherwise(fresh))


def reseed_vectors(codes: DataFrame, rows: DataFrame, ident: str, vec: str, key: Column | None = None, seed: int = 0) -> DataFrame:
    """A drawn row's vector for each code, no row twice: code, seed_vec.

    The i-th code takes the i-th row in the order of ``key`` (a seeded hash if
    not given); the draw keeps as many rows a task as there are codes, and
    codes beyond the rows get none. The codebook is bounded by its nature.
    """
    n = codes.count()
    k = F.xxhash64(ident, F.lit(seed)) if key is None else key
    drawn = rows.select(k.alias("_k"), F.col(ident).alias("_id"), F.col(vec).alias("seed_vec")).orderBy("_k", "_id").limit(n)
    drawn = drawn.withColumn("_r", F.row_number().over(Window.orderBy("_k", "_id"))).select("_r", "seed_vec")
    return codes.select("code", F.row_number().over(Window.orderBy("code")).alias("_r")).join(drawn, "_r").drop("_r")


def commit_loss(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean squared difference over all entries."""
    return df.agg((F.sum(V.sq_distance(F.col(a), F.col(b))) / F.sum(F.size(a))).alias("commit_loss"))


def recon_loss(df: DataFrame, a: str, b: str, kind: str = "l1_smooth", joints: int = 22, velocity: bool = False) -> DataFrame:
    """Mean loss over the leading (J-1)*12+11 entries, or over the velocity
    slice 4 .. (J-1)*3+4."""
    first, stop = (4, (joints - 1) * 3 + 4) if velocity else (0, (joints - 1) * 12 + 11)
    part = lambda c: F.slice(F.col(c), first + 1, stop - first)
    losses = {
        "l1": lambda d: F.abs(d),
        "l2": lambda d: d * d,
        "l1_smooth": lambda d: F.when(F.abs(d) < 1, 0.5 * d * d).otherwise(F.abs(d) - 0.5),
    }
    one = V.total(F.transform(V.sub(part(a), part(b)), losses[kind]))
    return df.agg((F.sum(one) / F.sum(F.size(part(a)))).alias("loss"))


def kl_report(df: DataFrame, mu: str, logvar: str) -> DataFrame:
    """-1/2 mean(1 + logvar - mu^2 - exp(logvar))."""
    t = V.total(V.zip_map(F.col(mu), F.col(logvar), lambda m, lv: 1 + lv - m * m - F.exp(lv)))
    return df.agg((-0.5 * F.sum(t) / F.sum(F.size(mu))).alias("kl"))


def gaussian_kl(mu1: Column, lv1: Column, mu2: Column, lv2: Column) -> Column:
    """KL of diagonal Gaussians, summed over entries."""
    z = F.arrays_zip(mu1.alias("a"), lv1.alias("b"), mu2.alias("c"), lv2.alias("d"))
    each = F.transform(
        z, lambda s: (s["a"] - s["c"]) * (s["a"] - s["c"]) / F.exp(s["d"].cast("double")) + F.exp((s["b"] - s["d"]).cast("double")) - 1 - s["b"] + s["d"]
    )
    return 0.5 * V.total(each)


def gaussian_nll(x: Column, mu: Column, lv: Column) -> Column:
    z = F.arrays_zip(x.alias("a"), mu.alias("b"), lv.alias("c"))
    log2pi = float(np.log(2 * np.pi))
    return 0.5 * V.total(F.transform(z, lambda s: log2pi + s["c"] + (s["a"] - s["b"]) * (s["a"] - s["b"]) / F.exp(s["c"].cast("double"))))


def pca(df: DataFrame, vec: str, k: int) -> DataFrame:
    """Coordinates on the first k principal axes of the centered table.

    The D by D covariance is summed on Spark and decomposed once; every row is
    then projected where it lies. Axis signs make the largest entry positive.
    """
    mu, c = _moments_matrix(df, vec)
    w, v = np.linalg.eigh(c)
    axes = v[:, np.argsort(-w)[:k]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        known = v.notna()
        found = iter((_stack(v[known]) - mu) @ axes if known.any() else ())
        return pd.Series([next(found) if k else None for k in known], index=v.index, dtype=object)

    return df.withColumn("pc", project(F.col(vec).cast("array<double>")))


def label_scatter_summary(df: DataFrame, label: str, coords: dict[str, Column]) -> DataFrame:
    """Centroid and spread of projected points per label."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for n, c in coords.items():
        aggs += [F.avg(c).alias(f"{n}_mean"), F.stddev_pop(c).alias(f"{n}_std")]
    return df.groupBy(label).agg(*aggs)


class MetricSet:
    """Named, weighted aggregates over one table, evaluated in a single pass.

    A metric is a function from its input columns to an aggregate Column
    (native, or built on a pandas UDF).
    """

    def __init__(self) -> None:
        self._metrics: dict[str, tuple] = {}
        self.history: dict[str, list[float]] = {}

    def add(self, name: str, fn, weight: float = 1.0, inputs: tuple[str, ...] = ("pred", "target"), active: bool = True) -> MetricSet:
        self._metrics[name] = (fn, weight, inputs, active)
        return self

    def remove(self, name: str) -> None:
        self._metrics.pop(name, None)
        self.history.pop(name, None)

    def set_weight(self, name: str, weight: float) -> None:
        fn, _, inputs, active = self._metrics[name]
        self._metrics[name] = (fn, weight, inputs, active)

    def activate(self, name: str, active: bool = True) -> None:
        fn, weight, inputs, _ = self._metrics[name]
        self._metrics[name] = (fn, weight, inputs, active)

    def summary(self) -> dict[str, dict]:
        return {n: {"weight": w, "active": a, "inputs": i} for n, (_, w, i, a) in self._metrics.items()}

    def compute(self, df: DataFrame) -> DataFrame:
        """One row: every active metric raw and weighted, and their total."""
        aggs, parts = [], []
        for n, (fn, weight, inputs, active) in self._metrics.items():
            if not active:
                continue
            missing = [c for c in inputs if c not in df.columns]
            if missing:
                raise ValueError(f"metric {n} needs missing columns {missing}")
            aggs.append(fn(*[F.col(c) for c in inputs]).alias(n))
            parts.append((n, weight))
        out = df.agg(*aggs).withColumns({f"{n}_weighted": F.col(n) * F.lit(float(w)) for n, w in parts})
        return out.withColumn("total", sum((F.col(f"{n}_weighted") for n, _ in parts), F.lit(0.0)))

    def record(self, result: DataFrame) -> dict[str, float]:
        """Run a computed row and append it to the history."""
        row = result.first().asDict()
        for n, v in row.items():
            self.history.setdefault(n, []).append(v)
        return row
