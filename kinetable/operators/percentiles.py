"""Exact percentiles of groups of any size.

The built-in exact percentile keeps all distinct values of a group in one
buffer. Here equal values are first counted map-side; the distinct values are
cut into blocks at approximate quantiles, and only the blocks that contain a
wanted rank are ever ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def percentiles(df: DataFrame, keys: list[str], col: str, ps: dict[str, float], blocks: int = 64) -> DataFrame:
    """One row per group with linearly interpolated percentiles named by
    ``ps``. Nulls are ignored."""
    tag = {f"_g{i}": F.col(k) for i, k in enumerate(keys)} or {"_g0": F.lit(0)}
    g = list(tag)
    vals = df.where(F.col(col).isNotNull()).select(*[c.alias(n) for n, c in tag.items()], F.col(col).cast("double").alias("v"))
    counts = vals.groupBy(*g, "v").agg(F.count(F.lit(1)).alias("c"))
    marks = [i / blocks for i in range(1, blocks)]
    edges = vals.groupBy(*g).agg(
        F.percentile_approx("v", marks, 1000).alias("edges"), F.count(F.lit(1)).alias("n")
    )
    if keys:
        d = counts.join(edges, g)
    else:  # one row: attach it as scalars instead of joining on a constant
        d = counts.withColumns({c: edges.select(c).scalar() for c in ("edges", "n")})
    d = d.withColumn("b", F.size(F.filter("edges", lambda e: e < F.col("v"))))
    per = d.groupBy(*g, "b").agg(F.sum("c").alias("bc"), F.first("n").alias("n"))
    before = Window.partitionBy(*g).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("off", F.coalesce(F.sum("bc").over(before), F.lit(0)))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("r")) for name, p in ps.items()])
    want = per.select(*g, "b", "off", "bc", F.explode(ranks).alias("w")).where(
        (F.ceil(F.col("w.r")) >= F.col("off")) & (F.floor(F.col("w.r")) < F.col("off") + F.col("bc"))
    )
    want = want.groupBy(*g, "b", "off").agg(F.collect_list("w").alias("ws"))
    w = Window.partitionBy(*g, "b").orderBy("v")
    hit = d.select(*g, "b", "v", "c").join(want, [*g, "b"])
    hi = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("off")  # ranks [hi - c, hi)
    hit = hit.withColumn("hi", hi).withColumn("w", F.explode("ws"))
    lo_r, hi_r = F.floor(F.col("w.r")), F.ceil(F.col("w.r"))
    covers = lambda r: (r >= F.col("hi") - F.col("c")) & (r < F.col("hi"))
    hit = hit.where(covers(lo_r) | covers(hi_r))
    picked = hit.groupBy(*g, F.col("w.name").alias("name"), F.col("w.r").alias("r")).agg(
        F.max(F.when(covers(lo_r), F.col("v"))).alias("a"), F.max(F.when(covers(hi_r), F.col("v"))).alias("z")
    )
    value = F.col("a") + (F.col("z") - F.col("a")) * (F.col("r") - F.floor("r"))
    out = picked.groupBy(*g).agg(*[F.max(F.when(F.col("name") == n, value)).alias(n) for n in ps])
    return out.select(*[F.col(a).alias(k) for a, k in zip(g, keys)], *ps)


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
