"""Vector statistics, neighbours and codebooks on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions import vectors as V
from kinetable.operators import knn as N
from kinetable.operators import vector_metrics as VM
from kinetable.plans.base import EMB_SQL, embeddings
from kinetable.plans.registry import query

#: Seeded order keys that both engines compute alike.
SQL_A, SQL_B = "(vec_id * 7919) % 10007", "(vec_id * 104729) % 10007"

BOOK_SQL = """book AS (
  SELECT label AS code, list(m ORDER BY d) AS c FROM (
    SELECT label, d, avg(e[d]) AS m FROM emb CROSS JOIN (SELECT unnest(range(1, 65)) AS d) GROUP BY 1, 2) GROUP BY 1)"""
ASSIGN_SQL = f"""{EMB_SQL}, {BOOK_SQL}, asg AS (
  SELECT vec_id, label, e, code, c, d FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, code) AS r FROM (
      SELECT vec_id, label, e, code, c, list_distance(e, c) AS d FROM emb CROSS JOIN book)) WHERE r = 1)"""


def centroids(spark, sf):
    """One code per label: the mean vector of its rows."""
    d = embeddings(spark, sf).select("label", F.posexplode("e").alias("i", "v"))
    d = d.groupBy("label", "i").agg(F.avg("v").alias("m"))
    d = d.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vec"))
    return d.select(F.col("label").cast("long").alias("code"), "vec")


def assigned(spark, sf):
    e = embeddings(spark, sf)
    hit = N.vq_assign(e, centroids(spark, sf), "vec_id", "e")
    return e.join(hit, "vec_id")


def key_a():
    return (F.col("vec_id") * 7919) % 10007


def key_b():
    return (F.col("vec_id") * 104729) % 10007


@query(
    "knn",
    f"""WITH {EMB_SQL} SELECT pool, qid, pid, round(d, 6) AS distance, rank FROM (
  SELECT a.label AS pool, a.vec_id AS qid, b.vec_id AS pid, list_distance(a.e, b.e) AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rank
  FROM emb a JOIN emb b ON a.label = b.label) WHERE rank <= 4""",
)
def knn(spark, sf):
    e = embeddings(spark, sf)
    d = N.knn(e, e, 4, "vec_id", "e", "vec_id", "e", ("label", "label"))
    return d.select(F.col("pool").cast("int").alias("pool"), "qid", "pid", F.round("distance", 6).alias("distance"), "rank")


@query(
    "knn_cells",
    f"""WITH {EMB_SQL} SELECT qid, pid, round(d, 6) AS distance, rank FROM (
  SELECT a.vec_id AS qid, b.vec_id AS pid, list_distance(a.e, b.e) AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rank
  FROM emb a CROSS JOIN emb b) WHERE rank <= 3""",
)
def knn_cells(spark, sf):
    """The plan for two large sides."""
    e = embeddings(spark, sf)
    d = N.knn(e, e, 3, "vec_id", "e", "vec_id", "e", plan="cells", pivots=8)
    return d.select("qid", "pid", F.round("distance", 6).alias("distance"), "rank")


@query(
    "knn_blend",
    f"""WITH {EMB_SQL}, nn AS (
  SELECT * FROM (SELECT a.vec_id AS qid, b.e AS v, list_distance(a.e, b.e) AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS r
  FROM emb a CROSS JOIN emb b) WHERE r <= 4)
SELECT qid, i - 1 AS dim, round(sum(d * v[i]) / sum(d), 6) AS value
FROM nn CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2""",
)
def knn_blend(spark, sf):
    e = embeddings(spark, sf)
    d = N.knn_blend(e, e, 4, "vec_id", "e", "vec_id", "e", "e")
    return d.select("qid", F.posexplode("blend").alias("dim", "value")).select("qid", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query(
    "snap",
    f"WITH {ASSIGN_SQL} SELECT vec_id AS qid, CASE WHEN d < 0.9 THEN code END AS pid FROM asg",
)
def snap(spark, sf):
    d = N.snap(embeddings(spark, sf), centroids(spark, sf), 0.9, "vec_id", "e", "code", "vec")
    return d.select("qid", F.col("pid").cast("int").alias("pid"))


@query("vq_assign", f"WITH {ASSIGN_SQL} SELECT vec_id, code, round(d, 6) AS distance FROM asg")
def vq_assign(spark, sf):
    d = N.vq_assign(embeddings(spark, sf), centroids(spark, sf), "vec_id", "e")
    return d.select("vec_id", F.col("code").cast("int").alias("code"), F.round("distance", 6).alias("distance"))


def _two_layer_book(spark, sf):
    """Layer 0: label centroids; layer 1: the same shrunk to a tenth."""
    c = centroids(spark, sf)
    second = c.select(F.lit(1).alias("layer"), "code", V.scale(F.col("vec"), 0.1).alias("vec"))
    return c.select(F.lit(0).alias("layer"), "code", "vec").unionByName(second)


@query(
    "rvq_assign",
    f"""WITH {ASSIGN_SQL}, l1 AS (
  SELECT a.vec_id, b.code, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.r, b.c), b.code) AS k
  FROM (SELECT vec_id, list_transform(list_zip(e, c), lambda p: p[1] - p[2]) AS r FROM asg) a
  CROSS JOIN (SELECT code, list_transform(c, lambda v: v * 0.1) AS c FROM book) b)
SELECT vec_id, 0 AS layer, code FROM asg UNION ALL SELECT vec_id, 1 AS layer, code FROM l1 WHERE k = 1""",
)
def rvq_assign(spark, sf):
    d = N.rvq_assign(embeddings(spark, sf), _two_layer_book(spark, sf), 2, "vec_id", "e")
    return d.select("vec_id", "layer", F.col("code").cast("int").alias("code"))


@query(
    "vq_decode",
    f"""WITH {ASSIGN_SQL}
SELECT vec_id, i - 1 AS dim, round(CASE WHEN label = 0 THEN 0 ELSE c[i] END, 6) AS value
FROM asg CROSS JOIN (SELECT unnest(range(1, 65)) AS i)""",
)
def vq_decode(spark, sf):
    codes = assigned(spark, sf).select("vec_id", F.lit(0).alias("layer"), F.when(F.col("label") != 0, F.col("code")).alias("code"))
    d = N.vq_decode(codes, _two_layer_book(spark, sf), ["vec_id"], 64)
    return d.select("vec_id", F.posexplode("vec").alias("dim", "value")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query(
    "feature_stats",
    f"""WITH {EMB_SQL} SELECT CAST(d - 1 AS INT) AS dim, round(avg(e[d]), 8) AS mean, round(stddev_pop(e[d]), 8) AS std, count(*) AS n
FROM emb CROSS JOIN (SELECT unnest(range(1, 65)) AS d) GROUP BY 1""",
)
def feature_stats(spark, sf):
    d = VM.feature_stats(embeddings(spark, sf), "e")
    return d.select("dim", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"), "n")


@query(
    "standard_scale",
    f"""WITH {EMB_SQL}, st AS (SELECT d, avg(e[d]) AS m, stddev_pop(e[d]) AS s FROM emb CROSS JOIN (SELECT unnest(range(1, 65)) AS d) GROUP BY 1)
SELECT vec_id, CAST(d - 1 AS INT) AS dim, round((e[d] - m) / s, 6) AS value FROM emb CROSS JOIN st""",
)
def standard_scale(spark, sf):
    d = VM.standard_scale(embeddings(spark, sf), "e").select("vec_id", F.posexplode("e").alias("dim", "value"))
    return d.withColumn("value", F.round("value", 6))


@query(
    "zscore",
    f"""WITH {EMB_SQL}, st AS (SELECT d, avg(e[d]) AS m, stddev_pop(e[d]) AS s FROM emb CROSS JOIN (SELECT unnest(range(1, 65)) AS d) GROUP BY 1)
SELECT vec_id, CAST(d - 1 AS INT) AS dim, round((e[d] - m) / s, 6) AS z, round(e[d], 6) AS back,
       round(((e[d] * s + m) - m * 2) / (s * 2), 6) AS rescaled FROM emb CROSS JOIN st""",
)
def zscore(spark, sf):
    """zscore, inverse_zscore and rescale in one pass."""
    e = embeddings(spark, sf)
    mu, sd = VM.stats_vectors(VM.feature_stats(e, "e"))
    d = e.withColumns({"m": mu, "s": sd})
    m, s = F.col("m"), F.col("s")
    d = d.withColumn("z", V.zscore(F.col("e"), m, s))
    d = d.withColumns({"back": V.inverse_zscore(F.col("z"), m, s), "rescaled": V.rescale(F.col("e"), m, s, V.scale(m, 2), V.scale(s, 2))})
    d = d.select("vec_id", F.posexplode(F.arrays_zip("z", "back", "rescaled")).alias("dim", "v"))
    return d.select("vec_id", "dim", *[F.round(F.col("v")[c], 6).alias(c) for c in ("z", "back", "rescaled")])


@query(
    "compose_stats",
    f"""WITH {EMB_SQL}, st AS (
  SELECT label, d, avg(e[d]) AS m, stddev_pop(e[d]) AS s FROM emb CROSS JOIN (SELECT unnest(range(1, 65)) AS d) GROUP BY 1, 2)
SELECT label * 64 + d - 1 AS dim, round(m, 6) AS mean, round(s, 6) AS std FROM st""",
)
def compose_stats(spark, sf):
    """Blocks: per-label statistics, concatenated in label order."""
    d = embeddings(spark, sf).select("label", F.posexplode("e").alias("i", "v"))
    d = d.groupBy("label", "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    rows = F.array_sort(F.collect_list(F.struct("i", "m", "s")))
    blocks = d.groupBy("label").agg(rows.alias("r")).select(
        F.lit("clip").alias("source"), F.col("label").alias("block"), F.transform("r", lambda x: x["m"]).alias("mean"), F.transform("r", lambda x: x["s"]).alias("std")
    )
    choice = blocks.select("block", "source", F.col("block").alias("position"))
    out = VM.compose_stats(blocks, choice).select(F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "v"))
    return out.select(F.col("dim").cast("long").alias("dim"), F.round("v.mean", 6).alias("mean"), F.round("v.std", 6).alias("std"))


@query(
    "activation_stats",
    f"""WITH {EMB_SQL}, r AS (SELECT unnest(range(1, 65)) AS d)
SELECT CAST(a.d - 1 AS INT) AS i, CAST(b.d - 1 AS INT) AS j, round(covar_samp(e[a.d], e[b.d]), 8) AS cov,
       round(avg(e[a.d]), 8) AS mean_i, round(avg(e[b.d]), 8) AS mean_j
FROM emb CROSS JOIN r a JOIN r b ON a.d <= b.d GROUP BY 1, 2""",
)
def activation_stats(spark, sf):
    d = VM.activation_stats(embeddings(spark, sf), "e")
    return d.select("i", "j", *[F.round(c, 8).alias(c) for c in ("cov", "mean_i", "mean_j")])


def _halves(spark, sf):
    """Rows with a label below the mean label, and the others."""
    e = embeddings(spark, sf)
    mid = e.agg(F.avg("label").alias("m")).scalar()
    d = e.withColumn("low", F.col("label") < mid)
    return d.where("low"), d.where("NOT low")


@query("frechet_distance")
def frechet_distance(spark, sf):
    a, b = _halves(spark, sf)
    return VM.frechet_distance(a, b, "e")


@query(
    "frechet_distance_plane",
    f"""WITH {EMB_SQL}, m AS (SELECT avg(label) AS m FROM emb),
s AS (SELECT label < (SELECT m FROM m) AS low, avg(e[1]) AS x, avg(e[2]) AS y, var_samp(e[1]) AS a, covar_samp(e[1], e[2]) AS b, var_samp(e[2]) AS c FROM emb GROUP BY 1)
SELECT round(power(p.x - q.x, 2) + power(p.y - q.y, 2) + p.a + p.c + q.a + q.c
  - 2 * sqrt(p.a*q.a + 2*p.b*q.b + p.c*q.c + 2 * sqrt((p.a*p.c - p.b*p.b) * (q.a*q.c - q.b*q.b))), 6) AS frechet
FROM s p JOIN s q ON p.low AND NOT q.low""",
)
def frechet_distance_plane(spark, sf):
    """In two dimensions the root of the product of the covariances has a closed form."""
    a, b = (d.withColumn("e", F.slice("e", 1, 2)) for d in _halves(spark, sf))
    return VM.frechet_distance(a, b, "e").select(F.round("frechet", 6).alias("frechet"))


@query(
    "kernel_distance",
    f"""WITH {EMB_SQL}, m AS (SELECT avg(label) AS m FROM emb),
s AS (SELECT CAST(unnest(range(0, 3)) AS INT) AS subset),
a AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY (vec_id * 7919 + subset * 4001) % 10007, vec_id) AS r FROM emb CROSS JOIN s WHERE label < (SELECT m FROM m) QUALIFY r <= 100),
b AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY (vec_id * 7919 + subset * 4001) % 10007, vec_id) AS r FROM emb CROSS JOIN s WHERE label >= (SELECT m FROM m) QUALIFY r <= 100),
ab AS (SELECT *, 0 AS side FROM a UNION ALL SELECT *, 1 FROM b),
k AS (SELECT p.subset, p.side, p.vec_id, p.side = q.side AS own, power(list_inner_product(p.e, q.e) / 64 + 1, 3) AS k FROM ab p JOIN ab q ON p.subset = q.subset AND p.vec_id <> q.vec_id),
f AS (SELECT subset, side, vec_id, sum(k) FILTER (own) AS s, sum(k * k) FILTER (own) AS s2, sum(k) FILTER (NOT own) AS r, sum(k * k) FILTER (NOT own) AS r2 FROM k GROUP BY 1, 2, 3),
t AS (SELECT subset, side, sum(s * s) AS ss, sum(s2) AS q, sum(s) AS s, sum(r * r) AS rr, sum(r2) AS w, sum(r) AS r, sum(s * r) AS sr FROM f GROUP BY 1, 2),
z AS (SELECT subset, sum(s) / 9900 - 2 * max(r) / 10000 AS mmd2,
  sum((ss - q) / 970200 - power(s / 9900, 2) + (rr - w) / 990000 - power(r / 10000, 2) - 2 * sr / 990000 + 2 * s * r / 99000000) AS z1,
  sum(q / 9900 - power(s / 9900, 2) + w / 10000 - power(r / 10000, 2) - 4 * sr / 990000 + 4 * s * r / 99000000) AS z2 FROM t GROUP BY 1),
n AS (SELECT least(count(*) FILTER (label < (SELECT m FROM m)), count(*) FILTER (label >= (SELECT m FROM m))) AS n FROM emb)
SELECT subset, round(mmd2, 8) AS mmd2, round((4 * (n - 2) * z1 + 2 * z2) / (n * (n - 1)), 11) AS variance FROM z CROSS JOIN n""",
)
def kernel_distance(spark, sf):
    a, b = _halves(spark, sf)
    d = VM.kernel_distance(a, b, "vec_id", "e", subsets=3, size=100, key=lambda s: (F.col("vec_id") * 7919 + s * 4001) % 10007)
    return d.select("subset", F.round("mmd2", 8).alias("mmd2"), F.round("variance", 11).alias("variance"))


def _draws(part: str, n: int) -> str:
    return f"""a AS (SELECT * FROM (SELECT label, e, row_number() OVER ({part} ORDER BY {SQL_A}, vec_id) AS k FROM emb) WHERE k <= {n}),
b AS (SELECT * FROM (SELECT label, e, row_number() OVER ({part} ORDER BY {SQL_B}, vec_id) AS k FROM emb) WHERE k <= {n})"""


@query(
    "diversity",
    f"WITH {EMB_SQL}, {_draws('', 300)} SELECT round(avg(list_distance(a.e, b.e)), 6) AS diversity FROM a JOIN b USING (k)",
)
def diversity(spark, sf):
    return VM.diversity(embeddings(spark, sf), "vec_id", "e", 300, key_a(), key_b()).select(F.round("diversity", 6).alias("diversity"))


@query(
    "multimodality",
    f"""WITH {EMB_SQL}, {_draws('PARTITION BY label', 10)}
SELECT round(avg(list_distance(a.e, b.e)), 6) AS multimodality FROM a JOIN b ON a.label = b.label AND a.k = b.k""",
)
def multimodality(spark, sf):
    d = VM.multimodality(embeddings(spark, sf), "label", "vec_id", "e", 10, key_a(), key_b())
    return d.select(F.round("multimodality", 6).alias("multimodality"))


@query(
    "label_diversity",
    f"""WITH {EMB_SQL}, {_draws('PARTITION BY label', 20)},
a2 AS (SELECT e, row_number() OVER (ORDER BY {SQL_A}, vec_id) AS k FROM emb), b2 AS (SELECT e, row_number() OVER (ORDER BY {SQL_B}, vec_id) AS k FROM emb)
SELECT round((SELECT avg(list_distance(a2.e, b2.e)) FROM a2 JOIN b2 USING (k) WHERE k <= 200), 6) AS diversity,
  round((SELECT sum(list_distance(a.e, b.e)) FROM a JOIN b ON a.label = b.label AND a.k = b.k) / (20 * (SELECT count(DISTINCT label) FROM emb)), 6) AS multimodality""",
)
def label_diversity(spark, sf):
    d = VM.label_diversity(embeddings(spark, sf), "label", "vec_id", "e", 200, 20, key_a(), key_b())
    return d.select(F.round("diversity", 6).alias("diversity"), F.round("multimodality", 6).alias("multimodality"))


NEXT_SQL = f"""{EMB_SQL}, pr AS (
  SELECT a.vec_id, a.label, a.e AS t, b.e AS p FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1),
pl AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / 32) AS BIGINT) AS pool FROM pr)"""


def next_pairs(spark, sf):
    """Truth: a row's vector; prediction: that of the next id."""
    e = embeddings(spark, sf)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("p"))
    return e.select("vec_id", "label", F.col("e").alias("t")).join(nxt, "vec_id")


@query(
    "r_precision",
    f"""WITH {NEXT_SQL}, rk AS (
  SELECT a.vec_id AS q, b.vec_id AS x, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.p, b.t), b.vec_id) AS r
  FROM pl a JOIN pl b ON a.pool = b.pool)
SELECT round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS top_1, round(avg(CASE WHEN r <= 2 THEN 1.0 ELSE 0 END), 6) AS top_2,
       round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END), 6) AS top_3 FROM rk WHERE q = x""",
)
def r_precision(spark, sf):
    d = VM.make_pools(next_pairs(spark, sf), "vec_id", 32)
    d = VM.r_precision(d, d, "vec_id", "p", "t", "pool", 3)
    return d.select(*[F.round(f"top_{i}", 6).alias(f"top_{i}") for i in (1, 2, 3)])


@query("matching_score", f"WITH {NEXT_SQL} SELECT round(avg(list_distance(p, t)), 6) AS matching_score FROM pr")
def matching_score(spark, sf):
    return VM.matching_score(next_pairs(spark, sf), "p", "t").select(F.round("matching_score", 6).alias("matching_score"))


@query(
    "reconstruction_report",
    f"""WITH {NEXT_SQL}, runs AS (SELECT CAST(unnest(range(0, 3)) AS INT) AS run),
tri AS (SELECT pr.vec_id, t, p, [0.75 * t[x] + 0.25 * n.e[x] FOR x IN range(1, 65)] AS c FROM pr JOIN emb n ON n.vec_id = pr.vec_id + 2),
o AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY run ORDER BY (vec_id * 7919 + run * 4001) % 10007, vec_id) - 1) / 32) AS BIGINT) AS pool,
  row_number() OVER (PARTITION BY run ORDER BY (vec_id * 104729 + run * 31) % 10009, vec_id) AS ka,
  row_number() OVER (PARTITION BY run ORDER BY (vec_id * 611953 + run * 17) % 10037, vec_id) AS kb FROM tri CROSS JOIN runs),
rk AS (SELECT a.run, a.vec_id AS q, b.vec_id AS x, list_distance(a.c, b.t) AS dt, list_distance(a.c, b.p) AS dp,
  row_number() OVER (PARTITION BY a.run, a.vec_id ORDER BY list_distance(a.c, b.t), b.vec_id) AS rt,
  row_number() OVER (PARTITION BY a.run, a.vec_id ORDER BY list_distance(a.c, b.p), b.vec_id) AS rp FROM o a JOIN o b ON a.run = b.run AND a.pool = b.pool),
own AS (SELECT * FROM rk WHERE q = x), ks AS (SELECT unnest(range(1, 4)) AS i),
v AS (SELECT run, 'matching_real' AS metric, avg(dt) AS value FROM own GROUP BY run
  UNION ALL SELECT run, 'matching_pred', avg(dp) FROM own GROUP BY run
  UNION ALL SELECT run, 'r_precision_' || i || '_real', avg(CASE WHEN rt <= i THEN 1.0 ELSE 0 END) FROM own CROSS JOIN ks GROUP BY run, i
  UNION ALL SELECT run, 'r_precision_' || i || '_pred', avg(CASE WHEN rp <= i THEN 1.0 ELSE 0 END) FROM own CROSS JOIN ks GROUP BY run, i
  UNION ALL SELECT a.run, 'diversity_real', avg(list_distance(a.t, b.t)) FROM o a JOIN o b ON a.run = b.run AND a.ka = b.kb WHERE a.ka <= 300 GROUP BY a.run
  UNION ALL SELECT a.run, 'diversity_pred', avg(list_distance(a.p, b.p)) FROM o a JOIN o b ON a.run = b.run AND a.ka = b.kb WHERE a.ka <= 300 GROUP BY a.run)
SELECT metric, round(avg(value), 6) AS mean, round(1.96 * stddev_pop(value) / sqrt(count(*)), 6) AS ci FROM v GROUP BY metric""",
)
def reconstruction_report(spark, sf):
    """Real and predicted vectors against a condition between them; the Fréchet distance has a query of its own."""
    from kinetable.functions import vectors as V

    e = embeddings(spark, sf).select((F.col("vec_id") - 2).alias("vec_id"), F.col("e").alias("n"))
    d = next_pairs(spark, sf).join(e, "vec_id").withColumn("c", V.zip_map(F.col("t"), F.col("n"), lambda t, n: 0.75 * t + 0.25 * n))
    key = lambda m, k, p: lambda run: (F.col("vec_id") * m + run * k) % p
    place = key(7919, 4001, 10007)
    d = VM.reconstruction_report(
        d, "vec_id", "t", "p", "c", runs=3, frechet=False, order=(place, lambda run: F.floor(place(run) / 128)),
        draws=(key(104729, 31, 10009), key(611953, 17, 10037)),
    )
    return d.select("metric", F.round("mean", 6).alias("mean"), F.round("ci", 6).alias("ci"))


@query(
    "code_perplexity",
    f"""WITH {ASSIGN_SQL}, c AS (SELECT count(*) / sum(count(*)) OVER () AS p FROM asg GROUP BY code)
SELECT round(exp(-sum(p * ln(p + 1e-7))), 6) AS perplexity FROM c""",
)
def code_perplexity(spark, sf):
    return VM.code_perplexity(assigned(spark, sf), "code").select(F.round("perplexity", 6).alias("perplexity"))


@query(
    "codebook_ema_step",
    f"""WITH {ASSIGN_SQL}, n AS (SELECT code, i, sum(e[i]) AS s, count(*) AS n FROM asg CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
u AS (SELECT book.code, i, 0.5 * c[i] + 0.5 * coalesce(s, 0) AS cs, 0.5 + 0.5 * coalesce(n, 0) AS cc
  FROM book CROSS JOIN (SELECT unnest(range(1, 65)) AS i) LEFT JOIN n USING (code, i))
SELECT code, CAST(i - 1 AS INT) AS i, round(cs, 6) AS code_sum, round(cc::DOUBLE, 6) AS code_count, round(CASE WHEN cc >= 1 THEN cs / cc END, 6) AS value FROM u""",
)
def codebook_ema_step(spark, sf):
    state = centroids(spark, sf).select("code", F.col("vec").alias("code_sum"), F.lit(1.0).alias("code_count"))
    d = VM.codebook_ema_step(assigned(spark, sf).select("code", "e"), state, "e", 0.5)
    return d.select(F.col("code").cast("int").alias("code"), "i", *[F.round(c, 6).alias(c) for c in ("code_sum", "code_count", "value")])


@query(
    "codebook_reseed",
    f"""WITH {ASSIGN_SQL}, used AS (SELECT vec_id, code, e FROM asg WHERE code % 3 <> 0), n AS (SELECT code, i, sum(e[i]) AS s, count(*) AS n FROM used CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
seed AS (SELECT code, e FROM (SELECT code, row_number() OVER (ORDER BY code) AS r FROM book) JOIN (SELECT e, row_number() OVER (ORDER BY {SQL_A}, vec_id) AS r FROM used) USING (r)),
u AS (SELECT book.code, i, 0.5 * c[i] + 0.5 * coalesce(s, 0) AS cs, 0.5 + 0.5 * coalesce(n, 0) AS cc, seed.e[i] AS fresh
  FROM book CROSS JOIN (SELECT unnest(range(1, 65)) AS i) LEFT JOIN n USING (code, i) LEFT JOIN seed USING (code))
SELECT code, CAST(i - 1 AS INT) AS i, cc < 1 AS reseeded, round(CASE WHEN cc >= 1 THEN cs / cc ELSE fresh END, 6) AS value FROM u""",
)
def codebook_reseed(spark, sf):
    """A third of the codes gets no rows, falls below one and starts again from drawn vectors."""
    codes = centroids(spark, sf)
    state = codes.select("code", F.col("vec").alias("code_sum"), F.lit(1.0).alias("code_count"))
    used = assigned(spark, sf).where("code % 3 <> 0")
    d = VM.codebook_ema_step(used.select("code", "e"), state, "e", 0.5, VM.reseed_vectors(codes.select("code"), used, "vec_id", "e", key_a()))
    return d.select(F.col("code").cast("int").alias("code"), "i", (F.col("code_count") < 1).alias("reseeded"), F.round("value", 6).alias("value"))


@query(
    "commit_loss",
    f"WITH {ASSIGN_SQL} SELECT round(avg(d * d) / 64, 8) AS commit_loss FROM asg",
)
def commit_loss(spark, sf):
    d = assigned(spark, sf).join(centroids(spark, sf), "code")
    return VM.commit_loss(d, "e", "vec").select(F.round("commit_loss", 8).alias("commit_loss"))


@query(
    "recon_loss",
    f"""WITH {NEXT_SQL}, x AS (SELECT abs(p[i] - t[i]) AS d, i FROM pr CROSS JOIN (SELECT unnest(range(1, 48)) AS i))
SELECT round(avg(d), 8) AS l1, round(avg(d * d), 8) AS l2, round(avg(CASE WHEN d < 1 THEN 0.5 * d * d ELSE d - 0.5 END), 8) AS l1_smooth,
  round(avg(d) FILTER (i > 4 AND i <= 13), 8) AS l1_velocity FROM x""",
)
def recon_loss(spark, sf):
    """All kinds on a 4-joint layout, which fits the 64 entries."""
    d = next_pairs(spark, sf)
    out = VM.recon_loss(d, "p", "t", "l1", 4).select(F.round("loss", 8).alias("l1"))
    for name, kind, vel in (("l2", "l2", False), ("l1_smooth", "l1_smooth", False), ("l1_velocity", "l1", True)):
        out = out.withColumn(name, F.round(VM.recon_loss(d, "p", "t", kind, 4, vel).scalar(), 8))
    return out


@query(
    "kl_report",
    f"""WITH {NEXT_SQL}, x AS (SELECT vec_id, p[i] AS m, t[i] AS lv FROM pr CROSS JOIN (SELECT unnest(range(1, 65)) AS i))
SELECT round(-0.5 * avg(1 + lv - m * m - exp(lv)), 8) AS kl,
  round(sum(0.5 * ((m - lv) * (m - lv) / exp(m) + exp(lv - m) - 1 - lv + m)) / count(DISTINCT vec_id), 6) AS kl_pair,
  round(sum(0.5 * (ln(2 * pi()) + lv + (m - lv) * (m - lv) / exp(lv))) / count(DISTINCT vec_id), 6) AS nll FROM x""",
)
def kl_report(spark, sf):
    d = next_pairs(spark, sf)
    p, t = F.col("p"), F.col("t")
    pair = d.agg(F.avg(VM.gaussian_kl(p, t, t, p)).alias("v")).scalar()
    nll = d.agg(F.avg(VM.gaussian_nll(p, t, t)).alias("v")).scalar()
    return VM.kl_report(d, "p", "t").select(F.round("kl", 8).alias("kl"), F.round(pair, 6).alias("kl_pair"), F.round(nll, 6).alias("nll"))


@query("pca")
def pca(spark, sf):
    d = VM.pca(embeddings(spark, sf), "e", 2)
    return d.select("vec_id", F.round(F.get("pc", F.lit(0)), 6).alias("pc1"), F.round(F.get("pc", F.lit(1)), 6).alias("pc2"))


@query(
    "pca_plane",
    f"""WITH {EMB_SQL}, v AS (SELECT var_samp(e[1]) AS a, covar_samp(e[1], e[2]) AS b, var_samp(e[2]) AS c FROM emb),
w AS (SELECT (a + c) / 2 AS m, sqrt(power((a - c) / 2, 2) + b * b) AS r FROM v)
SELECT round(m + r, 6) AS var1, round(m - r, 6) AS var2, 0.0::DOUBLE AS cov FROM w""",
)
def pca_plane(spark, sf):
    """The axes of a plane have the eigenvalues as variances and do not covary."""
    pc = [F.get("pc", F.lit(i)) for i in range(2)]
    d = VM.pca(embeddings(spark, sf).withColumn("e", F.slice("e", 1, 2)), "e", 2)
    cov = F.round(F.covar_samp(*pc), 6) + 0.0
    return d.agg(F.round(F.var_samp(pc[0]), 6).alias("var1"), F.round(F.var_samp(pc[1]), 6).alias("var2"), F.when(cov == 0, 0.0).otherwise(cov).alias("cov"))


@query(
    "label_scatter_summary",
    f"""WITH {EMB_SQL} SELECT label, count(*) AS n, round(avg(e[1]), 6) AS x_mean, round(stddev_pop(e[1]), 6) AS x_std,
  round(avg(e[2]), 6) AS y_mean, round(stddev_pop(e[2]), 6) AS y_std FROM emb GROUP BY 1""",
)
def label_scatter_summary(spark, sf):
    d = VM.label_scatter_summary(embeddings(spark, sf), "label", {"x": F.get("e", F.lit(0)), "y": F.get("e", F.lit(1))})
    return d.select("label", "n", *[F.round(c, 6).alias(c) for c in ("x_mean", "x_std", "y_mean", "y_std")])


@query(
    "metric_set",
    f"""WITH {NEXT_SQL}, x AS (SELECT avg(list_distance(p, t)) AS d, avg(list_distance(p, t) * list_distance(p, t)) / 64 AS m FROM pr)
SELECT round(d, 6) AS dist, round(m, 8) AS mse, round(d * 1.0, 6) AS dist_weighted, round(m * 0.5, 8) AS mse_weighted, round(d + m * 0.5, 6) AS total FROM x""",
)
def metric_set(spark, sf):
    ms = VM.MetricSet().add("dist", lambda p, t: F.avg(V.distance(p, t)), 1.0, ("p", "t"))
    ms.add("mse", lambda p, t: F.sum(V.sq_distance(p, t)) / F.sum(F.size(p)), 0.5, ("p", "t")).add("off", lambda p: F.max(p), 1.0, ("absent",), False)
    d = ms.compute(next_pairs(spark, sf))
    digits = {"dist": 6, "mse": 8, "dist_weighted": 6, "mse_weighted": 8, "total": 6}
    return d.select(*[F.round(c, n).alias(c) for c, n in digits.items()])
