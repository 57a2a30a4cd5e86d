"""Pairings, lookups, as-of joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.operators import frames as FR
from kinetable.operators import joins as J
from kinetable.operators import resample as RS
from kinetable.operators.blocks import Seq
from kinetable.operators.tracks import align_person_timelines as align_timelines
from kinetable.operators.tracks import reidentify as reident
from kinetable.plans.base import EV, EV_SQL, OFF_TIE, event_track, events
from kinetable.plans.q_filters import BOX_SQL, boxes
from kinetable.plans.registry import query, table


@query(
    "pair_body_face",
    """SELECT o_orderkey, conv_id, CAST(o_orderkey AS VARCHAR) AS pair FROM orders JOIN (SELECT DISTINCT conv_id FROM conversations) ON conv_id = o_orderkey""",
)
def pair_body_face(spark, sf):
    b = table(spark, sf, "orders").select("o_orderkey", F.concat("o_orderkey", F.lit("_body.npz")).alias("bn"))
    f = table(spark, sf, "conversations").select("conv_id").distinct().withColumn("fn", F.concat("conv_id", F.lit("_face.npz")))
    return J.pair_body_face(b, f, "bn", "fn").select("o_orderkey", "conv_id", "pair")


@query(
    "merge_with_defaults",
    "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
)
def merge_with_defaults(spark, sf):
    return J.merge_with_defaults(
        table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"], {"quality": F.lit(-1), "toxic": F.lit(0)}
    )


#: Faces and bodies: purchases and views of a user on the same day.
COST_SQL = """f AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS frame, event_id % 3 AS face, avg(value) AS x FROM events WHERE event_type = 'purchase' GROUP BY 1, 2, 3),
b AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS frame, event_id % 4 AS body, avg(value) AS y FROM events WHERE event_type = 'view' GROUP BY 1, 2, 3),
cost AS (SELECT user_id, face, body, avg(abs(x - y)) AS cost FROM f JOIN b USING (user_id, frame) GROUP BY 1, 2, 3)"""


def cost_table(spark, sf):
    e = events(spark, sf).withColumn("frame", F.floor(F.unix_micros("ts") / F.lit(86_400_000_000)))
    f = e.where("event_type = 'purchase'").groupBy("user_id", "frame", (F.col("event_id") % 3).alias("face")).agg(F.avg("value").alias("x"))
    b = e.where("event_type = 'view'").groupBy("user_id", "frame", (F.col("event_id") % 4).alias("body")).agg(F.avg("value").alias("y"))
    zero = F.lit(0.0)
    cost = J.landmark_cost([(F.col("x"), zero)], [(F.col("y"), zero)])
    return J.face_body_cost(f, b, ["user_id"], "frame", "face", "body", cost)


@query("face_body_cost", f"WITH {COST_SQL} SELECT user_id, face, body, round(cost + {OFF_TIE}, 4) AS cost FROM cost")
def face_body_cost(spark, sf):
    return cost_table(spark, sf).withColumn("cost", F.round(F.col("cost") + OFF_TIE, 4))


#: All ways to give each face a free body or none, three faces at most.
ASSIGN_SQL = f"""WITH RECURSIVE {COST_SQL},
fa AS (SELECT user_id, face, row_number() OVER (PARTITION BY user_id ORDER BY face) AS k FROM (SELECT DISTINCT user_id, face FROM cost)),
opt AS (SELECT user_id, face, body, cost FROM cost UNION ALL SELECT DISTINCT user_id, face, NULL, 0.0 FROM cost),
ways AS (
  SELECT DISTINCT user_id, 0::BIGINT AS k, []::BIGINT[] AS used, []::STRUCT(face BIGINT, body BIGINT, cost DOUBLE)[] AS pairs, 0.0::DOUBLE AS total FROM fa
  UNION ALL
  SELECT w.user_id, fa.k, CASE WHEN o.body IS NULL THEN used ELSE list_append(used, o.body) END,
         CASE WHEN o.body IS NULL THEN pairs ELSE list_append(pairs, {{'face': o.face, 'body': o.body, 'cost': o.cost}}) END, total + o.cost
  FROM ways w JOIN fa ON fa.user_id = w.user_id AND fa.k = w.k + 1 JOIN opt o ON o.user_id = fa.user_id AND o.face = fa.face
  WHERE o.body IS NULL OR NOT list_contains(used, o.body)),
best AS (
  SELECT user_id, pairs FROM ways WHERE (user_id, k) IN (SELECT user_id, max(k) FROM fa GROUP BY 1)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY len(pairs) DESC, total) = 1)
SELECT user_id, p.face AS face, p.body AS body, round(p.cost + {OFF_TIE}, 4) AS cost FROM (SELECT user_id, unnest(pairs) AS p FROM best)"""


@query("assign_min_cost", ASSIGN_SQL)
def assign_min_cost(spark, sf):
    d = J.assign_min_cost(cost_table(spark, sf), ["user_id"], "face", "body")
    return d.withColumn("cost", F.round(F.col("cost") + OFF_TIE, 4))


@query(
    "attach_captions",
    "SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)",
)
def attach_captions(spark, sf):
    return J.attach_captions(table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"])


@query("missing_sources", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_sources(spark, sf):
    return J.missing_sources(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query(
    "not_treated",
    """SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)
AND lower(trim(p_name)) NOT IN (SELECT lower(trim(p_name)) FROM part WHERE p_size = 1 AND p_type = 'ECONOMY')""",
)
def not_treated(spark, sf):
    p = table(spark, sf, "part")
    ids = table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"), F.lit(None).cast("string").alias("p_name"))
    titles = p.where("p_size = 1 AND p_type = 'ECONOMY'").select(F.lit(None).cast("long").alias("p_partkey"), "p_name")
    return J.not_treated(p.select("p_partkey", "p_name"), ids.unionByName(titles), "p_partkey", "p_name")


@query(
    "vocab_lookup",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents),
v AS (SELECT word, CAST(sum(quality) AS DOUBLE) AS q FROM w JOIN labels USING (doc_id) GROUP BY 1),
u AS (SELECT avg(q) AS q FROM v)
SELECT doc_id, count(*) AS n, round(sum(coalesce(v.q, u.q)), 4) AS q FROM w LEFT JOIN v USING (word) CROSS JOIN u GROUP BY 1""",
)
def vocab_lookup(spark, sf):
    """Vocabulary: words of labelled documents with their summed quality."""
    from kinetable.functions.text import words

    w = table(spark, sf, "documents").select("doc_id", F.explode(words(F.col("text"))).alias("word"))
    v = w.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").groupBy("word").agg(F.sum("quality").cast("double").alias("q"))
    unk = v.agg(F.lit("<unk>").alias("word"), F.array(F.avg("q")).alias("vec"))
    vocab = v.select("word", F.array("q").alias("vec")).unionByName(unk)
    d = J.vocab_lookup(w, vocab, "word", "<unk>")
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("vec", F.lit(0))), 4).alias("q"))


@query(
    "vip_tag",
    """WITH v AS (SELECT p_name AS word, p_type AS class, p_size AS rank FROM part WHERE p_brand = 'Brand#2'),
b AS (SELECT word, class FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY rank, class) AS r FROM v) WHERE r = 1)
SELECT p_partkey, coalesce(b.class, CASE WHEN k.word IS NOT NULL THEN p_brand END, 'OTHER') AS class
FROM part LEFT JOIN b ON b.word = p_name LEFT JOIN (SELECT DISTINCT p_name AS word FROM part WHERE p_size < 3) k ON k.word = p_name""",
)
def vip_tag(spark, sf):
    p = table(spark, sf, "part")
    vip = p.where("p_brand = 'Brand#2'").select(F.col("p_name").alias("word"), F.col("p_type").alias("class"), F.struct("p_size", "p_type").alias("rank"))
    known = p.where("p_size < 3").select(F.col("p_name").alias("word"))
    return J.vip_tag(p.select("p_partkey", "p_name", "p_brand"), vip, "p_name", "p_brand", known).select("p_partkey", "class")


@query(
    "best_overlap",
    f"""WITH {BOX_SQL}, a AS (SELECT l_orderkey AS f, l_linenumber AS i, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM bx GROUP BY 1, 2),
p AS (SELECT a.f, a.i, b.i AS j, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS n,
  (a.x2-a.x1)*(a.y2-a.y1) AS s, (b.x2-b.x1)*(b.y2-b.y1) AS t FROM a JOIN a b ON a.f = b.f AND a.i < b.i),
q AS (SELECT f, i, j, CASE WHEN s + t - n > 0 THEN n / (s + t - n) ELSE 0 END AS iou FROM p)
SELECT f AS scene, i AS a_id, j AS b_id, round(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY f, i ORDER BY iou DESC, j) AS r FROM q WHERE iou >= 0.3) WHERE r = 1""",
)
def best_overlap(spark, sf):
    """Best later line of the same order for every line's box."""
    d = boxes(spark, sf).groupBy(F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("id")).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")
    )
    c = ["x1", "y1", "x2", "y2"]
    a = d.select("scene", F.col("id").alias("a_id"), *[F.col(x).alias(f"a{x}") for x in c])
    b = d.select("scene", F.col("id").alias("b_id"), *[F.col(x).alias(f"b{x}") for x in c])
    later = a.join(b, "scene").where("a_id < b_id")
    right = later.select("scene", "a_id", "b_id", *[f"b{x}" for x in c])
    out = J.best_overlap(a, right, ["scene", "a_id"], "a_id", "b_id", [f"a{x}" for x in c], [f"b{x}" for x in c], 0.3)
    return out.select("scene", "a_id", "b_id", F.round("iou", 6).alias("iou"))


@query(
    "compact_scenes",
    """SELECT o_custkey, count(*) AS records, min(o_orderkey) AS first, max(o_orderkey) AS last, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
)
def compact_scenes(spark, sf):
    d = J.compact_scenes(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], ["o_totalprice"], F.floor(F.col("o_orderkey") / 1_000_000))
    r = F.col("records")
    tot = F.aggregate(r, F.lit(0.0), lambda a, x: a + x["o_totalprice"])
    return d.select("o_custkey", F.size(r).cast("long").alias("records"), r[0]["o_orderkey"].alias("first"), F.element_at(r, -1)["o_orderkey"].alias("last"), F.round(tot, 2).alias("total"))


@query("verify_keys", "SELECT o_orderkey FROM orders EXCEPT ALL SELECT DISTINCT l_orderkey FROM lineitem")
def verify_keys(spark, sf):
    return J.verify_keys(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select("l_orderkey").distinct())


@query(
    "union_flags",
    "SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day FROM events WHERE value > 150 UNION SELECT user_id, CAST(ts AS DATE)::VARCHAR FROM events WHERE event_type = 'error'",
)
def union_flags(spark, sf):
    e = events(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return J.union_flags(e.where("value > 150").select("user_id", "day"), e.where("event_type = 'error'").select("user_id", "day"))


@query(
    "combine_datasets",
    "SELECT dataset, fps, count(*) AS n FROM (SELECT 'a' AS dataset, 30.0::DOUBLE AS fps FROM orders UNION ALL SELECT 'b', 20.0::DOUBLE FROM lineitem) GROUP BY 1, 2",
)
def combine_datasets(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return J.combine_datasets({"a": (a, 30.0), "b": (b, 20.0)}).groupBy("dataset", "fps").agg(F.count(F.lit(1)).alias("n"))


@query(
    "quarantine",
    """SELECT coalesce(reason, 'good') AS reason, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 5 OR l_quantity IS NULL THEN 'short'
  WHEN l_discount >= 0.09 OR l_discount IS NULL THEN 'corrupt' END AS reason FROM lineitem) GROUP BY 1""",
)
def quarantine(spark, sf):
    good, bad = J.quarantine(table(spark, sf, "lineitem"), {"short": F.col("l_quantity") < 5, "corrupt": F.col("l_discount") >= 0.09})
    d = bad.select("reason").unionByName(good.select(F.lit("good").alias("reason")))
    return d.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("target_grid", "SELECT user_id, i, i / 30.0::DOUBLE AS t FROM (SELECT user_id, floor((max(value) / 100 + 1e-9) * 30) AS n FROM events GROUP BY 1), LATERAL (SELECT unnest(range(0, CAST(n AS BIGINT) + 1)) AS i)")
def target_grid(spark, sf):
    d = events(spark, sf).groupBy("user_id").agg((F.max("value") / 100).alias("last"))
    return RS.target_grid(d, ["user_id"], "last", 30.0)


SRC_SQL = """src AS (SELECT user_id, epoch(ts) - 1704067200 AS t, value, event_type FROM events WHERE event_type IN ('view', 'click', 'error')),
dst AS (SELECT user_id, event_id, epoch(ts) - 1704067200 AS t FROM events WHERE event_type IN ('purchase', 'signup'))"""


def sides(spark, sf):
    e = events(spark, sf).withColumn("t", F.unix_micros("ts") / 1e6 - 1704067200)
    src = e.where(F.col("event_type").isin("view", "click", "error")).select("user_id", "ts", "event_id", "t", "value", "event_type")
    return src, e.where(F.col("event_type").isin("purchase", "signup")).select("user_id", "event_id", "t")


@query(
    "asof_nearest",
    f"""WITH {SRC_SQL}
SELECT dst.user_id, dst.event_id, CASE WHEN b.t IS NULL OR dst.t - a.t <= b.t - dst.t THEN a.event_type ELSE b.event_type END AS event_type
FROM dst ASOF LEFT JOIN src a ON a.user_id = dst.user_id AND dst.t >= a.t ASOF LEFT JOIN src b ON b.user_id = dst.user_id AND dst.t <= b.t""",
)
def asof_nearest(spark, sf):
    src, dst = sides(spark, sf)
    d = RS.asof_nearest(src, dst, ["user_id"], "t", ["event_type"], 86400.0 * 7)
    return d.select("user_id", "event_id", "event_type")


@query(
    "asof_linear",
    f"""WITH {SRC_SQL}, s2 AS (SELECT *, lag(t) OVER w AS tp, lag(value) OVER w AS vp, lead(t) OVER w AS tn, lead(value) OVER w AS vn FROM src WINDOW w AS (PARTITION BY user_id ORDER BY t)),
j AS (SELECT dst.user_id, dst.event_id, dst.t, CASE WHEN b.t IS NULL THEN a.tp WHEN a.t IS NULL THEN b.t ELSE a.t END AS t0,
  CASE WHEN b.t IS NULL THEN a.vp WHEN a.t IS NULL THEN b.value ELSE a.value END AS v0,
  CASE WHEN b.t IS NULL THEN a.t WHEN a.t IS NULL THEN b.tn ELSE b.t END AS t1,
  CASE WHEN b.t IS NULL THEN a.value WHEN a.t IS NULL THEN b.vn ELSE b.value END AS v1
FROM dst ASOF LEFT JOIN s2 a ON a.user_id = dst.user_id AND dst.t >= a.t ASOF LEFT JOIN s2 b ON b.user_id = dst.user_id AND dst.t <= b.t)
SELECT user_id, event_id, round(v0 + (v1 - v0) * CASE WHEN t1 <> t0 THEN (t - t0) / (t1 - t0) ELSE 0 END, 4) AS value FROM j""",
)
def asof_linear(spark, sf):
    from kinetable.operators.blocks import number_rows

    src, dst = sides(spark, sf)
    src = number_rows(src, ["user_id"], ["ts", "event_id"], F.floor(F.col("t") / 86400)).drop("ts", "event_id")
    d = RS.asof_linear(src, dst, Seq(("user_id",), "pos"), "t", ["value"], 86400.0 * 7)
    return d.select("user_id", "event_id", F.round("value", 4).alias("value"))


@query(
    "reidentify",
    f"""WITH {EV_SQL}, b AS (SELECT user_id, pos, value AS x, value % 7 AS y, value + 10 AS w, 5 + value % 11 AS h FROM ev),
p AS (SELECT *, lag(x) OVER q AS x0, lag(y) OVER q AS y0, lag(w) OVER q AS w0, lag(h) OVER q AS h0 FROM b WINDOW q AS (PARTITION BY user_id ORDER BY pos)),
i AS (SELECT *, greatest(0, least(x + w, x0 + w0) - greatest(x, x0)) * greatest(0, least(y + h, y0 + h0) - greatest(y, y0)) AS n FROM p),
k AS (SELECT *, CASE WHEN x0 IS NULL THEN 0 WHEN n / (w*h + w0*h0 - n) < 0.3 OR NOT (w*h / (w0*h0) BETWEEN 0.66 AND 1.5) THEN 1 ELSE 0 END AS brk FROM i)
SELECT user_id, pos, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) AS part FROM k""",
)
def reidentify(spark, sf):
    v = F.col("value")
    d = event_track(spark, sf, "value").select("user_id", "pos", v.alias("x"), (v % 7).alias("y"), (v + 10).alias("w"), (5 + v % 11).alias("h"))
    return reident(d, EV, ["x", "y", "w", "h"]).select("user_id", "pos", "part")


@query(
    "align_person_timelines",
    """WITH d AS (SELECT conv_id, role, turn, length(text) AS n FROM conversations), g AS (SELECT conv_id, min(turn) AS a, max(turn) AS z FROM d GROUP BY 1),
f AS (SELECT conv_id, role, t AS turn FROM (SELECT DISTINCT conv_id, role FROM d) JOIN g USING (conv_id), LATERAL (SELECT unnest(range(a, z + 1)) AS t))
SELECT f.conv_id, f.role, f.turn, coalesce(n, 0) AS n, d.n IS NOT NULL AS detected FROM f LEFT JOIN d USING (conv_id, role, turn)""",
)
def align_person_timelines(spark, sf):
    d = table(spark, sf, "conversations").select("conv_id", "role", "turn", F.length("text").cast("long").alias("n"))
    return align_timelines(d, ["conv_id"], "role", "turn", {"n": F.lit(0).cast("long")})


@query("pad_to", f"""WITH {EV_SQL}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1)
SELECT e.user_id, f AS out_frame, e.value + 0.0 AS value, f < n AS is_valid FROM ev e JOIN n USING (user_id) CROSS JOIN (SELECT unnest(range(0, 100)) AS f) WHERE e.pos = least(f, n - 1)""")
def pad_to(spark, sf):
    """Clips of 100 rows; users with more events give their first 100."""
    return FR.pad_to(event_track(spark, sf, "value"), ["user_id"], "pos", 100, cut=True).select("user_id", "out_frame", "value", "is_valid")


@query("loop_to", f"""WITH {EV_SQL}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1)
SELECT e.user_id, f AS out_frame, e.value + 0.0 AS value FROM ev e JOIN n USING (user_id) CROSS JOIN (SELECT unnest(range(0, 100)) AS f) WHERE f % n = e.pos""")
def loop_to(spark, sf):
    return FR.loop_to(event_track(spark, sf, "value"), ["user_id"], "pos", 100).select("user_id", "out_frame", "value")


@query("length_mask", """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, f AS frame, f < n AS is_valid FROM n CROSS JOIN (SELECT unnest(range(0, 80)) AS f)""")
def length_mask(spark, sf):
    n = events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return FR.length_mask(n, ["user_id"], "n", 80)


@query("chunk", f"""WITH {EV_SQL}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1), c AS (SELECT user_id, k FROM n, LATERAL (SELECT unnest(range(0, n)) AS k) WHERE k * 12 + 16 <= n)
SELECT e.user_id, e.pos, c.k AS chunk, e.pos - c.k * 12 AS chunk_frame FROM ev e JOIN c ON c.user_id = e.user_id AND e.pos >= c.k * 12 AND e.pos < c.k * 12 + 16""")
def chunk(spark, sf):
    d = FR.chunk(event_track(spark, sf), ["user_id"], "pos", 16, 4)
    return d.select("user_id", "pos", "chunk", "chunk_frame")


@query("crop_window", f"""WITH {EV_SQL}, n AS (SELECT user_id, (user_id * 7919) % (count(*) - 32 + 1) AS s, count(*) AS n FROM ev GROUP BY 1 HAVING count(*) >= 32)
SELECT e.user_id, e.pos, e.pos - s AS crop_frame FROM ev e JOIN n ON n.user_id = e.user_id AND e.pos >= s AND e.pos < s + 32""")
def crop_window(spark, sf):
    return FR.crop_window(event_track(spark, sf), ["user_id"], "pos", 32, F.col("user_id") * 7919)


@query("renumber_segments", """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number FROM orders""")
def renumber_segments(spark, sf):
    d = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("s"))
    d = FR.renumber_segments(d, ["o_custkey"], "s", F.year("s"), ["o_orderkey"])
    return d.select("o_custkey", "o_orderkey", "number")


@query("assign_video_numbers", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + (SELECT max(c_custkey) FROM customer) AS number FROM orders""")
def assign_video_numbers(spark, sf):
    new = table(spark, sf, "orders").select("o_orderkey")
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("number"))
    return FR.assign_video_numbers(new, old, "number", ["o_orderkey"], F.floor(F.col("o_orderkey") / (1 << 20)))


@query("interval_stamp", """SELECT l_orderkey, l_linenumber, l_partkey, round(l_linenumber / 25.0 + l_quantity, 6) AS start_s, round((l_linenumber + 7) / 25.0 + l_quantity, 6) AS end_s FROM lineitem""")
def interval_stamp(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_linenumber") + 7).alias("z"))
    d = FR.interval_stamp(d, "l_linenumber", "z", F.lit(25.0), F.col("l_quantity"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))
