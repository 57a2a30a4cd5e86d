"""Filters, predicates and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions import camera as C
from kinetable.functions import vectors as V
from kinetable.operators import filters as FI
from kinetable.operators import kinematics as K
from kinetable.operators.blocks import Seq
from kinetable.plans.base import EMB_SQL, EV_SQL, JOINT_SQL, OFF_TIE, embeddings, event_track, events, joint_table
from kinetable.plans.registry import query, table

#: Lines as boxes: position from quantity and tax, size from price parts.
BOX_SQL = """bx AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x1, round(l_tax * 100) AS y1,
    l_quantity + l_linenumber * 10 AS x2, round(l_tax * 100) + l_suppkey % 50 AS y2 FROM lineitem)"""


def boxes(spark, sf):
    d = table(spark, sf, "lineitem")
    y = F.round(F.col("l_tax") * 100)
    return d.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x1"), y.alias("y1"),
        (F.col("l_quantity") + F.col("l_linenumber") * 10).alias("x2"), (y + F.col("l_suppkey") % 50).alias("y2"),
    )


@query("min_duration", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity - l_linenumber >= 4.0")
def min_duration(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return FI.min_duration(d, "l_linenumber", "l_quantity", 4.0)


@query("drop_short_segments", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= floor((20 + l_linenumber) * 2.0)")
def drop_short_segments(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return FI.drop_short_segments(d, "l_quantity", 20 + F.col("l_linenumber"), 2.0)


@query("min_length_gate", "SELECT user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 64)")
def min_length_gate(spark, sf):
    return FI.min_length_gate(events(spark, sf).select("user_id", "event_id"), ["user_id"], 64)


@query(
    "nan_gate",
    """SELECT user_id, event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value >= 250)""",
)
def nan_gate(spark, sf):
    """Values of 250 and more become NaN first."""
    d = events(spark, sf).select("user_id", "event_id", F.array(F.when(F.col("value") >= 250, F.lit(float("nan"))).otherwise(F.col("value"))).alias("vec"))
    return FI.nan_gate(d, ["user_id"], V.has_nan(F.col("vec"))).select("user_id", "event_id")


@query("finite_filter", "SELECT event_id FROM events WHERE value > 10")
def finite_filter(spark, sf):
    """log of a shifted value is NaN or infinite at and below 10."""
    x = F.when(F.col("value") == 10, F.lit(float("inf"))).when(F.col("value") < 10, F.lit(float("nan"))).otherwise(F.col("value"))
    return FI.finite_filter(events(spark, sf).select("event_id", x.alias("x")), "x").select("event_id")


@query(
    "track_conf_gate",
    f"""WITH {EMB_SQL} SELECT label, round(avg(abs(e[i])), 6) AS mean_conf FROM emb CROSS JOIN (SELECT unnest(range(1, 65)) AS i)
GROUP BY 1 HAVING avg(abs(e[i])) >= 0.0995""",
)
def track_conf_gate(spark, sf):
    conf = F.transform("e", lambda v: F.abs(v))
    d = FI.track_conf_gate(embeddings(spark, sf), ["label"], conf, 0.0995)
    return d.select("label", F.round("mean_conf", 6).alias("mean_conf"))


@query("low_conf_frames", f"WITH {EMB_SQL} SELECT vec_id, list_sum(list_transform(e, lambda v: abs(v))) / 64 < 0.1 AS low_conf FROM emb")
def low_conf_frames(spark, sf):
    d = FI.low_conf_frames(embeddings(spark, sf), F.transform("e", lambda v: F.abs(v)), 0.1)
    return d.select("vec_id", "low_conf")


@query(
    "static_clip_filter",
    f"""WITH {EV_SQL}, s AS (SELECT user_id, abs(lead(value) OVER w - value) AS d1,
    abs(lead(value, 3) OVER w - 3 * lead(value, 2) OVER w + 3 * lead(value) OVER w - value) AS d3 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, round(avg(d1) + {OFF_TIE}, 6) AS mean_dtheta, round(avg(d3) + {OFF_TIE}, 6) AS mean_jerk FROM s WHERE d3 IS NOT NULL GROUP BY 1
HAVING NOT (avg(d1) < 55 AND avg(d3) < 230)""",
)
def static_clip_filter(spark, sf):
    seq = Seq(("user_id",), "pos")
    d = event_track(spark, sf, "value")
    d3 = K.finite_diff(d, seq, ["value"], 3).select("user_id", "pos", F.col("d_value").alias("d3"))
    d1 = K.finite_diff(d, seq, ["value"], 1).select("user_id", "pos", F.col("d_value").alias("d1"))
    both = d3.join(d1, ["user_id", "pos"])
    out = FI.static_clip_filter(both, ["user_id"], F.abs("d1"), F.abs("d3"), 55.0, 230.0)
    return out.select("user_id", F.round(F.col("mean_dtheta") + OFF_TIE, 6).alias("mean_dtheta"), F.round(F.col("mean_jerk") + OFF_TIE, 6).alias("mean_jerk"))


@query(
    "crowd_flag",
    """SELECT user_id, max(c) > 2 AS crowded FROM (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def crowd_flag(spark, sf):
    d = events(spark, sf).withColumn("day", F.to_date("ts"))
    return FI.crowd_flag(d, ["user_id"], "day", 2)


def keypoints():
    """17 keypoints from an embedding: x, y and a confidence each."""
    at = lambda i, k: F.get("e", F.pmod(3 * i + k, F.lit(64)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y"), F.abs(at(i, 2) * 8).alias("conf")))


@query(
    "upside_down_flag",
    f"""WITH {EMB_SQL} SELECT label, bool_or((abs(e[3]*8) > 0.65 AND abs(e[48]*8) > 0.65 AND e[2] > e[47]) OR
  (abs(e[3]*8) > 0.65 AND abs(e[51]*8) > 0.65 AND e[2] > e[50])) AS upside_down FROM emb GROUP BY 1""",
)
def upside_down_flag(spark, sf):
    return FI.upside_down_flag(embeddings(spark, sf), ["label"], keypoints())


@query("human_present", "SELECT user_id, event_type, bool_or(value > 150) AS human FROM events GROUP BY 1, 2")
def human_present(spark, sf):
    return FI.human_present(events(spark, sf), ["user_id", "event_type"], F.col("value"), 150.0)


@query(
    "small_bbox",
    f"WITH {BOX_SQL} SELECT l_partkey, max((x2-x1)*(y2-y1)) AS max_area, max((x2-x1)*(y2-y1)) < 2000 AS too_small FROM bx GROUP BY 1",
)
def small_bbox(spark, sf):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return FI.small_bbox(boxes(spark, sf), ["l_partkey"], area, 2000.0)


@query(
    "valid_box",
    f"WITH {BOX_SQL} SELECT l_orderkey, l_linenumber, l_partkey, x1, x2, y1, y2 FROM bx WHERE x1 >= 0 AND y1 >= 0 AND x2 <= 80 AND y2 <= 40 AND x1 < x2 AND y1 < y2",
)
def valid_box(spark, sf):
    return FI.valid_box(boxes(spark, sf), tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), 80.0, 40.0)


@query(
    "face_present",
    f"WITH {EMB_SQL} SELECT vec_id, list_sum(list_transform(e, lambda v: abs(v))) / 64 > 1e-6 AS present, list_sum(e) <> 0 AS loose FROM emb",
)
def face_present(spark, sf):
    e = embeddings(spark, sf)
    return e.select("vec_id", FI.face_present(F.col("e")).alias("present"), FI.face_present(F.col("e"), False).alias("loose"))


@query(
    "has_format",
    """SELECT o_orderkey, coalesce(bool_or(l_returnflag <> 'A' AND l_linestatus = 'O' AND l_quantity >= 40), false) AS ok
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def has_format(spark, sf):
    """Every line is a list of one format; an order has what any line has."""
    li = table(spark, sf, "lineitem")
    fmt = F.struct(
        F.when(F.col("l_returnflag") == "A", "none").otherwise(F.col("l_returnflag")).alias("vcodec"),
        F.when(F.col("l_linestatus") == "O", "none").otherwise(F.col("l_linestatus")).alias("acodec"),
        F.col("l_quantity").alias("height"),
    )
    f = li.select(F.col("l_orderkey").alias("o_orderkey"), FI.has_format(F.array(fmt), 40).alias("ok")).groupBy("o_orderkey").agg(F.max("ok").alias("ok"))
    d = table(spark, sf, "orders").select("o_orderkey").join(f, "o_orderkey", "left")
    return d.select("o_orderkey", F.coalesce("ok", F.lit(False)).alias("ok"))


@query(
    "exactly_n_persons",
    "SELECT l_orderkey, count(DISTINCT l_linenumber) AS persons FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 2",
)
def exactly_n_persons(spark, sf):
    return FI.exactly_n_persons(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", 2)


@query(
    "sample_scenes",
    """SELECT l_orderkey, persons FROM (SELECT l_orderkey, count(DISTINCT l_linenumber) AS persons FROM lineitem GROUP BY 1)
WHERE persons = 2 ORDER BY (l_orderkey * 7919) % 10007, l_orderkey LIMIT 10""",
)
def sample_scenes(spark, sf):
    d = FI.exactly_n_persons(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", 2)
    return FI.sample_scenes(d, [(F.col("l_orderkey") * 7919) % 10007, "l_orderkey"], 10)


def projected(spark, sf):
    d = joint_table(spark, sf)
    u, v = C.project((F.col("px"), F.col("py"), F.col("pz") + 0.5), F.lit(500.0), F.lit(320.0), F.lit(240.0))
    return d.withColumns({"u": u, "v": v})


PROJ_SQL = f"""{JOINT_SQL}, pj AS (SELECT *, 500 * px / (pz + 0.5) + 320 AS u, 500 * py / (pz + 0.5) + 240 AS v FROM jt)"""


@query("in_fov", f"WITH {PROJ_SQL} SELECT clip, frame, CAST(joint AS INT) AS joint, u >= 0 AND u < 640 AND v >= 0 AND v < 480 AS inside FROM pj")
def in_fov(spark, sf):
    return projected(spark, sf).select("clip", "frame", "joint", C.in_fov(F.col("u"), F.col("v"), 640.0, 480.0).alias("inside"))


@query(
    "fov_category",
    f"""WITH {PROJ_SQL}, f AS (SELECT clip, frame, bool_and(i) AS a, bool_or(i) AS o FROM (
  SELECT clip, frame, u >= 0 AND u < 640 AND v >= 0 AND v < 480 AS i FROM pj) GROUP BY 1, 2)
SELECT clip, CASE WHEN bool_and(a) THEN 1 WHEN bool_and(o) THEN 2 WHEN NOT bool_or(o) THEN 4 ELSE 3 END AS category FROM f GROUP BY 1""",
)
def fov_category(spark, sf):
    return FI.fov_category(projected(spark, sf), ["clip"], "frame", F.col("u"), F.col("v"), 640.0, 480.0)


@query(
    "complete_groups",
    """SELECT o_custkey FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey
GROUP BY 1 HAVING bool_and(l_orderkey IS NOT NULL)""",
)
def complete_groups(spark, sf):
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return FI.complete_groups(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), done, ["o_custkey"], ["o_orderkey"])


@query("stride", f"WITH {EV_SQL} SELECT user_id, pos, value FROM ev WHERE pos % 3 = 0")
def stride(spark, sf):
    """Every third frame: 60 fps material at 20 fps."""
    return FI.stride(event_track(spark, sf, "value"), "pos", FI.stride_for(60, 20))


@query("truncate", f"WITH {EV_SQL} SELECT user_id, pos, value FROM ev WHERE pos < 50")
def truncate(spark, sf):
    return FI.truncate(event_track(spark, sf, "value"), "pos", 50)


@query(
    "box_nearby",
    """WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events WHERE value BETWEEN 50 AND 100 GROUP BY 1)
SELECT event_id, event_type, value FROM events JOIN b USING (event_type) WHERE value BETWEEN lo - 5 AND hi + 5""",
)
def box_nearby(spark, sf):
    d = events(spark, sf).select("event_id", "event_type", "value")
    return FI.box_nearby(d, d.where(F.col("value").between(50, 100)), ["event_type"], ["value"], 5.0)
