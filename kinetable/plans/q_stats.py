"""Dataset statistics on the order hierarchy, events and texts."""

from __future__ import annotations

from pyspark.sql import functions as F


from kinetable.operators import percentiles as PC
from kinetable.operators import stats as ST
from kinetable.operators import tracks as TR
from kinetable.plans.base import EV_SQL, event_track, events
from kinetable.plans.q_filters import BOX_SQL, boxes
from kinetable.plans.registry import query, table

#: A small fixed English stop list for the word statistics.
STOP = ["the", "of", "and", "a", "in", "to", "is", "it", "that", "for"]
STOP_SQL = "('" + "','".join(STOP) + "')"


def rounded(d, n=4):
    return d.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


def hierarchy(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity", "l_discount")
    return o.join(li, "o_orderkey")


@query(
    "persons_per_scene",
    """WITH c AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total, round(avg(n), 4) AS mean, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q3 FROM c""",
)
def persons_per_scene(spark, sf):
    c = ST.distinct_per_group(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber"], "n")
    return rounded(ST.count_summary(c, "n"))


@query(
    "scenes_per_video",
    """WITH c AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total, round(avg(n), 4) AS mean, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q3 FROM c""",
)
def scenes_per_video(spark, sf):
    c = ST.distinct_per_group(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], "n")
    return rounded(ST.count_summary(c, "n"))


@query(
    "percentiles",
    """SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1""",
)
def percentiles(spark, sf):
    return PC.percentiles(events(spark, sf), ["event_type"], "value", PC.QUARTILES)


@query(
    "multi_person_scenes",
    "SELECT l_orderkey, count(DISTINCT l_linenumber) AS persons FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) >= 2",
)
def multi_person_scenes(spark, sf):
    return ST.multi_person_scenes(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber"])


TOTAL_SQL = """SELECT f AS frames, h AS face_frames, round(100.0 * h / f, 4) AS face_percent, round(f / 30, 4) AS seconds,
  round(f / 1800, 4) AS minutes, round(f / 108000, 4) AS hours FROM """


@query("dataset_totals", TOTAL_SQL + "(SELECT sum(l_quantity) AS f, sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END) AS h FROM lineitem)")
def dataset_totals(spark, sf):
    face = F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).otherwise(0.0)
    return rounded(ST.dataset_totals(table(spark, sf, "lineitem"), F.col("l_quantity"), face))


@query(
    "scene_totals_max",
    TOTAL_SQL + """(SELECT sum(f) AS f, sum(h) AS h FROM (
  SELECT max(l_quantity) AS f, max(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END) AS h FROM lineitem GROUP BY l_orderkey))""",
)
def scene_totals_max(spark, sf):
    face = F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).otherwise(0.0)
    return rounded(ST.scene_totals_max(table(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_quantity"), face))


@query(
    "length_stats",
    """WITH d AS (SELECT n_name, l_quantity / (20 + n_nationkey) AS s FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT n_name, count(*) AS n, round(sum(s), 4) AS total, round(min(s), 4) AS shortest, round(max(s), 4) AS longest,
  round(quantile_cont(s, 0.25), 4) AS q1, round(quantile_cont(s, 0.5), 4) AS median, round(quantile_cont(s, 0.75), 4) AS q3 FROM d GROUP BY 1""",
)
def length_stats(spark, sf):
    """Nations as datasets, each with its own frame rate."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", (20 + F.col("n_nationkey")).alias("fps"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(n, "s_nationkey")
    d = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity").join(s, "l_suppkey")
    return rounded(ST.length_stats(d.select("n_name", (F.col("l_quantity") / F.col("fps")).alias("s")), "n_name", "s"))


@query(
    "length_histogram",
    "SELECT n AS length, count(*) AS clips FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) WHERE n > 1 GROUP BY 1",
)
def length_histogram(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("length"))
    return ST.length_histogram(c, "length")


@query(
    "binned_counts",
    """WITH b(bin, label, lo, hi) AS (VALUES (0, '1', 0, 1), (1, '2-3', 1, 3), (2, '4-7', 3, 7), (3, '8-15', 7, 15), (4, '16-31', 15, 31),
  (5, '32-63', 31, 63), (6, '64-127', 63, 127), (7, '128+', 127, 1e18)), c AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey)
SELECT bin, label, count(c.n) AS n FROM b LEFT JOIN c ON c.n > lo AND c.n <= hi GROUP BY 1, 2""",
)
def binned_counts(spark, sf):
    c = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    labels = ["1", "2-3", "4-7", "8-15", "16-31", "32-63", "64-127", "128+"]
    return ST.binned_counts(c, "n", [0, 1, 3, 7, 15, 31, 63, 127, 1e18], labels)


HIST_SQL = """WITH m AS (SELECT min(value) AS a, (max(value) - min(value)) / 50 AS w, count(*) AS n FROM events),
c AS (SELECT least(floor((value - a) / w), 49) AS b, count(*) AS k FROM events, m GROUP BY 1), r AS (SELECT unnest(range(0, 50)) AS bin)
SELECT CAST(bin AS INT) AS bin, round(a + bin * w, 4) AS left_edge, """


@query("histogram", HIST_SQL + "coalesce(k, 0) AS n FROM r CROSS JOIN m LEFT JOIN c ON b = bin")
def histogram(spark, sf):
    return rounded(ST.histogram(events(spark, sf), "value", 50)).select("bin", "left_edge", "n")


@query("histogram_density", HIST_SQL + "round(coalesce(k, 0) / (n * w), 8) AS density FROM r CROSS JOIN m LEFT JOIN c ON b = bin")
def histogram_density(spark, sf):
    d = ST.histogram(events(spark, sf), "value", 50, density=True)
    return d.select("bin", F.round("left_edge", 4).alias("left_edge"), F.round("density", 8).alias("density"))


@query(
    "moments",
    """SELECT event_type, round(avg(value), 4) AS mean, round(var_pop(value), 4) AS variance, round(quantile_cont(value, 0.95), 4) AS p95,
  round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1""",
)
def moments(spark, sf):
    return rounded(ST.moments(events(spark, sf), ["event_type"], "value", {"p95": 0.95, "p99": 0.99}))


@query("element_counts", "SELECT event_id, CAST(len(json_keys(props)) AS INT) AS entries, CAST(sum(len(json_keys(props))) OVER () AS BIGINT) AS total FROM events")
def element_counts(spark, sf):
    d = ST.element_counts(events(spark, sf).select("event_id", "props"), "props")
    return d.select("event_id", "entries", d.agg(F.sum("entries").alias("t")).scalar().alias("total"))


@query(
    "word_counts",
    rf"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM documents)
WHERE length(word) > 1 AND word NOT IN {STOP_SQL} GROUP BY 1""",
)
def word_counts(spark, sf):
    return ST.word_counts(table(spark, sf, "documents"), "text", STOP)


@query(
    "word_counts_top",
    rf"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM conversations)
WHERE length(word) > 1 AND word NOT IN {STOP_SQL} GROUP BY 1 ORDER BY n DESC, word LIMIT 200""",
)
def word_counts_top(spark, sf):
    """The two hundred most common words: the data behind a word cloud."""
    return ST.word_counts(table(spark, sf, "conversations"), "text", STOP, 200)


#: A turn's sentences as one tagged block, in both engines.
BLOCK_SQL = """blk AS (SELECT conv_id, turn, array_to_string(list_transform(string_split(replace(text, '<', ' '), '. '),
    lambda x, i: '<' || (i - 1) || '>' || x || '</' || (i - 1) || '>'), '') AS block FROM conversations)"""


def blocks(spark, sf):
    tag = lambda x, i: F.concat(F.lit("<"), i, F.lit(">"), x, F.lit("</"), i, F.lit(">"))
    parts = F.transform(F.split(F.replace("text", F.lit("<"), F.lit(" ")), r"\. "), tag)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(parts, "").alias("block"))


@query("movement_counts", f"WITH {BLOCK_SQL} SELECT conv_id, turn, CAST(len(regexp_extract_all(block, '</[0-9]+>')) AS INT) AS movements FROM blk")
def movement_counts(spark, sf):
    return ST.movement_counts(blocks(spark, sf), F.col("block")).select("conv_id", "turn", "movements")


@query(
    "track_summary",
    f"""WITH {BOX_SQL}, s AS (SELECT l_partkey, l_linenumber, min(x1) AS first, max(x1) AS last, count(*) AS length, sum((x2-x1)*(y2-y1)) AS area FROM bx GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY area DESC, l_linenumber) AS rank FROM s""",
)
def track_summary(spark, sf):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return TR.track_summary(boxes(spark, sf), ["l_partkey", "l_linenumber"], "x1", area)


@query("target_ids", f"WITH {EV_SQL} SELECT user_id, round(avg(value), 4) AS score FROM ev WHERE pos < 30 GROUP BY 1 HAVING avg(value) > 50")
def target_ids(spark, sf):
    return rounded(TR.target_ids(event_track(spark, sf, "value"), ["user_id"], "pos", "value", 30, 50.0))


@query("stage_timing", "SELECT event_type, round(sum(value), 4) AS total, count(*) AS calls, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def stage_timing(spark, sf):
    return rounded(ST.stage_timing(events(spark, sf), "event_type", F.col("value")))


@query(
    "dataset_rollup",
    """SELECT c_mktsegment, o_orderpriority, CAST(grouping(c_mktsegment, o_orderpriority) AS BIGINT) AS level, round(sum(o_totalprice), 2) AS total, count(*) AS n
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)""",
)
def dataset_rollup(spark, sf):
    d = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(ST.dataset_rollup(d, ["c_mktsegment", "o_orderpriority"], total=F.sum("o_totalprice"), n=F.count(F.lit(1))), 2)
