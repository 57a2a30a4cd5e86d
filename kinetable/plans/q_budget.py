"""Budgets, quotas, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.operators import budget as BU
from kinetable.operators.blocks import Seq
from kinetable.plans.base import EV_SQL, event_track, events
from kinetable.plans.registry import query, table

OSQL = "(o_orderkey * 7919) % 10007"


def okey():
    return (F.col("o_orderkey") * 7919) % 10007



@query(
    "duration_budget",
    """WITH r AS (SELECT o_orderkey, o_totalprice, coalesce(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM orders)
SELECT o_orderkey, round(least(o_totalprice, 500000000 - u), 2) AS granted FROM r WHERE u < 500000000""",
)
def duration_budget(spark, sf):
    d = BU.duration_budget(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 500_000_000.0)
    return d.select("o_orderkey", F.round("granted", 2).alias("granted"))


@query("quota", "SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 90")
def quota(spark, sf):
    return BU.quota(events(spark, sf).select("ts", "event_id", "user_id"), ["ts", "event_id"], 90).select("event_id", "user_id")


@query(
    "reserve",
    """WITH s AS (SELECT c_nationkey, 1 + c_nationkey % 4 AS free FROM customer GROUP BY 1),
r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer WHERE c_acctbal > 0)
SELECT c_nationkey, c_custkey FROM r JOIN s USING (c_nationkey) WHERE k <= free ORDER BY 1, 2 LIMIT 40""",
)
def reserve(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    slots = c.select("c_nationkey", (1 + F.col("c_nationkey") % 4).alias("free")).distinct()
    return BU.reserve(c.where("c_acctbal > 0").drop("c_acctbal"), slots, "c_nationkey", "c_custkey", 40)


@query("top_n_by", "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_n_by(spark, sf):
    d = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return BU.top_n_by(d, [F.desc("o_totalprice"), "o_orderkey"], 3, ["o_custkey"]).drop("o_totalprice")


@query("top_n_overall", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_n_overall(spark, sf):
    return BU.top_n_by(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 100)


@query("subsample", f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {OSQL}, o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= greatest(1, floor(n * 0.1))")
def subsample(spark, sf):
    return BU.subsample(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 0.1, key=okey())


@query(
    "trim_and_sample",
    f"""WITH {EV_SQL}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1),
k AS (SELECT e.user_id, pos, n, row_number() OVER (PARTITION BY e.user_id ORDER BY (pos * 7919) % 10007, pos) AS r FROM ev e JOIN n USING (user_id) WHERE pos >= floor(n * 0.1) AND pos < floor(n * 0.9))
SELECT user_id, pos FROM k WHERE r <= floor(0.24 * n)""",
)
def trim_and_sample(spark, sf):
    return BU.trim_and_sample(event_track(spark, sf), Seq(("user_id",), "pos"), 0.3, key=(F.col("pos") * 7919) % 10007)


SPLIT_SQL = f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {OSQL}, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders),
s AS (SELECT o_orderkey, CASE WHEN r < floor(n * 0.15) THEN 'test' WHEN r < floor(n * 0.15) + floor(n * 0.05) THEN 'val' ELSE 'train' END AS split FROM r)"""


def splitted(spark, sf):
    return BU.split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], key=okey())


@query("split", SPLIT_SQL + " SELECT * FROM s")
def split(spark, sf):
    return splitted(spark, sf)


@query("train_val", SPLIT_SQL + " SELECT o_orderkey FROM s WHERE split = 'train' UNION ALL SELECT o_orderkey FROM s WHERE split = 'val'")
def train_val(spark, sf):
    """Both parts are disjoint, so the union keeps every row once."""
    s = splitted(spark, sf)
    return s.where("split = 'train'").unionAll(s.where("split = 'val'")).select("o_orderkey")


@query("sampling_weights", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER () * 1e6, 6) AS weight FROM orders")
def sampling_weights(spark, sf):
    d = BU.sampling_weights(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
    return d.select("o_orderkey", F.round(F.col("weight") * 1e6, 6).alias("weight"))
