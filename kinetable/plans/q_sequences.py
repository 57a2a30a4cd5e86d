"""Window and sequence operators on event tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.operators import kinematics as K
from kinetable.operators import resample as RS
from kinetable.operators import runs as RU
from kinetable.operators import smoothing as SM
from kinetable.operators import tracks as TR
from kinetable.operators.blocks import Seq
from kinetable.plans.base import EV, EV_SQL, GRID, GRID_SQL, OFF_TIE, event_track, grid_spans, observed_grid
from kinetable.plans.registry import query

RUNS_SQL = """runs AS (
  SELECT user_id, flag, min(pos) AS start, max(pos) + 1 AS stop, count(*) AS length
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY user_id, flag ORDER BY pos) AS grp
        FROM (SELECT user_id, pos, value > 60 AS flag FROM ev))
  GROUP BY user_id, flag, grp)"""


def high():
    return F.col("value") > 60


@query(
    "clean_tracks",
    f"""WITH {GRID_SQL},
gaps AS (
  SELECT user_id, frame, v, frame - row_number() OVER (PARTITION BY user_id, v IS NULL ORDER BY frame) AS grp FROM dense),
gate AS (
  SELECT user_id FROM dense GROUP BY user_id
  HAVING max(frame) FILTER (v IS NOT NULL) - min(frame) FILTER (v IS NOT NULL) + 1 >= 30
     AND user_id NOT IN (SELECT user_id FROM gaps WHERE v IS NULL GROUP BY user_id, grp HAVING count(*) > 60)),
br AS (
  SELECT d.user_id, d.frame, d.v,
    max(CASE WHEN v IS NOT NULL THEN frame END) OVER (PARTITION BY d.user_id ORDER BY frame) AS t0,
    min(CASE WHEN v IS NOT NULL THEN frame END) OVER (PARTITION BY d.user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1
  FROM dense d JOIN gate USING (user_id)),
filled AS (
  SELECT b.user_id, b.frame, b.v IS NULL AS interpolated,
    CASE WHEN b.v IS NOT NULL THEN b.v WHEN t0 IS NULL THEN o1.v WHEN t1 IS NULL THEN o0.v
         ELSE o0.v + (o1.v - o0.v) * (b.frame - t0) / (t1 - t0) END AS v
  FROM br b LEFT JOIN obs o0 ON o0.user_id = b.user_id AND o0.frame = t0
            LEFT JOIN obs o1 ON o1.user_id = b.user_id AND o1.frame = t1),
off AS (SELECT unnest(range(-2, 3)) AS k),
s1 AS (
  SELECT a.user_id, a.frame, any_value(a.interpolated) AS interpolated, sum(b.v) / 5 AS v
  FROM filled a CROSS JOIN off JOIN filled b ON b.user_id = a.user_id AND b.frame = greatest(0, least(119, a.frame + k))
  GROUP BY a.user_id, a.frame),
s2 AS (
  SELECT a.user_id, a.frame, any_value(a.interpolated) AS interpolated, sum(b.v) / 5 AS v
  FROM s1 a CROSS JOIN off JOIN s1 b ON b.user_id = a.user_id AND b.frame = greatest(0, least(119, a.frame + k))
  GROUP BY a.user_id, a.frame)
SELECT user_id, frame, round(v + {OFF_TIE}, 6) AS v,
  interpolated OR coalesce(abs(v - lag(v) OVER (PARTITION BY user_id ORDER BY frame)) > 0.2 * abs(v), false) AS flagged
FROM s2""",
)
def clean_tracks(spark, sf):
    obs = observed_grid(spark, sf)
    jump = F.abs(F.col("v") - F.col("prev_v")) > 0.2 * F.abs(F.col("v"))
    d = TR.clean_tracks(obs, grid_spans(obs), GRID, ["v"], jump)
    return d.select("user_id", "frame", F.round(F.col("v") + OFF_TIE, 6).alias("v"), "flagged")


@query(
    "trailing_mode",
    f"""WITH {EV_SQL}
SELECT user_id, pos, smoothed FROM (
  SELECT a.user_id, a.pos, b.event_type AS smoothed,
    row_number() OVER (PARTITION BY a.user_id, a.pos ORDER BY count(*) DESC, min(b.pos)) AS r
  FROM ev a JOIN ev b ON b.user_id = a.user_id AND b.pos BETWEEN a.pos - 19 AND a.pos
  GROUP BY a.user_id, a.pos, b.event_type) WHERE r = 1""",
)
def trailing_mode(spark, sf):
    d = event_track(spark, sf, "event_type")
    return SM.trailing_mode(d, EV, "event_type", 20).select("user_id", "pos", "smoothed")


@query(
    "remove_islands",
    f"""WITH {EV_SQL}, {RUNS_SQL}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1)
SELECT e.user_id, e.pos,
  CASE WHEN r.flag AND NOT (r.length < 3 AND r.start > 0 AND r.stop < n) THEN round(e.value, 6) ELSE 0 END AS x
FROM ev e JOIN runs r ON r.user_id = e.user_id AND e.pos >= r.start AND e.pos < r.stop JOIN n ON n.user_id = e.user_id""",
)
def remove_islands(spark, sf):
    d = event_track(spark, sf, "value").withColumn("x", F.when(high(), F.col("value")).otherwise(0.0)).drop("value")
    return RU.remove_islands(d, EV, ["x"], 3).withColumn("x", F.round("x", 6))


@query(
    "fill_zero_gaps",
    f"""WITH {EV_SQL}, {RUNS_SQL}, x AS (SELECT user_id, pos, CASE WHEN value > 60 THEN value ELSE 0 END AS x FROM ev),
j AS (
  SELECT x.*, r.flag, r.length AS n, x.pos - r.start + 1 AS i, r.stop - x.pos AS k, l.x AS lv, q.x AS rv
  FROM x JOIN runs r ON r.user_id = x.user_id AND x.pos >= r.start AND x.pos < r.stop
  LEFT JOIN x l ON l.user_id = x.user_id AND l.pos = r.start - 1
  LEFT JOIN x q ON q.user_id = x.user_id AND q.pos = r.stop)
SELECT user_id, pos, round(CASE
  WHEN flag THEN x
  WHEN lv IS NOT NULL AND rv IS NOT NULL AND n <= 3 THEN lv + (rv - lv) * i / (n + 1)
  WHEN lv IS NOT NULL AND rv IS NOT NULL THEN CASE WHEN k <= 3 THEN rv * (3 - k) / 3.0 WHEN i <= 3 THEN lv * (3 - i) / 3.0 ELSE 0 END
  WHEN lv IS NOT NULL THEN greatest(0, lv * (least(n, 3) - i) / least(n, 3))
  WHEN rv IS NOT NULL THEN greatest(0, rv * (least(n, 3) - k) / least(n, 3))
  ELSE 0 END, 6) AS x FROM j""",
)
def fill_zero_gaps(spark, sf):
    d = event_track(spark, sf, "value").withColumn("x", F.when(high(), F.col("value")).otherwise(0.0)).drop("value")
    return RU.fill_zero_gaps(d, EV, "x", 3).withColumn("x", F.round("x", 6))


@query(
    "gaussian_smooth",
    f"""WITH {EV_SQL}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1),
off AS (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS k)),
ix AS (SELECT e.user_id, e.pos, w, n, (((e.pos + k) % (2 * n)) + 2 * n) % (2 * n) AS p FROM ev e JOIN n USING (user_id) CROSS JOIN off)
SELECT ix.user_id, ix.pos, round(sum(w * b.value), 6) AS value
FROM ix JOIN ev b ON b.user_id = ix.user_id AND b.pos = CASE WHEN p < n THEN p ELSE 2 * n - 1 - p END
GROUP BY 1, 2""",
)
def gaussian_smooth(spark, sf):
    d = event_track(spark, sf, "value")
    return SM.gaussian_smooth(d, EV, ["value"], 1.0, "reflect").withColumn("value", F.round("value", 6))


@query(
    "gaussian_smooth_replicate",
    f"""WITH {EV_SQL}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1),
off AS (SELECT k, exp(-0.5 * k * k / 9.0) / sum(exp(-0.5 * k * k / 9.0)) OVER () AS w FROM (SELECT unnest(range(-12, 13)) AS k))
SELECT e.user_id, e.pos, round(sum(w * b.value), 6) AS value
FROM ev e JOIN n USING (user_id) CROSS JOIN off JOIN ev b ON b.user_id = e.user_id AND b.pos = greatest(0, least(n - 1, e.pos + k))
GROUP BY 1, 2""",
)
def gaussian_smooth_replicate(spark, sf):
    d = event_track(spark, sf, "value")
    return SM.gaussian_smooth(d, EV, ["value"], 3.0, "replicate").withColumn("value", F.round("value", 6))


@query(
    "moving_average",
    f"""WITH {EV_SQL}
SELECT user_id, pos, round(sum(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 6) AS value FROM ev""",
)
def moving_average(spark, sf):
    d = event_track(spark, sf, "value")
    return SM.moving_average(d, EV, ["value"], 4, "zero").withColumn("value", F.round("value", 6))


@query(
    "moving_average_replicate",
    f"""WITH {EV_SQL}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1), off AS (SELECT unnest(range(-2, 3)) AS k)
SELECT e.user_id, e.pos, round(sum(b.value) / 5, 6) AS value
FROM ev e JOIN n USING (user_id) CROSS JOIN off JOIN ev b ON b.user_id = e.user_id AND b.pos = greatest(0, least(n - 1, e.pos + k))
GROUP BY 1, 2""",
)
def moving_average_replicate(spark, sf):
    d = event_track(spark, sf, "value")
    return SM.moving_average(d, EV, ["value"], 5, "replicate").withColumn("value", F.round("value", 6))


@query("true_runs", f"WITH {EV_SQL}, {RUNS_SQL} SELECT user_id, start, stop, length FROM runs WHERE flag")
def true_runs(spark, sf):
    return RU.true_runs(event_track(spark, sf, "value"), EV, high())


@query(
    "longest_run",
    f"""WITH {EV_SQL}, {RUNS_SQL}
SELECT user_id, start, stop, length, CAST(floor((start + stop - 1) / 2) AS BIGINT) AS middle FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) AS r FROM runs WHERE NOT flag) WHERE r = 1""",
)
def longest_run(spark, sf):
    return RU.longest_run(event_track(spark, sf, "value"), EV, ~high())


@query(
    "top_k_spans",
    f"""WITH {EV_SQL}, {RUNS_SQL}
SELECT user_id, start, stop, length, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) AS rank FROM runs WHERE flag) WHERE rank <= 3""",
)
def top_k_spans(spark, sf):
    return RU.top_k_spans(event_track(spark, sf, "value"), EV, high(), 3)


@query("densify", f"WITH {GRID_SQL} SELECT user_id, frame, round(v, 6) AS v FROM dense")
def densify(spark, sf):
    obs = observed_grid(spark, sf)
    return RS.densify(obs, GRID, grid_spans(obs)).select("user_id", "frame", F.round("v", 6).alias("v"))


@query(
    "max_gap",
    f"""WITH {GRID_SQL}, g AS (
  SELECT user_id, count(*) AS len FROM (
    SELECT user_id, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS grp FROM dense WHERE v IS NULL)
  GROUP BY user_id, grp), s AS (
  SELECT user_id, max(frame) FILTER (v IS NOT NULL) - min(frame) FILTER (v IS NOT NULL) + 1 AS duration FROM dense GROUP BY 1)
SELECT s.user_id, duration, coalesce(max(len), 0) AS max_gap FROM s LEFT JOIN g USING (user_id) GROUP BY 1, 2""",
)
def max_gap(spark, sf):
    obs = observed_grid(spark, sf)
    return RU.max_gap(RS.densify(obs, GRID, grid_spans(obs)), GRID, F.col("v").isNotNull())


@query(
    "interpolate_gaps",
    f"""WITH {GRID_SQL}, br AS (
  SELECT user_id, frame, v,
    max(CASE WHEN v IS NOT NULL THEN frame END) OVER (PARTITION BY user_id ORDER BY frame) AS t0,
    min(CASE WHEN v IS NOT NULL THEN frame END) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1
  FROM dense)
SELECT b.user_id, b.frame, round(CASE WHEN b.v IS NOT NULL THEN b.v WHEN t0 IS NULL THEN o1.v WHEN t1 IS NULL THEN o0.v
         ELSE o0.v + (o1.v - o0.v) * (b.frame - t0) / (t1 - t0) END + {OFF_TIE}, 6) AS v
FROM br b LEFT JOIN obs o0 ON o0.user_id = b.user_id AND o0.frame = t0
          LEFT JOIN obs o1 ON o1.user_id = b.user_id AND o1.frame = t1""",
)
def interpolate_gaps(spark, sf):
    obs = observed_grid(spark, sf)
    d = RS.interpolate_gaps(RS.densify(obs, GRID, grid_spans(obs)), GRID, ["v"])
    return d.select("user_id", "frame", F.round(F.col("v") + OFF_TIE, 6).alias("v"))


@query(
    "variation_anomalies",
    f"""WITH {EV_SQL}
SELECT user_id, pos, value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS p FROM ev)
WHERE abs(value - p) > 0.2 * (value + p)""",
)
def variation_anomalies(spark, sf):
    d = event_track(spark, sf, "value")
    v, p = F.col("value"), F.col("prev_value")
    return TR.variation_anomalies(d, EV, F.abs(v - p), v + p, 0.2)


@query(
    "frozen_runs",
    f"""WITH {EV_SQL}, g AS (
  SELECT user_id, event_type, pos, pos - row_number() OVER (PARTITION BY user_id, event_type ORDER BY pos) AS grp FROM ev)
SELECT user_id, min(pos) AS start, count(*) AS length, CAST(floor((count(*) - 1) / 2) AS BIGINT) AS cuts
FROM g GROUP BY user_id, event_type, grp HAVING count(*) >= 3""",
)
def frozen_runs(spark, sf):
    return RU.frozen_runs(event_track(spark, sf, "event_type"), EV, F.col("event_type"), 2)


@query(
    "trim_flagged",
    f"""WITH {EV_SQL}, {RUNS_SQL}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1),
b AS (
  SELECT user_id, n, bool_or(flag AND start = 0) AS dh, bool_or(flag AND stop = n) AS dt,
    min(start) FILTER (NOT flag AND length > 4) AS fc, max(stop) FILTER (NOT flag AND length > 4) AS lc
  FROM runs JOIN n USING (user_id) GROUP BY 1, 2),
c AS (
  SELECT user_id, n, CASE WHEN dh THEN least(coalesce(fc, n) + 2, n) ELSE 0 END AS start,
         CASE WHEN dt THEN greatest(coalesce(lc, 0) - 2, 0) ELSE n END AS stop FROM b)
SELECT * FROM c WHERE stop > start""",
)
def trim_flagged(spark, sf):
    return RU.trim_flagged(event_track(spark, sf, "value"), EV, high(), 4)


@query(
    "finite_diff",
    f"""WITH {EV_SQL}
SELECT user_id, pos, round(d, 4) AS d_value FROM (
  SELECT user_id, pos, (lead(value, 3) OVER w - 3 * lead(value, 2) OVER w + 3 * lead(value) OVER w - value) * 27000 AS d
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos)) WHERE d IS NOT NULL""",
)
def finite_diff(spark, sf):
    d = K.finite_diff(event_track(spark, sf, "value"), EV, ["value"], 3, 30.0)
    return d.select("user_id", "pos", F.round("d_value", 4).alias("d_value"))


def _grad_sql(src: str, dst: str) -> str:
    return f"""SELECT user_id, pos, CASE
      WHEN lag({src}) OVER w IS NULL THEN lead({src}) OVER w - {src}
      WHEN lead({src}) OVER w IS NULL THEN {src} - lag({src}) OVER w
      ELSE (lead({src}) OVER w - lag({src}) OVER w) / 2 END AS {dst}"""


@query(
    "gradient",
    f"""WITH {EV_SQL},
g1 AS ({_grad_sql('value', 'a')} FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
g2 AS ({_grad_sql('a', 'b')} FROM g1 WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
g3 AS ({_grad_sql('b', 'c')} FROM g2 WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, pos, round(c, 6) AS g_value FROM g3""",
)
def gradient(spark, sf):
    d = K.gradient(event_track(spark, sf, "value"), EV, ["value"], 3)
    return d.select("user_id", "pos", F.round("g_value", 6).alias("g_value"))


@query(
    "static_joint_mask",
    f"""WITH {EV_SQL}
SELECT user_id, pos, s / 0.033 < 600 AS is_static FROM (
  SELECT user_id, pos, abs(lead(value) OVER (PARTITION BY user_id ORDER BY pos) - value) AS s FROM ev) WHERE s IS NOT NULL""",
)
def static_joint_mask(spark, sf):
    d = K.static_joint_mask(event_track(spark, sf, "value"), EV, ["value"], 600.0)
    return d.select("user_id", "pos", "is_static")


@query(
    "foot_contact",
    f"""WITH {EV_SQL}
SELECT user_id, pos, CASE WHEN s * s < 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS contact FROM (
  SELECT user_id, pos, abs(lead(value) OVER (PARTITION BY user_id ORDER BY pos) - value) AS s FROM ev) WHERE s IS NOT NULL""",
)
def foot_contact(spark, sf):
    d = K.foot_contact(event_track(spark, sf, "value"), EV, ["value"], 100.0)
    return d.select("user_id", "pos", "contact")


@query(
    "rollout",
    f"""WITH {EV_SQL}
SELECT user_id, pos, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS x FROM ev""",
)
def rollout(spark, sf):
    d = K.rollout(event_track(spark, sf, "value"), EV, {"x": F.col("value")})
    return d.select("user_id", "pos", F.round("x", 4).alias("x"))


@query(
    "yaw_integrate",
    f"""WITH {EV_SQL}, y AS (
  SELECT user_id, pos, value / 1000 AS vx, value / 500 AS vz,
    sum((value - 50) / 1000) OVER (PARTITION BY user_id ORDER BY pos) AS t,
    coalesce(sum((value - 50) / 1000) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heading
  FROM ev), r AS (
  SELECT user_id, pos, heading, cos(2 * t) * vx - sin(2 * t) * vz AS wx, sin(2 * t) * vx + cos(2 * t) * vz AS wz FROM y)
SELECT user_id, pos, round(heading, 6) AS heading, round(coalesce(sum(wx) OVER p, 0), 6) AS x, round(coalesce(sum(wz) OVER p, 0), 6) AS z
FROM r WINDOW p AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def yaw_integrate(spark, sf):
    d = event_track(spark, sf, "value")
    d = d.select("user_id", "pos", ((F.col("value") - 50) / 1000).alias("yv"), (F.col("value") / 1000).alias("vx"), (F.col("value") / 500).alias("vz"))
    d = K.yaw_integrate(d, EV, "yv", "vx", "vz")
    return d.select("user_id", "pos", *[F.round(c, 6).alias(c) for c in ("heading", "x", "z")])
