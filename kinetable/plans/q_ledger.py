"""Ledger, segmentation and streaming queries on the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.operators import ledger as LE
from kinetable.operators import segments as SG
from kinetable.plans.base import EV, EV_SQL, event_track, events
from kinetable.plans.registry import query, table
from kinetable.streaming import state as ST

# An item is a (user, third) pair, its owner a group of users, its state the
# event type.
STATE_SQL = """CASE event_type WHEN 'purchase' THEN 'processed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'preprocessed' WHEN 'view' THEN 'available' ELSE 'in_progress' END"""
LED_SQL = f"""le AS (SELECT user_id || '/' || event_id % 3 AS item, CAST(user_id AS VARCHAR) AS folder, CAST(user_id % 20 AS VARCHAR) AS owner, {STATE_SQL} AS state, ts, event_id FROM events),
now AS (SELECT max(ts) AS now FROM events),
st AS (SELECT item, folder, owner, state, ts FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ts DESC, event_id DESC) AS r FROM le) WHERE r = 1),
beats AS (SELECT owner, max(ts) AS b FROM le WHERE state = 'available' GROUP BY 1),
ex AS (SELECT item, owner FROM st LEFT JOIN beats USING (owner) CROSS JOIN now WHERE state = 'in_progress' AND (epoch(now - ts) > 43200 OR coalesce(epoch(now - b) > 3600, false)))"""
RULES = {"lease": 43200.0, "beat": 300.0, "beats_allowed": 12}


def ledger_events(spark, sf):
    e = events(spark, sf)
    state = (
        F.when(F.col("event_type") == "purchase", "processed").when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "signup", "preprocessed").when(F.col("event_type") == "view", "available").otherwise("in_progress")
    )
    return e.select(
        F.concat("user_id", F.lit("/"), F.col("event_id") % 3).alias("item"), F.col("user_id").cast("string").alias("folder"),
        (F.col("user_id") % 20).cast("string").alias("owner"), state.alias("state"), "ts", "event_id",
    )


def states(spark, sf):
    return LE.ledger_state(ledger_events(spark, sf), tie="event_id")


def beats(spark, sf):
    return ledger_events(spark, sf).where("state = 'available'").select("owner", "ts")


def now(spark, sf):
    return events(spark, sf).agg(F.max("ts").alias("now")).scalar()


@query("ledger_state", f"WITH {LED_SQL} SELECT item, owner, state, epoch_us(ts) AS ts FROM st")
def ledger_state(spark, sf):
    return states(spark, sf).select("item", "owner", "state", F.unix_micros("ts").alias("ts"))


@query("expire_leases", f"WITH {LED_SQL} SELECT item, owner FROM ex")
def expire_leases(spark, sf):
    return LE.expired_leases(states(spark, sf), beats(spark, sf), now(spark, sf), **RULES).select("item", "owner")


@query(
    "available_work",
    f"WITH {LED_SQL} SELECT item FROM st WHERE NOT (state = 'processed' OR (state = 'in_progress' AND item NOT IN (SELECT item FROM ex)))",
)
def available_work(spark, sf):
    s = states(spark, sf)
    return LE.available_work(s.select("item"), s, beats(spark, sf), now(spark, sf), **RULES)


@query("release_owner", f"WITH {LED_SQL} SELECT item, state FROM st WHERE NOT (state = 'in_progress' AND owner IN (SELECT owner FROM st GROUP BY 1 HAVING count(*) FILTER (state = 'in_progress') > 4))")
def release_owner(spark, sf):
    """Owners that hold more than four items lose them."""
    s = states(spark, sf)
    greedy = s.groupBy("owner").agg(F.count_if(F.col("state") == "in_progress").alias("n")).where("n > 4")
    return LE.release_owner(s, greedy).select("item", "state")


@query("stale_reservations", f"WITH {LED_SQL} SELECT item FROM le WHERE state = 'in_progress' INTERSECT SELECT item FROM le WHERE state = 'processed'")
def stale_reservations(spark, sf):
    return LE.stale_reservations(ledger_events(spark, sf))


@query(
    "heartbeat_activity",
    f"""WITH {LED_SQL} SELECT owner, CAST(floor(epoch_us(ts) / 300000000) AS BIGINT) * 300000000 AS start, count(*) AS beats, max(epoch_us(ts)) AS last FROM le WHERE state = 'available' GROUP BY 1, 2""",
)
def heartbeat_activity(spark, sf):
    d = LE.heartbeat_activity(beats(spark, sf))
    return d.select("owner", F.unix_micros("start").alias("start"), "beats", F.unix_micros("last").alias("last"))


@query(
    "progress_report",
    f"""WITH {LED_SQL} SELECT folder, count(*) FILTER (state = 'processed') AS processed, count(*) FILTER (state = 'failed') AS failed,
  count(*) FILTER (state NOT IN ('processed', 'failed')) AS pending, count(*) AS total FROM st GROUP BY 1""",
)
def progress_report(spark, sf):
    s = states(spark, sf)
    return LE.progress_report(s.select("item", "folder"), s.select("item", "state"))


@query(
    "progress_rate",
    f"""WITH {LED_SQL} SELECT (CAST(floor(epoch_us(ts) / 900000000) AS BIGINT) - k) * 900000000 AS start, state, count(*) AS n
FROM le CROSS JOIN (SELECT unnest(range(0, 4)) AS k) WHERE state IN ('processed', 'failed') GROUP BY 1, 2""",
)
def progress_rate(spark, sf):
    d = LE.progress_rate(ledger_events(spark, sf))
    return d.select(F.unix_micros("start").alias("start"), "state", "n")


@query(
    "segment_by_gap",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 10 HOUR THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(epoch_us(ts)) AS start, max(epoch_us(ts)) AS stop, count(*) AS "rows" FROM s GROUP BY user_id, k""",
)
def segment_by_gap(spark, sf):
    d = LE.segment_by_gap(events(spark, sf), ["user_id"], "ts", "10 hours")
    return d.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "rows")


SIG_RULES = SG.SegmentRules(fps=4.0, box_area=20.0, high=300.0, low=5.0, longest=40, min_segment=0.5)


def frame_signals(spark, sf):
    """A user's events as frames: errors are frames without a human."""
    d = event_track(spark, sf, "event_type", "value")
    v = F.col("value")
    return d.select(
        "user_id", "pos", (F.col("event_type") != "error").alias("human"), v.alias("max_area"),
        F.when(F.col("pos") % 5 == 0, v).alias("flow"), (v < 3).alias("is_repeat"), (v > 15).alias("target_visible"),
        F.lit(True).alias("has_targets"), (v > 200).alias("crowded"), (v > 250).alias("odd_pose"),
    )


def _segments_sql(r: SG.SegmentRules) -> str:
    """The rules frame by frame: every level reads the one inside it, the recursion joins a user's next frame."""
    n, fps = r.frames, int(r.fps)
    keep = lambda own: ", ".join(c for c in STATE if c not in own)

    def level(inner: str, **own: str) -> str:
        state = keep(own)
        return f"SELECT user_id, pos, {SEEN}, reasons, done, {state}{', ' if state else ''}{', '.join(f'{e} AS {c}' for c, e in own.items())} FROM ({inner})"

    SEEN = "h, small_box, kind, rep, vis, cr, od"
    STATE = ("is_open", "start", "written", "buffered", "silent", "repeats", "small", "still", "fast", "missing", "cut", "seen", "targets", "crowded", "odd")
    sig = f"""sig AS (SELECT user_id, pos, event_type <> 'error' AS h, value < {r.box_area} AS small_box,
  CASE WHEN pos % 5 = 0 AND value > {r.high} THEN 1 WHEN pos % 5 = 0 AND value < {r.low} THEN -1 ELSE 0 END AS kind,
  value < 3 AS rep, value > 15 AS vis, value > 200 AS cr, value > 250 AS od FROM ev)"""
    joined = f"""SELECT g.user_id, g.pos, g.h, g.small_box, g.kind, g.rep, g.vis, g.cr, g.od, CAST([] AS VARCHAR[]) AS reasons, CAST(NULL AS BIGINT[]) AS done, {', '.join(f's.{c}' for c in STATE)}
  FROM st s JOIN sig g ON g.user_id = s.user_id AND g.pos = s.pos + 1"""
    # counters of the frame
    d = level(
        joined, silent="CASE WHEN h THEN 0 ELSE silent + 1 END", seen="CASE WHEN h THEN seen + 1 ELSE seen END",
        repeats="CASE WHEN NOT h THEN repeats WHEN rep THEN repeats + 1 ELSE 0 END", small="CASE WHEN NOT h OR small_box THEN small + 1 ELSE 0 END",
        fast="CASE WHEN h AND kind = 1 THEN fast + 1 WHEN h AND kind = -1 THEN 0 ELSE fast END", still="CASE WHEN h AND kind = -1 THEN still + 1 WHEN h AND kind = 1 THEN 0 ELSE still END",
        crowded="crowded OR (h AND cr)", odd="odd OR (h AND od)",
    )
    # what fires; has_targets is always true here
    why = (("frozen", f"h AND repeats >= {r.frozen}"), ("small box", f"h AND small_box AND small >= {n(r.small_box)}"), ("high flow", f"h AND kind = 1 AND fast >= {n(r.high_flow)}"), ("static", f"h AND kind = -1 AND still >= {n(r.static_flow)}"))
    fires = dict(why)
    hits = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in why)
    d = level(
        d, targets=f"CASE WHEN h AND seen = {fps} THEN true ELSE targets END", repeats=f"CASE WHEN {fires['frozen']} THEN 0 ELSE repeats END",
        cut=f"CASE WHEN {fires['high flow']} THEN least(fast, buffered) WHEN {fires['static']} THEN least(still, buffered) WHEN {fires['small box']} THEN least(small, buffered) ELSE cut END",
        small=f"CASE WHEN {fires['small box']} THEN 0 ELSE small END", fast=f"CASE WHEN {fires['high flow']} THEN 0 ELSE fast END", still=f"CASE WHEN {fires['static']} THEN 0 ELSE still END",
    ).replace("reasons, done", f"list_filter([{hits}], lambda x: x IS NOT NULL) AS reasons, done", 1)
    # a human opens a segment
    opens = "h AND NOT is_open"
    zero = {c: f"CASE WHEN {opens} THEN 0 ELSE {c} END" for c in ("written", "still", "fast", "seen", "missing", "cut")}
    d = level(d, is_open="is_open OR h", start=f"CASE WHEN {opens} THEN pos + 1 ELSE start END", targets=f"CASE WHEN {opens} THEN false ELSE targets END", **zero)
    # a target that stays away closes it: ``done`` holds start, frames and 1 for this way
    d = level(d, missing="CASE WHEN targets AND NOT vis THEN missing + 1 ELSE missing END")
    lost = f"targets AND NOT vis AND missing >= {r.fps} AND is_open"
    d = level(d).replace("reasons, done", f"""CASE WHEN {lost} THEN list_append(reasons, 'no target') WHEN written >= {r.longest} THEN list_append(reasons, 'too long') ELSE reasons END AS reasons,
  CASE WHEN {lost} THEN [start, written + greatest(0, buffered - missing), 1] END AS done""", 1)
    grown = f"greatest(0, buffered + 1 - {n(r.margin)})"
    adds = "done IS NULL AND is_open"
    d = level(
        d, written=f"CASE WHEN {adds} AND len(reasons) = 0 THEN written + {grown} ELSE written END",
        buffered=f"CASE WHEN {adds} AND len(reasons) = 0 THEN buffered + 1 - {grown} WHEN {adds} THEN buffered + 1 ELSE buffered END",
    )
    # a fired rule or silence closes it
    quiet = f"silent >= {n(r.no_human)}"
    closes = f"done IS NULL AND is_open AND (len(reasons) > 0 OR {quiet})"
    d = level(d).replace("reasons, done", f"""CASE WHEN {closes} AND {quiet} THEN list_append(reasons, 'no human') ELSE reasons END AS reasons,
  CASE WHEN {closes} THEN [start, written + greatest(0, buffered - CASE WHEN {quiet} THEN least(silent, buffered) ELSE cut END), 2] ELSE done END AS done""", 1)
    d = f"SELECT *, crowded AS was_crowded, odd AS was_odd FROM ({d})"
    after = {c: f"CASE WHEN done IS NOT NULL THEN 0 ELSE {c} END" for c in ("written", "buffered", "missing")}
    after |= {c: f"CASE WHEN done IS NOT NULL THEN false ELSE {c} END" for c in ("is_open", "crowded", "odd")}
    after |= {c: f"CASE WHEN done[3] = 2 THEN 0 ELSE {c} END" for c in ("still", "fast", "seen", "cut")}
    after["targets"] = "CASE WHEN done[3] = 2 THEN false ELSE targets END"
    step = f"SELECT user_id, pos, reasons, done, was_crowded, was_odd, {', '.join(f'{after.get(c, c)} AS {c}' for c in STATE)} FROM ({d})"
    truth = ("is_open", "targets", "crowded", "odd")
    first = f"""SELECT DISTINCT user_id, CAST(-1 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS reasons, CAST(NULL AS BIGINT[]) AS done, false AS was_crowded, false AS was_odd,
  {', '.join(f'false AS {c}' if c in truth else f'CAST(0 AS BIGINT) AS {c}' for c in STATE)} FROM sig"""
    return f"""WITH RECURSIVE {EV_SQL}, {sig}, st AS ({first} UNION ALL {step}),
z AS (SELECT user_id, max(pos) AS pos FROM sig GROUP BY 1),
o AS (SELECT user_id, done[1] AS start, done[2] AS frames, was_crowded AS crowded, was_odd AS odd_pose, array_to_string(reasons, ',') AS reasons FROM st WHERE done IS NOT NULL
  UNION ALL SELECT user_id, start, written + greatest(0, buffered - missing), crowded, odd, 'end of video' FROM st JOIN z USING (user_id, pos) WHERE is_open)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start) AS INT) AS number, CAST(start AS INT) AS start, CAST(frames AS INT) AS frames, crowded, odd_pose, reasons
FROM o WHERE frames >= {n(r.min_segment)}"""


@query("segment_scenes", _segments_sql(SIG_RULES))
def segment_scenes(spark, sf):
    d = SG.segment_scenes(frame_signals(spark, sf), EV, SIG_RULES)
    return d.select("user_id", "number", "start", "frames", "crowded", "odd_pose", F.array_join("reasons", ",").alias("reasons"))


def face_boxes(spark, sf):
    """Events as one or more boxes on quarter-day frames of their user."""
    e = events(spark, sf)
    f = F.floor(F.unix_micros("ts") / F.lit(21_600_000_000)).cast("long")
    v = F.col("value")
    emb = F.array(v / 100, F.length("event_type") / F.lit(8.0), F.lit(0.5))
    return e.select("user_id", f.alias("frame"), v.alias("x1"), (v / 2).alias("y1"), (v + 80).alias("x2"), (v / 2 + 60).alias("y2"), emb.alias("embedding"))


@query("track_faces")
def track_faces(spark, sf):
    return SG.track_faces(face_boxes(spark, sf), ["user_id"], "frame")


# ---- streams -----------------------------------------------------------------


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    d = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 100).parquet(sf)
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "trailing_mode_stream",
    f"""WITH {EV_SQL}
SELECT user_id, event_id, smoothed FROM (
  SELECT a.user_id, a.event_id, b.event_type AS smoothed, row_number() OVER (PARTITION BY a.user_id, a.pos ORDER BY count(*) DESC, min(b.pos)) AS r
  FROM ev a JOIN ev b ON b.user_id = a.user_id AND b.pos BETWEEN a.pos - 19 AND a.pos GROUP BY a.user_id, a.pos, a.event_id, b.event_type) WHERE r = 1""",
)
def trailing_mode_stream(spark, sf):
    d = ST.trailing_mode_stream(event_stream(spark, sf).select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", 20)
    return ST.run_available(d, ST.stream_folder(spark, "mode")).select("user_id", "event_id", "smoothed")


@query("ledger_state_stream", f"WITH {LED_SQL} SELECT item, owner, state, epoch_us(ts) AS ts FROM st")
def ledger_state_stream(spark, sf):
    """The same fold on a stream, in update mode."""
    e = event_stream(spark, sf)
    state = (
        F.when(F.col("event_type") == "purchase", "processed").when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "signup", "preprocessed").when(F.col("event_type") == "view", "available").otherwise("in_progress")
    )
    d = e.select(F.concat("user_id", F.lit("/"), F.col("event_id") % 3).alias("item"), (F.col("user_id") % 20).cast("string").alias("owner"), state.alias("state"), "ts", "event_id")
    out = ST.run_available(LE.ledger_state(d, tie="event_id"), ST.stream_folder(spark, "ledger"), "update")
    return ST.latest_by(out, ["item"]).select("item", "owner", "state", F.unix_micros("ts").alias("ts"))


@query(
    "segment_by_gap_stream",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 10 HOUR THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(epoch_us(ts)) AS start, max(epoch_us(ts)) AS stop, count(*) AS "rows" FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 10 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def segment_by_gap_stream(spark, sf):
    """Sessions of event time, each written once the watermark has passed its silence."""
    d = event_stream(spark, sf).withWatermark("ts", "1 hour")
    out = ST.run_available(LE.segment_by_gap(d, ["user_id"], "ts", "10 hours"), ST.stream_folder(spark, "sessions"))
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "rows")


@query(
    "heartbeat_activity_stream",
    f"""WITH {LED_SQL}, b AS (SELECT owner, ts, epoch_us(ts) // 300000000 * 300000000 AS start FROM le WHERE state = 'available')
SELECT owner, start, count(*) AS beats, max(epoch_us(ts)) AS last FROM b GROUP BY 1, 2
HAVING start + 300000000 <= (SELECT max(epoch_us(ts)) - 3600000000 FROM b)""",
)
def heartbeat_activity_stream(spark, sf):
    """Beats per owner and interval, written when the watermark closes the interval."""
    e = event_stream(spark, sf).where("event_type = 'view'")
    d = LE.heartbeat_activity(e.select((F.col("user_id") % 20).cast("string").alias("owner"), "ts"))
    out = ST.run_available(d, ST.stream_folder(spark, "beats"))
    return out.select("owner", F.unix_micros("start").alias("start"), "beats", F.unix_micros("last").alias("last"))


@query(
    "expire_leases_stream",
    f"""WITH {LED_SQL} SELECT item, owner, (epoch_us(ts) // 1000 + 43200000) * 1000 AS expired_at FROM st
WHERE state = 'in_progress' AND epoch_us(ts) // 1000 + 43200000 < (SELECT epoch_us(now) // 1000 - 3600000 FROM now)""",
)
def expire_leases_stream(spark, sf):
    """Leases whose end the watermark has passed without a later state of the item."""
    e = event_stream(spark, sf)
    state = F.when(F.col("event_type").isin("purchase", "error", "signup", "view"), "other").otherwise("in_progress")
    d = e.select(F.concat("user_id", F.lit("/"), F.col("event_id") % 3).alias("item"), (F.col("user_id") % 20).cast("string").alias("owner"), state.alias("state"), "ts")
    out = ST.run_available(ST.expire_leases_stream(d, 43200.0), ST.stream_folder(spark, "leases"))
    return out.select("item", "owner", F.unix_micros("expired_at").alias("expired_at"))


@query(
    "new_files_only",
    "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
)
def new_files_only(spark, sf):
    """A second run over the same checkpoint adds nothing."""
    path = ST.stream_folder(spark, "files")
    d = event_stream(spark, sf).select("event_id", "event_type")
    ST.run_available(d, path)
    return ST.run_available(d, path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("segment_scenes_stream")
def segment_scenes_stream(spark, sf):
    """Raw events as frames on a stream (frame = event id)."""
    v = F.col("value")
    d = event_stream(spark, sf).select(
        "user_id", F.col("event_id").alias("pos"), (F.col("event_type") != "error").alias("human"), v.alias("max_area"), v.alias("flow"),
        (v < 3).alias("is_repeat"), (v > 15).alias("target_visible"), F.lit(True).alias("has_targets"), (v > 200).alias("crowded"), (v > 250).alias("odd_pose"),
    )
    d = ST.segment_scenes_stream(d, ["user_id"], "pos", SIG_RULES)
    return ST.run_available(d, ST.stream_folder(spark, "segments")).withColumn("reasons", F.array_join("reasons", ","))


