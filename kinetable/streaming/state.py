"""Streaming forms of the causal operators.

Each keeps a small state per key and gives the same rows as its batch form
when frames arrive in order across micro-batches (within one they may be
mixed). Sinks are tables on shared storage; nothing is gathered on the driver.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinetable.operators import segments as SG
from kinetable.session import shared_base


def _types(df: DataFrame, cols: list[str]) -> str:
    t = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {t[c]}" for c in cols)


def _ordered(parts: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    """One key's rows of one micro-batch, in order."""
    rows = [p for p in parts if len(p)]
    return pd.concat(rows, ignore_index=True).sort_values(order) if rows else pd.DataFrame()


def trailing_mode_stream(df: DataFrame, keys: list[str], order: str, label: str, width: int = 20) -> DataFrame:
    """Label smoothing on a feed; state: the last ``width - 1`` labels."""
    schema = _types(df, [*keys, order, label]) + ", smoothed string"

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        rows = _ordered(parts, order)
        out = []
        for v in rows[label]:
            past = [*past, v][-width:]
            n = Counter(past)  # keeps first-seen order, so ties go to the oldest
            out.append(max(n, key=n.get))
        state.update((past,))
        res = rows[[*keys, order, label]].copy()
        res["smoothed"] = out
        yield res

    return df.groupBy(*keys).applyInPandasWithState(run, schema, "past array<string>", "append", GroupStateTimeout.NoTimeout)


def segment_scenes_stream(df: DataFrame, keys: list[str], order: str, rules: SG.SegmentRules = SG.SegmentRules()) -> DataFrame:  # noqa: B008
    """Segments as they close. A video's last open segment closes when a row
    with null ``human`` (end marker) arrives."""
    cols = [c.split()[0] for c in SG.SEGMENT_FIELDS.split(", ")]
    schema = _types(df, keys) + ", " + SG.SEGMENT_FIELDS

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = SG.SegmentState(*state.get) if state.exists else SG.SegmentState()
        got = []
        for row in _ordered(parts, order).rename(columns={order: "frame"}).to_dict("records"):
            done = SG.segment_end(s, rules) if row["human"] is None else SG.segment_step(s, row, rules)
            if done:
                got.append(done)
        state.update(tuple(v if isinstance(v, bool) else int(v) for v in astuple(s)))
        if got:
            yield pd.DataFrame(got, columns=cols).assign(**dict(zip(keys, key)))[[*keys, *cols]]

    return df.groupBy(*keys).applyInPandasWithState(run, schema, SG.STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def _pack(t: SG.FaceTracker, at: int | None) -> str:
    rows = [[x.ident, x.mean, x.cov, None if x.embedding is None else x.embedding.tolist(), x.missed] for x in t.tracks]
    return json.dumps([t.next_id, None if at is None else int(at), rows])


def _unpack(text: str, tracker: SG.FaceTracker) -> int | None:
    tracker.next_id, at, rows = json.loads(text)
    tracker.tracks = [SG.FaceTrack(i, m, c, None if e is None else np.array(e), k) for i, m, c, e, k in rows]
    return at


def track_faces_stream(df: DataFrame, keys: list[str], order: str, max_miss: int = 30, iou_min: float = 0.25, weight: float = 0.5) -> DataFrame:
    """Face identities on a feed; state: the live tracks of a video. A frame's
    detections must arrive in one micro-batch."""
    cols = [c.split()[0] for c in SG.FACE_FIELDS.split(", ")]
    names = [*keys, order]
    schema = _types(df, names) + ", " + SG.FACE_FIELDS

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = SG.FaceTracker(weight, iou_min, max_miss)
        feed = SG.FaceFeed(tracker, _unpack(state.get[0], tracker) if state.exists else None)
        out = []
        for row in _ordered(parts, order).rename(columns={order: "frame"}).to_dict("records"):
            out += feed.add(row)
        out += feed.flush()
        state.update((_pack(tracker, feed.at),))
        if out:
            yield pd.DataFrame(out, columns=[order, *cols]).assign(**dict(zip(keys, key)))[[*names, *cols]]

    return df.groupBy(*keys).applyInPandasWithState(run, schema, "packed string", "append", GroupStateTimeout.NoTimeout)


def expire_leases_stream(events: DataFrame, lease: float = 9000.0, delay: str = "3600 seconds") -> DataFrame:
    """(item, owner, expired_at) once event time passes an unfinished lease.

    ``events``: item, owner, state, ts. The watermark allows ``delay`` of
    lateness; a later state of the item cancels the timer.
    """
    d = events.withWatermark("ts", delay)
    schema = "item string, owner string, expired_at timestamp"

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            owner, ms = state.get
            state.remove()
            yield pd.DataFrame({"item": [key[0]], "owner": [owner], "expired_at": [pd.Timestamp(ms, unit="ms")]})
            return
        rows = _ordered(parts, "ts")
        if not len(rows):
            return
        last = rows.iloc[-1]
        if last["state"] == "in_progress":
            due = int(last["ts"].value // 1_000_000 + lease * 1000)
            state.update((last["owner"], due))
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return d.groupBy("item").applyInPandasWithState(run, schema, "owner string, due long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_folder(spark, name: str) -> str:
    """A fresh folder on the shared checkpoint storage."""
    return f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_available(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what is there and return the sink table.

    Append mode uses the exactly-once file sink. Update mode appends each
    micro-batch with its number in ``batch``; the highest is the newest.
    """
    spark = df.sparkSession
    out, mark = f"{path}/out", f"{path}/checkpoint"
    w = df.writeStream.trigger(availableNow=True).option("checkpointLocation", mark).outputMode(mode)
    if mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:

        def sink(batch: DataFrame, n: int) -> None:
            batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/part={n}")

        q = w.foreachBatch(sink).start()
    q.awaitTermination()
    return spark.read.schema(_table_schema(df, mode)).parquet(out)


def _table_schema(df: DataFrame, mode: str):
    return df.schema if mode == "append" else T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])


def latest_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row per key of an update-mode table."""
    cols = [c for c in df.columns if c not in keys and c not in ("batch", "part")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("_r")).select(*keys, "_r.*")
