"""Work ledger: who holds which item, what is done, what may be taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lease and heartbeat rules in seconds.
LEASE = 9000.0
BEAT = 300.0
BEATS = 12


def ledger_state(events: DataFrame, item: str = "item", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Latest event per item. The newest row is found by a map-combined
    aggregate, so an item with very many events is no problem."""
    cols = [c for c in events.columns if c != item]
    order = F.struct(ts, tie) if tie else F.col(ts)
    best = F.max_by(F.struct(*cols), order)
    return events.groupBy(item).agg(best.alias("_e")).select(item, "_e.*")


def _age(now: Column, ts: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / 1e6


def expired_leases(state: DataFrame, beats: DataFrame | None, now: Column, lease: float = LEASE, beat: float = BEAT, beats_allowed: int = BEATS) -> DataFrame:
    """In-progress items whose lease is too old or whose owner went silent.

    An owner that never sent a heartbeat is judged by the lease alone.
    """
    held = state.where("state = 'in_progress'")
    late = _age(now, F.col("ts")) > lease
    if beats is None:
        return held.where(late)
    last = beats.groupBy("owner").agg(F.max("ts").alias("_beat"))
    d = held.join(last, "owner", "left")
    return d.where(late | F.coalesce(_age(now, F.col("_beat")) > beat * beats_allowed, F.lit(False))).drop("_beat")


def available_work(items: DataFrame, state: DataFrame, beats: DataFrame | None, now: Column, item: str = "item", **rules: float) -> DataFrame:
    """Items neither processed nor held by a live lease."""
    free = expired_leases(state, beats, now, **rules).select(item)
    blocked = state.where(F.col("state").isin("processed", "in_progress")).join(free, item, "left_anti").select(item)
    return items.join(blocked, item, "left_anti")


def release_owner(state: DataFrame, owners: DataFrame) -> DataFrame:
    """Drop all leases of the given owners; other rows stay."""
    gone = owners.select("owner").distinct().withColumn("_gone", F.lit(True))
    d = state.join(gone, "owner", "left")
    return d.where(~(F.coalesce("_gone", F.lit(False)) & (F.col("state") == "in_progress"))).drop("_gone")


def stale_reservations(events: DataFrame, item: str = "item") -> DataFrame:
    """Items reported in progress that are already processed."""
    in_p = events.where("state = 'in_progress'").select(item)
    return in_p.intersect(events.where("state = 'processed'").select(item))


def heartbeat_activity(beats: DataFrame, width: str = "300 seconds", delay: str = "3600 seconds") -> DataFrame:
    """Per owner and interval: beats and the newest time. On a stream rows
    later than ``delay`` are dropped."""
    d = beats.withWatermark("ts", delay) if beats.isStreaming else beats
    g = d.groupBy(F.window("ts", width).alias("w"), "owner")
    return g.agg(F.count(F.lit(1)).alias("beats"), F.max("ts").alias("last")).select("owner", F.col("w.start").alias("start"), "beats", "last")


def progress_report(items: DataFrame, state: DataFrame, folder: str = "folder", item: str = "item") -> DataFrame:
    """Processed, failed and pending items per folder."""
    d = items.join(state.select(item, "state"), item, "left")
    n = lambda c: F.count_if(c).alias
    done, bad = F.col("state") == "processed", F.col("state") == "failed"
    return d.groupBy(folder).agg(
        n(done)("processed"), n(bad)("failed"), n(F.coalesce(~(done | bad), F.lit(True)))("pending"), F.count(F.lit(1)).alias("total")
    )


def progress_rate(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Items finished per sliding window."""
    d = events.where(F.col("state").isin("processed", "failed"))
    return d.groupBy(F.window("ts", width, slide).alias("w"), "state").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "state", "n")


def segment_by_gap(df: DataFrame, keys: list[str], ts: str, gap: str) -> DataFrame:
    """Segments separated by silence of ``gap``, by session windows.

    Sessions are merged from partial ones before the shuffle. Works on a
    stream when ``ts`` carries a watermark.
    """
    g = df.groupBy(*keys, F.session_window(ts, gap).alias("w"))
    last = F.max(ts).alias("stop")
    return g.agg(F.min(ts).alias("start"), last, F.count(F.lit(1)).alias("rows")).drop("w")
