"""Pairing, cost tables, assignment and lookups."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions import boxes as B
from kinetable.operators.blocks import number_rows


def pair_body_face(bodies: DataFrame, faces: DataFrame, body_name: str, face_name: str) -> DataFrame:
    """Inner join of files named ``<id>_body`` and ``<id>_face``."""
    b = bodies.withColumn("pair", F.regexp_extract(body_name, r"^([^_]+)_body", 1))
    f = faces.withColumn("pair", F.regexp_extract(face_name, r"^([^_]+)_face", 1))
    return b.where("pair != ''").join(f.where("pair != ''"), "pair")


def merge_with_defaults(bodies: DataFrame, faces: DataFrame, keys: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Keep every body row; missing face values become the defaults."""
    d = bodies.join(faces, keys, "left")
    return d.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def face_body_cost(faces: DataFrame, bodies: DataFrame, scene: list[str], frame: str, face: str, body: str, cost: Column) -> DataFrame:
    """Mean cost over the frames a face and a body share.

    The join key holds the frame, so a long scene spreads over all tasks, and
    the means are combined before their shuffle.
    """
    d = faces.join(bodies, [*scene, frame])
    return d.groupBy(*scene, face, body).agg(F.avg(cost).alias("cost"))


def landmark_cost(face_points: list[tuple[Column, Column]], body_points: list[tuple[Column, Column]]) -> Column:
    """Sum of distances between matching averaged landmarks."""
    return sum(
        (F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1])) for a, b in zip(face_points, body_points)),
        F.lit(0.0),
    )


def solve_assignment(left: np.ndarray, right: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which of the pairs (left, right, cost) make the cheapest of the largest
    1:1 assignments.

    Shortest augmenting paths with dual prices over the pairs that exist, so
    memory and each step follow the pairs and not the product of the sides.
    Every left node may stay alone at a price above any saving; paths never
    leave the connected component they start in.
    """
    if not len(cost):
        return np.zeros(0, int)
    wall = float((np.abs(cost).max() + 1.0) * (len(np.unique(left)) + len(np.unique(right)) + 1))
    low = float(min(cost.min(), 0.0))
    pairs: dict[int, list[tuple[int, float, int]]] = {}
    for k, (i, j, c) in enumerate(zip(left.tolist(), right.tolist(), cost.tolist(), strict=True)):
        pairs.setdefault(i, []).append((j, c - low, k))
    mate: dict[int, tuple[int, int]] = {}  # left node: its right node and pair
    owner: dict[int, int] = {}  # right node: its left node
    price_l, price_r = dict.fromkeys(pairs, 0.0), dict.fromkeys(right.tolist(), 0.0)
    for start in pairs:
        dist: dict[int, float] = {}
        via: dict[int, tuple[int, int]] = {}  # right node: the left node and pair it was reached by
        done: dict[int, float] = {}
        reached, heap, cur, base = {start: 0.0}, [], start, 0.0
        alone = (np.inf, start)  # the cheapest way to leave some left node alone
        while True:
            alone = min(alone, (base + wall - price_l[cur], cur))
            for j, c, k in pairs[cur]:
                way = base + c - price_l[cur] - price_r[j]
                if j not in done and way < dist.get(j, np.inf):
                    dist[j], via[j] = way, (cur, k)
                    heapq.heappush(heap, (way, j))
            while heap and heap[0][1] in done:
                heapq.heappop(heap)
            if not heap or alone[0] <= heap[0][0]:
                base = alone[0]
                end = mate.pop(alone[1])[0] if alone[1] != start else None
                break
            base, end = heapq.heappop(heap)
            done[end] = base
            if end not in owner:
                break
            cur = owner[end]
            reached[cur] = base
        for i, way in reached.items():
            price_l[i] += base - way
        for j, way in done.items():
            price_r[j] -= base - way
        while end is not None:  # shift the pairs along the path
            i, k = via[end]
            before = mate.get(i)
            mate[i], owner[end] = (end, k), i
            end = before[0] if i != start else None
    return np.array(sorted(k for _, k in mate.values()), int)


def assign_min_cost(costs: DataFrame, group: list[str], left: str, right: str, cost: str = "cost", cutoff: float | None = None) -> DataFrame:
    """Optimal 1:1 assignment per group of a cost table.

    A group is one scene's persons. Pairs absent from the table are never
    assigned; with ``cutoff`` only pairs cheaper than it are kept.
    A group's memory follows its pairs in the table.
    """
    fields = {f.name: f.dataType.simpleString() for f in costs.schema.fields}
    names = [*group, left, right, cost]
    schema = ", ".join(f"`{c}` {fields[c]}" for c in names)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[cost].notna()]
        chosen = pdf.iloc[solve_assignment(pd.factorize(pdf[left], sort=True)[0], pd.factorize(pdf[right], sort=True)[0], pdf[cost].to_numpy(dtype=float))]
        return (chosen if cutoff is None else chosen[chosen[cost] < cutoff])[names]

    return costs.select(*names).groupBy(*group).applyInPandas(solve, schema)


def attach_captions(clips: DataFrame, captions: DataFrame, keys: list[str]) -> DataFrame:
    """Clips without a caption are dropped."""
    return clips.join(captions, keys)


def missing_sources(index: DataFrame, sources: DataFrame, on: list[str]) -> DataFrame:
    return index.join(sources, on, "left_anti")


def not_treated(candidates: DataFrame, seen: DataFrame, ident: str, title: str) -> DataFrame:
    """Drop candidates whose id or cleaned title was seen. Two anti joins
    instead of one with OR, so both stay hash joins."""
    d = candidates.join(seen.select(ident).where(F.col(ident).isNotNull()).distinct(), ident, "left_anti")
    norm = F.lower(F.trim(F.replace(F.col(title), F.lit("|"), F.lit(""))))
    known = seen.select(norm.alias("_t")).where(F.col("_t").isNotNull()).distinct()
    return d.withColumn("_t", norm).join(known, "_t", "left_anti").drop("_t")


def vocab_lookup(words: DataFrame, vocab: DataFrame, word: str, unk: str = "unk") -> DataFrame:
    """Vector of each word; unknown words get the ``unk`` row's vector.

    A plain join: Spark broadcasts the vocabulary when its measured size
    allows it.
    """
    fallback = vocab.where(F.col("word") == unk).select("vec").scalar()
    v = vocab.withColumnRenamed("word", word)
    return words.join(v, word, "left").withColumn("vec", F.coalesce("vec", fallback))


def vip_tag(words: DataFrame, vip: DataFrame, word: str, pos: str, known: DataFrame | None = None) -> DataFrame:
    """Class of a word: the best-ranked special class, else its own part of
    speech, else OTHER for words outside ``known``."""
    best = vip.groupBy("word").agg(F.min_by("class", "rank").alias("_c")).withColumnRenamed("word", word)
    d = words.join(best, word, "left")
    own = F.col(pos)
    if known is not None:
        d = d.join(known.select(F.col("word").alias(word)).distinct().withColumn("_k", F.lit(True)), word, "left")
        own = F.when(F.col("_k"), own)
    return d.withColumn("class", F.coalesce("_c", own, F.lit("OTHER"))).drop("_c", "_k")


def best_overlap(a: DataFrame, b: DataFrame, frame: list[str], a_id: str, b_id: str, a_box: list[str], b_box: list[str], thr: float = 0.30) -> DataFrame:
    """Best match by overlap for every box of ``a`` on its frame."""
    o = B.iou(tuple(F.col(c) for c in a_box), tuple(F.col(c) for c in b_box))
    d = a.join(b, frame).withColumn("iou", o).where(F.col("iou") >= thr)
    best = F.max_by(F.struct(F.col(b_id), F.col("iou")), F.struct(F.col("iou"), -F.col(b_id)))
    return d.groupBy(*frame, a_id).agg(best.alias("_m")).select(*frame, a_id, F.col("_m")[b_id].alias(b_id), F.col("_m.iou").alias("iou"))


def compact_scenes(df: DataFrame, video: list[str], part: list[str], payload: list[str], bucket: Column, size: int = 10_000) -> DataFrame:
    """One record per video that lists its per-person records in key order.

    A video with more than ``size`` records continues in further chunks, so no
    list outgrows a task. ``bucket`` is a non-decreasing function of ``part``.
    """
    d = number_rows(df, video, part, bucket, "_n").withColumn("chunk", F.floor(F.col("_n") / size))
    return d.groupBy(*video, "chunk").agg(F.array_sort(F.collect_list(F.struct(*part, *payload))).alias("records"))


def verify_keys(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected keys that were not found (multiset difference)."""
    return expected.exceptAll(found)


def union_flags(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


def combine_datasets(named: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """Union of named tables with their frame rates."""
    out = None
    for name, (df, fps) in named.items():
        d = df.withColumns({"dataset": F.lit(name), "fps": F.lit(float(fps))})
        out = d if out is None else out.unionByName(d)
    return out


def quarantine(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with the first failed check as ``reason``."""
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(n)) for n, bad in checks.items()])
    d = df.withColumn("reason", reason)
    return d.where(F.col("reason").isNull()).drop("reason"), d.where(F.col("reason").isNotNull())


def sequence_udf(df: DataFrame, keys: list[str], order: str, fn, schema: str) -> DataFrame:
    """Run a user function over every sequence.

    ``fn(rows)`` gets an iterator of pandas chunks of one sequence in order
    and yields result chunks, so a long sequence never sits in memory whole.
    """
    def pieces(it: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
        for pdf in it:
            if not len(pdf):
                continue
            k = pdf[keys]
            starts = np.flatnonzero((k != k.shift()).any(axis=1).to_numpy())
            for a, b in zip(starts, [*starts[1:], len(pdf)]):
                yield tuple(k.iloc[a]), pdf.iloc[a:b].reset_index(drop=True)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, part in groupby(pieces(it), key=lambda t: t[0]):
            yield from fn(rows for _, rows in part)

    return _in_order(df, keys, order).mapInPandas(run, schema)


def _in_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Whole sequences per task, sorted. The explicit partition count keeps
    small but slow inputs on many tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, order)


def fold_rows(df: DataFrame, keys: list[str], order: str, start, step, end, fields: str) -> DataFrame:
    """Run a state machine along every sequence, row by row.

    ``start()`` makes a state, ``step(state, row)`` and ``end(state)`` return
    lists of output tuples matching ``fields``; keys are added. Output is sent
    once per Arrow batch, so many short sequences stay cheap, and only the
    state of one sequence is held.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + fields
    rest = [c for c in df.columns if c not in keys]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, names = None, None, None
        for pdf in it:
            out = []
            heads = zip(*[pdf[k].tolist() for k in keys])
            rows = zip(*[pdf[c].tolist() for c in rest])
            for k, vals in zip(heads, rows):
                if k != key:
                    if key is not None:
                        out += [(*key, *r) for r in end(state)]
                    key, state = k, start()
                out += [(*k, *r) for r in step(state, dict(zip(rest, vals)))]
            if out:
                names = names or [*keys, *fields_of(fields)]
                yield pd.DataFrame(out, columns=names)
        if key is not None and (out := [(*key, *r) for r in end(state)]):
            yield pd.DataFrame(out, columns=[*keys, *fields_of(fields)])

    return _in_order(df, keys, order).mapInPandas(run, schema)


def fields_of(fields: str) -> list[str]:
    """Column names of a flat field list."""
    return [f.split()[0].strip("`") for f in fields.split(", ")]
