"""Prefix trie of conversations: subtree figures from an Euler tour that is ranked as a distributed list.

Every node has an enter and an exit arc, and every arc names the next one of
the tour: a depth-first walk with siblings in the order of their smallest
conversation. Chains of arcs that lie in one task are put together there; the
list that is left is made shorter by splicing out random arcs, round by
round, until a bounded rest can be ranked, and is then laid out again in
reverse. Sums over the tour up to an arc give what a subtree holds as the
difference between its exit and its enter arc.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.llm.common import stage, task_count

#: Arcs that the list is brought down to before the driver ranks them, rows of one task, ids of one stretch of a hashed list.
REST, TASK_ROWS, STRETCH = 8_192, 200_000, 50_000

#: Conversations and arcs of one of them that lie in one task before chains are put together.
NEAR_CONVS, NEAR_ARCS = 128, 8_192

ARC = ["c", "k"]


def _sorted(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` cut into ranges of ``keys`` and sorted in each; ranges cut even a key that most rows have, by the later keys."""
    return df.repartitionByRange(task_count(df.sparkSession, rows, TASK_ROWS), *keys).sortWithinPartitions(*keys)


def running(df: DataFrame, key: str, order: list[str], sums: list[str] | None = None, xors: list[str] | None = None) -> DataFrame:
    """``df`` with each column of ``sums`` and ``xors`` (long) running over its key's rows in ``order``, the row included.

    Each range of rows runs by itself; a key that goes on over several ranges
    gets what the earlier ones add up to, one row for each range.
    """
    ops = {**dict.fromkeys(sums or [], np.add), **dict.fromkeys(xors or [], np.bitwise_xor)}
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, dict.fromkeys(ops, 0)
        for b in batches:
            if not b.num_rows:
                continue
            k = np.asarray(b.column(names.index(key)))
            first = np.append(True, k[1:] != k[:-1])
            start = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
            cols = list(b.columns)
            for c, op in ops.items():
                v = np.asarray(b.column(names.index(c))).copy()
                total = op.accumulate(v)
                earlier = np.append(np.int64(0), total[:-1])[start]
                v = total - earlier if op is np.add else total ^ earlier
                if k[0] == last:
                    own = start == 0
                    v[own] = op(v[own], carry[c])
                carry[c] = v[-1]
                cols[names.index(c)] = pa.array(v)
            last = k[-1]
            yield pa.RecordBatch.from_arrays(cols, names=[*names])

    out = stage(_sorted(df, df.count(), key, *order).mapInArrow(run, df.schema).withColumn("_part", F.spark_partition_id()))
    spans = out.groupBy(key).agg(F.min("_part").alias("a"), F.max("_part").alias("z")).filter("a < z").select(key)
    # Ranges meet at as many keys as there are ranges at most.
    ends = out.join(F.broadcast(spans), key).groupBy(key, "_part").agg(F.max(F.struct(*order, *ops)).alias("e")).select(key, "_part", *[F.col("e")[c].alias(c) for c in ops]).collect()
    carry: dict[tuple[int, int], list[int]] = {}
    state: dict[int, list[int]] = {}
    for r in sorted(ends, key=lambda r: (r[key], r["_part"])):
        carry[r[key], r["_part"]] = state.get(r[key], [0] * len(ops))
        state[r[key]] = [int(op(x, r[c])) for x, (c, op) in zip(carry[r[key], r["_part"]], ops.items(), strict=True)]
    if not carry:
        return out.drop("_part")
    kind = T.StructType([T.StructField("_key", T.LongType()), T.StructField("_at", T.IntegerType()), *[T.StructField(f"_{c}", T.LongType()) for c in ops]])
    more = df.sparkSession.createDataFrame([(*k, *v) for k, v in carry.items()], kind)
    out = out.join(F.broadcast(more), (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_at")), "left")
    zero = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0).cast("long"))
    new = {c: F.col(c) + zero(c) if op is np.add else F.col(c).bitwiseXOR(zero(c)) for c, op in ops.items()}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in names])


def turns_in_order(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 0), digest (of role and text) and n_bytes (of the text) of every row.

    Turns are ordered by ``turn_col``, null first; rows of one turn by their
    digest, so that equal rows follow each other. A null role or text is
    empty. Rows without a conversation's id belong to none and are left out.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("pos"),
    )
    return running(rows, "conv", ["turn", "digest"], sums=["pos"]).select("conv", (F.col("pos") - 1).alias("pos"), "digest", "n_bytes")


def regraft(turns: DataFrame, head: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation's first ``head`` turns (``most`` at most) become those of conversation ``base``.

    ``head`` and ``base`` are columns of ``conv``. The new conversation is the
    first ``head`` turns of ``base``, all if it has fewer and none if it does
    not exist, and its own turns from ``head`` on. Returns the turns (conv,
    pos, digest, n_bytes, last: whether none follows) and all conversations
    (conv, n: turns, which may be none).
    """
    turns = stage(turns)
    heads = turns.filter(F.col("pos") < most).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "n_bytes"))).alias("first"))
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"h": head.cast("long"), "base": base.cast("long")})
    own = stage(sizes.join(heads.select(F.col("conv").alias("base"), "first"), "base", "left"))
    taken = F.least(F.col("h"), F.coalesce(F.size("first"), F.lit(0)).cast("long"))
    own = own.withColumn("taken", taken).withColumn("total", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    front = own.filter("taken > 0").select("conv", "total", F.explode(F.slice("first", 1, F.col("taken").cast("int"))).alias("t")).select("conv", "t.pos", "t.digest", "t.n_bytes", "total")
    back = turns.join(own.select("conv", "h", "taken", "total"), "conv").filter("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "n_bytes", "total")
    every = front.union(back).select("conv", "pos", "digest", "n_bytes", (F.col("pos") + 1 == F.col("total")).alias("last"))
    return every, own.select("conv", F.col("total").alias("n"))


def _nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv, depth, parent, n_convs, n_children, saving, ka, kb of every node, and ka, kb, depth and conv of every conversation's end.

    A sequence's key is the exclusive or of two 64-bit hashes of each of its
    turns with its position, so all prefixes' keys come from one running sum.
    """
    hashed = turns.select("conv", "pos", F.xxhash64("pos", "digest").alias("ka"), F.xxhash64(F.lit(1), "pos", "digest").alias("kb"), "n_bytes", "last")
    hashed = hashed.withColumns({"a": F.col("ka"), "b": F.col("kb")})
    rows = stage(running(hashed, "conv", ["pos"], xors=["ka", "kb"]).select("conv", (F.col("pos") + 1).alias("depth"), "ka", "kb", F.col("ka").bitwiseXOR(F.col("a")).alias("pa"), F.col("kb").bitwiseXOR(F.col("b")).alias("pb"), "n_bytes", "last"))
    key = ["ka", "kb", "depth"]
    node = rows.groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).filter("conv IS NOT NULL")
    root = root.select(zero.alias("ka"), zero.alias("kb"), zero.alias("depth"), "conv", "n_convs", zero.alias("n_bytes"), none.alias("pa"), none.alias("pb"))
    node = stage(node.union(root))
    children = node.filter("depth > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    parents = node.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent"))
    full = node.join(children, key, "left").join(parents, ["pa", "pb", "depth"], "left")
    full = full.select("conv", "depth", "parent", "n_convs", F.coalesce("n_children", zero).alias("n_children"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saving"), "ka", "kb")
    ends = rows.filter("last").select(*key, "conv").union(convs.filter("n = 0").select(zero, zero, zero, "conv"))
    return stage(full), ends


def _end_hashes(ends: DataFrame) -> DataFrame:
    """ka, kb, depth, ends_sha256: of the ids that end at each node, ascending and joined by commas.

    Sorted ids are joined in stretches by many tasks; a node's stretches then go
    through one hash in their order, one at a time in memory.
    """
    key = ["ka", "kb", "depth"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [np.asarray(b.column(i)) for i in range(4)]
            if not b.num_rows:
                continue
            new = np.append(True, np.any([x[1:] != x[:-1] for x in cols[:3]], axis=0))
            place = np.arange(len(new))
            new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % STRETCH == 0
            low = np.flatnonzero(new)
            text = [",".join(map(str, cols[3][x:y].tolist())) for x, y in zip(low, [*low[1:], len(new)], strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(x[low]) for x in cols], pa.array(text, pa.string())], [*key, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, first = None, None, True
        for b in batches:
            own, out = list(zip(*[b.column(i).to_pylist() for i in range(3)], strict=True)), []
            for k, text in zip(own, b.column(4), strict=True):
                if k != now:
                    if now is not None:
                        out.append((*now, h.hexdigest()))
                    now, h, first = k, hashlib.sha256(), True
                h.update(("" if first else ",").encode() + text.as_py().encode())
                first = False
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i < 3 else pa.string()) for i in range(4)], [*key, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if i < 3 else pa.string()) for i, x in enumerate((*now, h.hexdigest()))], [*key, "ends_sha256"])

    ends = stage(ends)
    parts = _sorted(ends, ends.count(), *key, "conv").mapInArrow(write, "ka long, kb long, depth long, first long, ids string")
    return parts.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, "ka long, kb long, depth long, ends_sha256 string")


def _arcs(nodes: DataFrame) -> DataFrame:
    """The tour: c, k (arc: smallest conversation of its node, twice its depth, one more for exit), nc, nk (next arc) and the arc's own leaves and saved.

    Leaves and savings count on exit arcs. Siblings are found by sorting nodes
    by parent; what lies on the edge between two tasks is settled on the
    driver, two rows a task.
    """
    spark = nodes.sparkSession
    order = ["parent", "depth", "conv"]
    inner = nodes.filter("depth > 0").select(*order, "n_children", "saving")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows are held back by one: a row's next sibling is the row after it. edge: 1 the task's first row, 2 its last.
        held = None
        for b in batches:
            own = [np.asarray(x) for x in b.columns]
            if not b.num_rows:
                continue
            begin = held is None
            rows = own if begin else [np.append(h, x) for h, x in zip(held, own, strict=True)]
            p, d, c, kids, saving = rows
            same = (p[1:] == p[:-1]) & (d[1:] == d[:-1])
            u = slice(0, len(c) - 1)  # rows whose next one is known
            enter, leave = 2 * d, 2 * d + 1
            out = [(c[u], leave[u], np.where(same, c[1:], p[u]), np.where(same, enter[1:], leave[u] - 2), kids[u] == 0, saving[u])]
            v = slice(0 if begin else 1, None)  # rows not entered before
            first = np.append(False, ~same)[v]
            out.append((p[v][first], enter[v][first] - 2, c[v][first], enter[v][first], np.zeros(first.sum(), bool), np.zeros(first.sum(), np.int64)))
            leaf = kids[v] == 0
            out.append((c[v][leaf], enter[v][leaf], c[v][leaf], leave[v][leaf], np.zeros(leaf.sum(), bool), np.zeros(leaf.sum(), np.int64)))
            cols = [np.concatenate([o[i] for o in out]).astype(np.int64) for i in range(6)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.zeros(len(cols[0]), np.int32)), pa.nulls(len(cols[0]), pa.int64())], names)
            if begin:
                yield edge(1, *(x[0] for x in rows))
            held = [x[-1:] for x in rows]
        if held is not None:
            yield edge(2, *(x[0] for x in held))

    names = [*ARC, "nc", "nk", "leaves", "saved", "edge", "depth"]

    def edge(kind: int, p, d, c, kids, saving) -> pa.RecordBatch:
        row = (c, None, p, None, int(kids == 0), saving, kind, d)
        return pa.RecordBatch.from_arrays([pa.array([None if x is None else int(x)], pa.int32() if n == "edge" else pa.int64()) for n, x in zip(names, row, strict=True)], names)

    kind = "c long, k long, nc long, nk long, leaves long, saved long, edge int, depth long"
    made = stage(_sorted(inner, inner.count(), *order).mapInArrow(link, kind).withColumn("part", F.spark_partition_id()))
    rows = made.filter("edge > 0").collect()  # two rows a task at most
    firsts = {r.part: r for r in rows if r.edge == 1}
    lasts = {r.part: r for r in rows if r.edge == 2}
    fixed = []
    before = None
    for part in sorted(firsts):
        f, z = firsts[part], lasts[part]
        if before is not None and (before.nc, before.depth) == (f.nc, f.depth):
            fixed.append((before.c, 2 * before.depth + 1, f.c, 2 * f.depth, before.leaves, before.saved))
        else:
            if before is not None:
                fixed.append((before.c, 2 * before.depth + 1, before.nc, 2 * before.depth - 1, before.leaves, before.saved))
            fixed.append((f.nc, 2 * f.depth - 2, f.c, 2 * f.depth, 0, 0))
        before = z
    if before is not None:
        fixed.append((before.c, 2 * before.depth + 1, before.nc, 2 * before.depth - 1, before.leaves, before.saved))
    for r in nodes.filter("depth = 0").collect():  # the root
        fixed.append((r.conv, 1, None, None, int(r.n_children == 0), r.saving))
        if not r.n_children:
            fixed.append((r.conv, 0, r.conv, 1, 0, 0))
    own = "c long, k long, nc long, nk long, leaves long, saved long"
    return made.filter("edge = 0").select(*ARC, "nc", "nk", "leaves", "saved").union(spark.createDataFrame(fixed, own))


def _chains(arcs: DataFrame) -> DataFrame:
    """Arcs with the head of the chain that lies in one task, and what the chain adds up to before the arc.

    hc, hk: the head; r0, l0, s0: arcs, leaves and savings before it; leaves,
    saved: its own. Rows of heads also have the chain's next arc (nc, nk) and
    its sums (r, l, s); ``head`` tells them.
    """
    n = arcs.count()
    near = F.xxhash64(F.floor(F.col("c") / NEAR_CONVS), F.floor(F.col("k") / NEAR_ARCS))
    names = [*ARC, "hc", "hk", "r0", "l0", "s0", "leaves", "saved", "head", "nc", "nk", "r", "l", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        c, k, leaves, saved = (table[x].to_numpy() for x in ("c", "k", "leaves", "saved"))
        nc, nk = (table[x].combine_chunks().fill_null(-1).to_numpy() for x in ("nc", "nk"))  # no arc has a k below 0
        after = pd.MultiIndex.from_arrays([c, k]).get_indexer(pd.MultiIndex.from_arrays([nc, nk]))
        own = np.arange(len(c))
        before = np.full(len(c), -1)
        before[after[after >= 0]] = own[after >= 0]
        head = np.where(before >= 0, before, own)
        weights = np.stack([np.ones(len(c), np.int64), leaves, saved])
        sums = np.where(before >= 0, weights[:, before], 0)
        while (head[head] != head).any():
            sums = sums + sums[:, head]
            head = head[head]
        tail = np.flatnonzero(after < 0)
        of = head[tail]
        total = np.zeros_like(sums)
        total[:, of] = sums[:, tail] + weights[:, tail]
        ends = np.full((2, len(c)), -1)
        ends[:, of] = np.stack([nc[tail], nk[tail]])
        first = before < 0
        out = [c, k, c[head], k[head], *sums, leaves, saved, first, *ends, *total]
        for low in range(0, len(c), 50_000):
            part = slice(low, low + 50_000)
            cols = [pa.array(x[part]) for x in out[:10]] + [pa.array(x[part], mask=~first[part] | (ends[1][part] < 0)) for x in ends] + [pa.array(x[part]) for x in total]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = ", ".join(f"{x} {'boolean' if x == 'head' else 'long'}" for x in names)
    return stage(arcs.repartition(task_count(arcs.sparkSession, n, TASK_ROWS), near).mapInArrow(run, kind))


def _rank(chains: DataFrame, rest: int) -> DataFrame:
    """c, k, r, l, s of each element of the list (c, k, next nc, nk, sums r, l, s): the sums over all elements before it.

    In a round every element throws a coin. One whose coin shows 0 after one
    whose coin shows 1 is spliced out: the earlier one takes its sums and its
    next element. About a quarter goes in each round, so that all rounds
    together move some four times the list. The coins come from a hash of
    element and round, so a task that runs again throws the same.
    """
    spark = chains.sparkSession
    sums = ["r", "l", "s"]
    rounds = []
    now = chains.select(*ARC, "nc", "nk", *sums)
    while now.count() > rest:
        coin = F.xxhash64(F.lit(len(rounds)), "c", "k").bitwiseAND(1)
        one = now.filter(coin == 1).select(F.col("c").alias("ac"), F.col("k").alias("ak"), *[F.col(x).alias(f"a{x}") for x in ("nc", "nk", *sums)])
        none = now.filter(coin == 0)
        met = stage(one.join(none, (F.col("anc") == F.col("c")) & (F.col("ank") == F.col("k")), "full"))
        both, kept = F.col("ac").isNotNull() & F.col("c").isNotNull(), F.col("ac").isNotNull()
        now = met.select(
            F.when(kept, F.col("ac")).otherwise(F.col("c")).alias("c"), F.when(kept, F.col("ak")).otherwise(F.col("k")).alias("k"),
            *[F.when(both | ~kept, F.col(x)).otherwise(F.col(f"a{x}")).alias(x) for x in ("nc", "nk")],
            *[(F.coalesce(F.col(f"a{x}"), F.lit(0)) + F.coalesce(F.col(x), F.lit(0))).alias(x) for x in sums],
        )
        rounds.append(met.filter(both).select(*ARC, "ac", "ak", *[f"a{x}" for x in sums]))
    left = {(r.c, r.k): r for r in now.collect()}  # ``rest`` rows at most
    starts = set(left) - {(r.nc, r.nk) for r in left.values()}
    at, total, ranked = next(iter(starts), None), (0, 0, 0), []
    while at in left:
        r = left[at]
        ranked.append((*at, *total))
        total = tuple(x + r[c] for x, c in zip(total, sums, strict=True))
        at = r.nc, r.nk
    if len(ranked) < len(left) or len(starts) > 1:
        raise ValueError("the arcs do not form one tour")
    known = spark.createDataFrame(ranked, "c long, k long, r long, l long, s long")
    for removed in reversed(rounds):
        place = known.select(F.col("c").alias("ac"), F.col("k").alias("ak"), *sums)
        known = known.union(stage(removed.join(place, ["ac", "ak"]).select(*ARC, *[(F.col(x) + F.col(f"a{x}")).alias(x) for x in sums])))
    return known


def trie(turns: DataFrame, convs: DataFrame, rest: int = REST) -> DataFrame:
    """One row per node of the prefix trie of ``convs`` (conv) with ``turns`` (conv, pos, digest, n_bytes, last).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves and saved_tokens (sums over the subtree), ends_sha256, and the
    places of the node's two arcs in the tour, enter_at and exit_at. Without a
    conversation there is no node.
    """
    nodes, ends = _nodes(turns, convs)
    hashes = _end_hashes(ends)
    chains = _chains(_arcs(nodes))
    places = _rank(chains.filter("head"), rest).select(F.col("c").alias("hc"), F.col("k").alias("hk"), *[F.col(x).alias(f"at_{x}") for x in "rls"])
    leave = F.col("k") % 2 == 1
    before = {x: F.col(f"at_{x}") + F.col(f"{x}0") for x in "rls"}
    signed = lambda x, own: F.sum(F.when(leave, before[x] + F.col(own)).otherwise(-before[x]))
    subtree = chains.join(places, ["hc", "hk"]).groupBy(F.col("c").alias("conv"), F.floor(F.col("k") / 2).alias("depth")).agg(
        signed("l", "leaves").alias("n_leaves"), signed("s", "saved").alias("saved_tokens"),
        F.min(before["r"]).alias("enter_at"), F.max(before["r"]).alias("exit_at"),
    )
    out = nodes.join(hashes, ["ka", "kb", "depth"], "left").join(subtree, ["conv", "depth"])
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "enter_at", "exit_at",
    )


def regrafted_trie(conversations: DataFrame, head: Column, base: Column, most: int) -> DataFrame:
    """The trie of conversations whose first turns are another one's; see ``turns_in_order``, ``regraft`` and ``trie``.

    ``head`` and ``base`` are columns of ``conv``, the conversation's id.
    Nulls, ties and repeated rows are as in ``turns_in_order``; texts may be of
    any length, as only their digests are compared; other columns do not matter.
    """
    return trie(*regraft(turns_in_order(conversations), head, base, most))
