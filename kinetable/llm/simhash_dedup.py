"""SimHash near-dedup: word-shingle fingerprints joined with themselves on binary tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.llm.common import classes, stage, task_count
from kinetable.llm.trie import near_pairs, roots

SEED = 42

#: Shingles whose bits are summed at once, rows of a unit that one task joins, bits that a too large unit goes deeper.
CHUNK = 1 << 16
UNIT_ROWS = 2000
STEP = 4


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits set in over half of the shingles' hashes; 0 without a word."""
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    k = min(words, len(own))
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends.tolist()[k - 1 :]
    h, n, ones = xxhash.xxh64_intdigest, len(stops), np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = np.array([h(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + CHUNK)], stops[at : at + CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, words) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _units(fps: DataFrame, budget: int) -> DataFrame:
    """The units of work: rot, depth, pa, pb, x.

    One trie for each of ``budget + 1`` rotations, so that any two
    fingerprints in reach agree in the first block of one of them. A unit is a
    pair of nodes (prefixes pa <= pb of ``depth`` bits) with the fingerprints
    below both; it starts at the agreeing block, and as long as it has over
    ``UNIT_ROWS`` rows it is replaced by the pairs of its nodes' descendants
    that are still within the budget. It ends at 64 bits at the latest.
    """
    key = ["rot", "depth", "pa", "pb"]
    block = 64 // (budget + 1)
    turned = [F.struct(F.lit(r).alias("rot"), (F.col("fp") if not r else F.shiftleft("fp", block * r).bitwiseOR(F.shiftrightunsigned("fp", 64 - block * r))).alias("x")) for r in range(budget + 1)]
    rows = fps.select(F.explode(F.array(*turned)).alias("t")).select("t.rot", F.lit(block).alias("depth"), F.shiftrightunsigned("t.x", 64 - block).alias("pa"), "t.x")
    rows = rows.select("rot", "depth", "pa", F.col("pa").alias("pb"), "x")
    small, depth = [], block
    while True:
        rows = stage(rows)
        side = F.shiftrightunsigned("x", 64 - depth) if depth < 64 else F.col("x")
        sizes = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count(F.when(side == F.col("pa"), 1)).alias("a"), F.count(F.when(side == F.col("pb"), 1)).alias("b"))
        sizes = stage(sizes.filter(F.when(F.col("pa") == F.col("pb"), F.col("n") > 1).otherwise((F.col("a") > 0) & (F.col("b") > 0))))
        large = sizes.filter(F.col("n") > UNIT_ROWS)
        if depth >= 64 or large.isEmpty():
            small.append(rows.join(sizes.select(*key), key, "left_semi"))
            break
        small.append(rows.join(sizes.filter(F.col("n") <= UNIT_ROWS).select(*key), key, "left_semi"))
        step = min(STEP, 64 - depth)
        hot = rows.join(large.select(*key), key, "left_semi")
        here = hot.withColumn("own", F.shiftrightunsigned("x", 64 - depth)).withColumn("c", F.shiftrightunsigned("x", 64 - depth - step).bitwiseAND(F.lit((1 << step) - 1).cast("long")))
        spent = F.bit_count(F.col("pa").bitwiseXOR(F.col("pb")))
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << step) - 1).cast("long")), lambda o: spent + F.bit_count(F.col("c").bitwiseXOR(o)) <= budget)
        here = here.withColumn("o", F.explode(others))
        mine = F.shiftleft("own", step).bitwiseOR(F.col("c"))
        theirs = F.shiftleft(F.when(F.col("own") == F.col("pa"), F.col("pb")).otherwise(F.col("pa")), step).bitwiseOR(F.col("o"))
        rows = here.select("rot", F.lit(depth + step).alias("depth"), F.least(mine, theirs).alias("pa"), F.greatest(mine, theirs).alias("pb"), "x")
        depth += step
    out = small[0]
    for s in small[1:]:
        out = out.unionByName(s)
    return out


def _join_units(budget: int):
    block = 64 // (budget + 1)

    def links(rot, depth, pa, pb, x) -> tuple[np.ndarray, np.ndarray]:
        """Star links that span what the pairs of some whole units connect."""
        cut = np.flatnonzero((np.diff(rot) != 0) | (np.diff(depth) != 0) | (np.diff(pa) != 0) | (np.diff(pb) != 0)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(x)]])
        found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in np.unique(depth):
            at = depth[lo] == d
            a, b, p, q = lo[at], hi[at], pa[lo[at]].view(np.uint64), pb[lo[at]].view(np.uint64)
            ones = np.concatenate([[0], np.cumsum((x >> np.uint64(64 - d)) == pb.view(np.uint64))])
            mid = b - (ones[b] - ones[a])  # where the rows below pb begin
            own = p == q
            nodes = (a, np.where(own, b, mid), np.where(own, a, mid), b, np.where(own, 0, np.bitwise_count(p ^ q).astype(np.int64)))
            for i, j in near_pairs(x, nodes, int(d), budget):
                found_i.append(i)
                found_j.append(j)
        root = roots(len(x), np.concatenate(found_i), np.concatenate(found_j))
        linked = np.flatnonzero(root != np.arange(len(x)))
        back = (np.uint64(block) * rot.astype(np.uint64)) & np.uint64(63)
        plain = (x >> back) | np.where(back == 0, np.uint64(0), x << ((np.uint64(64) - back) & np.uint64(63)))
        return plain[linked], plain[root[linked]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            cols = [np.asarray(b.column(k)) for k in range(5)]
            if rest is not None:
                cols = [np.concatenate(v) for v in zip(rest, cols, strict=True)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1]) & (cols[3] == cols[3][-1]) if len(cols[0]) else np.zeros(0, bool)
            whole = int(len(same) - same[::-1].argmin()) if len(same) and not same.all() else 0
            rest = [v[whole:] for v in cols]  # the last unit may go on in the next batch
            if whole:
                yield from out(*(v[:whole] for v in cols))
        if rest is not None and len(rest[0]):
            yield from out(*rest)

    def out(rot, depth, pa_, pb_, x):
        a, b = links(rot, depth, pa_, pb_, x.view(np.uint64))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, budget: int = 3) -> DataFrame:
    """Links (a, b) that connect distinct ``fps`` (fp) as all pairs of at most ``budget`` differing bits do.

    Of the pairs within one unit only a spanning star per class is passed on.
    """
    units = _units(fps, budget)
    units = stage(units)
    n = task_count(fps.sparkSession, units.count())
    # Signed order would put prefixes with a first bit of one before the others only across units.
    order = [F.col("x").bitwiseXOR(F.lit(-(1 << 63)))]
    dealt = units.repartition(n, "rot", "depth", "pa", "pb").sortWithinPartitions("rot", "depth", "pa", "pb", *order)
    return dealt.mapInArrow(_join_units(budget), "a long, b long")


def _members(own: DataFrame, budget: int) -> DataFrame:
    """fp, root (its class) and component_id of every fingerprint of ``own`` (doc_id, fp)."""
    distinct = stage(own.groupBy("fp").agg(F.min("doc_id").alias("low")))
    root = classes(fingerprint_links(distinct.select("fp"), budget))
    member = stage(distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    low = stage(member.groupBy("root").agg(F.min("low").alias("component_id")))
    return stage(member.join(low, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over fingerprints that
    differ in at most ``budget`` bits. Null, empty and blank texts have the
    fingerprint 0 and link like any other. Null ids are left out of the
    minimum: a class of null ids alone has a null component_id. Rows that
    repeat an id are rows of their own. Other columns do not matter.
    """
    own = stage(fingerprints(docs, id_col, text_col, words))
    return own.join(_members(own, budget), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 3) -> DataFrame:
    """``docs`` with one row of each class of ``near_duplicates``, columns as they are.

    It is a row with the class's smallest id (null in a class of null ids
    alone); of several such rows one with the smallest fingerprint, and of
    those, which repeat each other, any.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, words) for x in b.column(1).field(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(1)], ["id", "fp", "row"])

    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("row", docs.schema)])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = stage(docs.select(F.col(id_col).cast("long").alias("id"), whole).mapInArrow(run, kind))
    member = _members(rows.select(F.col("id").alias("doc_id"), "fp"), budget)
    first = rows.select("id", "fp").join(member, "fp").filter(F.col("id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("root", "fp").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    best = stage(first.groupBy("root").agg(F.min(F.struct("fp", "id", "n")).alias("b")).select("b.id", "b.fp", "b.n"))

    def chosen(pairs: DataFrame) -> DataFrame:
        p = pairs.select(F.col("id").alias("_id"), F.col("fp").alias("_fp"))
        return rows.join(p, F.col("id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")), "left_semi")

    kept = chosen(best.filter("n = 1")).union(chosen(best.filter("n > 1")).dropDuplicates(["id", "fp"]))
    return kept.select("row.*")
