"""Near-duplicate documents by the Jaccard similarity of their word shingles, all pairs, verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.llm.common import classes, collect_garbage, free, lean, made_since, mark, part_of, sampled, stage, task_count
from kinetable.llm.simhash_dedup import fingerprint, fingerprint_links

SEED = 43

#: Documents among which frequent shingles are looked for, occurrences there that make a shingle frequent, how many are
#: sent to tasks at most. They come last in the order of shingles; which ones they are moves cost, never the result.
SAMPLE_DOCS, FREQUENT, MAX_FREQUENT = 20_000, 4, 500_000

#: Rounds that link each set to a leader before all pairs are looked at, leaders kept of the sets that share a smallest hash.
LEADER_ROUNDS, LEADERS = 3, 256

#: Rows of one unit of the search for pairs, largest filter of nodes in bytes, texts described at once.
UNIT_ROWS, FILTER_BYTES, OUT_ROWS = 2_000, 16 << 20, 512

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int) -> set[bytes]:
    """Distinct runs of ``words`` words; a shorter text is one run, a text without a word none."""
    own = (text or "").encode().lower().split()
    k = min(words, len(own))
    return {b" ".join(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The shingles' hashes, sorted, each once."""
    own = (text or "").encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    k = min(words, len(own))
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends.tolist()[k - 1 :], strict=False)], np.uint64))


def similarity(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def prefix_length(n: int, least: float) -> int:
    """Two sets as similar as ``least`` share one of their first so many members, in any order that both use."""
    return n - max(1, math.ceil(least * n - 1e-9)) + 1 if n else 0


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A bit for each bucket of hashes, set if an odd number fall in it; as many bits as members, rounded up to a power of two, 64 at least.

    Two sketches differ in no more bits than their sets in members. Buckets
    follow the hashes' low bits, so the exclusive or of a sketch's halves is
    the sketch of half as many bits.
    """
    bits = max(64, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Sketches (the last axis) brought down to ``width`` words."""
    while rows.shape[-1] > width:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] ^ rows[..., half:]
    return rows


def may_match(n: int, own: np.ndarray, others_n: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """The differing bits of one sketch and others of one width; -1 where sizes or bits rule out a similarity of ``least``."""
    width = min(len(own), others.shape[1])
    bits = np.bitwise_count(folded(own, width) ^ folded(others, width)).sum(axis=1, dtype=np.int64)
    can = bits <= np.floor((n + others_n) * ((1 - least) / (1 + least)) + 1e-6)
    can &= np.minimum(n, others_n) >= np.maximum(n, others_n) * least - 1e-9
    return np.where(can, bits, -1)


def _frequent(docs: DataFrame, id_col: str, text_col: str, words: int) -> np.ndarray:
    """Sorted hashes of shingles that occur in FREQUENT documents or more of a sample."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    part = sampled(own.filter("id IS NOT NULL"), "id", part_of(own.count(), SAMPLE_DOCS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(x.as_py(), words).view(np.int64))], ["sh"])

    counts = part.mapInArrow(run, "sh long").groupBy("sh").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    got = counts.orderBy(F.desc("n"), "sh").limit(MAX_FREQUENT).select("sh").toArrow()
    return np.sort(np.asarray(got.column(0).to_numpy(), np.int64).view(np.uint64))


def _described(docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """id, fp, sid (a number of the shingle set), n (its size), sketch, picks (smallest hashes), prefix and row of every row.

    Members are ordered by (frequent or not, hash); ``prefix`` holds the first ones.
    """
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, id_col, text_col, words))

    def lists(values: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, values)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        turns = [np.uint64((k + 1) * int(_MIX) & 0xFFFFFFFFFFFFFFFF) for k in range(LEADER_ROUNDS)]
        for whole in batches:
            for low in range(0, whole.num_rows, OUT_ROWS):
                b = whole.slice(low, OUT_ROWS)
                fp, sid, n, bits, picks, prefix = [], [], [], [], [], []
                for x in b.column(1).field(at):  # one text at a time is a Python string
                    x = x.as_py()
                    own = shingle_hashes(x, words)
                    hot = np.zeros(len(own), bool)
                    if len(frequent):
                        hot = frequent[np.searchsorted(frequent, own).clip(max=len(frequent) - 1)] == own
                    signed = own.view(np.int64)
                    fp.append(fingerprint(x))
                    sid.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                    n.append(len(own))
                    bits.append(sketch(own).tobytes())
                    picks.append(np.array([signed[np.argmin((own ^ t) * _MIX)] for t in turns] if len(own) else [], np.int64))
                    prefix.append(signed[np.lexsort((signed, hot))[: prefix_length(len(own), least)]])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(np.array(sid, np.uint64).view(np.int64)),
                        pa.array(n, pa.int32()), pa.array(bits, pa.binary()), lists(picks), lists(prefix), b.column(1),
                    ], ["id", "fp", "sid", "n", "sketch", "picks", "prefix", "row"],
                )

    kind = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("sid", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("sketch", T.BinaryType()),
        T.StructField("picks", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("row", docs.schema),
    ])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(F.col(id_col).cast("long").alias("id"), whole).mapInArrow(lean(run), kind)


def _filter_of(nodes: DataFrame, n: int):
    """A test whether a sid may be among ``nodes`` (sid): bits set by three parts of it, FILTER_BYTES at most, so that the test says yes more often where nodes are many."""
    words = 1 << min(FILTER_BYTES // 8, max(1, n // 4)).bit_length() - 1
    spread = lambda sid: [F.shiftrightunsigned(sid, s) for s in (0, 20, 40)] if isinstance(sid, str) else [sid >> np.uint64(s) for s in (0, 20, 40)]
    bit = nodes.select(F.explode(F.array(*spread("sid"))).alias("h"))
    at = bit.select(F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(words - 1).cast("long")).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63).cast("long")).cast("int")).alias("m"))
    got = at.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    table = np.zeros(words, np.uint64)
    table[got["w"].to_numpy()] = got["m"].to_numpy().view(np.uint64)
    sent = nodes.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def may_be(sid: pa.Array) -> pa.Array:
        own, filled = np.asarray(sid).view(np.uint64), sent.value
        yes = np.ones(len(own), bool)
        for h in spread(own):
            yes &= filled[((h >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1) == 1
        return pa.array(yes)

    return may_be


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame | None:
    """Of ``pairs`` (a, b) of sets those whose texts' shingles are as similar as asked, None without one. ``texts``: sid and text of every row."""
    start = mark()
    pairs = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    nodes = stage(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct())
    n = nodes.count()
    if not n:
        free(pairs.sparkSession, made_since(start))
        return None
    # Texts that no pair needs are left out before they are shuffled. All texts of a set have the same shingles: any will do.
    own = texts.filter(_filter_of(nodes, n)("sid")).join(nodes, "sid", "left_semi").groupBy("sid").agg(F.first("text").alias("text"))
    own = stage(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, set[bytes]] = {}
        for b in batches:
            keep = []
            for j, x, y in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):  # one pair of texts at a time
                if j not in memo:
                    memo = {j: shingle_set(y.as_py(), words)}
                keep.append(similarity(shingle_set(x.as_py(), words), memo[j]) >= least)
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left = own.select(F.col("sid").alias("a"), F.col("text").alias("x"))
    right = own.select(F.col("sid").alias("b"), F.col("text").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    old = made_since(start)
    out = stage(both.mapInArrow(lean(run), "a long, b long"))
    free(pairs.sparkSession, old)
    return None if out.isEmpty() else out


def _roots(sets: DataFrame, links: DataFrame | None) -> DataFrame:
    """sid and root of every set."""
    if links is None:
        return sets.select("sid", F.col("sid").alias("root"))
    start = mark()
    root = classes(links).withColumnRenamed("node", "sid")
    out = sets.select("sid").join(root, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"))
    old = made_since(start)
    out = stage(out)
    free(sets.sparkSession, old)
    return out


def _follow(least: float, forward: bool):
    """Links every set to the most similar leader of those that share its pick; a set that no leader may match leads from then on.

    Rows (pick, n, sid, root, sketch) come ordered by pick and n. Rows out:
    the links (a, b), and with ``forward`` the leaders themselves (b null).
    Of one pick's leaders LEADERS are kept; sets that come later without a
    link are left to the search for all pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        leaders: dict[int, list] = {}  # by width: sketches, sizes, sids, roots, number
        for batch in batches:
            out: list[tuple] = []
            for pick, n, sid, root, raw in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if pick != now:
                    now, leaders = pick, {}
                own = np.frombuffer(raw, np.uint64)
                best = None
                for width in (len(own) // 2, len(own), 2 * len(own)):
                    if width not in leaders:
                        continue
                    rows, sizes, sids, roots, k = leaders[width]
                    bits = may_match(n, own, sizes[:k], rows[:k], least)
                    bits[roots[:k] == root] = -1
                    ok = np.flatnonzero(bits >= 0)
                    if len(ok):
                        j = ok[np.argmin(bits[ok])]
                        best = min(best or (1 << 62, 0), (int(bits[j]), int(sids[j])))
                if best is not None:
                    out.append((sid, best[1], None, None, None, None))
                    continue
                if sum(x[4] for x in leaders.values()) < LEADERS:
                    if len(own) not in leaders:
                        leaders[len(own)] = [np.zeros((4, len(own)), np.uint64), *(np.zeros(4, np.int64) for _ in range(3)), 0]
                    own_leaders = leaders[len(own)]
                    k = own_leaders[4]
                    if k == len(own_leaders[1]):
                        own_leaders[:4] = [np.concatenate([x, np.zeros_like(x)]) for x in own_leaders[:4]]
                    for x, v in zip(own_leaders[:4], (own, n, sid, root), strict=True):
                        x[k] = v
                    own_leaders[4] += 1
                if forward:
                    out.append((sid, None, pick, n, root, raw))
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "pick", "n", "root", "sketch"])

    return run


_FOLLOWED = "a long, b long, pick long, n int, root long, sketch binary"


def _led(sets: DataFrame, root: DataFrame, k: int, least: float) -> DataFrame:
    """Links (a, b) of round ``k``: sets that share their k-th smallest hash follow leaders, first within the tasks that read them, then their leaders."""
    order = ["pick", "n", "sid"]
    rows = sets.join(root, "sid").filter("n > 0").select(F.col("picks")[k].alias("pick"), "n", "sid", "root", "sketch")
    here = stage(rows.sortWithinPartitions(*order).mapInArrow(_follow(least, True), _FOLLOWED))
    ahead = here.filter("b IS NULL").select("pick", "n", F.col("a").alias("sid"), "root", "sketch")
    ahead = ahead.repartition("pick").sortWithinPartitions(*order).mapInArrow(_follow(least, False), _FOLLOWED)
    return here.filter("b IS NOT NULL").select("a", "b").union(ahead.select("a", "b"))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (sh, sid) ordered by sh those whose sh another row has."""
    rest = [np.zeros(0, np.int64)] * 2
    before: int | None = None  # sh of the row before ``rest``
    for b in batches:
        sh, sid = (np.append(x, np.asarray(b.column(i))) for i, x in enumerate(rest))
        if not len(sh):
            continue
        same = sh[1:] == sh[:-1]
        first = before is not None and sh[0] == before
        keep = (np.append(first, same)[:-1] | same) if len(sh) > 1 else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(sh[:-1][keep]), pa.array(sid[:-1][keep])], ["sh", "sid"])
        if len(sh) > 1:
            before = int(sh[-2])
        rest = [sh[-1:], sid[-1:]]
    if len(rest[0]) and before is not None and rest[0][0] == before:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rest], ["sh", "sid"])


def _unit_pairs(least: float):
    """Pairs (a, b) of sets of one unit that have different roots and may match. Rows: sh, i, j, side, sid, n, root, sketch, ordered by unit and n."""

    def judge(side, sid, n, root, sketches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        width = np.fromiter(map(len, sketches), np.int64, len(sketches)) // 8
        groups = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
        rows = {w: np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), w) for w, at in groups.items()}
        for w, at in groups.items():
            for x in range(len(at)):
                i = at[x]
                for v in (w, 2 * w):
                    if v not in groups:
                        continue
                    low = x + 1 if v == w else 0
                    others = groups[v][low:]
                    if not len(others):
                        continue
                    bits = may_match(n[i], rows[w][x], n[others], rows[v][low:], least)
                    ok = others[(bits >= 0) & (root[others] != root[i]) & ((side[others] != side[i]) | (side[i] == 2))]
                    if len(ok):
                        yield np.full(len(ok), sid[i]), sid[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            cols = list(zip(*rows, strict=True))
            found = list(judge(np.array(cols[3]), np.array(cols[4], np.int64), np.array(cols[5], np.int64), np.array(cols[6], np.int64), cols[7]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(8)], strict=True):
                if rest and row[:3] != rest[0][:3]:
                    yield from out(rest)
                    rest = []
                rest.append(row)
        if rest:
            yield from out(rest)

    return run


def _all_pairs(sets: DataFrame, members: DataFrame, root: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of sets of different classes that share a member of their prefixes and may match.

    The holders of a member are one unit; of over UNIT_ROWS holders each pair
    of hash blocks is one, so a task holds one or two blocks at a time.
    """
    own = stage(members.join(root, "sid"))
    sizes = own.groupBy("sh").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    blocks = F.ceil(F.col("c") / (UNIT_ROWS // 2)).cast("int")
    mixed = sizes.select("sh", F.when(F.col("c") > UNIT_ROWS, blocks).otherwise(F.lit(1)).alias("k"))
    own = own.join(mixed, "sh").join(sets.select("sid", "n", "sketch"), "sid")
    own = own.withColumn("x", F.pmod(F.xxhash64("sid"), F.col("k")).cast("int"))
    own = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = own.select(
        "sh", F.least("x", "o").alias("i"), F.greatest("x", "o").alias("j"),
        F.when(F.col("x") == F.col("o"), 2).when(F.col("x") < F.col("o"), 0).otherwise(1).alias("side"), "sid", "n", "root", "sketch",
    )
    return rows.repartition("sh", "i", "j").sortWithinPartitions("sh", "i", "j", "n").mapInArrow(_unit_pairs(least), "a long, b long")


def set_classes(rows: DataFrame, words: int, least: float) -> DataFrame:
    """sid and root of the shingle sets of ``rows`` (as described), linked where similar.

    Three sources of candidates, all verified on the shingles themselves: the
    trie join of the fingerprints; rounds in which sets that share the
    smallest of their hashes follow leaders; and all pairs that share a member
    of their prefixes. The last alone misses no pair, whatever the order of
    members. The others join most sets of large groups beforehand, as pairs
    within a class need not be looked at. A candidate's sizes and sketches
    have to allow the similarity, which few pairs that lack it pass.
    """
    spark = rows.sparkSession
    texts = rows.select("sid", F.col("text"))
    sets = stage(rows.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("fp", "n", "sketch", "picks", "prefix")]))
    start = mark()
    by_fp = stage(sets.groupBy("fp").agg(F.min("sid").alias("hub")))
    same = sets.join(by_fp, "fp").filter("sid <> hub").select(F.col("sid").alias("a"), F.col("hub").alias("b"))
    near = fingerprint_links(by_fp.select("fp"))
    ends = near.join(by_fp.select(F.col("fp").alias("a"), F.col("hub").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("hub").alias("y")), "b")
    old = mark()
    links = _verified(same.union(ends.select("x", "y")), texts, words, least)
    free(spark, made_since(start, old))
    root = _roots(sets, links)
    for k in range(LEADER_ROUNDS):
        start = mark()
        led = _led(sets, root, k, least)
        old = mark()
        new = _verified(led, texts, words, least)
        free(spark, made_since(start, old))
        if new is None:
            break
        links = new if links is None else links.union(new)
        root = _roots(sets, links)
    collect_garbage(spark)

    start = mark()
    entries = sets.select(F.explode("prefix").alias("sh"), "sid")
    n = sets.agg(F.sum(F.size("prefix"))).first()[0] or 0
    members = stage(entries.repartition(task_count(spark, n, 1_000_000), "sh").sortWithinPartitions("sh").mapInArrow(_shared, "sh long, sid long"))
    collect_garbage(spark)
    found = _all_pairs(sets, members, root, least)
    old = mark()
    new = _verified(found, texts, words, least)
    free(spark, made_since(start, old))
    if new is not None:
        root = _roots(sets, new if links is None else links.union(new))
    return root


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class, columns as they are.

    Rows are linked if the sets of their runs of ``words`` words (lower-cased
    A to Z, split at ASCII blanks) have a Jaccard similarity of ``least`` or
    more; texts without a word are alike. A class's row is one with its
    smallest id (null in a class of null ids alone); of several such rows one
    with the smallest 3-word fingerprint, of those any. Other columns do not
    matter.
    """
    spark = docs.sparkSession
    rows = stage(_described(docs, id_col, text_col, words, least))
    start = mark()
    root = set_classes(rows.select("sid", "fp", "n", "sketch", "picks", "prefix", F.col("row").getField(text_col).alias("text")), words, least)
    # The ids and numbers alone find the row that stays; what repeats them all is thinned out last.
    keys = rows.select("id", "fp", "sid").join(root, "sid")
    best = keys.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("fp").bitwiseXOR(F.lit(-(1 << 63))).alias("order"), "fp", "sid")).alias("b")).select("b.id", "b.fp", "b.sid")
    old = made_since(start)
    best = stage(best)
    free(spark, old)
    n = stage(rows.select("id", "fp", "sid").join(best.select(F.col("id").alias("_id"), F.col("fp").alias("_fp"), "sid"), "sid").filter("id <=> _id AND fp = _fp").groupBy("sid", "id", "fp").agg(F.count("*").alias("n")))
    collect_garbage(spark)

    def chosen(pairs: DataFrame) -> DataFrame:
        p = pairs.select("sid", F.col("id").alias("_id"), F.col("fp").alias("_fp"))
        return rows.select("id", "fp", "sid", "row").join(p, (rows["sid"] == p["sid"]) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")), "left_semi")

    kept = chosen(n.filter("n = 1")).union(chosen(n.filter("n > 1")).dropDuplicates(["id", "fp", "sid"]))
    return kept.select("row.*")
