"""Sequence primitives that stay balanced when one sequence is huge.

A plain ``Window.partitionBy(key).orderBy(frame)`` puts a whole sequence into
one task, which fails when one video or user holds a third of all rows. Here a
sequence is cut into blocks of ``size`` order units and every window is
partitioned by (key, block):

* ``number_rows`` gives each row its dense 0-based position in its sequence,
* ``neighbors`` evaluates bounded windows (lag, lead, ``rowsBetween``); rows
  near a block edge are copied into the adjacent block as halo rows,
* ``scan`` evaluates unbounded ones (running sums, last/next known value) as a
  local scan plus one carry row per block,
* ``pipeline`` puts several of both behind one clustering.

Only the carry table (one row per block, ``size`` times smaller than the data)
is ever ordered per whole key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

WindowExpr = Callable[[WindowSpec], Column]


@dataclass(frozen=True)
class Seq:
    """Names the key and integer order columns of a table of sequences."""

    keys: tuple[str, ...]
    order: str = "pos"
    size: float = 3840
    ties: tuple[str, ...] = ()

    def block(self) -> Column:
        return F.floor(F.col(self.order) / F.lit(self.size)).cast("long")


def _clustered(d: DataFrame, keys: Iterable[str]) -> tuple[DataFrame, Column, Callable[..., Column]]:
    """``d`` shuffled by (key, block), an aggregate that touches all its columns, and a filter that does.

    A carry needs the rows twice: summed per block, and as they are. Column
    pruning would make these two shuffles of the same input different, and
    everything upstream would run twice. The aggregate goes to the sums, and
    the filter, which all rows pass, over the rows with a window's result that
    is named to it, so that it stays above the shuffle. Both then want the same
    columns whatever is read later, and Spark reuses one shuffle. Key and block are
    one struct ``_g``, which is never null and equals itself with null fields,
    so rows with a null key or a null order stay and find their carry.
    """
    d = d.withColumn("_g", F.struct(*keys, "_blk")).drop("_blk")
    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    entries = {n: F.map_entries(n) if k.startswith("map<") else F.col(n) for n, k in kinds.items()}
    hashable = [entries[n] for n, k in kinds.items() if "map<" not in k.removeprefix("map<")]
    return d.repartition("_g"), F.max(F.hash(*hashable)).alias("_touch"), lambda *local: F.hash(*hashable, *local) >= F.lit(-(1 << 31))


def _by_key(totals: DataFrame, keys: Iterable[str]) -> tuple[DataFrame, WindowSpec, WindowSpec]:
    """One row per block, with windows over a whole key: unordered, and in the order of blocks; the
    block of null orders comes first. The keys are columns, so that all windows share one shuffle."""
    keys = list(keys)
    own = [f"_key{i}" for i in range(len(keys))]
    d = totals.withColumns({**{o: F.col("_g")[k] for o, k in zip(own, keys)}, "_b": F.col("_g")["_blk"]})
    return d, Window.partitionBy(*own), Window.partitionBy(*own).orderBy("_b")


def number_rows(
    df: DataFrame,
    keys: Iterable[str],
    order_by: Iterable[str | Column],
    bucket: Column,
    out: str = "pos",
) -> DataFrame:
    """Dense 0-based position of each row within ``keys``.

    ``bucket`` must not decrease along ``order_by``; it bounds how many rows a
    task sorts. Rows are counted per bucket first, and the earlier buckets'
    total is added to the rank inside the bucket. Null keys are a key of their
    own; rows with a null bucket (a null order) come first.
    """
    keys = tuple(keys)
    d, touch, passes = _clustered(df.withColumn("_blk", bucket), keys)
    sizes = d.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), touch).where(F.col("_touch").isNotNull())
    sizes, _, blocks = _by_key(sizes, keys)
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_g").orderBy(*order_by))
    d = d.withColumn("_local", local).where(passes("_local"))
    return d.join(offsets, "_g").withColumn(out, (F.col("_off") + F.col("_local") - 1).cast("long")).drop("_g", "_off", "_local")


def fit_bucket(df: DataFrame, keys: Iterable[str], order: Column, limit: int = 1_000_000) -> Column:
    """A bucket for :func:`number_rows` sized to the data.

    One map-combined count finds the longest sequence. If it fits into
    ``limit`` rows there is one bucket; else ``order`` (a number) is cut evenly
    into four times as many buckets as that sequence needs, as rows may bunch.
    """
    x = order.cast("double")
    per = df.select(*keys, x.alias("_x")).groupBy(*keys).agg(F.count("_x").alias("n"), F.min("_x").alias("a"), F.max("_x").alias("z"))
    n, a, z = per.agg(F.max("n"), F.min("a"), F.max("z")).first()
    if not n or n <= limit or z <= a:
        return F.when(order.isNotNull(), F.lit(0)).cast("long")
    width = (z - a) / (4 * -(-n // limit))
    return F.floor((x - F.lit(a)) / F.lit(width))


def _with_halo(df: DataFrame, seq: Seq, before: int, after: int) -> DataFrame:
    """Rows with their block ``_blk``, and copies (``_halo``) of those near its edges in the next one."""
    if max(before, after) > seq.size:
        raise ValueError(f"reach {max(before, after)} exceeds block size {seq.size}")
    offset = F.pmod(F.col(seq.order), F.lit(seq.size))
    blk = seq.block()
    copies = [F.struct(blk.alias("b"), F.lit(False).alias("h"))]
    if before:
        copies.append(F.when(offset >= seq.size - before, F.struct((blk + 1).alias("b"), F.lit(True).alias("h"))))
    if after:
        copies.append(F.when(offset < after, F.struct((blk - 1).alias("b"), F.lit(True).alias("h"))))
    d = df.withColumn("_c", F.explode(F.array_compact(F.array(*copies))))
    return d.withColumns({"_blk": F.col("_c.b"), "_halo": F.col("_c.h")}).drop("_c")


def neighbors(
    df: DataFrame, seq: Seq, before: int, after: int, *stages: Mapping[str, WindowExpr]
) -> DataFrame:
    """Evaluate bounded windows. Positions must be dense (no holes).

    Each stage maps a new column to a function of the ordered window; later
    stages may read earlier columns as long as ``before``/``after`` cover the
    summed reach. All stages share one shuffle.
    """
    d = _with_halo(df, seq, before, after)
    w = Window.partitionBy(*seq.keys, "_blk").orderBy(seq.order, *seq.ties)
    for stage in stages:
        d = d.withColumns({name: fn(w) for name, fn in stage.items()})
    return d.where(~F.col("_halo")).drop("_blk", "_halo")


def scan(
    df: DataFrame,
    seq: Seq,
    sums: Mapping[str, Column] | None = None,
    shifted_sums: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,
    ends: tuple[str, str] | None = None,
    near: tuple[int, int, Mapping[str, WindowExpr]] | None = None,
) -> DataFrame:
    """Unbounded scans along each sequence; order values may have holes.

    ``sums``: running total including the row; ``shifted_sums``: excluding it;
    ``last`` / ``next``: nearest non-null value at or before / at or after it;
    ``ends``: names for the least and greatest order of the whole sequence;
    ``near``: reach to both sides and bounded windows, as in :func:`neighbors`
    (positions must then be dense), which the scans may read. They use the
    shuffle of the scans.
    Null keys are a key of their own; null orders come before all others.
    """
    sums, shifted_sums = dict(sums or {}), dict(shifted_sums or {})
    last, next_ = dict(last or {}), dict(next or {})
    inputs = {**sums, **shifted_sums, **last, **next_}
    values = {f"_i_{n}": c for n, c in inputs.items()}
    w = Window.partitionBy("_g").orderBy(seq.order, *seq.ties)
    if near is None:
        d, touch, passes = _clustered(df.withColumn("_blk", seq.block()), seq.keys)
    else:
        before, after, stage = near
        d, touch, passes = _clustered(_with_halo(df, seq, before, after), seq.keys)
        d = d.withColumns({n: fn(w) for n, fn in stage.items()}).where(~F.col("_halo"))
    d = d.withColumns(values)  # behind the shuffle, so that wide values are sent once
    aggs = [F.sum(f"_i_{n}").alias(f"_t_{n}") for n in (*sums, *shifted_sums)]
    place = F.struct(seq.order, *seq.ties)  # orders null orders too
    known = {n: F.when(F.col(f"_i_{n}").isNotNull(), place) for n in (*last, *next_)}
    aggs += [F.max_by(f"_i_{n}", known[n]).alias(f"_t_{n}") for n in last]
    aggs += [F.min_by(f"_i_{n}", known[n]).alias(f"_t_{n}") for n in next_]
    if ends:
        aggs += [F.min(seq.order).alias("_t_first"), F.max(seq.order).alias("_t_last")]
    totals = d.groupBy("_g").agg(*aggs, touch).where(F.col("_touch").isNotNull())
    totals, whole, blocks = _by_key(totals, seq.keys)
    # a frame that ends at the last row is read anew for every row, so what follows is walked to backwards
    back, fwd = (o.rowsBetween(Window.unboundedPreceding, -1) for o in (blocks, whole.orderBy(F.desc("_b"))))
    carry = totals.select(
        "_g",
        *[F.sum(f"_t_{n}").over(back).alias(f"_c_{n}") for n in (*sums, *shifted_sums)],
        *[F.last(f"_t_{n}", ignorenulls=True).over(back).alias(f"_c_{n}") for n in last],
        *[F.last(f"_t_{n}", ignorenulls=True).over(fwd).alias(f"_c_{n}") for n in next_],
        *([F.min("_t_first").over(whole).alias(ends[0]), F.max("_t_last").over(whole).alias(ends[1])] if ends else []),
    )

    upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy("_g").orderBy(F.desc("_nth")).rowsBetween(Window.unboundedPreceding, 0)
    local = {n: F.sum(f"_i_{n}").over(upto) for n in sums}
    local |= {n: F.sum(f"_i_{n}").over(prior) for n in shifted_sums}
    local |= {n: F.last(f"_i_{n}", ignorenulls=True).over(upto) for n in last}
    if next_:
        d = d.withColumn("_nth", F.row_number().over(w))
    local |= {n: F.last(f"_i_{n}", ignorenulls=True).over(onward) for n in next_}
    d = d.withColumns({f"_l_{n}": c for n, c in local.items()})
    if local:
        d = d.where(passes(*[f"_l_{n}" for n in local]))

    keep = [c for c in [*df.columns, *(near[2] if near else ())] if c not in inputs] + list(ends or ())
    zero = F.lit(0)
    out = [
        (F.coalesce(F.col(f"_l_{n}"), zero) + F.coalesce(F.col(f"_c_{n}"), zero)).alias(n)
        for n in (*sums, *shifted_sums)
    ] + [F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in (*last, *next_)]
    return d.join(carry, "_g").select(*keep, *out)


def pipeline(
    df: DataFrame,
    seq: Seq,
    before: int,
    after: int,
    last: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,
    local: Callable[[DataFrame, WindowSpec], DataFrame] | None = None,
    summary: Mapping[str, Column] | None = None,
    keep: Callable[[DataFrame, WindowSpec, WindowSpec], DataFrame] | None = None,
    then: Callable[[DataFrame, WindowSpec], DataFrame] | None = None,
    carried: Iterable[str] = (),
) -> DataFrame:
    """Scans, a filter on whole sequences and bounded windows behind one shuffle of the rows.

    Blocks hold halo rows for the summed reach of all that follows, and the
    scans are right on halo rows too, so ``then`` may run windows over what it
    derives from them. In order:

    * ``local(rows, window)`` prepares the rows of a block, halo rows too
      (``_halo``; ``_ahead`` where they lie before the block),
    * ``last`` / ``next`` are the nearest non-null values as in :func:`scan`,
    * ``summary`` holds aggregates of a block's own rows; ``keep(blocks, whole,
      back)`` filters whole sequences by them, with windows over all blocks of
      a sequence and over those before a block; columns it adds for ``then``,
      such as what earlier blocks sum up to, are named in ``carried``,
    * ``then(rows, window)`` adds columns that reach ``before`` and ``after``.

    Positions must be dense and not null; a block is as long as the reach at
    least. One carry row per block serves all scans and the filter.
    """
    last, next, carried = dict(last or {}), dict(next or {}), list(carried)
    seq = Seq(seq.keys, seq.order, max(seq.size, before, after), seq.ties)
    w = Window.partitionBy("_g").orderBy(seq.order, *seq.ties)
    d, touch, passes = _clustered(_with_halo(df, seq, before, after), seq.keys)
    given = set(d.columns)
    if local:
        d = local(d.withColumn("_ahead", F.col("_halo") & (F.col(seq.order) < F.col("_g")["_blk"] * F.lit(seq.size))), w).drop("_ahead")
    made = [c for c in d.columns if c not in given]
    d = d.withColumns({f"_i_{n}": c for n, c in {**last, **next}.items()})

    own, offset, place = ~F.col("_halo"), F.pmod(F.col(seq.order), F.lit(seq.size)), F.struct(seq.order, *seq.ties)
    at = lambda n, where: F.when(where & F.col(f"_i_{n}").isNotNull(), place)
    early, late = own & (offset < seq.size - before), own & (offset >= after)
    aggs = [F.max_by(f"_i_{n}", at(n, c)).alias(f"_{p}_{n}") for n in last for p, c in (("t", own), ("e", early))]
    aggs += [F.min_by(f"_i_{n}", at(n, c)).alias(f"_{p}_{n}") for n in next for p, c in (("t", own), ("e", late))]
    aggs += [c.alias(n) for n, c in (summary or {}).items()]
    totals = d.groupBy("_g").agg(*aggs, touch).where(F.col("_touch").isNotNull())

    # what lies before or after a block and its halo: the next block up to the halo, else those beyond
    totals, whole, blocks = _by_key(totals, seq.keys)
    first, end = Window.unboundedPreceding, Window.unboundedFollowing
    far = lambda f, n, near, rest: F.coalesce(
        f(f"_e_{n}", ignorenulls=True).over(blocks.rangeBetween(near, near)), f(f"_t_{n}", ignorenulls=True).over(blocks.rangeBetween(*rest))
    ).alias(f"_c_{n}")
    if keep:
        totals = keep(totals, whole, blocks.rowsBetween(first, -1))
    carry = totals.select("_g", *carried, *[far(F.last, n, -1, (first, -2)) for n in last], *[far(F.first, n, 1, (2, end)) for n in next])

    upto, onward = w.rowsBetween(first, 0), w.rowsBetween(0, end)
    near_by = {n: F.last(f"_i_{n}", ignorenulls=True).over(upto) for n in last}
    near_by |= {n: F.first(f"_i_{n}", ignorenulls=True).over(onward) for n in next}
    d = d.withColumns({f"_l_{n}": c for n, c in near_by.items()}).where(passes(*[f"_l_{n}" for n in near_by], *(made if carried else ()))).join(carry, "_g")
    d = d.withColumns({n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in (*last, *next)})
    if then:
        d = then(d, w)
    return d.where(own).drop("_g", "_halo", *carried, *[f"_{p}_{n}" for p in "ilc" for n in (*last, *next)])


def with_runs(df: DataFrame, seq: Seq, value: Column) -> DataFrame:
    """Add the maximal run of equal ``value`` that each row belongs to.

    New columns: ``run_start``/``run_end`` (inclusive positions) and
    ``touches_start``/``touches_end`` (the run meets the sequence border).
    """
    here = F.struct("_val")
    starts = F.col("_p").isNull() | ~F.col("_p").eqNullSafe(here)
    ends = F.col("_n").isNull() | ~F.col("_n").eqNullSafe(here)
    d = scan(
        df.withColumn("_val", value),
        seq,
        last={
            "run_start": F.when(starts, F.col(seq.order)),
            "touches_start": F.when(starts, F.col("_p").isNull()),
        },
        next={
            "run_end": F.when(ends, F.col(seq.order)),
            "touches_end": F.when(ends, F.col("_n").isNull()),
        },
        near=(1, 1, {"_p": lambda w: F.lag(F.struct("_val")).over(w), "_n": lambda w: F.lead(F.struct("_val")).over(w)}),
    )
    return d.drop("_val", "_p", "_n")


def grid(df: DataFrame, keys: Iterable[str], first: Column, last: Column, out: str, size: int = 4096) -> DataFrame:
    """Rows ``first..last`` (integers) per input row, expanded in two steps so
    that no single array grows with the sequence."""
    d = df.select(*keys, first.alias("_a"), last.alias("_z")).where("_a <= _z")
    d = d.select(*keys, "_z", F.explode(F.sequence("_a", "_z", F.lit(size).cast("long"))).alias("_s"))
    stop = F.least(F.col("_z"), F.col("_s") + size - 1)
    return d.select(*keys, F.explode(F.sequence(F.col("_s"), stop)).alias(out))
