"""Gap-and-island operators on dense sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.operators.blocks import Seq, neighbors, scan, with_runs


def run_table(df: DataFrame, seq: Seq, value: Column, carry: list[str] | None = None) -> DataFrame:
    """One row per maximal run: value, start, stop (exclusive), length, and
    the ``carry`` columns of its first row. No other column is shuffled."""
    named = list(dict.fromkeys([*seq.keys, seq.order, *seq.ties, *(carry or [])]))
    d = with_runs(df.select(*named, value.alias("run_value")), seq, F.col("run_value"))
    return d.where(F.col("run_start") == F.col(seq.order)).select(
        *seq.keys,
        "run_value",
        F.col("run_start").alias("start"),
        (F.col("run_end") + 1).alias("stop"),
        (F.col("run_end") - F.col("run_start") + 1).alias("length"),
        "touches_start",
        "touches_end",
        *(carry or []),
    )


def true_runs(df: DataFrame, seq: Seq, cond: Column) -> DataFrame:
    return run_table(df, seq, F.coalesce(cond, F.lit(False))).where("run_value").select(*seq.keys, "start", "stop", "length")


def longest_run(df: DataFrame, seq: Seq, clean: Column) -> DataFrame:
    """Longest run of ``clean`` rows per sequence, the first on ties, and its
    midpoint frame."""
    best = F.max_by(F.struct("start", "stop", "length"), F.struct(F.col("length"), -F.col("start")))
    return (
        true_runs(df, seq, clean)
        .groupBy(*seq.keys)
        .agg(best.alias("b"))
        .select(
            *seq.keys,
            F.col("b.start").alias("start"),
            F.col("b.stop").alias("stop"),
            F.col("b.length").alias("length"),
            F.floor((F.col("b.start") + F.col("b.stop") - 1) / 2).alias("middle"),
        )
    )


def top_k_spans(df: DataFrame, seq: Seq, cond: Column, k: int) -> DataFrame:
    w = Window.partitionBy(*seq.keys).orderBy(F.desc("length"), "start")
    return true_runs(df, seq, cond).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def max_gap(df: DataFrame, seq: Seq, present: Column) -> DataFrame:
    """Longest missing stretch (0 if none), and the span of present frames."""
    at = F.when(present, F.col(seq.order))
    spans = df.groupBy(*seq.keys).agg((F.max(at) - F.min(at) + 1).alias("duration"))
    gaps = true_runs(df, seq, ~present).groupBy(*seq.keys).agg(F.max("length").alias("max_gap"))
    return spans.join(gaps, list(seq.keys), "left").withColumn("max_gap", F.coalesce("max_gap", F.lit(0).cast("long")))


def remove_islands(df: DataFrame, seq: Seq, cols: list[str], width: int) -> DataFrame:
    """Zero the non-zero runs shorter than ``width`` with zeros on both sides.

    A row is non-zero when any of ``cols`` is.
    """
    active = F.greatest(*[F.col(c) != 0 for c in cols], F.lit(False))
    d = with_runs(df.withColumn("_act", active), seq, F.col("_act"))
    island = (
        F.col("_act")
        & ~F.col("touches_start")
        & ~F.col("touches_end")
        & (F.col("run_end") - F.col("run_start") + 1 < width)
    )
    d = d.withColumns({c: F.when(island, F.lit(0.0)).otherwise(F.col(c).cast("double")) for c in cols})
    return d.select(*df.columns)


def fill_zero_gaps(df: DataFrame, seq: Seq, col: str, width: int) -> DataFrame:
    """Bridge zero runs up to ``width`` linearly; in longer ones ramp down
    over ``width`` rows and up again before the end; border runs ramp on their
    one known side."""
    x = F.col(col).cast("double")
    o = F.col(seq.order)
    kinds = {"full": x != 0, "zero": x == 0, "none": x.isNull()}
    seen = {k: F.when(c, F.struct(o.alias("t"), x.alias("v"))) for k, c in kinds.items()}
    d = df.withColumn("_zero", x == 0)
    d = scan(d, seq, last={f"_l_{k}": c for k, c in seen.items()}, next={f"_n_{k}": c for k, c in seen.items()}, ends=("_first", "_last"))
    other = F.col("_zero")  # a run ends where a row of another kind stands; null rows are a kind of their own

    def border(side: str, pick) -> Column:
        t = {k: F.col(f"_{side}_{k}")["t"] for k in kinds}
        return F.when(other, pick(t["full"], t["none"])).when(other.isNull(), pick(t["full"], t["zero"]))

    d = d.withColumns({
        "run_start": F.coalesce(border("l", F.greatest) + 1, "_first"), "run_end": F.coalesce(border("n", F.least) - 1, "_last"),
        "_lv": F.col("_l_full")["v"], "_rv": F.col("_n_full")["v"],
    })
    n = F.col("run_end") - F.col("run_start") + 1
    i = F.col(seq.order) - F.col("run_start") + 1  # 1-based place in the run
    j = F.col("run_end") - F.col(seq.order) + 1  # 1-based from the end
    lv, rv, w = F.col("_lv"), F.col("_rv"), F.lit(width)
    bridge = lv + (rv - lv) * i / (n + 1)
    up = F.when(j <= w, rv * (w - j) / w)
    down = F.when(i <= w, lv * (w - i) / w)
    steps = F.least(n, w)
    tail = F.when(i <= steps, lv * (steps - i) / steps).otherwise(0.0)
    head = F.when(j <= steps, rv * (steps - j) / steps).otherwise(0.0)
    filled = (
        F.when(~F.col("_zero"), x)
        .when(lv.isNotNull() & rv.isNotNull(), F.when(n <= w, bridge).otherwise(F.coalesce(up, down, F.lit(0.0))))
        .when(lv.isNotNull(), tail)
        .when(rv.isNotNull(), head)
        .otherwise(0.0)
    )
    return d.withColumn(col, filled).select(*df.columns)


def frozen_runs(df: DataFrame, seq: Seq, value: Column, n: int = 10) -> DataFrame:
    """Cuts fired by ``n`` repeats in a row; the counter restarts after firing."""
    return (
        run_table(df, seq, value)
        .withColumn("cuts", F.floor((F.col("length") - 1) / F.lit(n)))
        .where("cuts >= 1")
        .select(*seq.keys, "start", "length", "cuts")
    )


def trim_flagged(df: DataFrame, seq: Seq, flagged: Column, gap: int | Column) -> DataFrame:
    """Kept range [start, stop) per sequence after cutting flagged borders.

    Flagged runs at a border are cut together with clean stretches of up to
    ``gap`` rows between them, plus ``gap // 2`` more rows. Sequences with
    nothing left are dropped. A column ``gap`` must be constant per sequence.
    """
    gap = F.lit(gap) if isinstance(gap, int) else gap
    r = run_table(df.withColumn("_gap", gap), seq, F.coalesce(flagged, F.lit(False)), ["_gap"])
    long_clean = ~F.col("run_value") & (F.col("length") > F.col("_gap"))
    b = r.groupBy(*seq.keys).agg(
        F.max("stop").alias("n"),
        F.max(F.col("run_value") & F.col("touches_start")).alias("dirty_head"),
        F.max(F.col("run_value") & F.col("touches_end")).alias("dirty_tail"),
        F.min(F.when(long_clean, F.col("start"))).alias("first_clean"),
        F.max(F.when(long_clean, F.col("stop"))).alias("last_clean"),
        F.floor(F.max("_gap") / 2).alias("half"),
    )
    half = F.col("half")
    n = F.col("n")
    start = F.when(F.col("dirty_head"), F.least(F.coalesce("first_clean", n) + half, n)).otherwise(F.lit(0))
    stop = F.when(
        F.col("dirty_tail"), F.greatest(F.coalesce(F.col("last_clean"), F.lit(0)) - half, F.lit(0))
    ).otherwise(n)
    b = b.select(*seq.keys, "n", start.cast("long").alias("start"), stop.cast("long").alias("stop"))
    return b.where("stop > start")


def renumber_kept(df: DataFrame, seq: Seq, kept: DataFrame) -> DataFrame:
    """Rows inside the kept ranges, positions restarting at 0."""
    k = kept.select(*seq.keys, F.col("start").alias("_s"), F.col("stop").alias("_e"))
    o = F.col(seq.order)
    return (
        df.join(k, list(seq.keys))
        .where((o >= F.col("_s")) & (o < F.col("_e")))
        .withColumn(seq.order, o - F.col("_s"))
        .drop("_s", "_e")
    )


def break_ids(df: DataFrame, seq: Seq, is_break: Column, out: str = "part") -> DataFrame:
    """Number the parts of each sequence; a true ``is_break`` row opens one."""
    return scan(df, seq, sums={out: F.coalesce(is_break, F.lit(False)).cast("long")})


def repeats(df: DataFrame, seq: Seq, value: Column) -> DataFrame:
    """Flag rows equal to the row before."""
    d = neighbors(df.withColumn("_v", value), seq, 1, 0, {"is_repeat": lambda w: F.coalesce(F.lag("_v").over(w) == F.col("_v"), F.lit(False))})
    return d.drop("_v")
