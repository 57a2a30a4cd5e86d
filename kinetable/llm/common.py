"""Shared pieces: the shared folder, written intermediate tables, classes over links."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.session import is_local, shared_base


def shared_folder(spark: SparkSession) -> str:
    """URI of a new folder under ``spark.checkpoint.dir``, deleted when the driver ends.

    Only a session in one process may go without the setting.
    """
    sc = spark.sparkContext
    base = shared_base(spark)
    base = f"file://{os.path.abspath(base)}" if "://" not in base and not base.startswith("file:") and is_local(spark) else base
    path = f"{base.rstrip('/')}/kinetable-{uuid.uuid4().hex}"
    jvm_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(jvm_path)
    fs.deleteOnExit(jvm_path)
    return path


#: Folders of all staged tables, in the order in which they were made; None where one was freed.
_STAGED: list[str | None] = []


def mark() -> int:
    """How many tables were staged so far, for ``made_since``."""
    return len(_STAGED)


def made_since(start: int, end: int | None = None) -> list[str]:
    """Folders of the tables staged since one mark, up to another one."""
    return [f for f in _STAGED[start:end] if f is not None]


def free(spark: SparkSession, folders: list[str]) -> None:
    """Deletes staged tables that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for f in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)
        _STAGED[_STAGED.index(f)] = None


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that are over; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    folder = shared_folder(df.sparkSession)
    _STAGED.append(folder)
    path = f"{folder}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ArrowFunction = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: ArrowFunction) -> ArrowFunction:
    """``run``, which gives what its worker no longer needs back to the system when the task is over: workers stay for the next one."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets tasks and Python workers exchange ``rows`` rows at once, as whole documents are long, unless the session has a setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def task_count(spark: SparkSession, rows: int, per_task: int = 200_000) -> int:
    """Partitions for ``rows`` small rows; at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def classes(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long, both not null).

    Returns node, root for every node that occurs; the root is the smallest
    node of its component. Rounds of pointing a node's larger neighbours at its
    smallest one and then a node's smaller neighbours at the smallest one; only
    minima per node are aggregated, so a node with many links needs no group
    in memory; they are written before they are joined, so that both sides of
    the join are plain shuffles and a hot node is split between tasks.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = stage(e)
    while True:
        # Larger neighbours go to the minimum of the neighbourhood.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Smaller neighbours, and the node itself, go to the minimum below it.
        large = stage(large)
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        # Done when the stars no longer change: every u has one v and no v is a u.
        n, nu = new.agg(F.count("*"), F.countDistinct("u")).first()
        deep = new.join(new.select(F.col("u").alias("x")).distinct(), F.col("v") == F.col("x"), "left_semi").isEmpty()
        e = new
        if n == nu and deep:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def held_out(doc_id: Column | str) -> Column:
    """crc32 of the id as text leaves remainder 0 by 5; a null id counts as the text ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def part_of(total: int, bound: int) -> float:
    """Share of ``total`` that keeps about ``bound``."""
    return min(1.0, bound / total) if total else 1.0


def sampled(df: DataFrame, key: str, share: float, seed: int = 17) -> DataFrame:
    """A repeatable share of the rows, by a hash of ``key``."""
    if share >= 1:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < int(share * (1 << 30)))
