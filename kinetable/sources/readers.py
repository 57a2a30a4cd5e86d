"""Readers for the pipeline's text, JSON, CSV and array files.

Every ``read_x(spark, path)`` is a Spark scan followed by ``parse_x``, which
works on any table with the same text column.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.functions.text import from_timecode, split_tokens

TIMECODE = r"[0-9]+:[0-9]+:[0-9]+\.[0-9]+"

INDEX_SCHEMA = "source_path string, start_frame int, end_frame int, new_name string"


def _files(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    d = spark.read.text(path, wholetext=whole, recursiveFileLookup=True)
    d = d.select("value", F.col("_metadata.file_path").alias("path"))
    if whole:  # each file counts as megabytes to Spark, so many small ones would make too many tasks
        least = 8 * spark.sparkContext.defaultParallelism
        if (parts := d.rdd.getNumPartitions()) > least:
            d = d.coalesce(max(least, parts // 64))
    return d


def parse_video_manifest(df: DataFrame, value: str = "value") -> DataFrame:
    """title | url | fps:x | accessed:d/m/Y H:M:S | request: q"""
    pattern = r"(?s)^\s*([^|\n]*?) \| ([^|]*?) \| fps:([^|]*?) \| accessed:([0-9/]+ [0-9:]+)\s*\| request: ([^\n]*)"

    def part(i: int) -> Column:
        return F.regexp_extract(value, pattern, i)

    d = df.where(F.regexp_like(value, F.lit(pattern)))
    return d.select(
        *[c for c in df.columns if c != value],
        part(1).alias("title"),
        part(2).alias("url"),
        part(3).try_cast("double").alias("fps"),
        F.try_to_timestamp(part(4), F.lit("dd/MM/yyyy HH:mm:ss")).alias("accessed"),
        part(5).alias("request"),
    )


def read_video_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_video_manifest(_files(spark, path, True))


def parse_scene_list(df: DataFrame, value: str = "value") -> DataFrame:
    """One row per ``Scene n: a - b`` line."""
    pattern = rf"Scene ([0-9]+):\s+({TIMECODE})\s+-\s+({TIMECODE})"
    d = df.where(F.regexp_like(value, F.lit(pattern)))
    part = lambda i: F.regexp_extract(value, pattern, i)
    return d.select(
        *[c for c in df.columns if c != value],
        part(1).cast("int").alias("scene"),
        from_timecode(part(2)).alias("start_s"),
        from_timecode(part(3)).alias("end_s"),
    )


def read_scene_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_scene_list(_files(spark, path, False))


def scene_offset(wanted: DataFrame, scenes: DataFrame, keys: list[str]) -> DataFrame:
    """Start of each wanted scene, 0.0 when it is not listed."""
    first = scenes.groupBy(*keys).agg(F.min("start_s").alias("offset"))
    return wanted.join(first, keys, "left").withColumn("offset", F.coalesce("offset", F.lit(0.0)))


def parse_segments(df: DataFrame, value: str = "value") -> DataFrame:
    """``[Extrait ]name : a - b[,] [flag: x, y]`` lines."""
    pattern = rf"^\s*(?:Extrait )?(.+?) : ({TIMECODE}) - ({TIMECODE})(?:,? flag: (.*))?\s*$"
    d = df.where(F.regexp_like(value, F.lit(pattern)))
    part = lambda i: F.regexp_extract(value, pattern, i)
    flags = F.when(part(4) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(part(4)), r",\s*"))
    return d.select(
        *[c for c in df.columns if c != value],
        part(1).alias("name"),
        from_timecode(part(2)).alias("start_s"),
        from_timecode(part(3)).alias("end_s"),
        flags.alias("flags"),
    )


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return parse_segments(_files(spark, path, False))


def parse_json_map(df: DataFrame, value: str = "value") -> DataFrame:
    """One row per entry of a JSON object; unreadable documents give none."""
    keep = [c for c in df.columns if c != value]
    return df.select(*keep, F.explode(F.from_json(value, "map<string,string>")).alias("key", "text"))


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """Caption files: {"video_a/b": tagged text}."""
    d = parse_json_map(_files(spark, path, True))
    return d.select(
        F.regexp_extract("key", r"([^/]+)/[^/]*$", 1).alias("video_id"), F.regexp_extract("key", r"([0-9]+)$", 1).alias("scene_id"), "text"
    )


_INFO = "struct<start_time:double,end_time:double,timestamp:double,pid:string,error:string,date_started:string,videos:array<string>>"
LEDGER_SCHEMA = ", ".join(f"{s} map<string,{_INFO}>" for s in ("processed", "in_progress", "failed", "preprocessed", "heartbeats"))


def parse_ledger(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(item states, heartbeats) of tracking documents; corrupt ones are
    empty. A state's ``ts`` is its newest known time."""
    keep = [c for c in df.columns if c != value]
    d = df.select(*keep, F.from_json(value, LEDGER_SCHEMA, {"mode": "PERMISSIVE"}).alias("j"))
    rows = None
    for s in ("processed", "in_progress", "failed", "preprocessed"):
        r = d.select(*keep, F.lit(s).alias("state"), F.explode(F.col("j")[s]).alias("item", "i")).select(
            *keep,
            "item",
            "state",
            F.col("i.pid").alias("owner"),
            F.timestamp_seconds(F.coalesce("i.end_time", "i.timestamp", "i.start_time")).alias("ts"),
            F.col("i.error").alias("error"),
        )
        rows = r if rows is None else rows.unionByName(r)
    beats = d.select(*keep, F.explode("j.heartbeats").alias("owner", "i")).select(
        *keep, "owner", F.timestamp_seconds("i.timestamp").alias("ts"), F.col("i.videos").alias("items")
    )
    return rows, beats


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_ledger(_files(spark, path, True))


ARRAY_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("frame", T.LongType()),
        T.StructField("vec", T.ArrayType(T.DoubleType())),
        T.StructField("length", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)


#: Files of more bytes are read in ranges of about so many.
ARRAY_RANGE = 64 << 20

RANGE_SCHEMA = "path string, start long, stop long, error string"


def _opened(path: str) -> pa.NativeFile:
    """A file of Spark's file listing, for reads at any place."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    fs, name = pafs.FileSystem.from_uri(quote(path, safe=":/@"))
    return fs.open_input_file(name)


def _array_header(f: pa.NativeFile) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, column order, type and place of the first entry of a ``.npy`` file."""
    raw = io.BytesIO(f.read_at(min(1 << 16, f.size()), 0))
    version = np.lib.format.read_magic(raw)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(raw)
    if dtype.hasobject:
        raise ValueError("object arrays are refused")
    np.zeros(1, dtype).astype(np.float64)  # raises for records and text
    if not shape or not math.prod(shape):
        raise ValueError("an array without rows")
    if f.size() < raw.tell() + math.prod(shape) * dtype.itemsize:
        raise ValueError("the file ends before its last entry")
    return shape, fortran, dtype, raw.tell()


def _array_rows(f: pa.NativeFile, start: int, stop: int) -> np.ndarray:
    """Rows ``start`` to ``stop`` as vectors; only their bytes are read."""
    shape, fortran, dtype, at = _array_header(f)
    width, size = math.prod(shape[1:]), dtype.itemsize
    read = lambda first, n: np.frombuffer(f.read_at(n * size, at + first * size), dtype=dtype)
    if not fortran:
        return read(start * width, (stop - start) * width).reshape(stop - start, width).astype(np.float64)
    # entries of one row lie a whole column apart
    cols = np.stack([read(j * shape[0] + start, stop - start) for j in range(width)], axis=1)
    return cols.reshape(stop - start, *shape[1:], order="F").reshape(stop - start, width).astype(np.float64)


def read_arrays(spark: SparkSession, path: str, rows: int = 4096, limit: int = ARRAY_RANGE) -> DataFrame:
    """Plain ``.npy`` files as one row per leading index. A file that cannot
    be read becomes one reject row with ``error``; object arrays are refused.
    Arrays are sent on in slices of ``rows``.

    Files of up to ``limit`` bytes are read whole, by Spark. Of a larger one a task
    reads the header and gives row ranges of ``limit`` bytes, and other tasks read
    each just its bytes, through ``pyarrow.fs``. A row is the least unit.
    """

    def frames(p: str, a: np.ndarray, first: int, total: int) -> Iterator[pd.DataFrame]:
        for s in range(0, len(a), rows):
            b = a[s : s + rows]
            yield pd.DataFrame({"path": p, "frame": np.arange(first + s, first + s + len(b)), "vec": list(b), "length": total, "error": None})

    def reject(p: str, e: object) -> pd.DataFrame:
        return pd.DataFrame({"path": [p], "frame": [None], "vec": [None], "length": [None], "error": [str(e)]})

    def load(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for p, blob in zip(pdf["path"], pdf["content"]):
                try:
                    a = np.load(io.BytesIO(blob), allow_pickle=False)
                    a = np.asarray(a, dtype=np.float64)
                    a = a.reshape(len(a), -1) if a.ndim else a.reshape(1, 1)
                except Exception as e:  # noqa: BLE001 - any bad file is a reject row
                    yield reject(p, e)
                    continue
                yield from frames(p, a, 0, len(a))

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for p in pdf["path"]:
                try:
                    with _opened(p) as f:
                        shape, _, dtype, _ = _array_header(f)
                except ValueError as e:
                    yield pd.DataFrame({"path": [p], "start": [0], "stop": [0], "error": [str(e)]})
                    continue
                step = max(1, limit // max(1, math.prod(shape[1:]) * dtype.itemsize))
                starts = np.arange(0, shape[0], step)
                yield pd.DataFrame({"path": p, "start": starts, "stop": np.minimum(starts + step, shape[0]), "error": None})

    def fetch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for p, start, stop, error in zip(pdf["path"], pdf["start"], pdf["stop"], pdf["error"]):
                if error is not None:
                    yield reject(p, error)
                    continue
                with _opened(p) as f:
                    yield from frames(p, _array_rows(f, int(start), int(stop)), int(start), _array_header(f)[0][0])

    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    small = d.where(F.col("length") <= limit).select("path", "content").mapInPandas(load, ARRAY_SCHEMA)
    ranges = d.where(F.col("length") > limit).select("path").mapInPandas(cut, RANGE_SCHEMA)
    # a given number, as tables of a few bytes would be put into one task
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return small.unionByName(ranges.repartition(tasks).mapInPandas(fetch, ARRAY_SCHEMA))


def parse_caption_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """``caption#word/POS …#from#to``"""
    p = F.split(value, "#")
    d = df.where(F.size(p) >= 4)
    return d.select(
        *[c for c in df.columns if c != value],
        F.get(p, F.lit(0)).alias("caption"),
        split_tokens(F.get(p, F.lit(1))).alias("tokens"),
        F.get(p, F.lit(2)).try_cast("double").alias("from_s"),
        F.get(p, F.lit(3)).try_cast("double").alias("to_s"),
    )


def read_caption_lines(spark: SparkSession, path: str) -> DataFrame:
    d = _files(spark, path, False).withColumn("clip_id", F.regexp_extract("path", r"([^/]+?)\.[^./]*$", 1))
    return parse_caption_lines(d.drop("path"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id != ''")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=INDEX_SCHEMA, header=True)


def stream_new_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """Incremental pickup: each file is read once per checkpoint."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)
