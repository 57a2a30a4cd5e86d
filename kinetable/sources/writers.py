"""Writers."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.functions.text import to_timecode


def write_id_list(df: DataFrame, col: str, path: str) -> None:
    df.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_index(df: DataFrame, path: str) -> None:
    df.select("source_path", "start_frame", "end_frame", "new_name").write.mode("overwrite").csv(path, header=True)


def write_dataset(df: DataFrame, path: str, keys: list[str], partition: list[str], buckets: int = 256) -> DataFrame:
    """Append the scenes that are not there yet; returns what was written.

    ``partition`` columns become folders. Existing keys are found by a
    null-safe anti join, so a second run writes nothing; only the folders that
    ``df`` has rows for are read. Rows are spread by key before the write,
    which bounds files per folder.
    """
    spark = df.sparkSession
    new = df
    try:
        seen = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        seen = None
    if seen is not None:
        here = df.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(partition)]).distinct()
        same_folder = [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(partition)]
        if same_folder:
            seen = seen.join(here, reduce(and_, same_folder), "left_semi")
        seen = seen.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(keys)]).distinct()
        new = df.join(seen, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(keys)]), "left_anti")
    spread = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    new.repartition(*partition, spread).write.mode("append").partitionBy(*partition).parquet(path)
    return new


def replace_partitions(df: DataFrame, path: str, partition: list[str]) -> None:
    """Overwrite only the folders present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def segment_lines(df: DataFrame) -> DataFrame:
    """The text line of each segment (name, start_s, end_s, flags)."""
    flags = F.when(F.size("flags") > 0, F.concat(F.lit(" flag: "), F.array_join("flags", ", "))).otherwise("")
    return df.withColumn("value", F.concat(F.lit("Extrait "), "name", F.lit(" : "), to_timecode(F.col("start_s")), F.lit(" - "), to_timecode(F.col("end_s")), flags))


def write_segments(df: DataFrame, path: str) -> None:
    segment_lines(df).select("value").write.mode("overwrite").text(path)


def write_texts(df: DataFrame, key: str, text: str, path: str, folders: int = 64) -> None:
    """A text file per ``key`` with the lines of its texts, in one of several folders.

    The number of tasks is given, as Spark would put a table of few bytes into
    one task. Each puts its files into place as in :func:`write_arrays`.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("value")).repartition(tasks, "key")
    d = d.groupBy("key").agg(F.array_join(F.collect_list("value"), "\n").alias("value"))
    d = d.withColumn("folder", F.pmod(F.xxhash64("key"), F.lit(folders)))

    def save(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _folder_of(path)
        made = set()
        for pdf in it:
            for k, v, at in zip(pdf["key"], pdf["value"], pdf["folder"]):
                if at not in made:
                    fs.create_dir(f"{base}/{at}", recursive=True)
                    made.add(at)
                _put(fs, f"{base}/{at}", "null" if k is None else "key=" + quote(k, safe=""), "txt", f"{v}\n".encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    d.mapInPandas(save, "n long").agg(F.sum("n")).collect()


def _folder_of(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _put(fs: pafs.FileSystem, folder: str, name: str, kind: str, content: bytes) -> None:
    aside = f"{folder}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as out:
        out.write(content)
    fs.move(aside, f"{folder}/{name}.{kind}")


def write_arrays(df: DataFrame, name: str, rows: str, path: str) -> None:
    """Each row's array of vectors as ``<name>.npy`` in the folder ``path``.

    Tasks write under another name and move the file into place, so a repeated
    attempt leaves one whole file.
    """

    def save(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _folder_of(path)
        fs.create_dir(base, recursive=True)
        for pdf in it:
            for n, vecs in zip(pdf[name], pdf[rows]):
                raw = io.BytesIO()
                np.save(raw, np.stack([np.asarray(v, dtype=np.float64) for v in vecs]))
                _put(fs, base, n, "npy", raw.getvalue())
            yield pd.DataFrame({"n": [len(pdf)]})

    df.select(name, rows).mapInPandas(save, "n long").agg(F.sum("n")).collect()
