"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that only matter when the caller has not chosen their own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_PRIVATE: dict[str, str] = {}


def build_session(app: str = "kinetable", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    if not is_local(spark):
        ship_package(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship_package(spark: SparkSession) -> str:
    """Give the workers this package, so that they need not have it installed."""
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="kinetable-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = shutil.make_archive(os.path.join(folder, "kinetable"), "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(made)
    return made


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a session in one process may
    go without and gets a private one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_base(spark))


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without it a private folder, removed when
    Python ends, but only for a ``local`` master, where all see it."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _PRIVATE:
        _PRIVATE[sc.applicationId] = tempfile.mkdtemp(prefix="kinetable-", dir=os.environ.get("TMPDIR"))
        atexit.register(shutil.rmtree, _PRIVATE[sc.applicationId], ignore_errors=True)
    return _PRIVATE[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    Used where several later branches would otherwise each recompute a long
    plan. The copy lives on shared storage, so a lost executor costs nothing.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
