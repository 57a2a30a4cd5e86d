"""Array files read by range: the same rows and rejects as whole files, in many tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.sources import readers as RD


def rows(d):
    return sorted((r["path"].rsplit("/", 1)[1], r["frame"], tuple(r["vec"]), r["length"]) for r in d.where("error IS NULL").collect())


@pytest.fixture
def folder(tmp_path):
    r = np.random.default_rng(0)
    a = r.normal(size=(500, 3, 2))
    np.save(tmp_path / "c order.npy", a)
    np.save(tmp_path / "f.npy", np.asfortranarray(a))
    np.save(tmp_path / "flat.npy", r.integers(0, 99, 4000))
    np.save(tmp_path / "big_endian.npy", a[:, 0].astype(">f4"))
    np.save(tmp_path / "tiny.npy", a[:2])
    np.save(tmp_path / "none.npy", a[:0])  # rejected: no rows
    np.save(tmp_path / "objects.npy", np.array([{"x": "y" * 5000}], dtype=object), allow_pickle=True)
    np.save(tmp_path / "text.npy", np.array(["word"] * 1000))
    whole = (tmp_path / "c order.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-1])
    (tmp_path / "junk.npy").write_bytes(b"junk" * 1000)
    return str(tmp_path)


@pytest.mark.parametrize("limit", [100, 2000])
def test_ranges_equal_whole_files(spark, folder, limit):
    whole, cut = RD.read_arrays(spark, folder), RD.read_arrays(spark, folder, rows=7, limit=limit)
    assert rows(cut) == rows(whole) and len(rows(whole)) == 500 * 3 + 4000 + 2
    bad = lambda d: sorted(r["path"].rsplit("/", 1)[1] for r in d.where("error IS NOT NULL").collect())
    assert bad(cut) == bad(whole) == ["cut.npy", "junk.npy", "none.npy", "objects.npy", "text.npy"]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(40_000.0).reshape(10_000, 4))
    d = RD.read_arrays(spark, str(tmp_path), limit=4000)
    per = d.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in per) == 10_000 and len(per) >= 4
