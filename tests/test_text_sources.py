import json

import numpy as np
from pyspark.sql import functions as F

from kinetable.functions import boxes as B
from kinetable.functions import text as X
from kinetable.operators import captions as CA
from kinetable.operators import frames as FR
from kinetable.sources import readers as RD
from kinetable.sources import writers as WR

CAPTION = (
    "<SceneDesc>A hall</SceneDesc><Action><0> walks left \n slowly</0><1>sits<0>turns right</Action>"
    "<BodyDesc><0>tall</0><1>short <b>x</BodyDesc><Style><0>calm</Style>"
)


def one(spark, text):
    return spark.createDataFrame([(text,)], "t string")


def test_caption_parsing(spark):
    d = one(spark, CAPTION)
    items = CA.caption_items(d.withColumnRenamed("t", "text"), []).orderBy("person_id").collect()
    assert [tuple(r) for r in items] == [("0", "tall", "calm", "walks left \n slowly"), ("1", "short ", None, "sits"), ("2", None, None, "turns right")]
    acts = {r["person"]: r["action"] for r in CA.person_actions(d.withColumnRenamed("t", "text"), []).collect()}
    assert acts == {"0": "turns right", "1": "sits"}  # the repeated tag wins
    assert d.select(X.closed_tags(X.section(F.col("t"), "Action"))).first()[0] == 1
    assert d.select(X.section(F.col("t"), "Absent")).first()[0] is None


def test_mirror_modes(spark):
    d = one(spark, "left hand turns clockwise, right counter-clockwise")
    assert d.select(X.mirror_text(F.col("t"))).first()[0] == "right hand turns counter-clockwise, left clockwise"
    assert d.select(X.mirror_text(F.col("t"), "sequential")).first()[0] == "left hand turns clockwise, left counter-clockwise"


def test_small_text_functions(spark):
    d = one(spark, "1. one\n\n 2: two\n3 : three")
    assert d.select(X.numbered_list(F.col("t"))).first()[0] == ["two", "three"]
    assert d.select(X.strip_enumeration(F.col("t"))).first()[0] == "one\n: two\n: three"
    assert one(spark, "5 7 900 3").select(X.code_string(F.col("t"))).first()[0] == [5, 7]
    assert one(spark, "none").select(X.code_string(F.col("t"))).first()[0] == [1, 1, 1, 1]
    tc = spark.createDataFrame([(90061.5,)], "s double").select(X.to_timecode(F.col("s")).alias("c"))
    assert tc.first()[0] == "01:01:01.500" and tc.select(X.from_timecode(F.col("c"))).first()[0] == 3661.5
    assert one(spark, "café au|Lait!").select(X.sanitize_name(F.col("t"))).first()[0] == "café_auLait"
    assert one(spark, "video_12_merged_scene_3_body_0").select(X.clip_short_name(F.col("t"))).first()[0] == "12_3_0"


def test_many_small_files_are_written_by_many_tasks(spark, tmp_path):
    d = spark.range(0, 300, 1, 1).select("id", F.concat(F.lit("t"), "id", F.lit(" | u | fps:2 | accessed:09/03/2024 10:11:12\n | request: r")).alias("value"))
    d = d.unionByName(d.where("id = 7")).unionByName(d.where("id < 2").withColumn("value", F.lit(None).cast("string")))
    path = str(tmp_path / "m")
    WR.write_texts(d, "id", "value", path)
    files = list((tmp_path / "m").rglob("*.txt"))
    assert len(files) == 300 and len({f.parent for f in files}) > 32  # so many folders are listed by tasks
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # one file a partition
    try:
        got = RD.read_video_manifest(spark, path)
        assert got.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
        assert sorted(r.title for r in got.collect()) == sorted(f"t{i}" for i in range(300))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)


def test_text_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "metadata.txt").write_text(
        "My title | http://v | fps:29.97 | accessed:09/03/2024 10:11:12\n | request: dance\nvideo_1.mp4:\n"
        "Scene 1: 00:00:01.000 - 00:00:06.500\nScene 2: 00:00:06.500 - 00:01:00.000\n"
        "Extrait a-1.mp4 : 00:00:01.000 - 00:00:04.000 flag: crowded, weird position\n2.mp4 : 00:00:05.000 - 00:00:06.000\n"
    )
    p = str(tmp_path / "m")
    v = RD.read_video_manifest(spark, p).first()
    assert (v["title"], v["url"], v["fps"], v["request"]) == ("My title", "http://v", 29.97, "dance") and str(v["accessed"]) == "2024-03-09 10:11:12"
    sc = RD.read_scene_list(spark, p).orderBy("scene")
    assert [(r["scene"], r["start_s"], r["end_s"]) for r in sc.collect()] == [(1, 1.0, 6.5), (2, 6.5, 60.0)]
    want = spark.createDataFrame([(2,), (9,)], "scene int")
    assert {r["scene"]: r["offset"] for r in RD.scene_offset(want, sc, ["scene"]).collect()} == {2: 6.5, 9: 0.0}
    seg = RD.read_segments(spark, p)
    assert {r["name"]: r["flags"] for r in seg.collect()} == {"a-1.mp4": ["crowded", "weird position"], "2.mp4": []}
    WR.write_segments(seg, str(tmp_path / "seg"))
    assert RD.read_segments(spark, str(tmp_path / "seg")).drop("path").exceptAll(seg.drop("path")).count() == 0


def test_json_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"video_a/1": "x", "video_b/22": "y\nz"}, indent=1))
    (tmp_path / "bad.json").write_text("{not json")
    got = {(r["video_id"], r["scene_id"]): r["text"] for r in RD.read_captions(spark, str(tmp_path)).collect()}
    assert got == {("video_a", "1"): "x", ("video_b", "22"): "y\nz"}
    led = tmp_path / "l"
    led.mkdir()
    (led / "t.json").write_text(json.dumps({"processed": {"v1": {"end_time": 10.0}}, "in_progress": {"v2": {"start_time": 5.0, "pid": 7}}, "heartbeats": {"7": {"timestamp": 6.0, "videos": ["v2"]}}}))
    (led / "corrupt.json").write_text('{"processed": {')
    items, beats = RD.read_ledger(spark, str(led))
    assert {(r["item"], r["state"], r["owner"]) for r in items.collect()} == {("v1", "processed", None), ("v2", "in_progress", "7")}
    assert [(r["owner"], r["items"]) for r in beats.collect()] == [("7", ["v2"])]


def test_arrays_and_lists(spark, tmp_path):
    a = np.arange(12.0).reshape(4, 3)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "o.npy", np.array([{"x": 1}], dtype=object), allow_pickle=True)
    (tmp_path / "b.npy").write_bytes(b"junk")
    d = RD.read_arrays(spark, str(tmp_path), rows=3)
    good = d.where("error IS NULL").orderBy("frame").collect()
    np.testing.assert_array_equal(np.stack([r["vec"] for r in good]), a)
    assert all(r["length"] == 4 for r in good) and d.where("error IS NOT NULL").count() == 2
    ids = spark.createDataFrame([("x1",), ("x2",)], "id string")
    WR.write_id_list(ids, "id", str(tmp_path / "ids"))
    assert RD.read_id_list(spark, str(tmp_path / "ids")).exceptAll(ids).count() == 0
    ix = spark.createDataFrame([("a.npy", 0, 9, "n1")], RD.INDEX_SCHEMA)
    WR.write_index(ix, str(tmp_path / "ix"))
    assert RD.read_index(spark, str(tmp_path / "ix")).collect() == ix.collect()
    (tmp_path / "clip7.txt").write_text("a man walks#a/DET man/NOUN walks/VERB#0.0#2.5\n")
    r = RD.read_caption_lines(spark, str(tmp_path / "clip7.txt")).first()
    assert (r["clip_id"], r["caption"], [t["pos"] for t in r["tokens"]], r["to_s"]) == ("clip7", "a man walks", ["DET", "NOUN", "VERB"], 2.5)


def test_write_dataset_skips_existing(spark, tmp_path):
    p = str(tmp_path / "d")
    d = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 3.0)], "video int, scene int, v double")
    assert WR.write_dataset(d.where("video = 1"), p, ["video", "scene"], ["video"]).count() == 2
    WR.write_dataset(d, p, ["video", "scene"], ["video"])
    assert spark.read.parquet(p).count() == 3
    WR.replace_partitions(d.where("video = 2").withColumn("v", F.lit(9.0)), p, ["video"])
    assert {r["v"] for r in spark.read.parquet(p).collect()} == {1.0, 2.0, 9.0}


def test_boxes(spark):
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    d = spark.range(1)
    r = d.select(
        B.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)).alias("a"), B.iou(box(0, 0, 1, 1), box(5, 5, 6, 6)).alias("b"), B.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("c"),
        B.valid(box(0, 0, 5, 5), 5.0, 5.0).alias("v"), B.valid(box(0.5, 0, 5, 5), 5.0, 5.0).alias("w"),
    ).first()
    assert abs(r["a"] - 1 / 7) < 1e-12 and (r["b"], r["c"], r["v"], r["w"]) == (0.0, 0.0, True, False)


def test_pad_and_loop(spark):
    d = spark.createDataFrame([("a", i, i) for i in range(3)], "k string, f long, v int")
    p = FR.pad_to(d, ["k"], "f", 5).orderBy("out_frame").collect()
    assert [(r["v"], r["is_valid"]) for r in p] == [(0, True), (1, True), (2, True), (2, False), (2, False)]
    assert [r["v"] for r in FR.loop_to(d, ["k"], "f", 5).orderBy("out_frame").collect()] == [0, 1, 2, 0, 1]
    c = FR.chunk(d, ["k"], "f", 2, 1).groupBy("chunk").count().collect()
    assert sorted((r["chunk"], r["count"]) for r in c) == [(0, 2), (1, 2)]
    assert FR.chunk(d, ["k"], "f", 2, 0, drop_short=False).agg(F.max("chunk")).first()[0] == 1
