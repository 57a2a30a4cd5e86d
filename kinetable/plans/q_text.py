"""Text, caption and parsing functions over documents, pages and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions import text as X
from kinetable.operators import captions as CA
from kinetable.plans.base import events
from kinetable.plans.q_stats import BLOCK_SQL, blocks
from kinetable.plans.registry import query, table
from kinetable.sources import readers as RD
from kinetable.sources import writers as WR

def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query(
    "to_timecode",
    """WITH m AS (SELECT o_orderkey, CAST(floor(o_totalprice * 1000) AS BIGINT) AS ms FROM orders)
SELECT o_orderkey, printf('%02d:%02d:%02d.%03d', (ms // 3600000) % 24, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS code,
  round(((ms // 3600000) % 24) * 3600 + ((ms // 60000) % 60) * 60 + (ms % 60000) / 1000.0, 3) AS back FROM m""",
)
def to_timecode(spark, sf):
    """Both directions."""
    d = table(spark, sf, "orders").select("o_orderkey", X.to_timecode(F.col("o_totalprice")).alias("code"))
    return d.withColumn("back", F.round(X.from_timecode(F.col("code")), 3))


@query(
    "sanitize_name",
    r"SELECT doc_id, md5(regexp_replace(replace(text, ' ', '_'), '[^\p{L}\p{N}_]', '', 'g')) AS name, md5(lower(trim(replace(text, '|', '')))) AS title FROM documents",
)
def sanitize_name(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", F.md5(X.sanitize_name(t)).alias("name"), F.md5(X.clean_title(t)).alias("title"))


@query(
    "parse_keys",
    "SELECT CAST(o_custkey AS VARCHAR) AS video, CAST(o_orderkey AS VARCHAR) AS scene, o_custkey || '_' || o_orderkey || '_3' AS clip FROM orders",
)
def parse_keys(spark, sf):
    o = table(spark, sf, "orders")
    key = F.concat(F.lit("video_"), "o_custkey", F.lit("/"), "o_orderkey")
    name = F.concat(F.lit("video_"), "o_custkey", F.lit("_merged_scene_"), "o_orderkey", F.lit("_body_3"))
    d = o.select(key.alias("k"), name.alias("n"))
    p = X.parse_scene_key(F.col("k"))
    return d.select(p["video"].alias("video"), p["scene"].alias("scene"), X.clip_short_name(F.col("n")).alias("clip"))


@query(
    "caption_sections",
    """SELECT page_id, CASE WHEN regexp_matches(html, '(?s)<title>(.*?)</title>') THEN md5(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) END AS title,
  CASE WHEN regexp_matches(html, '(?s)<article>(.*?)</article>') THEN md5(regexp_extract(html, '(?s)<article>(.*?)</article>', 1)) END AS article,
  CASE WHEN regexp_matches(html, '(?s)<absent>(.*?)</absent>') THEN 'x' END AS absent FROM pages""",
)
def caption_sections(spark, sf):
    s = X.sections(F.col("html"), ("title", "article", "absent"))
    d = table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in s.items()])
    return d.select("page_id", F.md5("title").alias("title"), F.md5("article").alias("article"), "absent")


SPLIT = "string_split_regex(block, '<[0-9]+>')[2:]"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    "items_by_position",
    f"""WITH {BLOCK_SQL}, s AS (SELECT conv_id, turn, {SPLIT} AS p FROM blk), u AS (SELECT conv_id, turn, unnest(range(1, len(p) + 1)) AS i, p FROM s)
SELECT conv_id, turn, i - 1 AS person, md5(string_split({STRIP.format('p[i]')}, '<')[1]) AS item FROM u""",
)
def items_by_position(spark, sf):
    d = blocks(spark, sf).select("conv_id", "turn", F.posexplode(X.items_by_position(F.col("block"))).alias("person", "item"))
    return d.select("conv_id", "turn", F.col("person").cast("long").alias("person"), F.md5("item").alias("item"))


@query(
    "items_by_tag",
    rf"""WITH {BLOCK_SQL}, b2 AS (SELECT conv_id, turn, block || '<0>' || substr(block, 1, 40) AS block FROM blk),
s AS (SELECT conv_id, turn, {SPLIT} AS p, regexp_extract_all(block, '<([0-9]+)>', 1) AS k FROM b2), u AS (SELECT conv_id, turn, unnest(range(1, len(p) + 1)) AS i, p, k FROM s),
c AS (SELECT conv_id, turn, i, k[i] AS person, regexp_replace(replace(replace({STRIP.format('p[i]')}, chr(10), ' '), '  ', ' '), '</[0-9]+>', '', 'g') AS item FROM u)
SELECT conv_id, turn, person, md5(item) AS item FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, person ORDER BY i DESC) AS r FROM c WHERE item <> '') WHERE r = 1""",
)
def items_by_tag(spark, sf):
    """A repeated first tag is appended, so duplicates occur."""
    d = blocks(spark, sf).withColumn("block", F.concat("block", F.lit("<0>"), F.substring("block", 1, 40)))
    d = d.select("conv_id", "turn", F.explode(X.items_by_tag(F.col("block"))).alias("person", "item"))
    return d.select("conv_id", "turn", "person", F.md5("item").alias("item"))


@query(
    "inner_items",
    f"""WITH {BLOCK_SQL}, u AS (SELECT conv_id, turn, regexp_extract_all(block, '(?s)<[0-9]+>(.*?)</[0-9]+>', 1) AS p FROM blk)
SELECT conv_id, turn, i - 1 AS place, md5(p[i]) AS item FROM (SELECT conv_id, turn, unnest(range(1, len(p) + 1)) AS i, p FROM u)""",
)
def inner_items(spark, sf):
    d = blocks(spark, sf).select("conv_id", "turn", F.posexplode(X.inner_items(F.col("block"))).alias("place", "item"))
    return d.select("conv_id", "turn", F.col("place").cast("long").alias("place"), F.md5("item").alias("item"))


@query(
    "caption_items",
    f"""WITH {BLOCK_SQL}, s AS (SELECT conv_id, turn, list_transform({SPLIT}, lambda x: string_split({STRIP.format('x')}, '<')[1]) AS p FROM blk),
q AS (SELECT conv_id, turn, p, p[2:] AS t FROM s)
SELECT conv_id, turn, CAST(i - 1 AS VARCHAR) AS person_id, md5(p[i]) AS body_desc, md5(t[i]) AS style, CAST(NULL AS VARCHAR) AS action FROM (SELECT conv_id, turn, unnest(range(1, len(p) + 1)) AS i, p, t FROM q)""",
)
def caption_items(spark, sf):
    """BodyDesc holds all turns, Style all but the first, Action nothing."""
    tail = F.regexp_replace("block", r"(?s)^<[0-9]+>.*?</[0-9]+>", "")
    text = F.concat(F.lit("<BodyDesc>"), "block", F.lit("</BodyDesc><Style>"), tail, F.lit("</Style>"))
    d = CA.caption_items(blocks(spark, sf).select("conv_id", "turn", text.alias("text")), ["conv_id", "turn"])
    return d.select("conv_id", "turn", "person_id", F.md5("body_desc").alias("body_desc"), F.md5("style").alias("style"), "action")


@query(
    "words",
    r"""SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: x NOT IN ('the', 'of', 'and')) AS w FROM documents)""",
)
def words(spark, sf):
    d = docs(spark, sf).withColumn("w", X.words(F.col("text"), ["the", "of", "and"]))
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


#: The sentences of a turn as lines, each with its number.
LINES_SQL = """ln AS (SELECT conv_id, turn, array_to_string(list_transform(string_split(replace(text, chr(10), ' '), '. '), lambda x, i: i || '{sep} ' || x), chr(10) || chr(10)) AS body FROM conversations)"""


def lines(spark, sf, sep):
    parts = F.transform(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. "), lambda x, i: F.concat(i + 1, F.lit(f"{sep} "), x))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(parts, "\n\n").alias("body"))


@query(
    "numbered_list",
    f"""WITH {LINES_SQL.format(sep=':')} SELECT conv_id, turn, md5(array_to_string(regexp_extract_all(body, '(?m)^\\s*[0-9]+\\s*:\\s*(.+)$', 1), '|')) AS items FROM ln""",
)
def numbered_list(spark, sf):
    return lines(spark, sf, ":").select("conv_id", "turn", F.md5(F.array_join(X.numbered_list(F.col("body")), "|")).alias("items"))


@query(
    "strip_enumeration",
    f"""WITH {LINES_SQL.format(sep='.')} SELECT conv_id, turn, md5(array_to_string(list_filter(list_transform(string_split(body, chr(10)),
  lambda s: trim(regexp_replace(s, '^[0-9. ]+', ''))), lambda s: s <> ''), chr(10))) AS digest FROM ln""",
)
def strip_enumeration(spark, sf):
    return lines(spark, sf, ".").select("conv_id", "turn", F.md5(X.strip_enumeration(F.col("body"))).alias("digest"))


#: Common words become side words, so that mirroring has work to do.
SIDES_SQL = "replace(replace(replace(replace(text, 'the ', 'left '), 'and ', 'clockwise '), 'of ', 'right '), 'is ', 'counter-clockwise ')"


def sided():
    t = F.col("text")
    for a, b in (("the ", "left "), ("and ", "clockwise "), ("of ", "right "), ("is ", "counter-clockwise ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


@query(
    "mirror_text",
    f"""WITH s AS (SELECT doc_id, {SIDES_SQL} AS t FROM documents), m AS (SELECT doc_id, t,
  replace(replace(replace(t, 'left', chr(1)), 'right', 'left'), chr(1), 'right') AS a FROM s)
SELECT doc_id, md5(replace(replace(replace(a, 'counter-clockwise', chr(1)), 'clockwise', 'counter-clockwise'), chr(1), 'clockwise')) AS swapped,
  md5(replace(replace(replace(replace(t, 'left', 'right'), 'right', 'left'), 'clockwise', 'counter-clockwise'), 'counter-clockwise', 'clockwise')) AS sequential FROM m""",
)
def mirror_text(spark, sf):
    d = docs(spark, sf).withColumn("t", sided())
    return d.select("doc_id", F.md5(X.mirror_text(F.col("t"))).alias("swapped"), F.md5(X.mirror_text(F.col("t"), "sequential")).alias("sequential"))


@query(
    "mirror_dataset",
    f"""WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS id, n_chars AS x, {SIDES_SQL} AS t FROM documents), m AS (SELECT id, x, replace(replace(replace(t, 'left', chr(1)), 'right', 'left'), chr(1), 'right') AS a FROM s)
SELECT id, x, md5(t) AS t FROM s UNION ALL
SELECT 'M' || id, -x, md5(replace(replace(replace(a, 'counter-clockwise', chr(1)), 'clockwise', 'counter-clockwise'), chr(1), 'clockwise')) FROM m""",
)
def mirror_dataset(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("x"), sided().alias("t"))
    return CA.mirror_dataset(d, "id", "t", {"x": -F.col("x")}).withColumn("t", F.md5("t"))


@query("truncate_text", "SELECT doc_id, md5(CASE WHEN trim(text) <> '' THEN substring(trim(text), 1, 2000) END) AS digest FROM documents")
def truncate_text(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.truncate_text(F.col("text"), 2000)).alias("digest"))


@query(
    "split_tokens",
    """WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_type FROM part), u AS (SELECT p_partkey, unnest(range(1, len(w) + 1)) AS i, w, p_type FROM t)
SELECT p_partkey, w[i] AS word, CASE WHEN i = len(w) THEN 'NOUN' ELSE p_type END AS pos, CASE WHEN i = len(w) THEN 2 ELSE 15 END AS hot FROM u""",
)
def split_tokens(spark, sf):
    """Last word a noun, the others tagged with an unknown class."""
    tagged = F.concat(F.replace("p_name", F.lit(" "), F.concat(F.lit("/"), "p_type", F.lit(" "))), F.lit("/NOUN"))
    d = table(spark, sf, "part").select("p_partkey", F.explode(X.split_tokens(tagged)).alias("t"))
    d = d.select("p_partkey", "t.word", "t.pos").withColumn("h", X.pos_onehot(F.col("pos")))
    return d.select("p_partkey", "word", "pos", F.array_position("h", 1.0).cast("int").alias("hot"))


@query(
    "code_string",
    """WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: coalesce(try_cast(x AS BIGINT), 512)) AS n FROM documents),
c AS (SELECT doc_id, n, list_position(list_transform(n, lambda x: x > 511), true) AS p FROM n),
d AS (SELECT doc_id, CASE WHEN p > 0 THEN n[1:p-1] ELSE n END AS k FROM c)
SELECT doc_id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE [1, 1, 1, 1] END, ' ') AS codes FROM d""",
)
def code_string(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(X.code_string(F.col("text")).cast("array<string>"), " ").alias("codes"))


@query(
    "truncate_at",
    """WITH q AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS a FROM documents),
t AS (SELECT doc_id, CASE WHEN list_position(a, 9) > 0 THEN a[1:list_position(a, 9)] ELSE a END AS a FROM q)
SELECT doc_id, md5(array_to_string(a, ' ')) AS cut, md5(array_to_string(list_concat(list_resize(CAST([] AS BIGINT[]), greatest(40 - len(a), 0), 0), a), ' ')) AS padded FROM t""",
)
def truncate_at(spark, sf):
    """Word lengths as codes, the first 9 as the end mark."""
    from kinetable.functions.vectors import pad_left
    from kinetable.functions.vectors import truncate_at as cut

    d = docs(spark, sf).select("doc_id", F.transform(F.split("text", " "), lambda x: F.length(x).cast("long")).alias("a"))
    d = d.withColumn("a", cut(F.col("a"), 9))
    join = lambda c: F.md5(F.array_join(c.cast("array<string>"), " "))
    return d.select("doc_id", join(F.col("a")).alias("cut"), join(pad_left(F.col("a"), 40, 0)).alias("padded"))


@query("read_captions", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS text FROM events")
def read_captions(spark, sf):
    return RD.parse_json_map(events(spark, sf).select("event_id", F.col("props").alias("value")))


@query(
    "read_segments",
    """SELECT o_orderkey, 'clip ' || o_custkey AS name, CAST(o_orderkey % 80000 AS DOUBLE) AS start_s, CAST(o_orderkey % 80000 + 5 AS DOUBLE) AS end_s,
  CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 1 ELSE 0 END AS flags FROM orders""",
)
def read_segments(spark, sf):
    """Orders written as segment lines and parsed back."""
    flags = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("crowded"), F.lit("weird position"))).when(
        F.col("o_orderpriority") == "5-LOW", F.array(F.lit("crowded"))
    ).otherwise(F.array().cast("array<string>"))
    t = (F.col("o_orderkey") % 80000).cast("double")
    d = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("clip "), "o_custkey").alias("name"), t.alias("start_s"), (t + 5).alias("end_s"), flags.alias("flags"))
    d = RD.parse_segments(WR.segment_lines(d).select("o_orderkey", "value"))
    return d.withColumn("flags", F.size("flags"))


@query(
    "read_scene_list",
    "SELECT o_custkey, CAST(o_orderkey % 1000 AS INT) AS scene, CAST(o_orderkey % 80000 AS DOUBLE) AS start_s, CAST(o_orderkey % 80000 + 5 AS DOUBLE) AS end_s FROM orders",
)
def read_scene_list(spark, sf):
    t = (F.col("o_orderkey") % 80000).cast("double")
    line = F.concat(F.lit("Scene "), F.col("o_orderkey") % 1000, F.lit(": "), X.to_timecode(t), F.lit(" - "), X.to_timecode(t + 5))
    return RD.parse_scene_list(table(spark, sf, "orders").select("o_custkey", line.alias("value")))


@query(
    "read_video_manifest",
    "SELECT doc_id, replace(lang || source, '|', '') AS title, 'http://v/' || doc_id AS url, 29.97::DOUBLE AS fps, '2024-03-09 10:11:12' AS accessed, lang AS request FROM documents",
)
def read_video_manifest(spark, sf):
    line = F.concat("lang", "source", F.lit(" | http://v/"), "doc_id", F.lit(" | fps:29.97 | accessed:09/03/2024 10:11:12\n | request: "), "lang")
    d = RD.parse_video_manifest(table(spark, sf, "documents").select("doc_id", line.alias("value")))
    return d.withColumn("accessed", F.date_format("accessed", "yyyy-MM-dd HH:mm:ss"))


@query(
    "read_caption_lines",
    "SELECT p_partkey, p_name AS caption, CAST(len(string_split(p_name, ' ')) AS INT) AS tokens, CAST(p_size AS DOUBLE) AS from_s, p_retailprice AS to_s FROM part",
)
def read_caption_lines(spark, sf):
    line = F.concat("p_name", F.lit("#"), F.replace("p_name", F.lit(" "), F.lit("/ADJ ")), F.lit("/NOUN#"), "p_size", F.lit("#"), "p_retailprice")
    d = RD.parse_caption_lines(table(spark, sf, "part").select("p_partkey", line.alias("value")))
    return d.withColumn("tokens", F.size("tokens"))


@query(
    "read_ledger",
    """SELECT CAST(user_id AS VARCHAR) AS item, CASE WHEN user_id % 3 = 0 THEN 'failed' ELSE 'processed' END AS state, count(*) AS n, round(max(value), 2) AS ts FROM events GROUP BY 1, 2""",
)
def read_ledger(spark, sf):
    """One tracking document per user, with one entry whose time is a value."""
    u = events(spark, sf).groupBy("user_id").agg(F.max("value").alias("v"), F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("user_id") % 3 == 0, "failed").otherwise("processed")
    doc = F.concat(F.lit('{"'), state, F.lit('": {"'), "user_id", F.lit('": {"end_time": '), "v", F.lit('}}, "heartbeats": {}}'))
    items, _ = RD.parse_ledger(u.select("n", doc.alias("value")))
    return items.select("item", "state", "n", F.round(F.unix_micros("ts") / 1e6, 2).alias("ts"))


@query("write_dataset", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def write_dataset(spark, sf):
    """Orders written by priority; a second write finds every key there."""
    from kinetable.streaming.state import stream_folder

    path = stream_folder(spark, "dataset")
    d = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    for _ in range(2):
        WR.write_dataset(d, path, ["o_orderkey"], ["o_orderpriority"], buckets=4)
    got = spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return got


@query("id_list", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders")
def id_list(spark, sf):
    """Written as one id per line and read back."""
    from kinetable.streaming.state import stream_folder

    path = stream_folder(spark, "ids")
    WR.write_id_list(table(spark, sf, "orders"), "o_orderkey", path)
    return RD.read_id_list(spark, path)


@query("index_file", "SELECT 'p/' || o_custkey AS source_path, CAST(o_orderkey % 100 AS INT) AS start_frame, CAST(o_orderkey % 100 + 9 AS INT) AS end_frame, 'n' || o_orderkey AS new_name FROM orders")
def index_file(spark, sf):
    """A CSV index written and read back."""
    from kinetable.streaming.state import stream_folder

    path = stream_folder(spark, "index")
    k = (F.col("o_orderkey") % 100).cast("int")
    d = table(spark, sf, "orders").select(F.concat(F.lit("p/"), "o_custkey").alias("source_path"), k.alias("start_frame"), (k + 9).alias("end_frame"), F.concat(F.lit("n"), "o_orderkey").alias("new_name"))
    WR.write_index(d, path)
    return RD.read_index(spark, path)


# ---- through files -------------------------------------------------------------------


def _folder(spark, name):
    from kinetable.streaming.state import stream_folder

    return stream_folder(spark, name)


@query(
    "read_segments_files",
    """SELECT 'clip ' || o_custkey AS name, CAST(o_orderkey % 80000 AS DOUBLE) AS start_s, CAST(o_orderkey % 80000 + 5 AS DOUBLE) AS end_s,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'crowded,weird position' ELSE '' END AS flags FROM orders""",
)
def read_segments_files(spark, sf):
    """Segment files written by the writer and opened by the reader."""
    flags = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("crowded"), F.lit("weird position"))).otherwise(F.array().cast("array<string>"))
    t = (F.col("o_orderkey") % 80000).cast("double")
    path = _folder(spark, "segments")
    WR.write_segments(table(spark, sf, "orders").select(F.concat(F.lit("clip "), "o_custkey").alias("name"), t.alias("start_s"), (t + 5).alias("end_s"), flags.alias("flags")), path)
    return RD.read_segments(spark, path).select("name", "start_s", "end_s", F.array_join("flags", ",").alias("flags"))


@query(
    "read_scene_list_files",
    "SELECT CAST(o_orderkey % 1000 AS INT) AS scene, CAST(o_orderkey % 80000 AS DOUBLE) AS start_s, CAST(o_orderkey % 80000 + 5 AS DOUBLE) AS end_s FROM orders",
)
def read_scene_list_files(spark, sf):
    """Scene lists in text files, opened by the reader."""
    t = (F.col("o_orderkey") % 80000).cast("double")
    path = _folder(spark, "scenes")
    line = F.concat(F.lit("Scene "), F.col("o_orderkey") % 1000, F.lit(": "), X.to_timecode(t), F.lit(" - "), X.to_timecode(t + 5))
    table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    return RD.read_scene_list(spark, path).select("scene", "start_s", "end_s")


@query(
    "read_captions_files",
    "SELECT 'v' || CAST(floor(c_custkey / 100) AS BIGINT) AS video_id, CAST(c_custkey AS VARCHAR) AS scene_id, c_name AS text FROM customer",
)
def read_captions_files(spark, sf):
    """One caption document for each hundred customers, a file each."""
    path = _folder(spark, "captions")
    group = F.floor(F.col("c_custkey") / 100)
    entry = F.struct(F.concat(F.lit("v"), group, F.lit("/"), "c_custkey"), "c_name")
    docs_ = table(spark, sf, "customer").groupBy(group.alias("g")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    WR.write_texts(docs_, "g", "value", path)
    return RD.read_captions(spark, path)


@query(
    "read_arrays_files",
    """SELECT CAST(vec_id // 100 AS BIGINT) AS file, count(*) AS length, round(sum(embedding[1]::DOUBLE), 6) AS x, round(sum(embedding[64]::DOUBLE), 6) AS y FROM embeddings GROUP BY 1""",
)
def read_arrays_files(spark, sf):
    """Blocks of embeddings saved as ``.npy`` by the tasks and opened by the reader."""
    path = _folder(spark, "arrays")
    block = F.floor(F.col("vec_id") / 100)
    rows = table(spark, sf, "embeddings").select(block.alias("file"), F.struct("vec_id", "embedding").alias("r")).groupBy("file").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["embedding"]).alias("vecs"))
    WR.write_arrays(rows, "file", "vecs", path)
    d = RD.read_arrays(spark, path, limit=40_000)  # a full file has 51,328 bytes: read in two ranges; the last one whole if shorter
    name = F.regexp_extract("path", r"([0-9]+)\.npy$", 1).cast("long")
    at = lambda i: F.round(F.sum(F.get("vec", F.lit(i))), 6)
    return d.groupBy(name.alias("file")).agg(F.count("frame").alias("length"), at(0).alias("x"), at(63).alias("y"))


@query(
    "read_video_manifest_files",
    "SELECT s_name AS title, 'http://v/' || s_suppkey AS url, s_acctbal::DOUBLE AS fps, '2024-03-09 10:11:12' AS accessed, 'n' || s_nationkey AS request FROM supplier",
)
def read_video_manifest_files(spark, sf):
    """A manifest file per video (a supplier), written by the tasks and opened by the reader."""
    path = _folder(spark, "manifests")
    line = F.concat("s_name", F.lit(" | http://v/"), "s_suppkey", F.lit(" | fps:"), "s_acctbal", F.lit(" | accessed:09/03/2024 10:11:12\n | request: n"), "s_nationkey")
    d = table(spark, sf, "supplier").select(line.alias("value"), "s_suppkey")
    WR.write_texts(d, "s_suppkey", "value", path)
    return RD.read_video_manifest(spark, path).select("title", "url", "fps", F.date_format("accessed", "yyyy-MM-dd HH:mm:ss").alias("accessed"), "request")


@query(
    "read_caption_lines_files",
    "SELECT p_name AS caption, CAST(len(string_split(p_name, ' ')) AS INT) AS tokens, CAST(p_size AS DOUBLE) AS from_s, p_retailprice AS to_s FROM part",
)
def read_caption_lines_files(spark, sf):
    """Caption lines in text files, opened by the reader."""
    path = _folder(spark, "lines")
    line = F.concat("p_name", F.lit("#"), F.replace("p_name", F.lit(" "), F.lit("/ADJ ")), F.lit("/NOUN#"), "p_size", F.lit("#"), "p_retailprice")
    table(spark, sf, "part").select(line.alias("value")).write.text(path)
    return RD.read_caption_lines(spark, path).select("caption", F.size("tokens").alias("tokens"), "from_s", "to_s")


@query(
    "read_ledger_files",
    """SELECT 'u' || user_id AS item, CASE WHEN user_id % 3 = 0 THEN 'failed' WHEN user_id % 3 = 1 THEN 'processed' ELSE 'in_progress' END AS state,
  'o' || user_id % 20 AS owner, max(epoch_us(ts)) // 1000000 AS ts FROM events GROUP BY user_id""",
)
def read_ledger_files(spark, sf):
    """One tracking document per owner with the items of its users, opened by the reader."""
    path = _folder(spark, "ledgers")
    u = events(spark, sf).groupBy("user_id").agg(F.unix_seconds(F.max("ts")).alias("t"))
    owner = F.concat(F.lit("o"), F.col("user_id") % 20)
    state = F.element_at(F.array(F.lit("failed"), F.lit("processed"), F.lit("in_progress")), (F.col("user_id") % 3 + 1).cast("int"))
    info = F.struct(F.col("t").cast("double").alias("timestamp"), F.col("owner").alias("pid"))
    items = u.select("t", owner.alias("owner"), state.alias("state"), F.concat(F.lit("u"), "user_id").alias("item"))
    per = items.groupBy("owner", "state").agg(F.map_from_entries(F.collect_list(F.struct("item", info))).alias("m"))
    docs_ = per.groupBy("owner").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("state", "m")))).alias("value"))
    docs_.repartition("owner").write.partitionBy("owner").text(path)
    found, _ = RD.read_ledger(spark, path)
    return found.select("item", "state", "owner", F.unix_seconds("ts").alias("ts"))
