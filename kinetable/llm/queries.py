"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.llm import bpe, conversation_trie, decontaminate, language_id, line_dedup, packing, pq_dedup, secrets, simhash_dedup, spelling, toxicity, url_filter, warc
from kinetable.llm.common import held_out


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark, _table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents")).drop("text")


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (r.key IS NOT NULL AND doc_id <> r.keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (r.key IS NULL OR doc_id = r.keeper), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), keep=lambda c: ~held_out(c))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", F.col("language").alias("threshold_language"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs, keep=~held_out("doc_id"))
    return language_id.predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"), count("random"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, p.b FROM reach r JOIN pair p ON p.a = r.y),
low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT a, count(*) AS n FROM pair GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN low ON x = vec_id LEFT JOIN n ON a = vec_id
"""


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _op10_sql() -> str:
    """The same rounds, written out one after the other."""
    rules = sorted(url_filter.RULES, key=lambda r: -len(r.text))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda field: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, field)}'" for r in rules) + " END"
    lower = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"
    d = url_filter.DAMPING
    ranks = ["r0 AS (SELECT kind, host, seed AS score FROM start)"]
    for k in range(url_filter.ROUNDS):
        ranks.append(f"""r{k + 1} AS (
  SELECT kind, host, sum(score) AS score FROM (
    SELECT e.kind, e.b AS host, r.score * e.share * {d} AS score FROM r{k} r JOIN e ON e.kind = r.kind AND e.a = r.host
    UNION ALL SELECT kind, host, seed * (1 - {d}) FROM start) GROUP BY 1, 2)""")
    rounds = ",\n".join(ranks)
    return rf"""
WITH u AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {lower}) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
p AS (SELECT page_id, html, host, path, {case("text")} AS rule, {case("verdict")} AS ruled FROM u),
seeds AS (SELECT host, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked FROM p WHERE host <> '' GROUP BY host),
t AS (
  SELECT DISTINCT page_id, host AS src, translate(regexp_replace(x, '^(?i:https?:)?//', ''), {lower}) AS dst
  FROM (SELECT page_id, host, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*((?:https?:)?//[^/?#\s"''>]+)', 1)) AS x FROM p)
  WHERE host <> ''),
links AS (SELECT src, dst, count(*) AS n FROM t WHERE dst <> '' AND src <> dst GROUP BY 1, 2),
w AS (SELECT 'trust' AS kind, src AS a, dst AS b, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
e AS (SELECT kind, a, b, n / sum(n) OVER (PARTITION BY kind, a) AS share FROM w),
s AS (SELECT 'trust' AS kind, host, allowed AS w FROM seeds UNION ALL SELECT 'distrust', host, blocked FROM seeds),
start AS (SELECT kind, host, w / sum(w) OVER (PARTITION BY kind) AS seed FROM s WHERE w > 0),
{rounds},
score AS (
  SELECT host, round(coalesce(sum(score) FILTER (kind = 'trust'), 0), {url_filter.DIGITS}) AS trust,
         round(coalesce(sum(score) FILTER (kind = 'distrust'), 0), {url_filter.DIGITS}) AS distrust
  FROM r{url_filter.ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * {url_filter.RATIO} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN score USING (host)
"""


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    return conversation_trie.regrafted_trie(_table(spark, sf_dir, "conversations"), head, F.col("conv") - F.col("conv") % 5, most=8).drop("enter_at", "exit_at")


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a string's bytes in DuckDB's SQL, bit by bit."""
    byte = lambda i: f"CAST('0x' || substr(hex(encode({text})), 2 * {i} - 1, 2) AS UBIGINT)"
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(range(1, 1 + octet_length(encode({text}))), lambda i: {byte('i')})"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {codes}), lambda a, b: {step}), 4294967295)"


OP11_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT c, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS turns FROM t GROUP BY c),
h AS (SELECT c, turns, CAST({crc32_sql("CAST(c AS VARCHAR)")} % 9 AS BIGINT) AS h, c - c % 5 AS base FROM o),
r AS (
  SELECT h.c, list_concat(coalesce(list_slice(b.turns, 1, h.h), []), list_slice(h.turns, h.h + 1, len(h.turns))) AS seq
  FROM h LEFT JOIN o b ON b.c = h.base),
m AS (SELECT c, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS depth, seq FROM r),
p AS (SELECT c, n, depth, list_slice(seq, 1, depth) AS path FROM m),
node AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * strlen(coalesce(path[depth].t, '')) AS saving,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256
  FROM p GROUP BY path, depth),
child AS (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(child.n, 0) AS n_children FROM node LEFT JOIN child USING (path)),
up AS (SELECT unnest(range(0, depth + 1)) AS d, path, n_children, saving FROM full_node),
sub AS (SELECT list_slice(path, 1, d) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saving) AS saved_tokens FROM up GROUP BY 1)
SELECT a.conv_id, a.depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, CAST(sub.n_leaves AS BIGINT) AS n_leaves,
       CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM full_node a JOIN sub USING (path) LEFT JOIN node b ON a.depth > 0 AND b.path = list_slice(a.path, 1, a.depth - 1)
"""


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_path(), with_text=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH RECURSIVE run AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}'), '[a-z\x{{00C0}}-\x{{00FF}}]{{6,}}')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, CAST(doc_id AS VARCHAR) || ':' || run AS said FROM run GROUP BY doc_id, run),
hashed AS (SELECT run, n, CAST({crc32_sql("said")} AS BIGINT) AS h FROM counted),
edited AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
place AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
less AS (SELECT DISTINCT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM place),
near AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, v.word FROM less l JOIN v ON l.rest = v.word
  UNION SELECT v.word, l.word FROM less l JOIN v ON l.rest = v.word),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(near, (-v.n, near)) AS form, max(v.n) AS form_n FROM near JOIN v ON v.word = near.near GROUP BY near.word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM f JOIN chain c USING (word) JOIN f g ON g.word = c.root WHERE g.form IS NULL
"""


QUERIES: dict[str, Entry] = {
    "op1_warc": Entry(op1_warc, OP1_SQL),
    "op2_decontamination": Entry(op2_decontamination),
    "op3_line_dedup": Entry(op3_line_dedup, OP3_SQL),
    "op4_best_fit_packing": Entry(op4_best_fit_packing),
    "op5_toxicity": Entry(op5_toxicity),
    "op6_language_id": Entry(op6_language_id),
    "op7_secret_scan": Entry(op7_secret_scan),
    "op8_embedding_dedup": Entry(op8_embedding_dedup, OP8_SQL),
    "op9_simhash_dedup": Entry(op9_simhash_dedup),
    "op10_url_filter": Entry(op10_url_filter, _op10_sql()),
    "op11_conversation_trie": Entry(op11_conversation_trie, OP11_SQL),
    "op12_bpe_round_trip": Entry(op12_bpe_round_trip),
    "op13_spelling_variants": Entry(op13_spelling_variants, OP13_SQL),
}
