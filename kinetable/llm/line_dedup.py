"""Line dedup: documents probe sharded minimal perfect hashes of repeated lines."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm import mph
from kinetable.llm.common import lean, shared_folder, stage

#: The white space that a key is stripped of, and the two hash seeds.
WHITE = b" \t\n\x0b\x0c\r"
SLOT_SEED, PRINT_SEED = 42, 1042

#: Distinct repeated lines in one shard, bytes of shards that a worker keeps, bytes of rows that a task holds while it goes through the shards.
SHARD_KEYS = 1_000_000
CACHE_BYTES = 192 << 20
HELD_BYTES = 64 << 20

_CACHE: OrderedDict[str, tuple] = OrderedDict()


def _keys(lines: list[bytes], min_chars: int) -> list[bytes]:
    """The key of each line, b'' for those too short to be judged."""
    out = []
    for x in lines:
        k = x.strip(WHITE).lower() if len(x) >= min_chars else b""
        # Bytes bound code points from above, a quarter of them from below.
        if k and (len(k) < min_chars or len(k) < 4 * min_chars and len(k.decode()) < min_chars):
            k = b""
        out.append(k)
    return out


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a = np.fromiter((xxhash.xxh64_intdigest(k, SLOT_SEED) for k in keys), np.uint64, len(keys))
    b = np.fromiter((xxhash.xxh64_intdigest(k, PRINT_SEED) for k in keys), np.uint64, len(keys))
    return a, b



def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = set(_keys((text or "").encode().split(b"\n"), min_chars))
                own.discard(b"")
                keys += own
                rows += [i] * len(own)
            a, b = _hashes(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column(0).take(pa.array(rows, pa.int64()))], ["h", "f", "id"]
            )

    return run


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 2) -> DataFrame:
    """Keys found in ``min_docs`` rows or more: h and f (two 64-bit hashes), n rows, keeper (largest id).

    A row counts once however often it repeats the key; counts are combined before the shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_line_rows(min_chars), "h long, f long, id long")
    return rows.groupBy("h", "f").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs)


def _build_shard(folder: str):
    def run(table: pa.Table) -> pa.Table:
        h = table["h"].to_numpy().view(np.uint64)
        f, n = table["f"].to_numpy().view(np.uint64), table["n"].to_numpy()
        keeper = table["keeper"].to_pylist()
        # Keys that agree in h (one in 2**64) would share a slot: later ones get a hash list of their own.
        _, first = np.unique(h, return_index=True)
        extra = np.setdiff1d(np.arange(len(h)), first)
        sizes, packed = mph.build(h[first])
        slot = np.empty(len(first), np.int64)
        slot[mph.Index(sizes, packed).slots(h[first])] = first
        order = np.concatenate([slot, extra]).astype(np.int64)
        shard = table["shard"][0].as_py()
        row = {
            "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())),
            "bits": pa.array([packed.tobytes()], pa.large_binary()),
            "prints": pa.array([f[order].tobytes()], pa.large_binary()),
            "counts": pa.array([n[order].astype(np.uint64).tobytes()], pa.large_binary()),
            "keepers": pa.array([np.array([keeper[i] or 0 for i in order], np.int64).tobytes()], pa.large_binary()),
            "no_keeper": pa.array([np.array([keeper[i] is None for i in order], bool).tobytes()], pa.large_binary()),
            "extra": pa.array([h[extra].tobytes()], pa.large_binary()),
        }
        fs, path = pafs.FileSystem.from_uri(folder)
        name = f"shard-{shard}-{hashlib.md5(h.tobytes()).hexdigest()}.parquet"
        # The same content whatever attempt writes it: written aside, then moved into place.
        aside = f"{path}/.{name}.{np.random.default_rng().integers(1 << 62)}"
        with fs.open_output_stream(aside) as out:
            pq.write_table(pa.table(row), out, compression="none")
        fs.move(aside, f"{path}/{name}")
        return pa.table({"shard": pa.array([shard], pa.int64()), "file": [name], "keys": pa.array([len(h)], pa.int64())})

    return run


def build_index(repeated: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[str, list[str | None]]:
    """Writes one file of arrays a shard into the shared folder; returns it and each shard's file (None: no keys).

    Shards are cut by hash, so they are even; their number follows the keys.
    """
    spark = repeated.sparkSession
    repeated = stage(repeated)
    shards = max(1, -(-repeated.count() // shard_keys))
    folder = shared_folder(spark)
    rows = repeated.withColumn("shard", F.pmod(F.col("h"), F.lit(shards).cast("long"))).groupBy("shard")
    made = rows.applyInArrow(_build_shard(folder), "shard long, file string, keys long").collect()
    files: list[str | None] = [None] * shards
    for r in made:
        files[r["shard"]] = r["file"]
    return folder, files


def _read_shard(uri: str) -> tuple:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        row = pq.read_table(f).to_pylist()[0]
    return (
        mph.Index(np.array(row["sizes"], np.int64), np.frombuffer(row["bits"], np.uint8)), np.frombuffer(row["prints"], np.uint64),
        np.frombuffer(row["counts"], np.uint64), np.frombuffer(row["keepers"], np.int64), np.frombuffer(row["no_keeper"], bool), np.frombuffer(row["extra"], np.uint64),
    )


def _shard(folder: str, name: str) -> tuple:
    uri = f"{folder}/{name}"
    if uri in _CACHE:
        _CACHE.move_to_end(uri)
        return _CACHE[uri]
    _CACHE[uri] = _read_shard(uri)
    size = lambda x: sum(a.nbytes for a in x[1:]) + x[0].packed.nbytes + x[0].before.nbytes
    while len(_CACHE) > 1 and sum(map(size, _CACHE.values())) > CACHE_BYTES:
        _CACHE.popitem(last=False)
    return _CACHE[uri]


def probe(folder: str, files: list[str | None], h: np.ndarray, f: np.ndarray, ids: np.ndarray, no_id: np.ndarray, min_docs: int) -> np.ndarray:
    """True where the key (h, f) is indexed with a count of ``min_docs`` or more and the row's id is not its keeper.

    Each shard is visited once, those that are at hand first.
    """
    out = np.zeros(len(h), bool)
    shard = np.mod(h.view(np.int64), np.int64(len(files)))
    order = np.argsort(shard, kind="stable")
    which, low = np.unique(shard[order], return_index=True)
    rows = {int(s): order[a:b] for s, a, b in zip(which, low, np.append(low, len(order))[1:], strict=True) if files[s] is not None}
    for s in sorted(rows, key=lambda s: f"{folder}/{files[s]}" not in _CACHE):
        index, prints, counts, keepers, no_keeper, extra = _shard(folder, files[s])
        at = rows[s]
        slot = index.slots(h[at])
        hit = (slot >= 0) & (prints[np.maximum(slot, 0)] == f[at]) if len(prints) else np.zeros(len(at), bool)
        for j, x in enumerate(extra):
            same = (h[at] == x) & (prints[len(index) + j] == f[at])
            slot, hit = np.where(same, len(index) + j, slot), hit | same
        at, slot = at[hit], slot[hit]
        keeps = np.where(no_keeper[slot], no_id[at], (keepers[slot] == ids[at]) & ~no_id[at])
        out[at] = ~keeps & (counts[slot] >= min_docs)
    return out


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about HELD_BYTES, so that a task goes through the shards as seldom as it can."""
    own: list[pa.RecordBatch] = []
    for b in batches:
        if own and sum(x.nbytes for x in own) + b.nbytes > HELD_BYTES:
            yield own
            own = []
        own.append(b)
    if own:
        yield own


def _judge(batches: Iterator[pa.RecordBatch], id_at: int, text_at: int, folder: str, files: list[str | None], min_chars: int, min_docs: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[list[bytes], int]]]]:
    """Each batch, in parts of some rows, with (kept lines, number of lines) of each row."""
    for own in _held(batches):
        parts = [b.slice(k, 512) for b in own for k in range(0, b.num_rows, 512)]
        h, f, ids, no_id, row, place = [], [], [], [], [], []
        for part in parts:  # of the lines only hashes are held
            keys, rows, places = [], [], []
            for i, x in enumerate(part.column(text_at)):
                for j, k in enumerate(_keys((x.as_py() or "").encode().split(b"\n"), min_chars)):
                    if k:
                        keys.append(k)
                        rows.append(i)
                        places.append(j)
            own_ids = part.column(id_at)
            for to, x in zip((h, f), _hashes(keys), strict=True):
                to.append(x)
            row.append(np.array(rows, np.int64))
            place.append(np.array(places, np.int64))
            no_id.append(np.asarray(own_ids.is_null().to_numpy(zero_copy_only=False))[row[-1]])
            ids.append(np.asarray(own_ids.cast(pa.int64()).fill_null(0))[row[-1]])
        if not parts:
            continue
        gone_at = probe(folder, files, *map(np.concatenate, (h, f, ids, no_id)), min_docs)
        low = 0
        for part, r, p in zip(parts, row, place, strict=True):
            gone: dict[int, set[int]] = {}
            for k in np.flatnonzero(gone_at[low : low + len(r)]):
                gone.setdefault(int(r[k]), set()).add(int(p[k]))
            low += len(r)
            docs = [(x or "").encode().split(b"\n") for x in part.column(text_at).to_pylist()]
            yield part, [([x for j, x in enumerate(lines) if j not in gone[i]] if i in gone else lines, len(lines)) for i, lines in enumerate(docs)]


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256, text (what is left).

    A line's key is the line without white space at its ends, A-Z lower-cased.
    Keys of at least ``min_chars`` code points found in at least ``min_docs``
    rows lose all their lines but those of the largest id that holds them. A
    null or empty text is one empty line. A null id counts as a document and
    is smaller than every id; rows that repeat an id each count, and all rows
    with the largest id keep the line. Other columns do not matter. The index
    holds every key of two rows or more with its count; the count of the slot
    that a line falls on decides.
    """
    folder, files = build_index(repeated_lines(docs, id_col, text_col, min_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, got in _judge(batches, 0, 1, folder, files, min_chars, min_docs):
            kept = [b"\n".join(x) for x, _ in got]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([n for _, n in got], pa.int64()), pa.array([n - len(x) for x, n in got], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array([x.decode() for x in kept], pa.string()),
                ], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "text"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, text string")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, chars_col: str | None = None) -> DataFrame:
    """``docs`` with the same columns and rows, the text without the lines that ``line_report`` drops.

    A text that loses nothing stays as it is, null included. ``chars_col``, if
    given, is set to the new length in code points where the text changed.
    """
    folder, files = build_index(repeated_lines(docs, id_col, text_col, min_chars))
    at = {n: i for i, n in enumerate(docs.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, got in _judge(batches, at[id_col], at[text_col], folder, files, min_chars, min_docs):
            old = batch.column(at[text_col]).to_pylist()
            new = [x if len(k) == n else b"\n".join(k).decode() for x, (k, n) in zip(old, got, strict=True)]
            cols = list(batch.columns)
            cols[at[text_col]] = pa.array(new, cols[at[text_col]].type)
            if chars_col is not None:
                was = cols[at[chars_col]].to_pylist()
                cols[at[chars_col]] = pa.array([w if len(k) == n else len(x) for w, x, (k, n) in zip(was, new, got, strict=True)], cols[at[chars_col]].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(lean(run), docs.schema)
