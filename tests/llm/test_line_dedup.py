"""Line dedup by plain Python, and the index on its own: collisions, shards, what a small cache reads."""

import hashlib
import random

import numpy as np
import pytest

from kinetable.llm import line_dedup as L
from kinetable.llm import mph

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def plain(docs, min_chars=40, min_docs=5):
    holders = {}
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append(i)
    keeper = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        text = "\n".join(kept)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    lines = [f"line {i} " + "x" * rng.randint(20, 45) for i in range(30)] + ["É" * 40, "é" * 40, "ü" * 39, "A" * 40, "a" * 40, "y" * 39]
    docs = []
    for i in range(120):
        own = [rng.choice(lines) if rng.random() < 0.6 else f"alone {rng.random()} " + "z" * 40 for _ in range(rng.randint(0, 8))]
        own = [rng.choice(["", " ", "\t", "\x0b"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "\r", "\x0c "]) for x in own]
        docs.append((i, "\n".join(own) + rng.choice(["", "\n", "\n\n"])))
    docs += [(None, lines[0]), (None, lines[0]), (3, docs[3][1]), (3, docs[3][1]), (900, None), (901, ""), (902, "\n"), (903, "\n".join(lines * 400)), (-4, lines[2])]
    docs += [(None, "only rows without an id hold this line, all five of them")] * 5
    docs += [(10, "this line stands at " + WHITE[0] * 3 + "a no-break space\xa0 at its end\xa0")] * 5 + [(11, "four documents hold this line and no other one has it")] * 4
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("shard_keys, cache, held", [(1_000_000, 192 << 20, 64 << 20), (4, 600, 1), (4, 600, 64 << 20), (1, 1, 4000)])
def test_report_by_plain_python(spark, monkeypatch, shard_keys, cache, held):
    monkeypatch.setattr(L.build_index, "__defaults__", (shard_keys,))
    monkeypatch.setattr(L, "CACHE_BYTES", cache)
    monkeypatch.setattr(L, "HELD_BYTES", held)
    docs = corpus()
    df = spark.createDataFrame([(*d, 1, 2, "k") for d in docs], "doc_id long, text string, n_lines int, h long, keeper string")
    assert sorted((tuple(r) for r in L.line_report(df).collect()), key=str) == plain(docs)


def test_drop_keeps_columns_and_null_texts(spark):
    docs = corpus()
    df = spark.createDataFrame([(t, len(t or ""), i, "k") for i, t in docs], "text string, n_chars long, doc_id long, keeper string")
    out = L.drop_repeated_lines(df, chars_col="n_chars")
    assert out.columns == df.columns
    want = sorted(((None if t is None else w, len(w), i, "k") for (i, t), (_, _, _, _, w) in zip(sorted(docs, key=lambda d: str(plain([d])[0][0])), plain(docs), strict=False)), key=str)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert len(got) == len(want)
    by = {}
    for i, _, _, _, text in plain(docs):
        by.setdefault(i, []).append(text)
    for text, n, i, _ in got:
        assert (text or "") in by[i] and n == len(text or "")
    assert sum(r[0] is None for r in got) == 1


def test_empty_table_and_no_repeats(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.line_report(df).collect() == [] and L.drop_repeated_lines(df).collect() == []
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in L.line_report(one).collect()] == [(1, 1, 0, hashlib.sha256(b"").hexdigest(), "")]


def _index(tmp_path, h, f, n, keepers, shards=1):
    build = L._build_shard(f"file://{tmp_path}")
    files = [None] * shards
    own = np.mod(h.view(np.int64), shards)
    for s in range(shards):
        at = own == s
        if at.any():
            table = L.pa.table({"h": h[at].view(np.int64), "f": f[at].view(np.int64), "n": n[at], "keeper": keepers[at], "shard": np.full(at.sum(), s)})
            files[s] = build(table)["file"][0].as_py()
    return f"file://{tmp_path}", files


def test_keys_with_one_hash_are_told_apart(tmp_path):
    h = np.array([5, 5, 5, 9], np.uint64)
    f = np.array([1, 2, 3, 1], np.uint64)
    folder, files = _index(tmp_path, h, f, np.array([5, 4, 7, 5]), np.array([10, 20, 30, 40]))
    ask = lambda h, f, i: L.probe(folder, files, np.array([h], np.uint64), np.array([f], np.uint64), np.array([i]), np.array([False]), 5)[0]
    assert ask(5, 1, 1) and not ask(5, 1, 10)
    assert not ask(5, 2, 1)  # held by four
    assert ask(5, 3, 10) and not ask(5, 3, 30)
    assert ask(9, 1, 10) and not ask(9, 2, 10) and not ask(6, 1, 1)


def test_each_shard_is_read_once_for_what_a_task_holds(tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    f = h ^ np.uint64(77)
    folder, files = _index(tmp_path, h, f, np.full(len(h), 9), np.arange(len(h)), shards=20)
    reads = []
    read = L._read_shard
    monkeypatch.setattr(L, "_read_shard", lambda uri: reads.append(uri) or read(uri))
    monkeypatch.setattr(L, "CACHE_BYTES", 40_000)  # about half of the shards
    L._CACHE.clear()
    where = {int(x): i for i, x in enumerate(h)}
    monkeypatch.setattr(L, "_hashes", lambda keys: (np.array([int(k) for k in keys], np.uint64), np.array([int(k) for k in keys], np.uint64) ^ np.uint64(77)))
    texts = ["\n".join(map(str, rng.choice(h, 200))) for _ in range(100)]
    batches = [L.pa.RecordBatch.from_arrays([L.pa.array(range(k, k + 10)), L.pa.array(texts[k : k + 10])], ["id", "text"]) for k in range(0, 100, 10)]
    monkeypatch.setattr(L, "_keys", lambda lines, n: [bytes(x) for x in lines])
    got = [r for _, part in L._judge(iter(batches), 0, 1, folder, files, 1, 5) for r in part]
    assert len(reads) == len(set(reads)) == 20
    for i, (kept, n) in enumerate(got):
        assert n == 200 and all(where[int(x)] == i for x in kept)


def test_minimal_perfect_hash():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        index = mph.Index(*mph.build(keys))
        assert sorted(index.slots(keys)) == list(range(len(keys)))
    with pytest.raises(ValueError, match="repeat"):
        mph.build(np.array([3, 3], np.uint64))
