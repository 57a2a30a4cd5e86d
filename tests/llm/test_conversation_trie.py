"""The trie by plain Python, with ranges, chains and rounds of the list made small."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kinetable.llm import conversation_trie as C
from kinetable.llm.queries import op11_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, conv string, pos long"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [r[3:] for r in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]  # the remainder has the sign of c, as in SQL
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
            saved[p[:d]] = saved.get(p[:d], 0) + (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), 120):
        if rng.random() < 0.3:
            turns = [("user", "hello"), ("assistant", "é ü"), ("user", "more")]  # the same for many
        else:
            turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, f"t{rng.randrange(6)}"])) for _ in range(rng.randint(1, 12))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(1005, None, "user", "first"), (1005, 3, "x", "tie"), (1005, 3, "x", "tie 2"), (1005, 3, "x", "tie 2"), (1005, -7, "y", "low")]
    rows += [(1007, 1, "x", "y" * 20_000), (None, 0, "user", "nobody's"), (-3, 0, "a", "b"), (-5, 0, "a", "c"), (2000, 0, "", "ab"), (2005, 0, "a", "b")]
    rows += [(3000, k, "user", str(k % 3)) for k in range(700)] + [(3001, k, "user", str(k % 3)) for k in range(650)]  # most rows
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 5) for r in rows], SCHEMA)


@pytest.mark.parametrize("small", [False, True])
def test_query_by_plain_python(spark, tmp_path, monkeypatch, small):
    if small:
        for name, value in {"TASK_ROWS": 150, "REST": 6, "STRETCH": 2, "NEAR_CONVS": 2, "NEAR_ARCS": 40}.items():
            monkeypatch.setattr(C, name, value)
        monkeypatch.setattr(C.trie, "__defaults__", (6,))
    rows = corpus(4)
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op11_conversation_trie(spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_tour_encloses_subtrees(spark):
    rows = [r for r in corpus(9) if r[0] is not None and r[0] < 3000]
    out = C.regrafted_trie(frame(spark, rows), F.lit(0), F.col("conv"), 8).collect()
    n = len(out)
    assert sorted(x for r in out for x in (r.enter_at, r.exit_at)) == list(range(2 * n))
    at = {(r.conv_id, r.depth): r for r in out}
    for r in out:
        if r.depth:
            p = at[r.parent_conv_id, r.depth - 1]
            assert p.enter_at < r.enter_at < r.exit_at < p.exit_at
        inside = [x for x in out if r.enter_at <= x.enter_at and x.exit_at <= r.exit_at]
        assert r.n_leaves == sum(not x.n_children for x in inside)


def test_turnless_conversations_and_empty_tables(spark):
    rows = [(1, 0, "a", "b")]  # crc32 of 1 leaves more than one turn to a conversation that is not there
    assert zlib.crc32(b"1") % 9 > 0
    got = C.regrafted_trie(frame(spark, rows), F.crc32(F.col("conv").cast("string").cast("binary")) % 9, F.col("conv") - F.col("conv") % 5, 8).collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in got] == [(1, 0, None, 1, 0, 1, 0)]
    assert got[0].ends_sha256 == hashlib.sha256(b"1").hexdigest()
    assert C.regrafted_trie(frame(spark, []), F.lit(3), F.col("conv"), 8).collect() == []


def test_running_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "TASK_ROWS", 30)
    rng = random.Random(1)
    rows = [(7 if rng.random() < 0.7 else rng.randrange(20), k, rng.randrange(100), rng.getrandbits(40)) for k in range(500)]
    df = spark.createDataFrame(rows, "key long, at long, n long, x long")
    got = {(r.key, r.at): (r.n, r.x) for r in C.running(df, "key", ["at"], sums=["n"], xors=["x"]).collect()}
    state = {}
    for k, at, n, x in sorted(rows):
        a, b = state.get(k, (0, 0))
        state[k] = a + n, b ^ x
        assert got[k, at] == state[k]
