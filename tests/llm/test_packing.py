import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kinetable.llm import packing as P
from kinetable.llm.queries import tokenizer_path


def texts():
    rng = random.Random(1)
    parts = ["the", " ", "  ", "\n", "\n\n", " \n", "\t", "don't", "x1y2", "é", "日本", "…", " ", " ", "a\nb", ".", ",", "<|endoftext|>", "'s", "!!", "𝒳", "\r\n", "0123"]
    return ["", " ", "  ", " a", "a ", "a b", "a  b", "a   b"] + ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(400)] + [" ".join(rng.choices([p for p in parts if p.strip(" ")], k=50)) for _ in range(200)]


@pytest.mark.parametrize("words", [0, 5, 400_000])
def test_ids_equal_the_tokenizers(words, monkeypatch):
    monkeypatch.setattr(P, "WORDS", words)
    t, coder = Tokenizer.from_file(tokenizer_path()), P.WordCoder(tokenizer_path())
    for low in range(0, 608, 16):
        part = texts()[low : low + 16]
        assert [np.frombuffer(x, np.uint32).tolist() for x in coder.encode(part)] == [e.ids for e in t.encode_batch(part, add_special_tokens=False)]


def filled(rows, capacity):
    """rows: (length, sequence, offset). Checks that there are no gaps; returns the number of sequences."""
    by = {}
    for n, s, o in rows:
        by.setdefault(s, []).append((o, n))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_each_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([6, 10, 64, 1024])
    counts = {rng.randint(1, capacity): rng.randint(0, 50) for _ in range(rng.randint(0, 60))}
    rows, seen = [], {}
    for n, rank, k, s, o in P.plan_bins(counts, capacity):
        seen.setdefault(n, set()).update(range(rank, rank + k))
        rows += [(n, s + i, o) for i in range(k)]
    assert {n: len(v) for n, v in seen.items()} == {n: c for n, c in counts.items() if c}
    assert len(rows) == sum(counts.values())
    # Best fit of one piece after the other, longest first.
    free = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = [g for g in free if g >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            free.append(capacity - n)
    assert filled(rows, capacity) <= len(free) + 1


@pytest.mark.parametrize("seed", range(20))
def test_large_pieces_make_the_most_pairs(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(35, 100) for _ in range(rng.randint(1, 9))]

    def most(left):
        if not left:
            return 0
        a, rest = left[0], left[1:]
        return max([most(rest), *(1 + most(rest[:i] + rest[i + 1 :]) for i, b in enumerate(rest) if a + b <= 100)])

    counts = {n: sizes.count(n) for n in sizes}
    rows = [(n, s + i, o) for n, _, k, s, o in P.plan_bins(counts, 100) for i in range(k)]
    assert filled(rows, 100) == len(sizes) - most(sizes)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_PIECES", 20)
    rng = random.Random(2)
    t = Tokenizer.from_file(tokenizer_path())
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gamma,", "delta"], k=rng.choice([0, 1, 5, 40, 100])))) for i in range(150)]
    docs += [(None, None), (7, ""), (7, ""), (8, "word " * 500)]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, length int, offset string")
    got = P.pack_documents(df, tokenizer_path(), capacity=64, with_ids=True).collect()
    assert filled([(r.length, r.sequence_id, r.offset) for r in got], 64) <= -(-sum(r.length for r in got) // 64) + 1
    whole = []
    for i, x in docs:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        whole += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(repr, whole)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids)) for r in got)


def test_empty(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []
