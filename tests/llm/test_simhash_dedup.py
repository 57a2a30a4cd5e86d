import random

import numpy as np
import pytest
import xxhash

from kinetable.llm import simhash_dedup as S


def plain_fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_classes(fps, budget=3):
    low = {f: f for f in fps}

    def root(f):
        while low[f] != f:
            f = low[f]
        return f

    fs = list(low)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= budget:
                low[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in fs}


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "one TWO", "a b c", "é x b\tC d", "x " * 300])
def test_fingerprint(text):
    assert S.fingerprint(text) == plain_fingerprint(text)


def test_documents_by_brute_force(spark):
    rng = random.Random(3)
    words = ["ab", "cd", "ef", "gh", "Ij", "kl", "mn", "öp"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(120)]
    base = " ".join(rng.choices(words, k=400)).split()
    for k in range(60):
        t = list(base)
        for _ in range(k % 4):
            t[rng.randrange(400)] = "zz"
        texts.append(" ".join(t))
    texts += [None, "", texts[5], texts[5]]
    rows = [(i if i != 3 else None, t, "x", 1.0) for i, t in enumerate(texts)]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id double")).collect()
    fps = [plain_fingerprint(t) for t in texts]
    cls = plain_classes(fps)
    want = {}
    for (i, *_), f in zip(rows, fps, strict=True):
        if i is not None:
            want[cls[f]] = min(i, want.get(cls[f], i))
    assert sorted(map(repr, ((r.doc_id, r.fingerprint, r.component_id) for r in got))) == sorted(map(repr, ((r[0], f"{f:016x}", want.get(cls[f])) for r, f in zip(rows, fps, strict=True))))


@pytest.mark.parametrize("unit", [3, 40, 2000])
def test_units_of_any_size_find_the_same_classes(spark, monkeypatch, unit):
    monkeypatch.setattr(S, "UNIT_ROWS", unit)
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    fps = {int(c) for c in centre} | {0, (1 << 64) - 1}
    for c in centre:
        for _ in range(40):
            f = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                f ^= 1 << int(b)
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    root = {r.node: r.root for r in S.classes(S.fingerprint_links(df)).collect()}
    got = {}
    for f in signed:
        got.setdefault(root.get(f, f), set()).add(f & (1 << 64) - 1)
    want = {}
    for f, r in plain_classes(fps).items():
        want.setdefault(r, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_row_of_each_class_stays(spark):
    long = "a b c d e f g h i j " * 30
    rows = [(5, long), (2, long + "z"), (2, long + "z"), (None, long), (7, "other words here"), (7, "different again now"), (None, "nothing else like this"), (None, "nothing else like this"), (9, None), (8, "")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, fp string")
    got = S.drop_near_duplicates(df)
    assert got.columns == df.columns
    want = [(2, long + "z", "s"), (7, "other words here", "s"), (7, "different again now", "s"), (None, "nothing else like this", "s"), (8, "", "s")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert S.drop_near_duplicates(df.limit(0)).collect() == []
