import random

import corpus_pipeline as C
import numpy as np
import pytest

from kinetable.llm import shingle_dedup as D


def plain_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def plain_kept(rows, least=0.8):
    """Ids kept, by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (len(a & b) / len(a | b) if a | b else 1.0) >= least:
                root[find(i)] = find(j)
    by = {}
    for k, (i, _) in enumerate(rows):
        by.setdefault(find(k), []).append(i)
    return sorted(min((i for i in v if i is not None), default=-1) for v in by.values())


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    line = lambda n: rng.choices(vocabulary, k=n)
    licence = line(60)
    texts = []
    for _ in range(25):  # ordinary documents, each with copies that have a few edited words
        base = line(rng.randint(30, 200)) + (licence if rng.random() < 0.5 else [])
        texts.append(base)
        for edits in (1, 2, 3, 6):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(t)
    chain = line(120)  # each like the next one, the ends unlike each other
    for k in range(0, 60, 4):
        texts.append([*line(0), *chain[k:], *[f"c{j}" for j in range(k)]])
    texts += [licence, licence + ["a"], ["a", "b"], ["a", "b"], ["A", "b"], ["b", "a"], [], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, None), (None, " ".join(texts[0])), (3, " ".join(texts[3])), (None, "alone here")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("frequent, rounds, leaders, unit", [(4, 3, 256, 2000), (2, 0, 256, 2000), (10**9, 3, 1, 6), (10**9, 0, 1, 4)])
def test_all_pairs_by_brute_force(spark, monkeypatch, frequent, rounds, leaders, unit):
    for name, value in {"FREQUENT": frequent, "LEADER_ROUNDS": rounds, "LEADERS": leaders, "UNIT_ROWS": unit, "OUT_ROWS": 30}.items():
        monkeypatch.setattr(D, name, value)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, fp string")
    got = D.drop_similar(df)
    assert got.columns == df.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == plain_kept(rows)


def test_stage_drops_copies_with_an_edited_word(spark):
    rng = random.Random(2)
    base = [rng.choices([f"w{i}" for i in range(500)], k=80) for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(base)] + [(100 + i, " ".join([*t[:40], "edited", *t[41:]])) for i, t in enumerate(base)]
    got = C.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == list(range(20))


def test_hashes_and_prefixes():
    assert len(D.shingle_hashes("a b c d e f a b c d e f a b c d e", 5)) == 6
    assert D.shingle_set("É x", 5) == {"É x".encode()} and D.shingle_set(None, 5) == set()
    rng = np.random.default_rng(0)
    for _ in range(300):  # sets at the limit share a member of their prefixes
        n = int(rng.integers(2, 40))
        a = rng.permutation(100)[:n]
        b = rng.permutation(np.concatenate([a[: int(rng.integers(0, n + 1))], 100 + rng.permutation(50)[: int(rng.integers(0, 8))]]))
        if len(b) and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8:
            assert set(np.sort(a)[: D.prefix_length(len(a), 0.8)]) & set(np.sort(b)[: D.prefix_length(len(b), 0.8)])


def test_empty(spark):
    assert D.drop_similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_passage_in_all_documents(spark, monkeypatch):
    """Documents that share a passage of half their length are not alike; copies of one are."""
    monkeypatch.setattr(D, "FREQUENT", 10**9)
    monkeypatch.setattr(D, "UNIT_ROWS", 20)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    words = [f"w{i}" for i in range(5000)]
    rows = [(i, " ".join([*rng.choices(words, k=50), *passage, *rng.choices(words, k=10)])) for i in range(150)]
    rows += [(500 + i, rows[i % 3][1] + " more" * (i % 2)) for i in range(60)]
    got = D.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(150))


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.append(rng.permutation(a)[: int(rng.integers(0, n + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, 60))).astype(np.uint64)))
        x, y = D.sketch(a), D.sketch(b)
        w = min(len(x), len(y))
        assert np.bitwise_count(D.folded(x, w) ^ D.folded(y, w)).sum() <= len(np.setxor1d(a, b))
        similar = len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
        assert not similar or D.may_match(len(a), x, np.array([len(b)]), y[None], 0.8)[0] >= 0


def test_shared_rows_over_batches():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sh = np.sort(rng.integers(0, 12, int(rng.integers(0, 25))))
        cuts = np.sort(rng.integers(0, len(sh) + 1, 4))
        batches = [D.pa.RecordBatch.from_arrays([D.pa.array(x), D.pa.array(x)], ["sh", "sid"]) for x in np.split(sh, cuts)]
        got = [v for b in D._shared(iter(batches)) for v in b.column(0).to_pylist()]
        values, n = np.unique(sh, return_counts=True)
        assert got == [v for v in sh.tolist() if n[values.tolist().index(v)] > 1]
