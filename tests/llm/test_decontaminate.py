import random
import re
from collections import Counter

import numpy as np
import pytest

from kinetable.llm import decontaminate as D


def plain(text, item, size=5):
    """The best similarity of any window, by comparing all of them."""
    a, b = (re.findall(r"\w+", (x or "").lower()) for x in (text, item))
    if not a or not b:
        return 0.0
    cut = lambda w: Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))
    n, want = min(len(b), len(a)), cut(b)
    best = 0.0
    for s in range(len(a) - n + 1):
        got = cut(a[s : s + n])
        both = sum((got & want).values())
        best = max(best, both / (sum(got.values()) + sum(want.values()) - both))
    return best


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 15, 30, 50]))) for _ in range(25)] + ["", None, "one"]
    docs = [None, "", "...", "one"]
    for k in range(300):
        t = rng.choices(vocabulary, k=rng.randint(0, 120))
        if k % 2:
            p = (items[k % 25]).split()
            for _ in range(k % 10 // 4):
                p[rng.randrange(len(p))] = rng.choice(vocabulary)
            if k % 3 == 0:
                p = [x.upper() + "," for x in p]
            at = rng.randint(0, len(t))
            t[at:at] = p
        docs.append(" ".join(t))
    docs += [items[4], items[4][: len(items[4]) * 9 // 10]]
    return docs, items


def test_pairs_by_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(i if i != 9 else None, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(items)], "item_id string, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.contaminated(d, b).collect()}
    want = {(i if i != 9 else None, f"i{j}"): s for i, t in enumerate(docs) for j, x in enumerate(items) if (s := plain(t, x)) >= 0.8}
    assert got == pytest.approx(want)
    assert len(want) > 40
    left = D.drop_contaminated(d, b)
    assert left.columns == d.columns
    hit = {i for i, _ in want}
    assert sorted(repr(tuple(r)) for r in left.collect()) == sorted(repr(tuple(r)) for r in d.collect() if r.doc_id not in hit)


def test_many_passes_give_the_same(spark):
    docs, items = corpus()
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    one = sorted(map(tuple, D.contaminated(d, b).collect()))
    parts = [matched for p in D.item_passes(b, "item_id", "text", 5, pass_words=50) for i, t in enumerate(docs) for matched in [(i, p.ids[m[0]], *m[1:]) for m in D.matches(t, p, 5, 0.8)]]
    assert sorted(parts) == one


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(0)
    items = D.prepare([(i, " ".join(map(str, rng.integers(0, 99, 12)))) for i in range(50)], 5)
    index = items.sized[12]
    prints = index.prints.copy()
    for k in range(len(prints)):
        for b in rng.choice(64, k % 30, replace=False):
            prints[k] ^= np.uint64(1) << np.uint64(b)
    got = sorted(zip(*(x.tolist() for x in D._candidates(prints, index)), strict=True))
    d = np.bitwise_count(prints[:, None] ^ index.prints[None, :])
    assert got == sorted((int(w), int(i), int(d[w, i])) for w, i in np.argwhere(d <= D.RADIUS))


@pytest.mark.parametrize("width", [1, 2, 7, 40])
def test_prints_of_windows_equal_those_of_plain_counts(width):
    rng = np.random.default_rng(2)
    for kinds in (3, 12, 5000):
        sh = D.shingles(rng.integers(0, kinds, 300).astype(np.uint64), 1)
        for starts in (np.arange(300 - width + 1), np.sort(rng.choice(300 - width + 1, 40, replace=False))):
            want = []
            for a in starts:
                sums, seen = np.zeros(64, np.int64), Counter()
                for x in sh[a : a + width]:
                    seen[x] += 1
                    sums += D._signs(D._numbered(np.array([x]), np.array([seen[x]])))[0]
                want.append(D._bits(sums[None])[0])
            assert D._window_prints(sh, starts, width).tolist() == want


def test_repeated_shingles_do_not_leave_the_radius():
    missed = far = 0
    for k in range(300):
        item = [f"a{k}x{i}" for i in range(104)]
        # 93 words of the item, then one filler over and over: weighted similarity is just above 0.8.
        text = " ".join([*item[:93], *["filler"] * 11])
        assert plain(text, " ".join(item)) >= 0.8
        got = D.matches(text, D.prepare([(k, " ".join(item))], 5), 5, 0.8)
        missed += not got
        far += bool(got) and got[0][4] > 20
    assert missed == 0 and far < 30


def test_a_text_longer_than_one_chunk_of_windows():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(8)]
    item = rng.choices(vocabulary, k=12)
    words = rng.choices(vocabulary, k=3 * D.CHUNK)
    words[2 * D.CHUNK + 5 : 2 * D.CHUNK + 5] = item
    words[40:40] = [*item[:11], "other"]
    # Shingles of one word over few words: nearly every window needs a fingerprint.
    got = D.matches(" ".join(words), D.prepare([(1, " ".join(item))], 1), 1, 0.8)
    sims = [sum((Counter(words[a : a + 12]) & Counter(item)).values()) for a in range(len(words) - 11)]
    best = max(sims)
    assert [(i, a, n) for i, a, n, *_ in got] == [(0, sims.index(best), 12)] and got[0][3] == best / (24 - best)


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.contaminated(d.limit(0), b).collect() == []
    assert D.contaminated(d, b.limit(0)).collect() == []
    assert D.drop_contaminated(d, b.limit(0)).count() == 1
