"""Spelling variants by plain Python, and the neighbourhoods themselves."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kinetable.llm import spelling as S
from kinetable.llm.queries import op13_spelling_variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def plain_words(docs):
    total = Counter()
    for i, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 199 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            total[r] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def order(rows):
    return sorted((tuple(r) for r in rows), key=str)


def vocabulary(seed, n=160):
    rng = random.Random(seed)
    letters = "abcé"
    words = {"".join(rng.choices(letters, k=rng.randint(6, 8))): rng.choice([5, 6, 25, 30, 150, 4000]) for _ in range(n)}
    for w in list(words)[:40]:
        i = rng.randrange(len(w))
        words.setdefault(w[:i] + rng.choice(letters) + w[i + 1 :], 5)
        words.setdefault(w[:i] + rng.choice(letters) + w[i:], 27)
    words |= {"aaaaaa" + "a" * k: 5 ** (k + 1) for k in range(6)}  # a chain of forms
    words |= {"x" * 5000: 5, "x" * 2500 + "y" + "x" * 2499: 40, "x" * 5001: 7}
    words |= {"abcdefgh" + c: 9 for c in "ijklm"}  # ties
    words |= {"abcdefghz": 45, "abcdefghy": 45}
    return words


@pytest.mark.parametrize("symbols, crowd", [(None, 64), (4, 1), (1, 3), (2, 1000), (30, 64)])
def test_variants_by_brute_force(spark, monkeypatch, symbols, crowd):
    monkeypatch.setattr(S, "CLASS_WORDS", crowd)
    monkeypatch.setattr(S, "MADE", 5_000)
    words = vocabulary(symbols or 0)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert order(S.variants(df, symbols=symbols).collect()) == order(plain_variants(words))


def test_neighbourhood_is_whole_and_without_repeats():
    rng = random.Random(2)
    for _ in range(60):
        k = rng.randint(1, 4)
        word = [rng.randrange(k) for _ in range(rng.randint(1, 6))]
        own = {tuple(word)}
        for i in range(len(word) + 1):
            own |= {(*word[:i], s, *word[i:]) for s in range(k)}
        for i in range(len(word)):
            own |= {(*word[:i], s, *word[i + 1 :]) for s in range(k)} | {(*word[:i], *word[i + 1 :])}
        value = S._value(np.arange(k))
        keys, keep = S.neighbourhood(value[np.array([word])], value)
        got = keys[keep].tolist()
        assert sorted(got) == sorted(int(S.number(value[np.array([w], int).reshape(1, -1)])[0]) for w in own)


def test_query_on_awkward_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "COUNTED", 20)
    rng = random.Random(8)
    pool = ["lettre", "lettres", "lettré", "Straße", "strase", "wording", "wordinG", "WÖRDING", "zimmer", "zimner", "short", "d'accord", "naïveté", "abcdefg×hij"]
    docs = [(i, " ".join(rng.choices(pool, weights=range(1, 15), k=rng.randint(0, 30))) + rng.choice(["", "\n", "1x", "_"])) for i in range(250)]
    docs += [(None, "lettre zimmer " * 3), (7, docs[7][1]), (7, docs[7][1]), (900, None), (901, ""), (902, "  . "), (903, "wording " * 30_000), (904, "q" * 40_000)]
    spark.createDataFrame([(*d, "a", 3, 4) for d in docs], "doc_id long, text string, word string, n int, key int").write.parquet(f"{tmp_path}/documents.parquet")
    words = plain_words(docs)
    assert 8 <= len(words) and any(len(w) == 6 and "lettre"[:3] in w for w in words)
    got = op13_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {t for c, t in got.dtypes if c in ("n", "n_near", "form_n")} == {"bigint"}
    assert order(got.collect()) == order(plain_variants(words))


def test_empty_and_ratio(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.spelling_variants(docs).collect() == []
    assert S.spelling_variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError, match="ratio"):
        S.variants(spark.createDataFrame([], "word string, n long"), ratio=1)
