import random

import numpy as np
import pytest

from kinetable.llm import toxicity as X


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    plain = {"en": [f"en{i}" for i in range(300)] + X.FUNCTION_WORDS["en"], "de": [f"de{i}" for i in range(300)] + X.FUNCTION_WORDS["de"]}
    bad = {"en": ["grubby", "vile"], "de": ["mistkerl", "mistding", "mistzeug"]}
    texts, y = [], []
    for k in range(n):
        lang = "en" if k % 3 else "de"
        words = rng.choices(plain[lang], k=rng.randint(5, 80))
        y.append(int(k % 5 == 0))
        if y[-1]:
            words[rng.randrange(len(words))] = rng.choice(bad[lang])
        texts.append(" ".join(words))
    return texts, y


def cells_of(model, rows):
    """(language, label, score, 1) of every (text, label)."""
    reader = X.Reader(model)
    read = [reader.read(t) for t, _ in rows]
    return [(d[2], y, float(s), 1.0) for d, (_, y), s in zip(read, rows, X._logits(model, [d[:2] for d in read]), strict=True)]


def fitted():
    model = X.fit(*corpus())
    model.thresholds = X.thresholds_of(cells_of(model, list(zip(*corpus(200, seed=9), strict=True))))
    return model


def test_unseen_texts_are_told_apart(spark):
    model = fitted()
    texts, y = corpus(300, seed=1)
    got = X.score(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int"), model).collect()
    assert len(got) == 300
    wrong = sum(r.predicted != y[r.doc_id] for r in got)
    assert wrong <= 6
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    df = spark.createDataFrame([(i, t, "u") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    left = X.drop_toxic(df, model)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in got if not r.predicted}


def test_long_texts_are_read_to_the_end(monkeypatch):
    model = fitted()
    text = "en1 the " * 400 + "vile"
    reader = X.Reader(model)
    whole = X._scores(model, reader, [text])[0]
    monkeypatch.setattr(X, "STRETCH", 7)
    assert X._scores(model, X.Reader(model), [text])[0] == pytest.approx(whole)
    assert whole[0] > 0.5 > X._scores(model, reader, ["en1 the " * 400])[0][0]


def test_null_empty_and_repeated(spark):
    model = fitted()
    rows = [(1, None), (2, ""), (3, "?!"), (None, "en1 the"), (4, "en1 the"), (4, "en1 the")]
    got = {(r.doc_id, r.score) for r in X.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    by = {}
    for i, s in got:
        by.setdefault(i, set()).add(s)
    assert by[1] == by[2] == by[3]
    assert by[None] == by[4] and len(by[4]) == 1
    assert X.score(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


@pytest.mark.parametrize("y", [[], [0, 0, 0], [1, 1]])
def test_one_class_alone(y):
    model = X.fit(["a b"] * len(y), y)
    s = X._scores(model, X.Reader(model), ["a", None])[0]
    assert all(s > 0.5) if 1 in y else all(s < 0.5)


def test_training_rows_are_bounded_and_unique(spark):
    docs = spark.createDataFrame([(i, f"text {i % 500}") for i in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 10 == 0) for i in range(1000)] + [(3, None), (None, True)], "doc_id long, t boolean").selectExpr("doc_id", "int(t) as toxic")
    rows = X.training_rows(docs, labels, max_docs=200)
    assert len({t for t, _ in rows}) == len(rows) and 80 < len(rows) < 260
    assert np.mean([y for _, y in rows]) > 0.3


def best_by_enumeration(scores, y, weight):
    """Every cut between two scores, and below the last; of those with the best F1 the one in the widest gap, the highest of several."""
    values = sorted(set(scores), reverse=True)
    best = None
    for k, v in enumerate(values):
        taken = [(b, w) for s, b, w in zip(scores, y, weight, strict=True) if s >= v]
        hit = sum(w for b, w in taken if b)
        f1 = 2 * hit / (sum(w for _, w in taken) + sum(w for b, w in zip(y, weight, strict=True) if b))
        gap = v - values[k + 1] if k + 1 < len(values) else 1.0
        at = (v + values[k + 1]) / 2 if k + 1 < len(values) else v - 0.5
        if best is None or f1 > best[0] + 1e-12 or abs(f1 - best[0]) <= 1e-12 and gap > best[1]:
            best = max(f1, best[0]) if best and abs(f1 - best[0]) <= 1e-12 else f1, gap, at
    return best[2]


def test_thresholds_by_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(100):
        n = int(rng.integers(2, 30))
        scores, y, w = rng.integers(0, 12, n) / 2, rng.integers(0, 2, n), rng.integers(1, 5, n)
        if 0 < y.sum() < n:
            assert X.best_weighted(scores, y, w) == pytest.approx(best_by_enumeration(scores, y, w))
    assert X.best_weighted(np.array([1.0, 2.0]), np.array([1, 1]), np.ones(2)) == X.best_weighted(np.zeros(0), np.zeros(0, int), np.zeros(0)) == 0.0
    cells = [("en", 1, 3.0, 4.0), ("en", 0, 1.0, 9.0), ("de", 0, 5.0, 2.0)]
    got = X.thresholds_of(cells)
    assert set(got) == {"", *X.FUNCTION_WORDS}
    for lang, rarer in (("en", 4.0), ("de", 0.0), ("fr", 0.0)):
        own = [c for c in cells if c[0] == lang] + [(*c[:3], c[3] * 5 / (5 + rarer)) for c in cells]
        assert got[lang] == pytest.approx(best_by_enumeration([c[2] for c in own], [c[1] for c in own], [c[3] for c in own]))


def test_forward_pass_by_loops():
    """Every window of every width is looked at on its own."""
    model = fitted()
    words = {int(h): k + 1 for k, h in enumerate(model.words)}
    prefixes = {int(h): k + 1 for k, h in enumerate(model.prefixes)}
    for text in [*corpus(12, seed=4)[0], "", "vile", "unknown words only", "en1 vile"]:
        own = X._WORD.findall(text.lower())
        x = [model.word_vec[words.get(X.word_hash(w), 0)] + model.prefix_vec[prefixes.get(X.prefix_hash(w), 0)] for w in own]
        x += [np.zeros(X.DIM, np.float32)] * max(X.WIDTHS)
        logit = model.shift
        for k, (width, f) in enumerate(zip(X.WIDTHS, model.filters, strict=True)):
            for c in range(X.FILTERS):
                most = max(sum(float(x[at + j] @ f[j][:, c]) for j in range(width) if at + j < len(x)) for at in range(len(x)))
                logit += max(0.0, most + float(model.bias[k * X.FILTERS + c])) * float(model.out[k * X.FILTERS + c])
        got = X._logits(model, [X.Reader(model).read(text)[:2]])[0]
        assert got == pytest.approx(logit, abs=1e-3)


@pytest.mark.parametrize("toxic", [150, 20, 5])
def test_few_toxic_rows_still_set_thresholds(spark, toxic):
    """One rule at every size: all languages have a threshold, and it does not depend on how many rows the fit sees."""
    rng = random.Random(toxic)
    rows = []
    for i in range(3000):
        words = rng.choices([f"en{j}" for j in range(60)], k=8) + ["the", "of"]
        rows.append((i, " ".join(words + ["vile"] * (i < toxic)), int(i < toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4).cache()
    calls = []
    for most in (400, 100_000):
        model = X.train(df, df.select("doc_id", "toxic"), max_docs=most)
        assert set(model.thresholds) == {"", *X.FUNCTION_WORDS}
        got = X.score(df, model).filter("predicted = 1").collect()
        calls.append({r.doc_id for r in got if r.doc_id >= toxic})
    if toxic >= 20:
        assert not calls[0] and not calls[1]
    fold = df.select("doc_id", X._for_cuts(df["doc_id"].cast("long")).alias("cut")).filter("cut").count()
    assert 450 < fold < 750


def test_cut_rows_are_not_fitted(spark):
    rows = [(i, f"t{i}", i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    cut = {r.doc_id for r in df.filter(X._for_cuts(df["doc_id"])).collect()}
    fit_on = {int(t[1:]) for t, _ in X.training_rows(df, df.select("doc_id", "toxic"))}
    assert cut and not cut & fit_on and cut | fit_on == set(range(400))
    cells = X.score_counts(df, X._labelled(df, "doc_id", "toxic", None), X.fit(["a"], [0]))
    assert sum(c[3] for c in cells) == len(cut)


def overlapping(n, share, seed):
    """Each text has one doubtful word; how often such a text is toxic goes with the word."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < share)
        k = min(9, max(0, round(rng.gauss(6 if y else 3, 1.5))))
        rows.append((i, " ".join([*rng.choices([f"en{j}" for j in range(60)], k=8), "the", "of", f"q{k}x"]), y))
    return rows


def test_a_bounded_sample_does_not_shift_the_thresholds(spark):
    """With one toxic row in ten the cut of a balanced sample calls far too many rows toxic."""
    rows = overlapping(12000, 0.1, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4).cache()
    model = X.train(df, df.select("doc_id", "toxic"), max_docs=1600)
    fresh = overlapping(6000, 0.1, 6)
    docs = [X.Reader(model).read(t) for _, t, _ in fresh]
    logits = X._logits(model, [d[:2] for d in docs])
    y = np.array([v for *_, v in fresh])

    def f1(cut):
        p = logits >= cut
        return 2 * (p & (y == 1)).sum() / (p.sum() + (y == 1).sum())

    best = max(f1(c) for c in np.quantile(logits, np.linspace(0.5, 0.999, 300)))
    assert f1(model.thresholds["en"]) >= best - 0.03
    assert ((logits >= model.thresholds["en"]).mean()) < 0.15
