import random

import numpy as np
import pytest

from kinetable.llm import language_id as L
from kinetable.llm.common import held_out

SYLLABLES = {"xx": ["ka", "to", "mi", "ru", "ne"], "yy": ["sch", "ung", "bei", "ver", "lich"], "zz": ["ção", "que", "nha", "dor", "ão"]}


def corpus(n=300, seed=0):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = sorted(SYLLABLES)[0 if k % 4 < 2 else k % 4 - 1]
        rows.append((k, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), lang))
    return rows


def test_held_out_accuracy(spark):
    df = spark.createDataFrame([(*r, 1) for r in corpus()] + [(900, None, "xx", 1), (901, "ka to", None, 1)], "doc_id long, text string, lang string, score int")
    model = L.train(df, keep=~held_out("doc_id"))
    assert model.languages == ["xx", "yy", "zz"] and (model.weights == 0).mean() > 0.9
    got = L.predict(df, model).collect()
    right = {r[0]: r[2] for r in corpus()}
    assert len(got) == 302 and sum(r.lang_pred != right[r.doc_id] for r in got if r.doc_id < 900) == 0
    assert all(0 <= r.score <= 1 for r in got)


def test_document_frequencies_cover_all_rows(spark):
    rows = corpus(40)
    got = {r.bucket: r.df for r in L.document_frequencies(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)).collect()}
    want = sum((L.counts(t) > 0).astype(int) for _, t, _ in rows)
    assert got.pop(-1) == 40
    assert got == {int(b): int(want[b]) for b in np.flatnonzero(want)}


@pytest.mark.parametrize("text", ["a", "ab", "abc", "äbc déf", "x" * 50, "été 123 ÉTÉ"])
def test_stretches_do_not_change_counts(text, monkeypatch):
    whole = L.counts(text)
    n = len(text.lower())
    assert whole.sum() == n + max(0, n - 1) + max(0, n - 2)
    for stretch in (1, 2, 3, 7):
        monkeypatch.setattr(L, "STRETCH", stretch)
        assert np.array_equal(L.counts(text), whole)


def test_defined_results_at_the_edges(spark):
    df = spark.createDataFrame(corpus(60), "doc_id long, text string, lang string")
    model = L.train(df)
    rows = [(1, None), (2, ""), (3, "123 !? _"), (None, "ka to mi"), (4, "ka to mi"), (4, "ka to mi"), (5, "ka to " * 50_000)]
    got = sorted((repr(r.doc_id), r.lang_pred, r.score) for r in L.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect())
    assert [g[:2] for g in got] == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "xx"), ("4", "xx"), ("5", "xx"), ("None", "xx")]
    assert all(g[2] == 0 for g in got[:3]) and got[3] == got[4]
    assert L.predict(df.limit(0), model).collect() == []
    none = L.train(df.limit(0))
    assert {r.lang_pred for r in L.predict(df, none).collect()} == {"und"}
    one = L.train(df.filter("lang = 'xx'"))
    assert {(r.lang_pred, r.score) for r in L.predict(df, one).collect()} == {("xx", 1.0)}
