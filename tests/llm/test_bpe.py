"""Encoding against the tokenizers library and against the plain rule; decoding as a round trip."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from kinetable.llm import bpe
from kinetable.llm.queries import op12_bpe_round_trip, tokenizer_path


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(tokenizer_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def plain_merge(coder, rank, word):
    """Of the pairs of one word the one of lowest rank is merged, from the left, until none has a rank."""
    s = [int(coder.byte_id[x]) for x in word]
    while True:
        found = min(((rank[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in rank), default=None)
        if found is None:
            return s
        i = found[1]
        s[i : i + 2] = [rank[s[i], s[i + 1]][1]]


def test_merges_by_the_plain_rule(coder):
    rng = random.Random(3)
    words = [bytes(rng.choices(b"aabbtthhe  \xc3\xa9", k=rng.randint(1, 14))) for _ in range(300)] + [b"a" * n for n in range(1, 20)] + [b""]
    rank = {(int(a), int(b)): (k, int(c)) for k, (a, b, c) in enumerate(zip(coder.left, coder.right, coder.made, strict=True))}
    assert [ids(x) for x in coder.merge(words)] == [plain_merge(coder, rank, w) for w in words]
    assert coder.merge([]) == []


def test_every_code_point_is_cut_as_in_the_library(coder, library):
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000] + list(range(0x1F300, 0x1F400)) + [0xFEFF, 0xFFFD, 0x10FFFF]
    texts = [f"a{chr(c)}b {chr(c)}.{chr(c)} {chr(c)}{chr(c)}7  x{chr(c)}" for c in points]
    assert [ids(x) for x in coder.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_random_texts_and_added_tokens(coder, library):
    rng = random.Random(5)
    letters = [*"aaabbc  \n\n\t'sdrm1.,!é中", "<|endoftext|>", "<|endof", "   ", "'ll", chr(0x3000)]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    got = coder.encode(texts)
    assert [ids(x) for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [coder.decode(x) for x in got] == texts


def test_decode_of_any_ids(coder, library):
    rng = random.Random(6)
    for _ in range(300):
        own = [rng.randrange(50257) for _ in range(rng.randint(0, 8))]
        assert coder.decode(np.array(own, "<u4").tobytes()) == library.decode(own, skip_special_tokens=False)
    assert coder.decode(np.array([4_000_000_000], "<u4").tobytes()) == ""


def test_forgotten_words_and_long_texts(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    long = " ".join(f"word{i}" for i in range(60_000)) + "z" * 50_000
    for texts in (["one two three"], [long], ["four five"], [" ".join("abcdefghijklmnop")]):
        assert [ids(x) for x in coder.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_query_on_awkward_rows(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "READ_CHARS", 50)
    monkeypatch.setattr(bpe, "OUT_ROWS", 2)
    rows = [(1, "Some text, and some more."), (1, "Some text, and some more."), (2, None), (3, ""), (None, "no id\n\n x"), (4, "x <|endoftext|> y"), (5, "long " * 200)]
    spark.createDataFrame([(*r, "a", 7, "b") for r in rows], "doc_id long, text string, ids string, n_tokens int, decoded string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_bpe_round_trip(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        own = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_encode_then_decode_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "ä b"), (2, None)], "doc_id long, text string")
    coded = bpe.encode(df, tokenizer_path())
    assert coded.columns == ["doc_id", "n_tokens", "ids"]
    back = bpe.decode(coded.union(spark.createDataFrame([(3, 0, None)], "doc_id long, n_tokens long, ids binary")), tokenizer_path())
    assert sorted(back.collect()) == [(1, "ä b"), (2, ""), (3, None)]
    assert bpe.encode(df.limit(0), tokenizer_path(), with_text=True).collect() == [] and bpe.decode(coded.limit(0), tokenizer_path()).collect() == []


def test_other_files_are_refused(tmp_path):
    (tmp_path / "f.json").write_text('{"model": {"type": "Unigram", "vocab": {}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel"}}')
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Bpe(str(tmp_path / "f.json"))
