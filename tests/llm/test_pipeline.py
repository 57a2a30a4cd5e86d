"""The pipeline against plain Python, on a corpus with every awkward row."""

import random

import corpus_pipeline as C
import pytest
from tokenizers import Tokenizer

from kinetable.llm import toxicity
from kinetable.llm.common import held_out
from kinetable.llm.queries import tokenizer_path
from tests.llm.test_decontaminate import plain as item_similarity
from tests.llm.test_shingle_dedup import plain_set
from tests.llm.test_simhash_dedup import plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, row int, component_id double, score string"


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)] + toxicity.FUNCTION_WORDS["en"]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    common = [line(15), line(20).upper()]
    items = [line(30) for _ in range(4)] + ["", None]
    docs, labels = [], []
    for i in range(260):
        lines = [line(rng.randint(1, 40)) for _ in range(rng.randint(1, 6))]
        toxic = i % 9 == 0
        if toxic:
            lines[0] += " vile grubby"
        if i % 4 == 0:
            lines.insert(0, f" {rng.choice(common)}\t")
        if i % 25 == 3:
            lines.append(items[i % 4].upper().replace(" ", ", "))
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(toxic)))
    docs += [(1000 + i, docs[i][1]) for i in range(40)] + [(2000 + i, docs[i][1] + " zz") for i in range(40, 60)]
    docs += [(3000, None), (3001, ""), (3002, " \n "), (3003, line(30_000)), (None, line(9)), (5, docs[5][1]), (5, docs[5][1])]
    labels += [(None, 1), (7, None), (8, 0)]
    return docs, labels, items


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs, labels, items = corpus()
    rows = [(i, t, "en" if i != 9 else None, None if i == 10 else "s", len(t or ""), 1, "x", 2, 0.5, "y") for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def drop_lines(docs):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for n, (i, t) in enumerate(docs):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders.setdefault(k, []).append(i)
    keeper = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if key(x) not in keeper or keeper[key(x)] == i)) for i, t in docs]


def one_of_each(docs):
    """One document of each class that 5-word Jaccard similarities of 0.8 link."""
    sets = [plain_set(t) for _, t in docs]
    fps = [plain_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if root[i] != root[j] and (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    best = {}
    for k, r in enumerate(root):
        rank = (docs[k][0] is None, docs[k][0] or 0, fps[k])
        if r not in best or rank < best[r][0]:
            best[r] = rank, docs[k]
    return [v for _, v in best.values()]


def test_run_by_plain_python(spark, sf):
    docs, labels, items = corpus()
    table = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    model = toxicity.train(table("documents"), table("labels"), keep=lambda c: ~held_out(c))
    kept = [(i, t) for (i, t), s in zip(docs, toxicity._scores(model, toxicity.Reader(model), [t for _, t in docs])[0], strict=True) if s < 0.5]
    assert 20 < len(docs) - len(kept) < 50
    kept = one_of_each(drop_lines(kept))
    kept = [(i, t) for i, t in kept if not any(item_similarity(t, x) >= 0.8 for x in items)]
    tok = Tokenizer.from_file(tokenizer_path())
    sizes = {}
    for i, t in kept:
        sizes[i] = sizes.get(i, 0) + len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    got = C.run(spark, sf).collect()
    mine = {}
    for r in got:
        mine[r.doc_id] = mine.get(r.doc_id, 0) + r.length
    assert mine == sizes
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in fill.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:])) and min(v)[0] == 0 and sum(n for _, n in v) <= 1024


@pytest.mark.parametrize("name, step", C.STAGES)
def test_stages_keep_columns_and_take_empty_tables(spark, sf, name, step):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = step(spark, docs, sf)
    if name != C.STAGES[-1][0]:
        assert out.schema == docs.schema or [f.simpleString() for f in out.schema] == [f.simpleString() for f in docs.schema]
        assert out.count() <= docs.count()
    assert step(spark, docs.limit(0), sf).collect() == []
