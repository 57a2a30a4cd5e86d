import math

import numpy as np
import pytest

from kinetable.llm import pq_dedup as Q

SCHEMA = "vec_id long, embedding array<float>, label int, v string, rid long"


def plain(rows, least=0.98):
    good = [k for k, (_, v, c, *_) in enumerate(rows) if c is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: [] for k in range(len(rows))}
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.float32(rows[a][1]).astype(float), np.float32(rows[b][1]).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    links[a].append(b)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        low = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((rows[k][0], len(links[k]), low, rows[k][0] == low))
    return sorted(map(repr, out))


def corpus(n=260, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = rng.normal(size=dim)
        if k % 3 == 0 and rows:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=dim) * rng.choice([0, 0.05, 0.12, 0.2])
            v *= rng.choice([1, 1, 3.5])
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(k % 2), "x", 1))
    base = rng.normal(size=dim)
    rows += [(1000 + k, [float(x) for x in (base + rng.normal(size=dim) * 0.03).astype(np.float32)], 1, "x", 1) for k in range(60)]
    rows += [(2000 + k, rows[7][1], 1, "x", 1) for k in range(25)] + [rows[3], rows[3]]
    nan, inf = float("nan"), float("inf")
    rows += [(3000, None, 0, "x", 1), (3001, rows[0][1], None, "x", 1), (3002, [0.0] * dim, 0, "x", 1), (3003, [nan] + rows[0][1][1:], 0, "x", 1), (3004, [inf] + rows[0][1][1:], 0, "x", 1)]
    rows += [(3005, [None] + rows[0][1][1:], 0, "x", 1), (3006, [], 0, "x", 1), (None, rows[0][1], 0, "x", 1), (None, [-x for x in rows[0][1]], 0, "x", 1), (3007, rows[0][1] + [0.0], 0, "x", 1), (3008, rows[0][1][:3], 0, "x", 1)]
    return rows


@pytest.mark.parametrize("group, lists", [(1024, 1024), (16, 20)])
def test_all_links_by_brute_force(spark, monkeypatch, group, lists):
    monkeypatch.setattr(Q, "GROUP_ROWS", group)
    monkeypatch.setattr(Q, "LIST_ROWS", lists)
    rows = corpus()
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in Q.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(repr, got)) == plain(rows)


def test_probes_reach_every_near_vector():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = Q.fit(x[:300], 20)
    _, own = q.nearest(x)
    codes, error = q.encode(x, own)
    reach = 0.6
    asked = set(zip(*(v.tolist() for v in q.probes(x, reach)), strict=True))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    i, j = np.nonzero(d <= reach)
    assert all((a, own[b]) in asked for a, b in zip(i.tolist(), j.tolist(), strict=True))
    for k in range(20):
        at = np.flatnonzero(own == k)
        assert np.all(np.abs(q.distances(x, k, codes[at]) - d[:, at]) <= error[at] + 1e-6)


@pytest.mark.parametrize("rows", [[], [(1, None, 0, "x", 1)], [(5, [1.0], 0, "x", 1)], [(5, [1.0], 0, "x", 1), (4, [2.0], 0, "x", 1), (3, [-1.0], 0, "x", 1)]])
def test_small_tables(spark, rows):
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in Q.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(repr, got)) == plain(rows)
