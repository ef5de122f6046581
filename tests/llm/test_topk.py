"""Dual-tree search against brute force."""

import math
import random

import numpy as np

from ledgerspan.llm import topk as T


def brute(rows, k):
    good = sorted({(i, tuple(math.floor(float(x) * 256) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = {}
    for i, v in good:
        if i % 50 == 0:
            own = [(-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v)]
            out[i] = out.get(i, []) + own
    return {(i, r + 1, j, -s) for i, own in out.items() for r, (s, j) in enumerate(sorted(own)[:k])}


def test_trees_prune_and_agree():
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(40, 8)) * 400
    data = np.floor(np.concatenate([c + rng.normal(size=(100, 8)) * 5 for c in centers]))
    tree = T.build(data)
    assert sorted(tree.order.tolist()) == list(range(len(data)))
    for c, r, a, b in zip(tree.center, tree.radius, tree.start, tree.end):
        assert (np.sqrt(((data[tree.order[a:b]] - data[c]) ** 2).sum(1)) <= r + 1e-9).all()
    ids = np.arange(len(data))
    best = T.search(ids[::50], data[::50], ids, data, 5)
    scores = data[::50] @ data.T
    scores[np.arange(len(data[::50])), ids[::50]] = -np.inf
    want = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :5]
    assert (best.ids == want).all()


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "DATA_BLOCK", 90)
    monkeypatch.setattr(T, "QUERY_BLOCK", 3)
    rng = random.Random(2)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(3)]) for i in range(400)]
    rows += [(i, rows[i - 1000][1]) for i in range(1000, 1100)]  # ties
    rows += [(50, rows[50][1]), (2000, None), (2001, [1.0, None, 2.0]), (2050, [float("nan")] * 3), (2100, [float("inf")] * 3), (2150, [0.5, 0.25]), (2151, [1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (2200, []), (2201, []), (2250, [1e9, 1e9, 1e9, 1e9]), (2251, [1e9, 1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, v int")
    vectors = T.quantized(df)
    got = [tuple(r) for r in T.top_k(vectors.filter("vec_id % 50 = 0"), vectors, 5).collect()]
    want = brute(rows, 5)
    want = {(a, b, c, min(s, (1 << 63) - 1)) for a, b, c, s in want}
    assert len(got) == len(set(got)) and set(got) == want
    assert T.top_k(vectors.limit(0), vectors, 5).collect() == []
