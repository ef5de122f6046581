"""Segments against brute force; held-out accuracy on planted words; defined cases."""

import itertools
import math
import os
import random
import zlib

import pytest

from ledgerspan.llm import toxicity as T


def test_segments_match_definition():
    """Maximal segments: found by taking the best-scoring segment again and again, left and right of the last."""

    def plain(values, lo, hi):
        best = None
        for a in range(lo, hi):
            for b in range(a, hi):
                s = sum(values[a : b + 1])
                if s > 1e-12 and (best is None or s > best[2] + 1e-9 or (abs(s - best[2]) <= 1e-9 and b - a < best[1] - best[0])):
                    best = (a, b, s)
        return [] if best is None else plain(values, lo, best[0]) + [best] + plain(values, best[1] + 1, hi)

    rng = random.Random(0)
    for _ in range(200):
        values = [rng.choice([0, 0, 0, 0, 1.3, 2.71]) for _ in range(rng.randint(0, 22))]
        hits = [i for i, v in enumerate(values) if v]
        got = T.segments(hits, [values[i] for i in hits], -0.77)
        want = plain([v or -0.77 for v in values], 0, len(values))
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in want]


def test_slope_and_pooling():
    x = T.solve_slope([-0.05, 3.0], [0.999, 0.001])
    assert abs(0.999 * math.exp(-0.05 * x) + 0.001 * math.exp(3 * x) - 1) < 1e-6 and x > 0.1
    shares = T.pooled([0, 5, 1, 9], [10, 10, 10, 10])
    assert shares == sorted(shares) and abs(shares[1] - shares[2]) < 1e-9


def corpus(n=1600):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(600)]
    bad = ["grrk", "blarg", "zonk", "vuxis", "vuxor", "vuxam"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(20, 150))
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randint(2, 5) * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(bad).capitalize())
        docs.append((i, " ".join(words), f"s{i % 3}", "c"))
        if i % 3:
            labels.append((i, toxic))
    return docs, labels, {i: t for i, t in labels}


def test_held_out_accuracy_and_cases(spark):
    docs, labels, truth = corpus()
    extra = [(9001, None, "s", "c"), (9002, "", "s", "c"), (None, "Grrk zonk grrk blarg", "s", "c"), (9003, "word " * 30_000, "s", "c"), (9003, "word", "s", "c")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, source string, toxic string")
    lab = spark.createDataFrame([(i, t, 1) for i, t in labels] + [(1, None, 1), (None, None, 1)], "doc_id long, toxic int, text int")
    got = T.score_documents(df, lab).collect()
    assert len(got) == len(docs) + len(extra)
    wrong = seen = 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2)
        if r.held_out and r.doc_id in truth:
            seen += 1
            wrong += r.predicted != truth[r.doc_id]
    assert seen > 150 and wrong <= seen * 0.03
    assert {r.predicted for r in got if r.doc_id in (9001, 9002, 9003)} == {0}
    kept = T.drop_toxic(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_held_out_labels_are_not_used(spark):
    docs, labels, _ = corpus(500)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, toxic string")
    flip = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    a, b = (sorted(map(str, T.score_documents(df, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, flip))
    assert a == b


def test_no_labels_or_documents(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in T.score_documents(df, none).collect()] == [0]
    assert T.score_documents(df.limit(0), none).collect() == []


def test_terms_without_clean_occurrence_count():
    """Sure evidence (15 toxic, 0 clean) is above weaker evidence (8, 8); few documents are not enough."""
    assert T.signed_root(15, 36, 0, 260) > T.signed_root(8, 36, 8, 260) > T.signed_root(1, 36, 0, 260) > 0 > T.signed_root(1, 36, 60, 260)


@pytest.mark.parametrize(("sf", "least"), [("sf0.001", 1), ("sf0.01", 9)])
def test_held_out_recall_on_small_tables(spark, sf, least):
    """The held-out toxic documents with an insult in them (1 and 9; the other 1 and 5 hold none) are found, no clean one is."""
    root = f"/root/testdata/{sf}"
    if not os.path.isdir(root):
        pytest.skip("no test data")
    labels = spark.read.parquet(f"{root}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in T.score_documents(spark.read.parquet(f"{root}/documents.parquet"), labels).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted for r in got if truth[r.doc_id] == 1) >= least
    assert not any(r.predicted for r in got if truth[r.doc_id] == 0)


def test_rows_without_or_with_equal_doc_id_are_decided_apart(spark):
    docs, labels, _ = corpus(600)
    bad = "Grrk zonk grrk blarg"
    extra = [(None, bad), (None, "clean one"), (None, "clean two"), (None, None), (9001, bad), (9001, "clean three"), (9001, bad)]
    df = spark.createDataFrame([(i, t) for i, t, *_ in docs] + extra, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in T.drop_toxic(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect() if r.doc_id is None or r.doc_id > 9000]
    assert sorted(kept, key=str) == sorted([(None, "clean one"), (None, "clean two"), (None, None), (9001, "clean three")], key=str)
