"""Exact dedup and source mixing against plain counterparts."""

import hashlib
import random

from ledgerspan.llm import exact_dedup as X, mixing as M

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, source string, digest string, size int, keep_id int"


def rows_():
    rng = random.Random(9)
    rows = [(i, rng.choice(["Same Text", "same text", "É one", "é one", "", None, f"own {i}", "x" * 50_000]), rng.choice(["a", "b", "c", "", None, "é"])) for i in range(300)]
    rows += [(None, "same text", "a"), (None, "only here", "a"), (5, rows[5][1], rows[5][2])]
    return [(*r, "d", 1, 2) for r in rows]


def test_exact_groups(spark):
    rows = rows_()
    got = X.classify(spark.createDataFrame(rows, DOCS), X.new_index(spark, 3)).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_index_persists_and_stays_idempotent(spark):
    index = X.new_index(spark, 4)
    first = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "doc_id long, text string")
    assert {r.doc_id for r in X.deduplicate(first, index).collect()} == {2, 3}
    again = X.DigestIndex(spark, index.path, 99)
    assert again.buckets == 4 and again.entries().count() == 2
    second = spark.createDataFrame([(10, "B"), (11, "c"), (12, "C"), (12, "C")], "doc_id long, text string")
    for _ in range(2):
        assert [(r.doc_id, r.text) for r in X.deduplicate(second, again).collect()] == [(12, "C")]
    assert again.entries().count() == 3
    plan = again.entries().join(again.entries().withColumnRenamed("keep_id", "k").hint("merge"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_many_copies_take_the_broadcast_way(spark):
    rows = [(i, "copy") for i in range(3000)] + [(5000 + i, f"t{i}") for i in range(2000)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in X.classify(spark.createDataFrame(rows, "doc_id long, text string"), X.new_index(spark)).collect()}
    assert len(got) == 5000 and got[7] == (2999, 3000) and got[5001] == (5001, 1)


def plain_targets(sizes, total, cap=3):
    """Reshare the excess by weight until nobody is above the cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        rest, w = total - sum(cap * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and w and rest * weight[s] / w >= cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else rest * weight[s] / w for s in names}
        full |= more


def test_mix(spark):
    rows = rows_()
    df = spark.createDataFrame(rows, DOCS)
    got = M.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, M.mix(df.repartition(7)).collect()))
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes, sum(sizes.values()))
    taken = {}
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) < 1 for s in sizes)
    # within a source the part epoch takes a prefix of the random order
    for s in sizes:
        own = sorted((int(hashlib.md5(f"mix:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:15], 16), r.doc_id or -1, r.size, r.part) for r in got if r.source == s)
        seen_end = False
        for _, _, size, part in own:
            assert not (seen_end and part)
            seen_end |= part < size


def test_mixed_rows(spark):
    df = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2], "d", 1, 2) for i in range(100)], DOCS)
    out = M.apply_mix(df, M.mix(df))
    counts = {s: n for s, n in out.groupBy("source").count().collect()}
    assert out.columns == df.columns and abs(counts["a"] - 100 * 5 / 7) <= 1 and abs(counts["b"] - 100 * 2 / 7) <= 1


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert X.deduplicate(df, X.new_index(spark)).collect() == [] and M.mix(df).collect() == []
    blank = spark.createDataFrame([(1, None, "a", "d", 1, 2), (2, " ", None, "d", 1, 2)], DOCS)
    assert {(r.taken, r.target) for r in M.mix(blank).collect()} == {(0, 0.0)}


def test_rows_without_or_with_equal_doc_id_are_copied_apart(spark):
    """Each row comes as often as its own share says: no all-pairs join of rows with the same or no doc_id."""
    rows = [(None, f"n{i} " * (1 + i % 7), "ab"[i % 2]) for i in range(60)]
    rows += [(7, f"s{i} " * (1 + i % 5), "ab"[i % 2]) for i in range(20)] + [(9, "same text", "a")] * 12 + [(None, "same null", None)] * 9
    df = spark.createDataFrame([(*r, "d", i, 2) for i, r in enumerate(rows)], DOCS)
    mixed = M.mix(df)
    text = {(r.hash, r.hash2): r.text for r in df.selectExpr("text", "xxhash64(text) AS hash", "xxhash64(reverse(text)) AS hash2").collect()}
    want = {}
    for r in mixed.collect():
        key = (r.doc_id, r.source, text[r.hash, r.hash2])
        want[key] = want.get(key, 0) + r.epochs + (r.part > 0 and 2 * r.part >= r.size)
    got, per_row = {}, {}
    for r in M.apply_mix(df, mixed).collect():
        got[r.doc_id, r.source, r.text] = got.get((r.doc_id, r.source, r.text), 0) + 1
        per_row[r.size] = per_row.get(r.size, 0) + 1
    assert got == {k: n for k, n in want.items() if n} and max(per_row.values()) <= 3
    words = {}
    for (_, s, t), n in got.items():
        words[s] = words.get(s, 0) + n * len(t.split())
    for s, goal in {r.source: r.target for r in mixed.collect()}.items():
        assert abs(words.get(s, 0) - goal) <= 7
    one = spark.createDataFrame([(1, "w " * 8, "a", "d", 1, 2)] * 2, DOCS)
    assert M.apply_mix(one, M.mix(one)).count() == 2
