"""Repeated byte strings against brute force; the merge against a plain sort."""

import hashlib
import os
import random

from ledgerspan.llm import suffix_dedup as S


def brute(rows, length):
    seen = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raw:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng):
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(20, 90)) for _ in range(6)]
    rows = []
    for d in range(90):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += [p[a : len(p) - rng.randint(0, len(p) // 3)], text(rng.randint(0, 15))]
        rows.append((d, "".join(parts)))
    for d in range(90, 110):  # near copies
        own = list(rows[3][1] + passages[0] + text(80))
        for _ in range(3):
            own[rng.randrange(len(own))] = "#"
        rows.append((d, "".join(own)))
    rows += [(200, None), (201, ""), (202, "a" * 1500), (203, "ab" * 400 + "\0" * 300), (204, rows[7][1]), (7, rows[7][1]), (None, rows[8][1]), (None, None), (205, "x" * 199), (206, "\0" * 230)]
    rng.shuffle(rows)
    return rows


def check(spark, rows, options):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, row_key int, few string")
    key = lambda x: tuple(-1 if v is None else v for v in x)
    want = sorted(brute(rows, options.length), key=key)
    for with_bytes in (False, True):
        got = S.remove_repeated(df, options, with_bytes).collect()
        assert sorted((tuple(r)[:5] for r in got), key=key) == want
        if with_bytes:
            assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert any(x[2] for x in want) and any(x[1] and not x[2] for x in want)


def test_against_brute_force(spark):
    check(spark, corpus(random.Random(1)), S.Options())


def test_frequent_anchors_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 700)
    monkeypatch.setattr(S, "FLUSH", 4000)
    check(spark, corpus(random.Random(2)), S.Options(group_limit=8, receiver_rows=50))


def test_merge():
    rng = random.Random(3)
    for k in (1, 2, 3, 7, 16):
        parts = []
        for _ in range(k):
            own = sorted(bytes(rng.choices(b"ab\0", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 30)))
            own = sorted(set(own))
            parts.append((own, [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(own, own[1:])]))
        order, common = S.merge(parts)
        got = [parts[r][0][i] for r, i in order]
        assert got == sorted(x for p in parts for x in p[0])
        assert common[1:] == [len(os.path.commonprefix([a, b])) for a, b in zip(got, got[1:])]


def test_empty(spark):
    assert S.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
