"""Periodic runs against a plain search of every lag, and the registered query on a small table."""

import hashlib
import random
import zlib
from fractions import Fraction

from ledgerspan.llm import periodic, queries

OPTIONS = periodic.Options()


def plain(words, least=OPTIONS.least):
    smallest = {}
    for q in range(1, len(words) // 3 + 1):
        start = None
        for i in range(len(words) - q + 1):
            same = i + q < len(words) and words[i] == words[i + q]
            if same and start is None:
                start = i
            elif not same and start is not None:
                if i - start + q >= least(q):
                    smallest.setdefault((start, i + q), q)
                start = None
    return sorted((s, e, q) for (s, e), q in smallest.items())


def texts(rng):
    out = []
    for _ in range(60):
        alphabet = [f"w{i}" for i in range(rng.choice([1, 2, 3, 50, 1000]))]
        words = []
        for _ in range(rng.randint(1, 5)):
            words += rng.choices(alphabet, k=rng.randint(0, 40))
            block = rng.choices(alphabet, k=rng.choice([1, 2, 7, 30, 47, 48, 49, 50, 96, 97, 150, 300]))
            if rng.random() < 0.5:  # a long period made of nearly short ones
                block = (rng.choices(alphabet, k=rng.randint(1, 20)) * 40)[: len(block) - 1] + ["odd"]
            length = int(len(block) * rng.choice([1.5, 2.9, 3, 3.1, 5]))
            words += (block * 6)[: max(length, rng.choice([0, 23, 24]))]
        out.append(rng.choice([" ", "\n"]).join(words))
    return out


def test_scan_against_plain():
    rng = random.Random(5)
    rows = texts(rng)
    rows += ["", None, "a", "a " * 23, "a " * 24, "a b " * 6000, "é x y " * 30, "".join(rng.choices("ab ", k=4000)), "x y\x1cz " * 24]
    rows += [" ".join(rng.choices([f"v{i}" for i in range(400)], k=700) * 3 + ["end"])]
    batch = list(periodic.scan(rows, OPTIONS))
    assert len(batch) == len(rows)
    for text, (runs, kept) in zip(rows, batch):
        words = (text or "").encode().split()
        want = plain(words) if len(words) < 5000 else [(0, 12000, 2)]
        assert runs == want
        gone = {i for s, e, q in want for i in range(s + q, e)}
        assert kept == [w for i, w in enumerate(words) if i not in gone]
    assert max(q for runs, _ in batch for _, _, q in runs) == 700
    assert any(len(runs) > 2 for runs, _ in batch)


def test_long_text_of_few_words():
    """Hashed groups inside short runs take no part, so nothing grows with the square of a constant stretch."""
    text = "the " * 300_000 + " ".join(f"u{i}" for i in range(5000)) * 3
    runs, kept = next(periodic.scan([text], OPTIONS))
    assert (0, 300_000, 1) in runs and len(kept) < 16_000


def expected(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain(words)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    s, length, q = (best[0], best[1] - best[0], best[2]) if best else (None, None, None)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()
    return doc_id, len(runs), s, length, q, 1000 * length // q if best else None, digest(lines), digest(b" ".join(w for i, w in enumerate(words) if i not in gone))


def test_query_against_plain(spark, tmp_path):
    rng = random.Random(6)
    rows = list(enumerate(texts(rng))) + [(d, " ".join(rng.choices([f"v{i}" for i in range(300)], k=rng.randint(0, 900)))) for d in range(60, 260)]
    rows += [(None, "a " * 40), (None, "a " * 40), (3, "b " * 30), (300, None), (301, ""), (302, " \n "), (303, "z " * 20_000)]
    df = spark.createDataFrame([(d, t, 0, "s") for d, t in rows], "doc_id long, text string, runs int, collapsed string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    def brute(d, t):
        return expected(d, t) if d != 303 else None
    want = sorted((brute(d, t) for d, t in rows if d != 303), key=repr)
    assert [r for r in got if r[0] != 303] == want
    assert [r[1:6] for r in got if r[0] == 303] == [(1, 0, 20_000, 1, 20_000_000)]
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows if d is not None) > 10
    assert periodic.digests(df.limit(0)).count() == 0
