"""Near-duplicates against brute force over full shingle sets."""

import random
import re

from ledgerspan.llm import minhash as M


def word_set(text, words):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    return {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(rows, words, percent=80, by_id=True):
    """Rows of (doc_id, set size, least doc_id of the component), and the component of each row, by all pairs."""
    sets = [word_set(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            n = len(sets[i] & sets[j])
            same = by_id and rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if same or (n and 100 * n >= percent * len(sets[i] | sets[j])):
                root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)], [find(i) for i in range(len(rows))]


def corpus(rng, groups=25, copies=8):
    vocab = [f"wörd{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(groups):
        base = rng.choices(vocab, k=rng.randint(3, 300))
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((n, rng.choice([" ", "\n", " \t"]).join(own)))
            n += 1
    return rows


def check(spark, rows, words, **sizes):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id int, key string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df, M.Options(words=words)).collect()), key=repr)
    assert got == sorted(((d, n, c, d == c) for d, n, c in brute(rows, words)[0]), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = corpus(rng)
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "One"), (9004, "one"), (9005, "a b c"), (9006, "A B C"), (9007, "a b d"), (9008, "x" * 40_000), (9009, "é " * 9000), (None, rows[0][1])]
    rng.shuffle(rows)
    check(spark, rows, 4)


def test_shared_and_missing_ids(spark):
    """One document in two texts links both its neighbourhoods; rows without doc_id meet their copies."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(2000)]
    say = lambda n: rng.choices(vocab, k=n)
    a, b, c, d = say(90), say(90), say(80), say(70)
    near = lambda w: " ".join(w[:-1] + ["other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(say(50))), (5, " ".join(c)), (None, near(c)), (None, " ".join(d)), (None, near(d)), (None, " ".join(d)), (6, None), (None, ""), (7, " ".join(a)), (4, " ".join(say(3)))]
    for _ in range(3):
        rng.shuffle(rows)
        check(spark, rows, 5)
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, place int").repartition(3)
    kept = sorted(r.place for r in M.drop_near_duplicates(df).collect())
    _, part = brute(rows, 5, by_id=False)
    empty = {n for n, (_, t) in enumerate(rows) if not (t or "").strip()}
    assert empty <= set(kept) and len(kept) - len(empty) == len({p for n, p in enumerate(part) if n not in empty}) == len({part[n] for n in kept if n not in empty})
    assert all(rows[n][0] is not None for n in kept if n not in empty and any(rows[m][0] is not None for m, p in enumerate(part) if p == part[n]))


def test_one_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 20)
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(5000)]
    base = rng.choices(vocab, k=120)
    rows = []
    for n in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = rng.choice(vocab)
        rows.append((n, " ".join(own)))
    check(spark, rows, 5)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert M.near_duplicates(df).collect() == []
    assert M.drop_near_duplicates(df).columns == ["doc_id", "text"]
