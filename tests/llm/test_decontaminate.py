"""Exact and near phrase matches against plain loops over all places."""

import hashlib
import random
import re

from ledgerspan.llm import decontaminate as D

TERM = re.compile(D.TERM)


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, window):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in rows:
        w = words(text)
        hit, found = set(), set()
        for phrase, names in wins.items():
            for i in range(len(w) - len(phrase) + 1):
                if tuple(w[i : i + len(phrase)]) == phrase:
                    hit |= set(range(i, i + len(phrase)))
                    found |= names
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), ids, bool(hit)))
    return sorted(out, key=repr)


def tables(rng):
    vocab = [f"t{i}" for i in range(60)] + ["É", "é", "naïve", "x1", "日本語"]
    say = lambda n: rng.choice([" ", ", ", "-", "\n"]).join(rng.choices(vocab, k=n))
    items = [(i, say(rng.randint(1, 30))) for i in range(25)] + [(100, None), (101, "..."), (102, "the the the"), (103, "the " * 14), (None, say(12)), (7, say(11)), (8, items_text := say(15)), (9, items_text)]
    rows = []
    for d in range(120):
        text = say(rng.randint(0, 80))
        if rng.random() < 0.6:
            text += " " + (rng.choice(items)[1] or "").upper() + " " + say(5)
        rows.append((d, text))
    rows += [(200, None), (201, ""), (202, "the " * 3000), (203, "?!"), (None, items_text), (None, items_text), (4, items_text + " z"), (4, "other")]
    return rows, items


def test_against_plain(spark):
    rows, items = tables(random.Random(8))
    docs = spark.createDataFrame([(d, t, 1, [1]) for d, t in rows], "doc_id long, text string, h1 int, terms array<int>").repartition(3)
    bench = spark.createDataFrame([(i, t, 1, "p") for i, t in items], "item_id long, text string, n int, phrase string")
    for options in (D.Options(), D.Options(window=4, lists=1), D.Options(window=3, lists=9)):
        got = sorted((tuple(r) for r in D.contamination(docs, bench, options).collect()), key=repr)
        assert got == plain(rows, items, options.window)
    assert sum(r[-1] for r in got) > 50


def test_near_matches(spark):
    rng = random.Random(9)
    vocab = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(rng.sample(vocab, 4))) for i in range(6)]
    rows = []
    for d in range(60):
        w = rng.choices(vocab, k=20)
        phrase = rng.choice(items)[1].split()
        for t in phrase:
            w.insert(min(len(w), 8 + rng.randint(-2, 2) + phrase.index(t)), t)
        rows.append((d, " ".join(w)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    count = {}
    for _, t in rows:
        for w in t.split():
            count[w] = count.get(w, 0) + 1
    for slop in (0, 2):
        want = set()
        for i, text in items:
            phrase = text.split()
            rarest = min(range(4), key=lambda k: (count.get(phrase[k], 0), phrase[k], k))
            for d, t in rows:
                w = t.split()
                for p in (p for p, x in enumerate(w) if x == phrase[rarest]):
                    start = p - rarest
                    if (slop or start >= 0) and all(any(0 <= start + k + e < len(w) and w[start + k + e] == phrase[k] for e in range(-slop, slop + 1)) for k in range(4) if k != rarest):
                        want.add((d, str(i), start))
        got = {tuple(r) for r in D.near_matches(docs, bench, slop).collect()}
        assert got == want
    assert len(want) > 10


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    none = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in D.contamination(docs, bench.limit(0)).collect()] == [(1, 2, 0, 0, none, False)]
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert D.contamination(docs, bench).first().n_hit == 1
