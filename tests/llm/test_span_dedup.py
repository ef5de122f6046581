"""Sentence spans against a plain counterpart with a splitter of its own."""

import random
import re

import numpy as np

from ledgerspan.llm import span_dedup as S

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def low(raw):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in raw)


def split(text):
    """[(words, bytes up to the next part, ends a sentence)] of a text, word by word; the cut words are the operator's."""
    raw = text.encode()
    found = list(WORD.finditer(raw))
    parts, words, begin = [], [], found[0].start() if found else 0
    for i, m in enumerate(found):
        word = m[0]
        words.append(low(word))
        after = found[i + 1].start() if i + 1 < len(found) else len(raw)
        sentence = word[-1:] in (b".", b"!", b"?") or b"\n" in raw[m.end() : after] or i + 1 == len(found)
        own = S.parts_of(np.frombuffer(word, np.uint8), np.array([0, len(word)])).hashes[0]
        if sentence or int(own) % S.CUT_EVERY == 0:
            parts.append((words, raw[begin:after], sentence))
            words, begin = [], after
    return raw[: found[0].start()] if found else raw, parts


def spans(parts, least):
    out = set()
    count = [len(w) for w, _, _ in parts]
    for i in range(len(parts)):
        j = next((j for j in range(i + 1, len(parts) + 1) if sum(count[i:j]) >= least), None)
        if j:
            out.add((i, j))
        k = next((k for k in range(i, -1, -1) if sum(count[k : i + 1]) >= least), None)
        if parts[i][2] and k is not None:
            out.add((k, i + 1))
    return [(tuple(w for p in parts[i:j] for w in p[0]), i, j) for i, j in sorted(out)]


def plain(rows, options):
    first, result = {}, {}
    for doc, text in sorted(((d, t) for d, t in rows if d is not None), key=lambda x: x[0]):
        for key, _, _ in spans(split(text or "")[1], options.min_words):
            first.setdefault(key, doc)
    for doc, text in rows:
        lead, parts = split(text or "")
        dead, seen = set(), set()
        for key, i, j in spans(parts, options.min_words):
            if key in seen or (doc is not None and first[key] < doc):
                dead |= set(range(i, j))
            seen.add(key)
        kept = lead + b"".join(p[1] for i, p in enumerate(parts) if i not in dead) if dead else (text or "").encode()
        result.setdefault(doc, []).append((len(parts), len(dead), kept.decode()))
    return result


def corpus(rng):
    vocab = [f"w{i}" for i in range(400)]
    sentence = lambda n: " ".join(rng.choices(vocab, k=n)).capitalize() + rng.choice([". ", "! ", "?\n", "\n\n"])
    passages = ["".join(sentence(rng.randint(5, 20)) for _ in range(6)) for _ in range(4)] + [sentence(60)]
    rows = []
    for d in range(120):
        parts = [sentence(rng.randint(1, 25)) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((d, "".join(parts)))
    rows += [(206, "  \n lead " + rows[7][1]), (207, "kein Satz ohne Größe\u00a0und Ende " * 30), (208, rows[9][1] + rows[9][1]), (200, None), (201, ""), (202, rows[5][1].upper()), (None, rows[5][1]), (None, rows[5][1]), (203, "In. In. In. " * 30), (204, "x" * 50_000), (5, rows[5][1])]
    rng.shuffle(rows)
    return rows


def test_against_plain(spark):
    rows = corpus(random.Random(11))
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, hash int, later int")
    got = {}
    for r in S.remove_repeated(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_sentences, r.n_removed, r.text))
    want = plain(rows, S.Options())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert any(x[0][1] for x in want.values())


def test_passage_removed_once_and_clean_text_kept(spark):
    passage = "The first of these sentences has some nine words. A second one follows it with even more words here. And a third one closes the passage at last. Then a fourth. "
    rows = [(1, "Alpha one two. " + passage), (2, passage + "Other end here."), (3, "Nothing in common with the others at all, not a word.")]
    got = {r.doc_id: r.text for r in S.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "Other end here.", 3: rows[2][1]}


def test_nothing_goes_without_a_repeated_run_of_twenty_words(spark):
    """On the given documents, by every run of words and not by sentences."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    where, again = {}, set()
    for doc, text in sorted(rows):
        words = [low(w) for w in WORD.findall(text.encode())]
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if where.setdefault(key, (doc, i)) != (doc, i):
                again.add(doc)
    got = S.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    altered = {r.doc_id for r in got if r.n_removed}
    assert altered <= again and len(altered) > 0.7 * len(again)
    assert all(r.text == dict(rows)[r.doc_id] for r in got if not r.n_removed)


def test_empty(spark):
    assert S.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_passage_inside_running_text(spark):
    """A passage of 60 words without a boundary before or behind it: all but what is glued to its edges goes."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    rows = []
    for n in range(20):
        passage = [word() + ("." if i % 25 == 24 else "") for i in range(60)]
        for k in range(2):
            rows.append((2 * n + k, " ".join([word() for _ in range(15)] + passage + [word() for _ in range(15)]), set(passage)))
    got = {r.doc_id: r.text for r in S.remove_repeated(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    left = [sum(w in passage for w in got[d].split()) for d, _, passage in rows if d % 2]
    assert all(got[d] == t for d, t, _ in rows if d % 2 == 0)
    assert max(left) < 50 and sum(left) < 20 * 25
    foreign = [[w for w in t.split() if w not in p] for d, t, p in rows if d % 2]
    assert foreign == [[w for w in got[d].split() if w not in p] for d, _, p in rows if d % 2]
