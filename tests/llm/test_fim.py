"""Fill-in-middle: cuts against a plain counterpart, exact round trip, marks in texts, odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from ledgerspan.llm import fim


def plain(doc_id, text, options):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    h = hashlib.sha256(f"{options.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    p, s, m = options.marks
    if not text or any(x in text for x in options.marks) or h3 % 100 >= options.rate:
        return n, "plain", None, None, text
    if h4 % 100 < options.spm:
        return n, "spm", len(pre), len(mid), s + suf + p + pre + m + mid
    return n, "psm", len(pre), len(mid), p + pre + s + suf + m + mid


def corpus():
    rng = random.Random(3)
    pieces = ["a", "é", "日本", "\n", "\n\n", "🙂", " ", "x" * 7, "word\n", "\r\n", "<", ">", "P>"]
    rows = [(d, "".join(rng.choices(pieces, k=rng.randint(0, 60)))) for d in range(400)]
    rows += [(400, None), (401, ""), (402, "\n"), (403, "no end"), (404, "has <P> inside\nx"), (405, "ends with <"), (406, "P>\nS>\nM>\n<"), (None, "a\nb\nc"), (None, "a\nb\nc"), (5, "other\ntext")]
    return rows + [(407, "line of text\n" * 200_000), (408, "é" * 300_000)]


@pytest.mark.parametrize("options", [fim.Options(), fim.Options(seed=1, rate=60, spm=20, prefix="<|fim_prefix|>", suffix="<|fim_suffix|>", middle="<|fim_middle|>")])
def test_against_plain(spark, options):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, output string").repartition(3)
    got = fim.restore(fim.transform(docs, options), options).collect()
    want = sorted(((d, *plain(d, t, options), t or "") for d, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_marks_count_and_find():
    rng = np.random.default_rng(0)
    for size in (0, 1, 7, 8, 9, 64, 1000):
        data = rng.choice(np.array([0x0A, 0x0B, 0x09, 0x8A, 0x00, 0x61, 0xC3, 0xA9], np.uint8), size)
        words = fim.as_words(data)
        for marked, places in ((fim.line_ends(words), np.flatnonzero(data == 0x0A)), (fim.char_starts(words), np.flatnonzero(data & 0xC0 != 0x80))):
            marks = fim.Marks(marked)
            assert (marks.find(np.arange(len(places))) == places).all()
            assert (marks.count(np.arange(size + 1)) == np.searchsorted(places, np.arange(size + 1))).all()


def test_digests_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb\n"), (2, None)], "doc_id long, text string")
    r = {x.doc_id: x for x in fim.digests(docs).collect()}
    assert r[1].restored_sha256 == hashlib.sha256(b"a\nb\n").hexdigest() and r[2].form == "plain" and r[2].prefix_chars is None
    assert fim.digests(docs.limit(0)).count() == 0


def test_marks_must_not_form_together():
    with pytest.raises(ValueError):
        fim.Options(prefix="P")
    with pytest.raises(ValueError):
        fim.Options(prefix="<S>")
