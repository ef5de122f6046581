"""Each stage of the corpus pipeline against a plain counterpart on its own input."""

import os
import random
import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from test_minhash import brute


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(800)]
    docs, labels = [], []
    for i in range(500):
        words = rng.choices(vocab, k=rng.randint(5, 120))
        toxic = int(rng.random() < 0.25)
        for _ in range(4 * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(["grrk", "blarg", "zonk"]))
        docs.append((i, " ".join(words), "en", rng.choice("aab"), len(words)))
        labels.append((i, 1, toxic))
    for i in range(500, 560):
        text = rng.choice(docs[:40])[1]
        docs.append((i, text.upper() if i % 2 else text + " end", "en", "a", 1))
    docs += [(600, None, None, "a", None), (601, "", "en", "b", 0)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, f in P.STAGES:
        out = f(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append((name, [tuple(r) for r in now.collect()], spark.read.parquet(f"{tmp_path}/{name}")))
        now = seen[-1][2]
    assert [s[0] for s in seen] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    for _, _, out in seen[:-1]:
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    bad = {"grrk", "blarg", "zonk"}
    (_, a, x), (_, b, y), (_, c, z), (_, d, m), (_, e, t) = seen
    dropped = {r[0] for r in a} - {r.doc_id for r in x.collect()}
    planted = {r[0] for r in a if bad & set((r[1] or "").lower().split())}
    held = {i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert len(dropped ^ planted) <= 0.02 * len(a) and len((dropped ^ planted) & held) <= 3
    best = {}
    for r in b:
        best[(r[1] or "").lower()] = max(best.get((r[1] or "").lower(), -1), r[0])
    assert {r.doc_id for r in y.collect()} == set(best.values())
    assert {r.doc_id for r in z.collect()} == {i for i, _, k in brute([(r[0], r[1]) for r in c], 5, by_id=False)[0] if i == k}
    size, taken = {}, {}
    for r in d:
        size[r[3]] = size.get(r[3], 0) + len((r[1] or "").split())
    for r in m.collect():
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    order = sorted(size, key=lambda s: (s is None, s))
    assert set(order) == {"a", "b"} and abs(taken["a"] - sum(size.values()) * 5 / 7) < 130 and abs(taken["b"] - sum(size.values()) * 2 / 7) < 130
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted((r.doc_id, list(r.ids)) for r in t.collect()) == sorted((r[0], lib.encode(r[1] or "").ids) for r in e)
    assert t.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens", "exact"] and t.filter("not exact or n_tokens <> size(ids)").count() == 0
    assert os.path.isdir(f"{tmp_path}/bpe")


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Rows without doc_id or sharing one, repeated rows, empty and very long texts, nulls everywhere and clashing columns."""
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(900)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    a, b, c = say(60), say(60), say(80)
    rows = [(i, say(rng.randint(10, 80)), rng.choice("ab")) for i in range(60)]
    rows += [(None, a, "a"), (None, b, None), (None, b + " tail", None), (None, None, None), (100, a, "b"), (101, c, "b"), (101, say(70), "a"), (102, c, "b"), (103, c, "b"), (103, c, "b"), (104, "", "a"), (105, "x" * 300_000, "a"), (106, say(40_000), "a")]
    spark.createDataFrame([(d, t, s, n, "i", 1, True) for n, (d, t, s) in enumerate(rows)], "doc_id long, text string, source string, place int, ids string, h1 int, kept boolean").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = P.run(spark, str(tmp_path))
    got = out.collect()
    assert set(out.columns) == {"doc_id", "text", "source", "place", "ids", "h1", "kept", "n_tokens", "exact"} and all(r.exact for r in got)
    places = {r.place for r in got}
    texts = {}
    for r in got:
        texts.setdefault(r.text, set()).add(r.place)
    assert all(len(x) == 1 for x in texts.values())  # no two rows of one text
    assert len([n for n in places if rows[n][1] == c]) <= 1
    assert len([n for n in places if rows[n][1] in (b, b + " tail")]) <= 1
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    for name, f in P.STAGES:
        assert f(spark, none, str(tmp_path)).count() == 0, name
