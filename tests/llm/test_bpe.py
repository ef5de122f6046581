"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerspan.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pair():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Codec(f.read()), Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    alphabet = "ab cdE'sré ñß 12\n\t\x1c\x85　,.!?😀中文ء́\x00\\<|" + "the ing"
    fixed = ["", " ", "  \n ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "it's we'll I'M", "x" * 5000, "ab" * 3000 + " end", " " * 3000 + "x", "​­", "naïve café ΑΒΓ"]
    return fixed + ["".join(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(400)]


def test_matches_library(pair):
    own, lib = pair
    for t in texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t[:80]
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_slices_and_heap_agree(pair, monkeypatch):
    own, lib = pair
    text = "Then the other, it's a plain text with 12 numbers.  And  more words here\n" * 200
    whole = own.encode(text)
    monkeypatch.setattr(bpe, "SLICE", 50)
    assert own.encode(text) == whole == lib.encode(text).ids
    monkeypatch.setattr(bpe, "SHORT", 1)
    own.words.clear()
    assert own.encode(text) == whole


def test_decode_of_broken_bytes(pair):
    own, lib = pair
    rng = random.Random(1)
    for _ in range(100):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_dataframes(spark, pair):
    own, lib = pair
    rows = [(1, "hello <|endoftext|> world", "x"), (2, None, "y"), (2, "", None), (None, "tie", "z"), (None, "tie", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, tuple(r.ids)) for r in bpe.encode(docs, PATH).collect()}
    assert got == {(i, tuple(lib.encode(t or "").ids)) for i, t, _ in rows}
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t, _ in rows)
    trip = bpe.round_trip(docs, PATH).collect()
    assert len(trip) == 5 and bpe.round_trip(docs.limit(0), PATH).collect() == []
    for r in trip:
        if r.doc_id == 1:
            ids = lib.encode(rows[0][1]).ids
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(rows[0][1].encode()).hexdigest()
