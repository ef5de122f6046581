"""Byte-level BPE encoding and decoding with a given vocabulary file.

Each distinct word is merged once per worker and remembered. A short word is a contiguous array of part
ids with the rank of each adjacent pair beside it: scan for the least rank, merge, delete the boundary, refresh
the two neighbouring ranks. A word above SHORT parts keeps the same order with a heap, so an unbroken run
of letters does not cost its square. Texts are cut at plain letter-space-letter places before splitting, so memory
follows the slice and not the text.

Defined results: null text counts as empty and has no tokens. The vocabulary's special strings inside a text
become their own ids. Repeated rows get equal rows. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .arrow import small_batches
from .common import importable

#: The published pattern of byte-level BPE (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT, REMEMBERED, SLICE = 64, 200_000, 1 << 20
_SAFE_CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")
NEVER = 1 << 30


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class _Words(dict):
    """word -> ids, filled on demand; starts anew when full, so it stays bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.encode(word.encode())
        if len(word) <= SHORT:
            self[word] = ids
        return ids


class Codec:
    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for word, i in vocab.items():
            self.tokens[i] = bytes(map(alphabet.__getitem__, word))
        for word, i in self.specials.items():
            self.tokens[i] = word.encode()
        self.of_byte = [0] * 256
        for char, b in alphabet.items():
            self.of_byte[b] = vocab[char]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.numbers = [str(i) for i in range(len(self.tokens))]
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.words = _Words(self.merge)

    def merge(self, word: bytes) -> tuple[int, ...]:
        ids = [self.of_byte[b] for b in word]
        return tuple(self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids))

    def _merge_short(self, ids: list[int]) -> list[int]:
        get = self.pairs.get
        none = (NEVER, -1)
        ranks = [get(p, none)[0] for p in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            ids[i] = self.pairs[ids[i], ids[i + 1]][1]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)[0]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)[0]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order: least rank first, leftmost of equal ones."""
        n, get = len(ids), self.pairs.get
        after, before, dead = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(p[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], dead[j], after[i] = self.pairs[left, right][1], 1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := get((ids[a], ids[b]))):
                    heapq.heappush(heap, (p[0], a, ids[a], ids[b]))
        return [x for x, gone in zip(ids, dead) if not gone]

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE and (cut := _SAFE_CUT.search(text, at + SLICE)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def _plain(self, text: str) -> Iterator[list[int]]:
        word = self.words.__getitem__
        for part in self._slices(text):
            yield list(chain.from_iterable(map(word, self.split(part))))

    def encode_parts(self, text: str) -> Iterator[list[int]]:
        """The ids of a text in order, in lists of bounded length."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._plain(text[at : m.start()])
            yield [self.specials[m[0]]]
            at = m.end()
        yield from self._plain(text[at:] if at else text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_parts(text)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(vocabulary: str) -> Codec:
    """One codec per vocabulary and worker process."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def _ship(docs: DataFrame, path: str):
    """The vocabulary file (a fixed size) goes to the workers from the driver."""
    importable(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every whole text."""
    shipped = _ship(docs, path)

    def run(batches):
        own = codec(shipped.value)
        for b in small_batches(batches, "text"):
            ids = [own.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    shipped = _ship(encoded, path)

    def run(batches):
        own = codec(shipped.value)
        for b in batches:
            texts = [own.decode(i or []) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """The rows of docs with ids, n_tokens and exact: whether the ids, decoded again, give the text back to the byte (null text: empty).
    Columns of docs with these names make way."""
    shipped, new = _ship(docs, path), ("ids", "n_tokens", "exact")
    rows = docs.drop(*new)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        own = codec(shipped.value)
        for b in small_batches(batches, "text"):
            ids, exact = [], []
            for text in b.column("text").to_pylist():
                ids.append(own.encode(text or ""))
                exact.append(own.decode(ids[-1]) == (text or ""))
            columns = [*b.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(exact, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, *new])

    return rows.mapInArrow(run, f"{fields}, ids array<int>, n_tokens long, exact boolean")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, its ids decoded again, both digested part by part."""
    shipped = _ship(docs, path)

    def run(batches):
        own = codec(shipped.value)
        number, token = own.numbers.__getitem__, own.tokens.__getitem__
        for b in small_batches(batches, "text"):
            rows = []
            for text in b.column("text").to_pylist():
                n, of_ids, pieces = 0, hashlib.sha256(), []
                for ids in own.encode_parts(text or ""):
                    if ids:
                        of_ids.update(("," * (n > 0) + ",".join(map(number, ids))).encode())
                        n += len(ids)
                        pieces.append(b"".join(map(token, ids)))
                decoded = b"".join(pieces).decode("utf-8", "replace").encode()
                rows.append((n, of_ids.hexdigest(), hashlib.sha256(decoded).hexdigest()))
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
