"""Substring deduplication over sliding sentence spans.

Sentences end at . ! ? before white space, or at a line end. They are also cut behind every word whose hash is a multiple of
CUT_EVERY, so a passage that stands in running text, with foreign words glued to its first and last sentence, is cut at the same
places as elsewhere. Two kinds of span are hashed: from every cut forward, and from every true sentence end backward, the shortest run of
whole parts that holds `min_words` words. So a repeat is found from its first cut to its last sentence end, and
nothing goes that is not part of a repeated run of `min_words` words. The first occurrence of a span (smallest doc_id, then
position) stays; a part covered by any later occurrence is removed.

Words, their hashes, cuts and spans of a whole batch are arrays over its bytes: hashes are differences of prefix sums, ends are found by
binary search among the cuts. Repeats within a document are found in place. Across documents only (hash, check, doc_id) is
exchanged, the first document per hash by a partial aggregation and a join whose frequent hashes are broadcast within a
proven bound; then the texts meet their later spans once.

Defined results: words are what ASCII white space separates, A-Z count as lower case; null text counts as empty and has no sentence. Rows that
repeat a doc_id are one document: what repeats between them stays. A row without doc_id is only compared with itself: it has no place in
the order. Equal hashes of 96 bits count as equal spans. Scripts without spaces are not cut inside a line. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import small_batches, text_bytes
from .common import stage, with_group

CUT_EVERY = 8
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_STOP = np.isin(np.arange(256), list(b".!?"))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Options:
    min_words: int = 20  # of a span


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of each base and of its inverse modulo 2^64, grown on demand."""

    of: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def get(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls.of or len(cls.of[base][0]) < n:
            size = 1 << max(16, n.bit_length())
            cls.of[base] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)])) for b in (base, pow(base, -1, 1 << 64)))
        return cls.of[base]


def _runs_of(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] for each run, by prefix sums."""
    up, down = _Powers.get(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0x165667B19E3779F9)


@dataclass
class Parts:
    """The parts of a batch. A part is a run of words; `at` are word numbers.

    word_start, word_end: bytes of each word. rows: first word of each text, and the number of words. start, end: words of
    each part. sentence: whether a part ends a sentence. own: first part of each text, and the number of parts."""

    word_start: np.ndarray
    word_end: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sentence: np.ndarray
    own: np.ndarray


def parts_of(data: np.ndarray, offsets: np.ndarray) -> Parts:
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a text's words end with it
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    rows = np.searchsorted(starts, offsets)
    hashes = _mixed(_runs_of(_LOWER[data].astype(_U) + _U(1), starts, ends, _BASES[0]))
    m = len(starts)
    last = np.zeros(m + 1, bool)
    last[rows[1:][rows[1:] > rows[:-1]]] = True  # word numbers behind each text's last word
    feeds = np.concatenate(([0], np.cumsum(data == 0x0A)))
    following = np.append(starts[1:], n) if m else starts
    sentence = _STOP[data[ends - 1]] | (feeds[following] > feeds[ends]) | last[1:] if m else np.zeros(0, bool)
    cut = sentence | (hashes % _U(CUT_EVERY) == 0)
    end = np.flatnonzero(cut) + 1
    start = np.concatenate(([0], end[:-1])) if len(end) else end
    return Parts(starts, ends, rows, hashes, start, end, sentence[end - 1], np.searchsorted(start, rows))


def spans_of(p: Parts, options: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, check, first part, last part + 1 and text of every span, by position."""
    n = len(p.start)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int32), *(np.zeros(0, np.int64),) * 3
    text = np.searchsorted(p.own, np.arange(n), side="right") - 1
    limit, floor = p.own[text + 1], p.own[text]
    ahead = np.searchsorted(p.end, p.start + options.min_words) + 1  # first part end that is far enough
    behind = np.searchsorted(p.start, p.end - options.min_words, side="right") - 1
    a = np.flatnonzero(ahead <= limit)
    b = np.flatnonzero((behind >= floor) & p.sentence & (behind >= 0))
    pairs = np.unique(np.concatenate((np.stack((a, ahead[a]), 1), np.stack((behind[b], b + 1), 1))), axis=0) if len(a) + len(b) else np.zeros((0, 2), np.int64)
    at, to = pairs[:, 0], pairs[:, 1]
    first, last = p.start[at], p.end[to - 1]
    h = _mixed(_runs_of(p.hashes, first, last, _BASES[1]))
    check = (_mixed(_runs_of(_mixed(p.hashes ^ _U(_BASES[0])), first, last, _BASES[0])) >> _U(33)).astype(np.int32)
    return h, check, at, to, text[at]


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether each row is the first of its keys, in the order given."""
    n = len(keys[0])
    order = np.lexsort((np.arange(n), *keys))
    same = np.ones(n, bool)
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    first = np.zeros(n, bool)
    first[order] = ~same
    if n:
        first[order[0]] = True
    return first


def _emit(options: Options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            h, check, _, _, text = spans_of(parts_of(*text_bytes(b.column("text"))), options)
            first = _first_of(text, check, h)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(check[first]), pa.array(ids[text[first]])], ["hash", "check", "doc"])

    return run


def repeated(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc, and the spans of it that an earlier document holds too."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())
    rows = stage(own.mapInArrow(_emit(options), "hash long, check int, doc long"), "spans")
    firsts = rows.groupBy("hash", "check").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    # two checks of one hash are two keys; the join is on the hash, and the check decides
    firsts = stage(firsts.groupBy("hash").agg(F.sum("copies").alias("copies"), F.collect_list(F.struct("check", "first")).alias("firsts")), "span-firsts")
    met = with_group(rows, firsts, "hash", "copies").filter(F.exists("firsts", lambda f: (f["check"] == F.col("check")) & (f["first"] < F.col("doc"))))
    return met.select("doc", "hash", "check").distinct().groupBy("doc").agg(F.collect_list(F.struct("hash", "check")).alias("later"))  # a document's own spans


RESULT = "doc_id long, n_sentences int, n_removed int, removed_chars long, text string"


def _remove(options: Options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            data, offsets = text_bytes(b.column("text"))
            p = parts_of(data, offsets)
            h, check, at, to, text = spans_of(p, options)
            gone = ~_first_of(text, check, h)
            bounds = np.searchsorted(text, np.arange(b.num_rows + 1))
            later = b.column("later").to_pylist()
            for r, known in enumerate(later):
                if known:
                    k = slice(bounds[r], bounds[r + 1])
                    pairs = {(x["hash"], x["check"]) for x in known}
                    gone[k] |= np.fromiter(((x, y) in pairs for x, y in zip(h[k].view(np.int64).tolist(), check[k].tolist())), bool, bounds[r + 1] - bounds[r])
            marks = np.zeros(len(p.start) + 1, np.int64)  # +1 where a removed span starts, -1 behind its end
            np.add.at(marks, at[gone], 1)
            np.add.at(marks, to[gone], -1)
            dead = np.cumsum(marks)[:-1] > 0
            # a part reaches from its first word to the next part's; what stands before a text's first word stays
            begin = p.word_start[p.start] if len(p.start) else np.zeros(0, np.int64)
            rows = []
            for r, doc_id in enumerate(b.column("doc_id").to_pylist()):
                lo, hi = int(p.own[r]), int(p.own[r + 1])
                raw = data[offsets[r] : offsets[r + 1]].tobytes()
                if dead[lo:hi].any():
                    edges = np.append(begin[lo:hi], offsets[r + 1]) - offsets[r]
                    kept = raw[: edges[0]] + b"".join(raw[x:y] for x, y, d in zip(edges[:-1].tolist(), edges[1:].tolist(), dead[lo:hi].tolist()) if not d)
                else:
                    kept = raw
                whole, left = raw.decode(), kept.decode()
                rows.append((doc_id, hi - lo, int(dead[lo:hi].sum()), len(whole) - len(left), left))
            cols = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_sentences", "n_removed", "removed_chars", "text"])

    return run


def remove_repeated(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, n_sentences (parts), n_removed (of them), removed_chars and the remaining text of every document."""
    later = repeated(docs, options)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.join(later, own["doc_id"] == later["doc"], "left").select("doc_id", "text", "later").mapInArrow(_remove(options), RESULT)
