"""Periodic runs in texts: stretches of words that repeat with a period at least a few times in a row.

A run of period q holds word i = word i + q throughout, has no smaller period, at least max(min_words, min_exponent * q) words, and no
neighbouring word extends it. Words are compared by exact numbers, documents of a batch lie in one array with a number of
its own between them.

Periods up to DIRECT: one comparison of the array with itself per lag; stretches between mismatches that are long enough are runs.
Periods in (Q, 2Q], Q = DIRECT, 2 DIRECT, ...: window minima of hashed word groups of Q/2 words. A window of Q words and its copy one
period later both lie in the run, so the minimum is taken at both places, and the pair of equal minimizers gives the lag. Groups inside
a run of a third of their length or less are left out of the minima: such a run is known from a smaller scale, equal groups that
remain lie at least Q/6 words apart (so a place has few partners and no long constant stretch gives all pairs), and every window of a
longer period still holds a group that counts. Each pair is extended word by word in both directions, so neither hash equality
nor the minima decide anything; they only have to miss no run.

Defined results: words are what ASCII white space separates; null text has no words. Documents without a run have an empty array and
keep their words. Repeated rows, and rows that share or lack doc_id, are told apart and answered each for itself. A very long text is one
row; its cost grows with n log n. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrow import small_batches
from .common import WORD, importable

#: Periods up to here are found by direct comparison; the word groups of the first scale have half as many words.
DIRECT = 48
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
#: An odd base and its inverse modulo 2^64, for hashes of word groups by prefix sums.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


@dataclass(frozen=True)
class Options:
    min_words: int = 24
    min_exponent: int = 3

    def __post_init__(self):
        if self.min_words > DIRECT // 2 or self.min_exponent < 3:
            raise ValueError(f"runs have at most {DIRECT // 2} words at least and an exponent of 3 or more")

    def least(self, period: int) -> int:
        return max(self.min_words, self.min_exponent * period)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _sliding(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """The least (or, with np.maximum, greatest) of each `width` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x, span = least(x[:-span], x[span:]), span * 2
    return least(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def direct_runs(ids: np.ndarray, lags: range, options: Options) -> Iterator[tuple[int, int, int]]:
    """start, end, lag of every long enough stretch with that lag, smallest period or not."""
    n = len(ids)
    for q in lags:
        need = options.least(q) - q  # equal pairs in a row
        if n - q < need:
            return
        bounds = np.concatenate(([-1], np.flatnonzero(ids[:-q] != ids[q:]), [n - q]))
        for g in np.flatnonzero(np.diff(bounds) > need).tolist():
            yield int(bounds[g]) + 1, int(bounds[g + 1]) + q, q


class _Scales:
    """Equal minimizers at lags above a scale, over the whole array."""

    def __init__(self, ids: np.ndarray, breaks: np.ndarray):
        n = len(ids)
        self.n, self.breaks = n, breaks
        values = _mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(BASE, n), dtype=np.uint64)))
        self.back = _powers(INVERSE, n)

    def pairs(self, scale: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
        """Rows (lag, place), sorted: equal minimizers at place and place + lag with scale < lag <= 2 * scale."""
        group = window = scale // 2
        m = self.n - group + 1
        if m < window:
            return np.zeros((0, 2), np.int64)
        h = _mixed((self.sums[group:] - self.sums[:-group]) * self.back[:m])
        h[h == NEVER] = 0
        out = np.zeros(m + 1, np.int32)  # groups over a document's end, or inside a run of short period
        np.add.at(out, np.maximum(self.breaks - group + 1, 0), 1)
        np.add.at(out, np.minimum(self.breaks + 1, m), -1)
        for start, end, period in runs:
            if period * 3 <= group and end - start >= group:
                out[start] += 1
                out[end - group + 1] -= 1
        h[np.cumsum(out[:-1]) > 0] = NEVER
        least = _sliding(h, window, np.minimum)
        around = np.concatenate((np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)))
        chosen = np.flatnonzero((h == _sliding(around, window, np.maximum)) & (h != NEVER))
        hashes = h[chosen]
        order = np.argsort(hashes, kind="stable")
        hashes, places = hashes[order], chosen[order]
        found, step = [], 1
        while step < len(places):  # a place has few partners within 2 * scale, so few steps
            lag = places[step:] - places[:-step]
            near = (hashes[step:] == hashes[:-step]) & (lag <= 2 * scale)
            if not near.any():
                break
            near &= lag > scale
            found.append(np.stack((lag[near], places[:-step][near]), 1))
            step += 1
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def _first_difference(ids: np.ndarray, at: int, lag: int, direction: int) -> int:
    """The first place from `at` on in that direction that differs from the word one lag later, or the end."""
    n, size = len(ids) - lag, 64
    while 0 <= at < n:
        if direction > 0:
            stop = min(n, at + size)
            bad = np.flatnonzero(ids[at:stop] != ids[at + lag : stop + lag])
            if len(bad):
                return at + int(bad[0])
            at = stop
        else:
            stop = max(0, at + 1 - size)
            bad = np.flatnonzero(ids[stop : at + 1] != ids[stop + lag : at + 1 + lag])
            if len(bad):
                return stop + int(bad[-1])
            at = stop - 1
        size *= 2
    return at


def find_runs(ids: np.ndarray, breaks: np.ndarray, longest: int, options: Options) -> list[tuple[int, int, int]]:
    """start, end, period of every run of the array, by start and period. `breaks` are the places between
    documents (numbers that occur once), `longest` is the number of words of the longest one."""
    found = list(direct_runs(ids, range(1, min(DIRECT, longest // options.min_exponent) + 1), options))
    scale = DIRECT
    scales = _Scales(ids, breaks) if longest >= options.min_exponent * (scale + 1) else None
    while longest >= options.min_exponent * (scale + 1):
        runs, lag, done = [], 0, -1
        for q, place in scales.pairs(scale, found).tolist():
            if q == lag and place < done:
                continue  # inside the stretch that was just extended
            start = _first_difference(ids, place, q, -1) + 1
            lag, done = q, _first_difference(ids, place, q, 1)
            if done + q - start >= options.least(q):
                runs.append((start, done + q, q))
        found += runs
        scale *= 2
    smallest: dict[tuple[int, int], int] = {}
    for start, end, q in found:  # a multiple of a period has the same bounds
        smallest[start, end] = min(q, smallest.get((start, end), q))
    return sorted((start, end, q) for (start, end), q in smallest.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, end, q in runs:
        gone[start + q] += 1
        gone[end] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return [w for w, stays in zip(words, keep.tolist()) if stays]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def scan(texts: list[str | None], options: Options) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """Per text its runs (start, end, period) and the words that stay."""
    words = [(t or "").encode().split() for t in texts]
    numbers = _Numbers()
    sizes = np.array([len(w) for w in words], np.int64)
    breaks = np.cumsum(sizes + 1) - 1
    ids = np.empty(int(sizes.sum()) + len(words), np.int64)
    for end, w in zip(breaks.tolist(), words):
        ids[end - len(w) : end] = np.fromiter(map(numbers.__getitem__, w), np.int64, len(w))
    ids[breaks] = len(numbers) + np.arange(len(words))
    if len(ids) < 1 << 31:
        ids = ids.astype(np.int32)
    mine: list[list[tuple[int, int, int]]] = [[] for _ in words]
    runs = find_runs(ids, breaks, int(sizes.max(initial=0)), options)
    for (start, end, q), doc in zip(runs, np.searchsorted(breaks, [r[0] for r in runs]).tolist()):
        at = int(breaks[doc] - sizes[doc])
        mine[doc].append((start - at, end - at, q))
    for w, r in zip(words, mine):
        yield r, collapsed(w, r)


def periodic_runs(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start and period), collapsed (the words outside all repetitions, joined by a space)."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            runs, texts = [], []
            for found, words in scan(b.column("text").to_pylist(), options):
                runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in found])
                texts.append(b" ".join(words).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(runs, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text of the test documents: one in ten, chosen by the checksum of its doc_id, repeats a stretch of its own words from
    some word on to its end, white space between words reduced to a space. The others, and rows without doc_id, stay as they are."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
    at = g % F.greatest(n, F.lit(1))
    period = F.lit(1) + F.floor((n - at) / (F.lit(3) + g % 8)).cast("long")
    part = F.slice(words, (at + 1).cast("int"), period.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(part, F.ceil((n - at) / period).cast("int"))), F.lit(1), (n - at).cast("int"))
    head = F.when(at > 0, F.slice(words, F.lit(1), at.cast("int"))).otherwise(F.array().cast("array<string>"))
    text = F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def digests(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the run that repeats most (ties: smallest start, then period), runs_sha256, collapsed_sha256."""

    def order(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        first = (x > y) | ((x == y) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
        return F.when(first, -1).otherwise(1)

    best = F.get(F.array_sort("runs", order), F.lit(0))
    line = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = periodic_runs(docs, options).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    )
    exponent = F.expr("(1000 * best.length) div best.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")
