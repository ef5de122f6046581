"""Removal of repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

A byte goes if it lies in a string of LENGTH bytes that also starts anywhere else, in the same text or another.

1. Every window of LENGTH bytes has an anchor: its least GRAM-byte hash, leftmost of equal ones. The choice depends on the
   window's bytes alone, so equal windows have equal anchors at equal offsets. Windows whose anchor occurs once in the
   corpus are unique and drop out; consecutive windows of one anchor form a segment.
2. Each task sorts the suffixes that start at its repeated anchors, joins equal segments, and sends them as front-coded
   runs (common prefix length and tail, compressed), one per receiving range of anchors.
3. A receiver merges the runs by a loser tree. A run's head carries the length of its common prefix with the last winner:
   the longer one wins unseen, and only heads of equal length are compared, from there on. The merge yields the common prefix of each
   suffix with its predecessor; what lies left of the anchors is ranked in the same way. The suffixes that share their first d
   bytes are neighbours, so a window at offset o is repeated exactly if another element has the same left class at depth o and
   the same right class at depth LENGTH - o.
4. An anchor with GROUP_LIMIT occurrences or more would make one receiver's group too large: its windows are counted one by one
   through 64-bit hashes instead: a task settles those that it holds more than once, and passes on each hash once.

Defined results: null text counts as empty; texts shorter than LENGTH stay whole. Rows that repeat doc_id and text are repeats
of each other and get equal rows. A null doc_id is carried through. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .arrow import runs, small_batches, text_bytes
from .common import stage, with_group

GRAM, CHUNK, FLUSH = 32, 4 << 20, 32 << 20
_U = np.uint64
_BASE, _ODD = 0x9E3779B97F4A7C15, (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
_PLACE = _U((1 << 24) - 1)  # low bits that hold a position while minima are taken


@dataclass(frozen=True)
class Options:
    length: int = 200
    group_limit: int = 20_000
    receiver_rows: int = 40_000


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position, by doubling."""
    h = (data.astype(_U) + _U(1)) * _ODD[0]
    h ^= h >> _U(32)
    width, power = 1, _BASE
    while width < GRAM:
        h = h[:-width] * _U(power) + h[width:]
        power, width = power * power % (1 << 64), width * 2
    h ^= h >> _U(29)
    h *= _ODD[1]
    return h ^ (h >> _U(32))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        h, done = np.minimum(h[:-done], h[done:]), done * 2
    rest = width - done
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


@dataclass
class Segments:
    """Runs of windows first..last (starts within their row) that share the anchor at `anchor`."""

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    hash: np.ndarray


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[Segments, np.ndarray, np.ndarray]]:
    """Segments of all rows, a chunk at a time, with the chunk's gram hashes and where row starts lie among them."""
    starts, sizes = offsets[:-1], np.diff(offsets)
    row = np.flatnonzero(sizes >= length)
    if not row.size:
        return
    # pieces of at most CHUNK windows; neighbours overlap by what a window needs
    pieces = -(-(sizes[row] - length + 1) // CHUNK)
    piece_row = np.repeat(row, pieces)
    base = (np.arange(len(piece_row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * CHUNK
    size = np.minimum(sizes[piece_row] - base, CHUNK + length - 1)
    group = np.cumsum(size) // CHUNK
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        at = np.concatenate([[0], np.cumsum(size[own])])
        b = data[runs(starts[piece_row[own]] + base[own], size[own])]
        h = grams(b)
        packed = (h & ~_PLACE) | np.arange(len(h), dtype=_U)
        least = (sliding_min(packed, length - GRAM + 1) & _PLACE).astype(np.int64)
        window = runs(at[:-1], size[own] - length + 1)
        anchor = least[window]
        new = np.ones(len(window), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(window)) - 1
        piece = np.searchsorted(at, window[first], "right") - 1
        shift = at[piece] - base[own][piece]
        yield Segments(piece_row[own][piece], window[first] - shift, window[last] - shift, anchor[first] - shift, h[anchor[first]]), h, shift


SUMMARY = "doc_id long, row_key long, n_bytes long, sha256 string, anchors array<long>"


def _summaries(length: int):
    def run(batches):
        for b in small_batches(batches, "text", CHUNK):
            data, offsets = text_bytes(b.column("text"))
            found: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
            for s, _, _ in segments(data, offsets, length):
                cuts = np.flatnonzero(np.diff(s.row)) + 1
                for r, part in zip(s.row[np.concatenate([[0], cuts])], np.split(s.hash.view(np.int64), cuts)):
                    found[r].append(part)
            lists = pa.array([np.concatenate(x) if x else np.zeros(0, np.int64) for x in found], pa.list_(pa.int64()))
            whole = [hashlib.sha256(data[a:z]).hexdigest() for a, z in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(np.diff(offsets), pa.int64()), pa.array(whole, pa.string()), lists], SUMMARY_NAMES)

    return run


SUMMARY_NAMES = ["doc_id", "row_key", "n_bytes", "sha256", "anchors"]


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of a and b, known to be start at least."""
    end, step = min(len(a), len(b)), 32
    while start < end:
        x, y = a[start : start + step], b[start : start + step]
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            different = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return start + n - (different.bit_length() + 7) // 8
        start, step = start + n, step * 2
    return end


@dataclass
class Run:
    """Sorted distinct elements: suffixes with the common prefix of each with the one before, what stands left of the
    anchor, and the places (row key, first window) where the element occurs."""

    suffix: list[bytes]
    prefix: list[int]
    left: list[bytes]
    places: list[tuple[np.ndarray, np.ndarray]]


def encode_run(elements: dict[tuple[bytes, bytes], list[tuple[int, int]]]) -> bytes:
    order = sorted(elements)
    prefix, tails, last = [], [], b""
    for suffix, _ in order:
        n = common_prefix(last, suffix, 0)
        prefix.append(n)
        tails.append(suffix[n:])
        last = suffix
    places = [elements[x] for x in order]
    head = np.array([prefix, [len(t) for t in tails], [len(x[1]) for x in order], [len(p) for p in places]], np.int32)
    where = np.array([y for p in places for y in p], np.int64).reshape(-1, 2)
    raw = b"".join([np.int32(len(order)).tobytes(), head.tobytes(), where.tobytes(), *tails, *(x[1] for x in order)])
    return zstandard.ZstdCompressor(level=3).compress(raw)


def decode_run(data: bytes) -> Run:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    head = np.frombuffer(raw, np.int32, 4 * n, 4).reshape(4, n)
    at = 4 + head.nbytes
    total = int(head[3].sum())
    where = np.frombuffer(raw, np.int64, 2 * total, at).reshape(-1, 2)
    at += where.nbytes
    suffix, last = [], b""
    for keep, size in zip(head[0].tolist(), head[1].tolist()):
        last = last[:keep] + raw[at : at + size]
        suffix.append(last)
        at += size
    left = []
    for size in head[2].tolist():
        left.append(raw[at : at + size])
        at += size
    cuts = np.cumsum(head[3])[:-1]
    return Run(suffix, head[0].tolist(), left, list(zip(np.split(where[:, 0], cuts), np.split(where[:, 1], cuts))))


def merge(sorted_runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Loser-tree merge of (suffixes, prefixes): (run, index) in order, and each one's common prefix with its predecessor."""
    k = 1
    while k < len(sorted_runs):
        k *= 2
    suffixes = [r[0] for r in sorted_runs] + [[]] * (k - len(sorted_runs))
    prefixes = [r[1] for r in sorted_runs] + [[]] * (k - len(sorted_runs))
    at = [0] * k
    head: list[bytes | None] = [s[0] if s else None for s in suffixes]
    known = [0] * k  # common prefix of the head with the last winner
    tree = [0] * k  # losers; tree[0] is unused

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser then knows its common prefix with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] > known[b]:
            return a, b
        if known[a] < known[b]:
            return b, a
        n = common_prefix(x, y, known[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def start(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = play(start(2 * node), start(2 * node + 1))
        return winner

    winner = start(1) if k > 1 else 0
    order, common = [], []
    while head[winner] is not None:
        order.append((winner, at[winner]))
        common.append(known[winner])
        at[winner] += 1
        i = at[winner]
        more = i < len(suffixes[winner])
        head[winner] = suffixes[winner][i] if more else None
        known[winner] = prefixes[winner][i] if more else 0
        node = (winner + k) // 2
        while node:
            winner, tree[node] = play(winner, tree[node])
            node //= 2
    return order, common


def left_ranks(left: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings read backwards, and the common prefix of each with its predecessor in that order."""
    lengths = np.array([len(x) for x in left])
    width = max(8, -(-int(lengths.max()) // 8) * 8)
    table = np.zeros((len(left), width), np.uint8)
    flat = np.frombuffer(b"".join(x[::-1] for x in left), np.uint8)
    table[np.repeat(np.arange(len(left)), lengths), runs(np.zeros(len(left), np.int64), lengths)] = flat
    words = table.view(">u8").astype(_U)
    order = np.lexsort((lengths, *words.T[::-1]))  # of equal padded strings the shorter comes first
    table, lengths = table[order], lengths[order]
    same = np.minimum(lengths[1:], lengths[:-1])
    different = table[1:] != table[:-1]
    first = np.where(different.any(axis=1), different.argmax(axis=1), width)
    return order, np.concatenate([[0], np.minimum(first, same)])


def repeated_offsets(suffix_sizes: np.ndarray, left_sizes: np.ndarray, weights: np.ndarray, common: np.ndarray, left: list[bytes], length: int) -> np.ndarray:
    """Elements in suffix order -> for each the offsets (window start before its anchor) at which its window is repeated."""
    n = len(left)
    order, left_common = left_ranks(left)
    low, high = length - suffix_sizes, left_sizes
    out = np.zeros((n, int(high.max()) + 1), bool)
    for o in range(int(low.min()), int(high.max()) + 1):
        own = np.flatnonzero((low <= o) & (o <= high))
        if not own.size:
            continue
        right = np.cumsum(common < length - o)
        by_left = np.empty(n, np.int64)
        by_left[order] = np.cumsum(left_common < o)
        _, name = np.unique(by_left[own] * (n + 2) + right[own], return_inverse=True)
        out[own, o] = np.bincount(name, weights[own])[name] > 1
    return out


PLACES = "row_key long, start long, stop long"


def _receive(length: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [decode_run(x.as_py()) for x in table["run"]]
        order, common = merge([(p.suffix, p.prefix) for p in parts])
        left = [parts[r].left[i] for r, i in order]
        places = [parts[r].places[i] for r, i in order]
        weights = np.array([len(p[0]) for p in places])
        sizes = np.array([len(parts[r].suffix[i]) for r, i in order])
        left_sizes = np.array([len(x) for x in left])
        hit = repeated_offsets(sizes, left_sizes, weights, np.array(common), left, length)
        # maximal runs of offsets; a larger offset is an earlier window
        edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        element, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        count = weights[element]
        keys = np.concatenate([places[e][0] for e in element]) if element.size else np.zeros(0, np.int64)
        first = np.concatenate([places[e][1] for e in element]) if element.size else np.zeros(0, np.int64)
        start = first + np.repeat(left_sizes[element] - high, count)
        stop = first + np.repeat(left_sizes[element] - low, count) + length
        return pa.table([pa.array(keys), pa.array(start.astype(np.int64)), pa.array(stop.astype(np.int64))], names=["row_key", "start", "stop"])

    return run


def _send(length: int, receivers: int):
    """Rows with their repeated anchors -> front-coded runs, a row per receiver and flush; frequent anchors -> window hashes."""

    types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def batch(n, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(SENT_NAMES, types)], SENT_NAMES)

    def rows(waiting, windows):
        for receiver, elements in waiting.items():
            yield batch(1, receiver=[receiver], run=[encode_run(elements)])
        if not windows:
            return
        # windows that this task holds more than once are settled here, and count once for the others
        hashes, keys, starts = (np.concatenate(x) for x in zip(*windows))
        names, name, times = np.unique(hashes, return_inverse=True, return_counts=True)
        again = times[name] > 1
        yield batch(int((~again).sum()), hash=hashes[~again], row_key=keys[~again], start=starts[~again], weight=np.ones(int((~again).sum()), np.int32))
        several = names[times > 1]
        yield batch(len(several), hash=several, weight=np.full(len(several), 2, np.int32))
        keys, starts = keys[again], starts[again]
        order = np.lexsort((starts, keys))
        keys, starts = keys[order], starts[order]
        if len(keys):
            first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (starts[1:] > starts[:-1] + 1)])
            last = np.append(np.flatnonzero(first)[1:], len(keys)) - 1
            yield batch(len(last), row_key=keys[first], start=starts[first], stop=starts[last] + length)

    def run(batches):
        waiting: dict[int, dict] = {}
        windows, size = [], 0
        for b in small_batches(batches, "text", CHUNK):
            data, offsets = text_bytes(b.column("text"))
            raw = memoryview(data)
            keys = b.column("row_key").to_numpy(zero_copy_only=False)
            few, many = (np.unique(b.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) if isinstance(b.column(c), pa.ChunkedArray) else b.column(c).flatten().to_numpy(zero_copy_only=False)).astype(np.int64) for c in ("few", "many"))
            for s, h, shift in segments(data, offsets, length):
                own = s.hash.view(np.int64)
                for i in np.flatnonzero(np.isin(own, few)).tolist():
                    base = offsets[s.row[i]]
                    middle = base + s.anchor[i]
                    left, suffix = bytes(raw[base + s.first[i] : middle]), bytes(raw[middle : base + s.last[i] + length])
                    elements = waiting.setdefault(int(s.hash[i] % _U(receivers)), {})
                    if (suffix, left) not in elements:
                        size += len(left) + len(suffix) + 200
                        elements[suffix, left] = []
                    elements[suffix, left].append((int(keys[s.row[i]]), int(s.first[i])))
                    size += 100
                for i in np.flatnonzero(np.isin(own, many)).tolist():
                    at = np.arange(s.first[i], s.last[i] + 1) + shift[i]
                    mixed = np.zeros(len(at), _U)
                    for j in [*range(0, length - GRAM, GRAM), length - GRAM]:  # grams that cover the window
                        mixed = (mixed ^ h[at + j]) * _ODD[0]
                        mixed ^= mixed >> _U(31)
                    windows.append((mixed.view(np.int64), np.full(len(at), keys[s.row[i]], np.int64), np.arange(s.first[i], s.last[i] + 1)))
                    size += 24 * len(at)
                if size > FLUSH:
                    yield from rows(waiting, windows)
                    waiting, windows, size = {}, [], 0
        yield from rows(waiting, windows)

    return run


SENT = "receiver int, run binary, hash long, row_key long, start long, stop long, weight int"
SENT_NAMES = ["receiver", "run", "hash", "row_key", "start", "stop", "weight"]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return own.withColumn("row_key", F.xxhash64("doc_id", "text"))


def repeated_places(docs: DataFrame, summary: DataFrame, options: Options = Options()) -> DataFrame:
    """row_key, start, stop of byte ranges that repeated strings cover."""
    spark, length = docs.sparkSession, options.length
    anchors = summary.select(F.explode("anchors").alias("hash"), "row_key")
    counts = anchors.groupBy("hash").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    counts = stage(counts, "suffix-anchors")
    marks = with_group(anchors, counts, "hash", "copies").groupBy("row_key").agg(
        F.collect_set(F.when(F.col("copies") < options.group_limit, F.col("hash"))).alias("few"),
        F.collect_set(F.when(F.col("copies") >= options.group_limit, F.col("hash"))).alias("many"),
    )
    total = counts.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    receivers = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // options.receiver_rows))
    marked = _keyed(docs).join(marks, "row_key").select("row_key", "text", "few", "many")
    sent = stage(marked.mapInArrow(_send(length, receivers), SENT), "suffix-runs")
    merged = sent.filter("receiver is not null").select("receiver", "run").groupBy("receiver").applyInArrow(_receive(length), PLACES)
    windows = sent.filter("hash is not null").select("hash", "row_key", "start", "weight")
    again = windows.groupBy("hash").agg(F.sum("weight").alias("copies")).filter("copies > 1")
    single = windows.filter("row_key is not null").drop("weight")
    frequent = with_group(single, stage(again, "suffix-windows"), "hash", "copies").select("row_key", "start", (F.col("start") + length).alias("stop"))
    settled = sent.filter("stop is not null").select("row_key", "start", "stop")
    return stage(merged.unionByName(frequent).unionByName(settled), "suffix-places")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(batches):
    for b in small_batches(batches, "text", CHUNK):
        data, offsets = text_bytes(b.column("text"))
        rows = []
        for doc_id, places, a, z in zip(b.column("doc_id").to_pylist(), b.column("places").to_pylist(), offsets, offsets[1:]):
            cover = np.zeros(z - a + 1, np.int32)
            np.add.at(cover, [p["start"] for p in places], 1)
            np.add.at(cover, [p["stop"] for p in places], -1)
            gone = np.cumsum(cover)[:-1] > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            kept = data[a:z][~gone].tobytes()
            rows.append((doc_id, int(z - a), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*rows)) or [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeated(docs: DataFrame, options: Options = Options(), with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes (a cut may split a character)."""
    keyed = _keyed(docs)
    summary = stage(keyed.mapInArrow(_summaries(options.length), SUMMARY), "suffix-summary")
    places = repeated_places(docs, summary, options)
    by_row = places.groupBy("row_key").agg(F.collect_list(F.struct("start", "stop")).alias("places"))  # ranges of one text
    cut = keyed.join(by_row, "row_key").select("doc_id", "text", "places").mapInArrow(_cut, RESULT)
    whole = summary.join(places.select("row_key").distinct(), "row_key", "left_anti")
    if with_bytes:
        texts = keyed.join(places.select("row_key").distinct(), "row_key", "left_anti")
        whole = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("text").cast("binary").alias("kept"))
    else:
        cut, whole = cut.drop("kept"), whole.select("doc_id", "n_bytes", "sha256")
    zero = F.lit(0).cast("long")
    same = [F.col("kept")] if with_bytes else []
    return cut.unionByName(whole.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha256").alias("kept_sha256"), *same))
