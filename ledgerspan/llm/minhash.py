"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A signature has SYMBOLS minima of 16 bits each. Two documents of similarity s differ in about SYMBOLS (1 - s) symbols; the join
finds every pair that differs in at most MAX_DIFFERENT of them: over CHUNKS chunks, some chunk then has at most
MAX_DIFFERENT // CHUNKS = 1 error (pigeonhole), and enumerating that error means one key per chunk and left-out symbol. A pair
at similarity 0.8 differs in more with probability below 1e-5.

Candidates become links only by their full shingle sets. Equal sets are one node from the start. Then:
* each node is checked against the least member of the key group that it meets most often (linear in the members);
* key groups that still hold several components are checked whole: small ones as pairs, large ones in blocks, where
  a task holds the sets of two blocks, counts all intersections by matrix products and returns a spanning forest, so no pair is emitted
  and no partner is left out.

Defined results: A-Z are lowered, words are split at ASCII white space; null text counts as empty; a text without words has an empty
set and no link; with fewer words than a shingle the whole sequence is one. A node is a set, whoever has it: rows that share a doc_id but
differ in text keep all links of each text, and near_duplicates puts them in one component. Rows without doc_id are compared like the
others; their component_id is the least doc_id that their links reach, null if there is none. drop_near_duplicates decides by text
alone, so it needs no doc_id and never drops a row for one it shares; of rows equal in doc_id and text one stays, rows without words all
stay. Shingles are compared by 64-bit hashes. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .arrow import small_batches, text_bytes
from .common import stage, text_hashes, with_group
from .components import components

SYMBOLS, CHUNKS, WIDTH = 48, 12, 4
MAX_DIFFERENT = 2 * CHUNKS - 1
SMALL_GROUP, BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 16, 1024, 400_000, 4096

_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BASE = _U(0x100000001B3)


@dataclass(frozen=True)
class Options:
    words: int = 5
    percent: int = 80


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _ODD[1]
    x = (x ^ (x >> _U(29))) * _ODD[2]
    return x ^ (x >> _U(32))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    up = down = np.ones(1, _U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = _U(pow(int(_BASE), -1, 1 << 64))
            make = lambda b: np.concatenate([[_U(1)], np.multiply.accumulate(np.full(n - 1, b, _U))])
            cls.up, cls.down = make(_BASE), make(inverse)
        return cls.up, cls.down


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a text column, and where each row's words start in that array."""
    n = len(data)
    inside = ~_SPACE[data]
    at_start = np.zeros(n + 1, bool)
    at_start[offsets[:-1]] = True
    starts = np.flatnonzero(inside & (at_start[:n] | ~np.concatenate([[False], inside[:-1]]) if n else inside))
    after = np.concatenate([~inside[1:], [True]]) if n else inside
    ends = np.flatnonzero(inside & (after | at_start[1:])) + 1
    up, down = _Powers.get(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum((_LOWER[data].astype(_U) + _U(1)) * up[:n], out=sums[1:])
    hashes = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _ODD[3])
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words (repeats included) and where each row's start."""
    count = np.diff(rows)
    per_row = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(per_row)])
    out = np.empty(at[-1], _U)
    n = len(words)
    if n >= size:
        full = np.zeros(n - size + 1, _U)
        for j in range(size):
            full = (full ^ words[j : j + n - size + 1]) * _ODD[j % len(_ODD)]
            full ^= full >> _U(32)
        inside = np.repeat(rows[:-1] - at[:-1], np.where(count >= size, per_row, 0))
        place = np.flatnonzero(np.repeat(count >= size, per_row))
        out[place] = _mixed(full[place + inside])
    for r in np.flatnonzero((count > 0) & (count < size)):  # the whole text is one shingle
        x = _U(int(count[r]))
        for w in words[rows[r] : rows[r + 1]].tolist():
            x = _U(((int(x) ^ w) * int(_ODD[5])) & 0xFFFFFFFFFFFFFFFF)
            x ^= x >> _U(32)
        out[at[r]] = x
    return out, at


def row_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    hashes, at = shingle_hashes(*word_hashes(*text_bytes(column)), size)
    for a, b in zip(at, at[1:]):
        yield np.unique(hashes[a:b])


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SYMBOLS minima of 16 bits for each non-empty row."""
    short = (hashes >> _U(32)).astype(np.uint32)
    out = np.empty((len(at), SYMBOLS), np.uint16)
    v = np.empty_like(short)
    for j in range(SYMBOLS):
        np.bitwise_xor(short, _XOR[j], out=v)
        np.multiply(v, _MUL[j], out=v)
        out[:, j] = (np.minimum.reduceat(v, at) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


SKETCH = "doc_id long, h1 long, h2 long, n_shingles long, digest binary, signature binary"


def sketch(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """Text hashes, set size, digest of the set and signature of every whole text."""
    size = options.words

    def run(batches):
        for b in small_batches(batches, "text"):
            sets = list(row_sets(b.column("text"), size))
            lengths = np.array([len(s) for s in sets], np.int64)
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            some = np.flatnonzero(lengths)
            signature: list[bytes | None] = [None] * len(sets)
            if some.size:
                at = np.cumsum(lengths[some]) - lengths[some]
                for r, s in zip(some, signatures(np.concatenate([sets[r] for r in some]), at)):
                    signature[r] = s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "h1", "h2")), pa.array(lengths), pa.array(digest, pa.binary()), pa.array(signature, pa.binary())], ["doc_id", "h1", "h2", "n_shingles", "digest", "signature"]
            )

    h1, h2 = text_hashes(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), "text").mapInArrow(run, SKETCH)


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """For each signature row, the keys of all chunks with each one symbol left out."""
    n = len(signature)
    chunks = signature.reshape(n, CHUNKS, WIDTH).astype(_U)
    keys = np.empty((n, CHUNKS, WIDTH), _U)
    for left_out in range(WIDTH):
        k = np.zeros((n, CHUNKS), _U)
        for j in range(WIDTH):
            if j != left_out:
                k = (k << _U(16)) | chunks[:, :, j]
        keys[:, :, left_out] = _mixed(k * _ODD[0] + (np.arange(CHUNKS, dtype=_U) * _U(WIDTH) + _U(left_out + 1)) * _ODD[4])
    return keys.reshape(n, SYMBOLS)


def _emit_keys(batches):
    for b in batches:
        if b.num_rows:
            signature = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            keys = chunk_keys(signature).view(np.int64)
            ids = np.repeat(b.column("id").to_numpy(zero_copy_only=False), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])


def similar(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    return 100 * common >= percent * (a + b - common)


def _verify(percent: int):
    def run(batches):
        for b in batches:
            left, right = b.column("left").to_pylist(), b.column("right").to_pylist()
            ok = np.zeros(len(left), bool)
            for i, (x, y) in enumerate(zip(left, right)):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    ok[i] = similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], ["u", "v"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("right"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "left", "right").mapInArrow(_verify(percent), "u long, v long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products over the shingles that occur more than once."""
    n = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, name, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    keep = times[name] > 1
    row, column = row[keep], shared[name[keep]]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(column[-1]) + 1 if column.size else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        dense = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - first)), np.float32)
        dense[row[a:b], column[a:b] - first] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def _link_blocks(percent: int):
    """Two blocks of one key group -> a spanning forest of their links between different components."""

    def run(table: pa.Table) -> pa.Table:
        ids, parts = np.array(table["id"].to_pylist(), np.int64), table["component"].to_pylist()
        first = np.unique(ids, return_index=True)[1]
        ids, parts = ids[first], [parts[i] for i in first]
        raw = table["shingles"]
        sets = [np.frombuffer(raw[int(i)].as_py(), _U) for i in first]
        sizes = np.array([len(s) for s in sets])
        common = intersections(sets)
        names = {c: i for i, c in enumerate(dict.fromkeys(parts))}
        group = np.array([names[c] for c in parts])
        u, v = np.nonzero(np.triu(similar(common, sizes[:, None], sizes[None, :], percent) & (group[:, None] != group[None, :]), 1))
        root = list(range(len(names)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = []
        for a, b in zip(u.tolist(), v.tolist()):
            x, y = find(int(group[a])), find(int(group[b]))
            if x != y:
                root[y] = x
                links.append((int(ids[a]), int(ids[b])))
        cols = list(zip(*links)) or [[], []]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], names=["u", "v"])

    return run


def links(nodes: DataFrame, docs: DataFrame, options: Options) -> DataFrame:
    """u, v: verified links that connect every component of nodes(id, digest, least, signature); least is a doc_id that has the set."""
    percent, size = options.percent, options.words
    keys = stage(nodes.select("id", "signature").mapInArrow(_emit_keys, "key long, id long"), "near-keys")
    groups = keys.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = stage(with_group(keys, stage(groups, "near-groups"), "key", "members"), "near-met")

    def make_sets(batches):
        for b in small_batches(batches, "text"):
            sets = [s.tobytes() for s in row_sets(b.column("text"), size)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"])

    # the texts of each wanted node's doc_id; of several that share it, the set decides
    wanted = stage(nodes.join(met.select("id").distinct(), "id", "left_semi").select("id", "digest", "least"), "near-wanted")
    ids = wanted.select(F.col("least").alias("w_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["w_id"]), "left_semi").select("text")
    sets = stage(texts.mapInArrow(make_sets, "digest binary, shingles binary").join(wanted.select("id", "digest"), "digest").select("id", "shingles"), "near-sets")
    # rows of one doc_id and text give a set again; only these are sorted to keep one
    again = stage(sets.groupBy("id").count().filter("count > 1").select("id"), "near-again")
    if not again.isEmpty():
        sets = stage(sets.join(again, "id", "left_anti").unionByName(sets.join(again, "id", "left_semi").dropDuplicates(["id"])), "near-sets")

    most = Window.partitionBy("id").orderBy(F.desc("times"), "least")
    star = met.filter("id <> least").groupBy("id", "least").agg(F.count(F.lit(1)).alias("times")).withColumn("place", F.row_number().over(most)).filter("place = 1")
    found = stage(verified(star.select(F.col("least").alias("u"), F.col("id").alias("v")), sets, percent), "near-star")

    part = components(found).withColumnRenamed("id", "c_id")
    placed = stage(met.join(part, met["id"] == part["c_id"], "left").select("key", "id", "members", F.coalesce("component", "id").alias("component")), "near-placed")
    open_ = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("size")).filter("a <> b")
    rest = stage(with_group(placed.drop("members"), stage(open_.select("key", "size"), "near-open"), "key", "size"), "near-rest")

    small = rest.filter(F.col("size") <= SMALL_GROUP)
    left, right = small.select("key", F.col("id").alias("u"), F.col("component").alias("cu")), small.select("key", F.col("id").alias("v"), F.col("component").alias("cv"))
    pairs = left.join(right, "key").filter("u < v and cu <> cv").select("u", "v").distinct()
    found = found.unionByName(stage(verified(pairs, sets, percent), "near-pairs"))

    large = rest.filter(F.col("size") > SMALL_GROUP).join(sets, "id")
    weight = F.length("shingles") / 8
    sizes = large.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(weight) / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("size"))
    large = with_group(stage(large.drop("size"), "near-large"), stage(sizes, "near-blocks"), "key", "size")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = large.withColumn("own", own).select("key", "id", "component", "shingles", "own", other.alias("other"))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    blocks = dealt.groupBy("key", "low", "high").applyInArrow(_link_blocks(percent), "u long, v long")
    return found.unionByName(stage(blocks, "near-block-links"))


def _placed(docs: DataFrame, options: Options, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """(rows of the sketch, digest with copies, least doc_id, component and the component's least doc_id). With by_id, sets that share a doc_id are linked."""
    rows = stage(sketch(docs, options), "near-sketch")
    full = rows.filter("n_shingles > 0")
    # numbered where it is written: what is read back never changes
    each = full.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("signature").alias("signature"))
    heads = stage(each.withColumn("id", F.monotonically_increasing_id()), "near-heads")
    found = links(heads, docs, options)
    if by_id:
        held = with_group(full.filter("doc_id is not null").select("doc_id", "digest"), heads.select("digest", "copies", "id"), "digest", "copies").select("doc_id", "id")
        several = held.groupBy("doc_id").agg(F.min("id").alias("u"), F.max("id").alias("last")).filter("u <> last")
        found = found.unionByName(stage(held.join(several, "doc_id").filter("id <> u").select("u", F.col("id").alias("v")).distinct(), "near-same-id"))
    part = components(found).withColumnRenamed("id", "c_id")
    placed = stage(heads.join(part, heads["id"] == part["c_id"], "left").select("digest", "copies", "least", F.coalesce("component", "id").alias("component")), "near-components")
    firsts = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    return rows, stage(with_group(placed, stage(firsts, "near-firsts"), "component", "members").drop("members"), "near-placed-heads")


def near_duplicates(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    rows, placed = _placed(docs, options, True)
    linked = with_group(rows.filter("n_shingles > 0").select("doc_id", "n_shingles", "digest"), placed.select("digest", "copies", "component_id"), "digest", "copies")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """One document of each component (the least doc_id, those without last), with all its columns."""
    rows, placed = _placed(docs, options, False)
    best = placed.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "digest")).alias("b")).select("b.digest", F.col("b.least").alias("b_id"))
    full = rows.filter("n_shingles > 0").select("doc_id", "h1", "h2", "digest")
    best = stage(best.join(placed.select("digest", "copies"), "digest"), "near-best")
    chosen = with_group(full, best, "digest", "copies").filter(F.col("doc_id").eqNullSafe(F.col("b_id"))).groupBy("digest").agg(F.min(F.struct("h1", "h2")).alias("h"), F.first("doc_id").alias("k_id"))
    stay = stage(chosen.select("k_id", F.col("h.h1").alias("k1"), F.col("h.h2").alias("k2")), "near-stay")
    h1, h2 = text_hashes(docs["text"])
    own = docs.withColumns({"_h1": h1, "_h2": h2})
    kept = own.join(stay, own["doc_id"].cast("long").eqNullSafe(stay["k_id"]) & (own["_h1"] == stay["k1"]) & (own["_h2"] == stay["k2"]), "left_semi")
    one = kept.withColumn("_place", F.row_number().over(Window.partitionBy("doc_id", "_h1", "_h2").orderBy("_h1"))).filter("_place = 1")
    empty = docs.filter(F.coalesce(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")), F.lit(0)) == 0)
    return one.select(docs.columns).unionByName(empty)
