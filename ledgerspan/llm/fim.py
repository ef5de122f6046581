"""Fill-in-middle transformation: a text is cut at two unit ends into prefix, middle and suffix, and put together again with marks.

The UTF-8 bytes of a batch are viewed as 64-bit words. Unit-ending bytes are marked in all eight bytes of a word by
arithmetic, bitwise_count counts them per word, and a cumulative sum over the words is searched for the word that holds the k-th unit end;
the place within that word is resolved by clearing its lower marks. The same counts over character starts give lengths in code points.

A unit is a line with its line feed, or what follows the last one. Three hashes of seed and doc_id choose the two cuts and the
form, so reruns agree. Forms: psm `<P>prefix<S>suffix<M>middle`, spm `<S>suffix<P>prefix<M>middle`, plain (the text as it is).

Defined results: null text counts as empty; an empty text, or one that contains a mark, stays plain with null lengths, so `restore` is always
exact. A null doc_id hashes as an empty string. Repeated rows get equal rows. A text of any length is one row and costs a few
times its bytes in one task. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .arrow import small_batches, strings, text_bytes
from .common import importable

LOW7, HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
LINE_FEEDS = np.uint64(0x0A0A0A0A0A0A0A0A)
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Options:
    """Percentages: `rate` of the texts are transformed, `spm` of those in suffix-first form."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def __post_init__(self):
        if any(m[:1] != "<" or "<" in m[1:] or m[-1:] != ">" or ">" in m[:-1] or len(m) < 3 for m in self.marks) or len(set(self.marks)) < 3:
            raise ValueError("marks must be three different strings of the form <name>, so that texts and marks cannot form one together")


def line_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is a line feed: a byte is zero after the xor, and only then does adding 0x7F to its low bits, or the byte itself, leave the high bit clear."""
    x = words ^ LINE_FEEDS
    return ~(((x & LOW7) + LOW7) | x) & HIGH


def char_starts(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that does not continue a character (a continuing byte has bit 7 set and bit 6 clear)."""
    return ~(words & ~(words << np.uint64(1))) & HIGH


class Marks:
    """Marked bytes of a buffer, for counting them before a byte and finding the k-th one."""

    def __init__(self, marked: np.ndarray):
        self.marked = marked
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(marked), dtype=np.int64)))

    def count(self, at: np.ndarray) -> np.ndarray:
        """Marks in the bytes before each place."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        padded = np.append(self.marked, np.uint64(0))
        low = padded[word] & ((np.uint64(1) << (byte * np.uint64(8))) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def find(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th mark of the buffer, from 0."""
        word = np.searchsorted(self.before, k, side="right") - 1
        rest, bits = k - self.before[word], self.marked[word].copy()
        while (rest > 0).any():  # at most seven times
            bits = np.where(rest > 0, bits & (bits - np.uint64(1)), bits)
            rest = rest - (rest > 0)
        lowest = bits & (~bits + np.uint64(1))
        return word * 8 + (np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) >> 3)


def as_words(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, filled up with zeros (no line feeds; what they count as starts lies behind every text)."""
    padded = np.zeros(-(-len(data) // 8) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8").astype(np.uint64, copy=False)


def numbers(seed: int, doc_ids: list) -> np.ndarray:
    """Four unsigned 32-bit numbers per document."""
    digests = (hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in doc_ids)
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)


def cut(column: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, and byte offsets within the text of the ends of prefix and middle, and both lengths in code points.
    `chosen` holds two numbers per row; each modulo n + 1 is the number of units before a cut."""
    data, offsets = text_bytes(column)
    words = as_words(data)
    ends, starts = Marks(line_ends(words)), Marks(char_starts(words))
    first, last = offsets[:-1], offsets[1:]
    before = ends.count(first)
    complete = ends.count(last) - before
    closed = np.zeros(len(first), bool)
    full = last > first
    closed[full] = data[last[full] - 1] == 0x0A
    n = complete + (full & ~closed)
    places = []
    for k in (np.minimum(*(chosen % (n + 1)[:, None]).T), np.maximum(*(chosen % (n + 1)[:, None]).T)):
        inside = (k > 0) & (k <= complete)
        place = np.where(k > 0, last, first)
        place[inside] = ends.find((before + k - 1)[inside]) + 1
        places.append(place)
    chars = [starts.count(p) for p in (first, *places)]
    return n, places[0] - first, places[1] - first, chars[1] - chars[0], chars[2] - chars[1]


def _formatted(batch: pa.RecordBatch, options: Options) -> pa.RecordBatch:
    column = strings(batch.column("text"))
    h = numbers(options.seed, batch.column("doc_id").to_pylist())
    n, a, b, prefix_chars, middle_chars = cut(column, h[:, :2])
    marked = np.zeros(len(column), bool)
    for mark in options.marks:
        marked |= pc.match_substring(column, mark).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h[:, 2] % 100 >= options.rate)
    spm = h[:, 3] % 100 < options.spm
    p, s, m = (x.encode() for x in options.marks)
    out = []
    for text, i, j, is_plain, is_spm in zip(column.to_pylist(), a.tolist(), b.tolist(), plain.tolist(), spm.tolist()):
        if is_plain:
            out.append(text)
            continue
        raw = text.encode()
        parts = (s, raw[j:], p, raw[:i], m, raw[i:j]) if is_spm else (p, raw[:i], s, raw[j:], m, raw[i:j])
        out.append(b"".join(parts).decode())
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(prefix_chars, mask=plain), pa.array(middle_chars, mask=plain), pa.array(out, pa.string())],
        ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def transform(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points), output."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            yield _formatted(batch, options)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def restore(formatted: DataFrame, options: Options = Options()) -> DataFrame:
    """The rows of `transform` with `restored`: the text, rebuilt from output and form alone."""
    p, s, m = options.marks
    middle, head = F.substring_index("output", m, -1), F.substring_index("output", m, 1)
    psm = F.concat(F.substring_index(F.substring_index(head, s, 1), p, -1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(F.substring_index(head, p, 1), s, -1))
    return formatted.withColumn("restored", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("output")))


def digests(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    sha = {f"{c}_sha256": F.sha2(F.col(c), 256) for c in ("output", "restored")}
    return restore(transform(docs, options), options).withColumns(sha).drop("output", "restored")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l FROM documents),
k AS (SELECT *, len(l) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM k),
p AS (SELECT *, array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:n], '') AS suf,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""
