r"""Chat formatting by columnar byte assembly.

Turns arrive sorted; a batch of conversations becomes one preallocated buffer. Segment lengths give
offsets by a cumulative sum, and headers, roles and texts are scattered into it by index arrays; the
buffer is the value buffer of the resulting Arrow column.

A turn reads `<s>[role] text</s>`. Inside roles and texts each of the bytes \ < [ ] is preceded by a
backslash, so no text can form a mark and `parse` restores every text.

Defined results: null role and null text count as empty; a null conv_id is a conversation of its own; turns
are ordered by turn (null first), then role and text; repeated rows are repeated turns. A conversation
is one output row and is held by one task. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .arrow import strings, text_bytes
from .common import importable

OPEN, MIDDLE, CLOSE, ESCAPE = b"<s>[", b"] ", b"</s>", 0x5C
LOSS_ROLE = "assistant"
_ESCAPED = np.isin(np.arange(256), np.frombuffer(rb"\<[]", np.uint8))
_TURN = re.compile(r"<s>\[((?:[^\\\]]|\\.)*)\] ((?:[^\\<]|\\.)*)</s>", re.DOTALL)
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)

FORMATTED = "conv_id long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"


def _fill(out: np.ndarray, at: np.ndarray, fixed: bytes) -> None:
    for i, b in enumerate(fixed):
        out[at + i] = b


class _Escaped:
    """A text column and the lengths that its rows take once escaped."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_bytes(column)
        self.mask = _ESCAPED[self.data]
        self.before = np.concatenate([[0], np.cumsum(self.mask)])
        self.lengths = np.diff(self.offsets) + self.before[self.offsets[1:]] - self.before[self.offsets[:-1]]

    def scatter(self, out: np.ndarray, at: np.ndarray) -> None:
        """Row i goes to out[at[i]:]."""
        shift = at - self.offsets[:-1] - self.before[self.offsets[:-1]]
        place = np.arange(len(self.data)) + np.repeat(shift, np.diff(self.offsets)) + self.before[:-1] + self.mask
        out[place] = self.data
        out[place[self.mask] - 1] = ESCAPE


def assemble(conv_id: pa.Array, role: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """Rows of whole conversations, in order -> one row per conversation."""
    ids = conv_id.combine_chunks() if isinstance(conv_id, pa.ChunkedArray) else conv_id
    n = len(ids)
    known, value = ids.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    first = np.concatenate([[True], (known[1:] != known[:-1]) | (value[1:] != value[:-1])])[:n]
    starts = np.append(np.flatnonzero(first), n)
    roles, texts = _Escaped(role), _Escaped(text)
    lengths = len(OPEN) + roles.lengths + len(MIDDLE) + texts.lengths + len(CLOSE)
    ends = np.cumsum(lengths)
    at = ends - lengths
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    _fill(out, at, OPEN)
    at_role = at + len(OPEN)
    roles.scatter(out, at_role)
    at_middle = at_role + roles.lengths
    _fill(out, at_middle, MIDDLE)
    at_text = at_middle + len(MIDDLE)
    texts.scatter(out, at_text)
    _fill(out, at_text + texts.lengths, CLOSE)
    offsets = np.append(at[starts[:-1]], out.size) if n else np.zeros(1, np.int64)
    chars = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])  # code points before each byte
    loss = pc.equal(strings(role), LOSS_ROLE).to_numpy(zero_copy_only=False).astype(bool)
    base = chars[np.repeat(offsets[:-1], np.diff(starts))]
    per_conv = np.add.reduceat(loss.astype(np.int64), starts[:-1]) if n else np.zeros(0, np.int64)
    spans = pa.array(np.concatenate([[0], np.cumsum(per_conv)]), pa.int32())
    span = lambda x: pa.ListArray.from_arrays(spans, pa.array((chars[x] - base)[loss], pa.int64()))
    formatted = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(starts[:-1])), pa.array(np.diff(starts), pa.int64()), formatted.cast(pa.string()), span(at_text), span(at_text + texts.lengths)],
        ["conv_id", "n_turns", "formatted", "loss_start", "loss_end"],
    )


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last conversation of a batch waits for the next batch."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        ids = table["conv_id"].to_pylist()
        cut = len(ids)
        while cut and ids[cut - 1] == ids[-1]:
            cut -= 1
        if cut:
            head = table.slice(0, cut)
            yield assemble(head["conv_id"], head["role"], head["text"])
        rest = table.slice(cut)
    if rest is not None:
        yield assemble(rest["conv_id"], rest["role"], rest["text"])


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, n_turns, formatted, and the spans of the loss mask in code points."""
    importable(turns.sparkSession)
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; refuses anything that is not whole turns."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((_UNESCAPE.sub(r"\1", m[1]), _UNESCAPE.sub(r"\1", m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a turn at character {at}")
    return turns


def loss_text(formatted: str, starts: list[int], ends: list[int]) -> str:
    return _UNESCAPE.sub(r"\1", "".join(formatted[a:b] for a, b in zip(starts, ends)))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            turns, loss = parse(r["formatted"]), loss_text(r["formatted"], r["loss_start"], r["loss_end"])
            rows.append((r["conv_id"], len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), len(r["formatted"])))
        cols = list(zip(*rows)) or [[]] * 6
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold, from the formatted text and its loss mask alone."""
    return chats.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
             CAST(sum(10 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[\]]', '', 'g'))) AS BIGINT) AS formatted_chars
      FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
