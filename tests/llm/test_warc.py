"""Archives: exact round trip, plain record types, and what the format says about its frames."""

import hashlib
import io
import random
import struct

import zstandard

from ledgerspan.llm import warc as W
from ledgerspan.llm.common import stage_path


def pages():
    rng = random.Random(6)
    shared = ["<p>" + "shared page " * 30, "é" * 60, "short", "", None]
    rows = [(i, rng.choice([f"http://x/{i}", None, "http://x/a b\r\nX: 1"]), rng.choice(shared + [f"<html>{rng.random()}{'body ' * rng.randint(0, 400)}\r\n\r\n</html>" for _ in range(6)]), "c", "c") for i in range(400)]
    return rows + [(None, "http://n", shared[0], "c", "c"), (7, rows[7][1], rows[7][2], "c", "c"), (1000, "http://big", "z" * 3_000_000, "c", "c")]


def test_round_trip(spark):
    rows = pages()
    uri = stage_path(spark, "warc-test")
    manifest = W.write(spark.createDataFrame(rows, "page_id long, url string, html string, digest string, revisit string"), uri, W.Options(sample_bytes=50_000))
    got = W.read(spark, uri, manifest).collect()
    first = {}
    for i, _, h, *_ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 100 and i != first[h or ""]
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[h or ""] if revisit else None, None if revisit else raw))
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(map(repr, have)) == sorted(map(repr, want))
    assert all("\r" not in (r.url or "") and " " not in (r.url or "") for r in got)


def test_frames_stand_alone():
    records = [W.record_bytes(i, "http://x", b"payload %d " % i * 40, "00", None, False) for i in range(300)]
    sink = io.BytesIO()
    writer = W.Writer(sink, W.Options(dictionary_bytes=4096, sample_bytes=20_000))
    for r in records:
        writer.add(r)
    writer.close()
    data = sink.getvalue()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and data[8:12] == struct.pack("<I", zstandard.MAGIC_NUMBER ^ 0) or data[8:12] == b"\x37\xa4\x30\xec"
    assert list(W.read_records(io.BytesIO(data))) == records
    plain = len(zstandard.ZstdCompressor().compress(records[0])) * len(records)
    assert len(data) - 8 - size < plain


def test_few_records_and_none(spark):
    sink = io.BytesIO()
    writer = W.Writer(sink, W.Options())
    writer.add(b"WARC/1.1\r\n\r\n")
    writer.close()
    assert list(W.read_records(io.BytesIO(sink.getvalue()))) == [b"WARC/1.1\r\n\r\n"]
    uri = stage_path(spark, "warc-none")
    manifest = W.write(spark.createDataFrame([], "page_id long, url string, html string"), uri)
    assert manifest.collect() == [] and W.read(spark, uri, manifest).collect() == []
