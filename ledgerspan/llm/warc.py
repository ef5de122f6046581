"""WARC archives with an embedded Zstandard dictionary.

Each task writes one `.warc.zst` file: the first records, up to a stated number of bytes, train a dictionary, which
stands in a leading skippable frame; then every record is a frame of its own. Files go through the file
system of the target URI under a temporary name and get a name that follows from the partition, so a repeated
task replaces its own file. The manifest that a write returns is the only thing a reader trusts.

Of records with equal payloads of at least `min_revisit` bytes the smallest page_id is the response, others revisit it.

Defined results: a null html is an empty payload; a null url leaves out the target; a null page_id is written as
`null`, sorts behind all ids and reads back as null. Rows that repeat page_id and payload are each of the same type.
Control characters in a url are percent-encoded. An empty table writes no file. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import stage, with_group

#: Fixed values of the formats.
SKIPPABLE_MAGIC, RECORD_END, DATE = 0x184D2A5D, b"\r\n\r\n", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20


@dataclass(frozen=True)
class Options:
    min_revisit: int = 100
    dictionary_bytes: int = 64 << 10
    sample_bytes: int = 4 << 20  # of each file's own first records
    level: int = 3


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else re.sub(r"^file:/+", "file:///", uri))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + RECORD_END


def parse_record(data: bytes) -> dict:
    """Fields of one record; the payload of a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != RECORD_END:
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    number = lambda x: None if x is None or x == "<urn:page:null>" else int(x[len("<urn:page:") : -1])
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": payload if fields["WARC-Type"] == "response" else None,
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")),
    }


class Writer:
    """One archive file; records wait until the dictionary's sample is full."""

    def __init__(self, sink, options: Options):
        self.sink, self.options, self.waiting, self.size, self.compressor, self.records = sink, options, [], 0, None, 0

    def _start(self) -> None:
        try:
            dictionary = zstandard.train_dictionary(self.options.dictionary_bytes, self.waiting, k=512, d=8)
        except zstandard.ZstdError:  # too few records to train on: their text itself is the dictionary
            content = b"".join(self.waiting)[-self.options.dictionary_bytes :]
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        frame = dictionary.as_bytes()
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(frame)) + frame)
        self.compressor = zstandard.ZstdCompressor(level=self.options.level, dict_data=dictionary, write_checksum=True)
        for r in self.waiting:
            self.sink.write(self.compressor.compress(r))
        self.waiting = []

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor:
            self.sink.write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.size += len(record)
        if self.size >= self.options.sample_bytes:
            self._start()

    def close(self) -> None:
        if self.waiting:
            self._start()


def read_records(source) -> Iterator[bytes]:
    """The records of an archive stream, one frame at a time."""
    magic, length = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no dictionary frame")
    content = source.read(length)
    # content trained as a dictionary starts with its own magic; anything else is raw content
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO))
    pending = b""
    while pending or (pending := source.read(READ_BYTES)):
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(pending))
            pending = frame.unused_data
            if frame.eof:
                break
            if not (pending := source.read(READ_BYTES)):
                raise ValueError("archive ends inside a record")
        yield b"".join(parts)


def classify(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """page_id, digest, refers_to (null for responses), revisit of every page, without payloads."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = stage(pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha2(payload.cast("binary"), 256)).alias("digest"), F.octet_length(payload).alias("bytes")), "warc-rows")
    first = rows.filter(F.col("bytes") >= options.min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    several = stage(first.filter("copies > 1"), "warc-copies")
    found = with_group(rows.select("page_id", "digest"), several, "digest", "copies")
    return found.filter(~F.col("page_id").eqNullSafe(F.col("first_id"))).select("page_id", "digest", F.col("first_id").alias("refers_to"))


def write(pages: DataFrame, uri: str, options: Options = Options()) -> DataFrame:
    """Write the archives under `uri`; returns the manifest: file, records."""
    revisits = classify(pages, options).select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to").distinct()
    payload = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.unhex(F.sha2(payload.cast("binary"), 256)).alias("digest"))
    rows = own.join(revisits, own["page_id"].eqNullSafe(revisits["r_id"]) & (own["digest"] == revisits["r_digest"]), "left")
    rows = rows.select("page_id", "url", "html", F.lower(F.hex("digest")).alias("digest"), "refers_to", F.col("r_digest").isNotNull().alias("revisit"))

    def run(batches):
        fs, folder = _open(uri)
        fs.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.zst"
        hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
        writer = None
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                sink = fs.open_output_stream(hidden, compression=None)
                writer = Writer(sink, options)
            for page_id, url, html, digest, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns)):
                writer.add(record_bytes(page_id, url, html.encode(), digest, refers_to, revisit))
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(hidden, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([writer.records], pa.int64())], ["file", "records"])

    return stage(rows.mapInArrow(run, "file string, records long"), "warc-manifest")


_READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark: SparkSession, uri: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest names, a file per task at a time."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        fs, folder = _open(uri)
        for b in batches:
            for file, records in zip(b.column("file").to_pylist(), b.column("records").to_pylist()):
                rows, size, seen = [], 0, 0
                with fs.open_input_stream(os.path.join(folder, file), compression=None) as source:
                    for data in read_records(source):
                        row = parse_record(data)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        seen += 1
                        size += len(row["payload"] or b"") + 200
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if seen != records:
                    raise ValueError(f"{file} holds {seen} records, the manifest says {records}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = manifest.repartition(max(1, manifest.count()))  # a file a task: the rows are tiny, the files are not
    return files.select("file", "records").mapInArrow(run, _READ)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM f
"""
