"""WARC archives with a Zstandard dictionary.

Each task trains a dictionary on the first of its records (``sample_bytes`` at most), writes it
into a skippable frame at the head of its file, and compresses every record as a frame of its own
against it, so that a reader can start at any record. Equal payloads are stored once: the record
with the largest page id is the response, the others are revisits that name it.

Files are written under a task's own name and moved into place when complete, so a repeated task
replaces its file. Null payloads are empty; a null url is an empty target; a null page id takes
part like the smallest id. Rows that repeat both id and payload are equal records. An empty table
leaves no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator
from uuid import UUID

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import small_batches

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
SPACE = 0x77617263_70616765 << 64  # high half of record ids; the low half is the page id
NO_ID = 0x77617263_6E6F6964 << 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{UUID(int=NO_ID if page is None else SPACE | (page & (2**64 - 1)))}>"


def page_of(record: str) -> int | None:
    n = UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = n & (2**64 - 1)
    return None if n >> 64 != SPACE >> 64 else low - (2**64 if low >> 63 else 0)


def record(page: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _write(records: Iterator[bytes], folder: str, sample_bytes: int, dictionary_bytes: int) -> tuple[str, int, int] | None:
    import zstandard as zstd

    head, size = [], 0
    for r in records:
        head.append(r)
        size += len(r)
        if size >= sample_bytes:
            break
    if not head:
        return None
    context = TaskContext.get()
    try:
        words = zstd.train_dictionary(min(dictionary_bytes, max(1024, size // 8)), head).as_bytes()
    except zstd.ZstdError:  # too few or too even records to train on
        words = b"".join(head)[:dictionary_bytes]
    known = zstd.ZstdCompressionDict(words)
    known.precompute_compress(level=LEVEL)
    fs, path = _store(folder)
    fs.create_dir(path, recursive=True)
    name = f"part-{context.partitionId():05d}.warc.zst"
    draft = f"{path}/.{name}.{context.taskAttemptId()}"
    engine = zstd.ZstdCompressor(dict_data=known, write_content_size=True)
    n = 0
    with fs.open_output_stream(draft, compression=None) as out:
        out.write(struct.pack("<II", SKIPPABLE, len(words)) + words)
        for group in (head, records):
            for r in group:
                out.write(engine.compress(r))
                n += 1
    fs.move(draft, f"{path}/{name}")
    return f"{folder}/{name}", n, fs.get_file_info(f"{path}/{name}").size


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` with ``_refers_to``: the page that holds the same payload, null for that page itself.

    Only pages that share a payload are marked; payloads of fewer than ``least_bytes`` never are.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.withColumn("_sha1", F.sha1(payload))
    ids = keyed.where(F.octet_length(payload) >= least_bytes).select("page_id", "_sha1")
    shared = ids.groupBy("_sha1").agg(F.max("page_id").alias("_refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    marks = ids.join(shared, "_sha1").where("not page_id <=> _refers_to").distinct()
    same = F.col("p.page_id").eqNullSafe(F.col("m.page_id")) & (F.col("p._sha1") == F.col("m._sha1"))
    return keyed.alias("p").join(marks.alias("m"), same, "left").select(
        "p.page_id", "p.url", "p.html", F.col("m._refers_to").alias("_refers_to"), F.col("m._sha1").isNotNull().alias("_revisit"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, sample_bytes: int = SAMPLE_BYTES,
                   dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """Writes one archive per task into ``folder``; a row (path, records, bytes) for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in batches:
                for page, url, html, ref, revisit in zip(*(b[c].to_pylist() for c in b.schema.names), strict=True):
                    yield record(page, url or "", (html or "").encode(), ref, revisit)
        if made := _write(records(), folder, sample_bytes, dictionary_bytes):
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "records", "bytes"), ([x] for x in made), strict=True)))

    marked = with_revisits(small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), least_bytes)
    return materialize(marked.mapInArrow(run, "path string, records bigint, bytes bigint"))


def _records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an uncompressed stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts here: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        block = stream.read(int(head["Content-Length"]))
        stream.read(4)
        yield head, block


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, streamed; the dictionary comes from its leading frame."""
    import zstandard as zstd

    fs, name = _store(path)
    with fs.open_input_stream(name, compression=None) as f:
        magic, n = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path} doesn't start with a dictionary frame")
        engine = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(f.read(n)))
        yield from _records(io.BufferedReader(engine.stream_reader(f, read_across_frames=True), 1 << 20))


def read_archives(paths: DataFrame) -> DataFrame:
    """One row per record of the archives in ``paths`` (path); payload digests are verified."""
    columns = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(),
               "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}

    def rows(path: str) -> Iterator[tuple]:
        for head, block in read_archive(path):
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(http.rpartition(b"Content-Length: ")[2])
            digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
            if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError(f"{head['WARC-Record-ID']} in {path} is damaged")
            refers = page_of(head["WARC-Refers-To"]) if kind == "revisit" else None
            yield page_of(head["WARC-Record-ID"]), size, digest, kind, refers, head["WARC-Target-URI"], payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b["path"].to_pylist():
                held, n = [], 0
                for row in rows(path):
                    held.append(row)
                    n += len(row[-1])
                    if n > 4 << 20 or len(held) >= 5000:
                        yield batch_of(held)
                        held, n = [], 0
                if held:
                    yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), columns.values(), strict=True)], list(columns))

    return paths.select("path").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
                                                "refers_to bigint, url string, payload binary")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS r, count(*) AS n FROM p GROUP BY h)
SELECT page_id, octet_length(encode(t)) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '')
           AS payload_digest,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM r THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM r THEN r END AS refers_to
FROM p JOIN m USING (h)
"""
