"""WARC archives from pages and back, by way of a table of payload chunks.

A payload travels as rows (record, chunk number, bytes, each chunk compressed by itself), each with the digest of all
bytes so far, so no step after the source holds a whole payload. The last chunk's digest is the payload's. Records with equal payloads
are stored once: the one with the largest page_id as a response, the others as revisits of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, open_fs

#: Bytes in a chunk.
CHUNK = 1 << 18
CHUNKS = "record long, page_id long, url string, chunk int, data binary, so_far long, digest string, last boolean"
READ = "page_id long, record_type string, refers_to long, chunk int, so_far long, digest string, last boolean"
#: Fixed value: the standard's name for revisits of an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_rows(payload: bytes, size: int) -> Iterator[tuple[int, bytes, int, str, bool]]:
    """(number, bytes, bytes so far, digest so far, whether last) of each chunk; an empty payload has one."""
    seen = hashlib.sha1()
    for number, start in enumerate(range(0, max(1, len(payload)), size)):
        data = payload[start : start + size]
        seen.update(data)
        yield number, data, start + len(data), base32(seen.digest()), start + size >= len(payload)


def chunk_table(pages: DataFrame, work: Workspace, size: int = CHUNK) -> DataFrame:
    """The chunk rows of all pages, written; ``record`` tells rows apart even where ids repeat or are null."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        rows, held, pack = [], 0, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i in range(batch.num_rows):
                record, page, url = (batch.column(c)[i].as_py() for c in ("record", "page_id", "url"))
                payload = batch.column("html")[i].as_buffer()
                for number, data, so_far, digest, last in chunk_rows(memoryview(payload) if payload else b"", size):
                    rows.append((record, page, url, number, pack.compress(data), so_far, digest, last))
                    held += len(data)
                    if held > 16 * CHUNK:
                        yield _batch(rows, names)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, names)
                rows, held = [], 0

    source = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("html"))
    return work.table(source.mapInArrow(cut, CHUNKS), "chunks")


_TYPES = {"record": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "chunk": pa.int32(), "data": pa.binary(), "so_far": pa.int64(), "digest": pa.string(), "last": pa.bool_(), "record_type": pa.string(), "refers_to": pa.int64()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[n]) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def record_plan(chunks: DataFrame, work: Workspace) -> DataFrame:
    """Per record: the digest and size of its payload, and the record that holds it (its own or another)."""
    whole = chunks.where("last").select("record", "page_id", "digest", F.col("so_far").alias("bytes"))
    holders = work.table(whole.groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "record")).alias("holder")), "holders")
    return whole.join(holders, ["digest", "bytes"]).select("record", F.col("digest").alias("payload_digest"), F.col("bytes").alias("payload_bytes"), F.col("holder.record").alias("holder"), F.col("holder.page_id").alias("holder_page"))


def _name(record: int, page: int | None) -> str:
    return f"<urn:record:{record}:{'' if page is None else page}>"


def _http(n: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n


def _head(row: dict, http: bytes, date: str) -> bytes:
    response = row["holder"] == row["record"]
    size = len(http) + (row["payload_bytes"] if response else 0)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {_name(row['record'], row['page_id'])}", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(row['url'] or 'urn:none', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {size}"]
    if not response:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(row['holder'], row['holder_page'])}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def _rows(batches: Iterator[pa.RecordBatch], together: int = 16) -> Iterator[dict]:
    for batch in batches:
        for k in range(0, batch.num_rows, together):
            yield from batch.slice(k, together).to_pylist()


def write_archives(chunks: DataFrame, plan: DataFrame, work: Workspace, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One archive for each partition, records in order, each its own gzip member; returns the archives' paths."""
    folder = work.path("warc")
    base, path = open_fs(folder)
    base.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, top = open_fs(folder)
        files.create_dir(top, recursive=True)
        # each attempt writes a file of its own; the table of archives names that of the one that counts
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        records, member, unpack = 0, None, zstandard.ZstdDecompressor()
        with files.open_output_stream(f"{top}/{name}", compression=None) as out:
            for row in _rows(batches):
                if row["chunk"] == 0:
                    member, records = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=4, mtime=0), records + 1
                    member.write(_head(row, _http(row["payload_bytes"]), date))
                if row["data"]:
                    member.write(unpack.decompress(row["data"]))
                if row["last"]:
                    member.write(b"\r\n\r\n")
                    member.close()
        if not records:
            files.delete_file(f"{top}/{name}")
            return
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([records], pa.int64())})

    revisit = F.col("holder") != F.col("record")
    stored = (
        chunks.join(plan, "record")
        .where(~revisit | (F.col("chunk") == 0))
        .withColumn("data", F.when(~revisit, F.col("data")))
        .withColumn("last", F.col("last") | revisit)
        .drop("so_far", "digest")
        .sortWithinPartitions("record", "chunk")
    )
    return work.table(stored.mapInArrow(write, "path string, records long"), "archives")


def read_archives(archives: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk rows of all records; a revisit has one, with its header's digest and size."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, inner = open_fs(path)
                rows = []
                with files.open_input_stream(inner, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) as file:
                    for row in _records(file, size):
                        rows.append(row)
                        if len(rows) >= 5000:
                            yield _batch(rows, names)
                            rows = []
                if rows:
                    yield _batch(rows, names)

    n = archives.count()  # archives, not records
    return archives.select("path").repartition(max(1, n)).mapInArrow(read, READ)


def _fields(file: io.BufferedReader) -> dict[str, str]:
    out = {}
    while (line := file.readline().rstrip(b"\r\n")) != b"":
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _page(name: str) -> int | None:
    number = name.rstrip(">").rpartition(":")[2]
    return int(number) if number else None


def _records(file: io.BufferedReader, size: int) -> Iterator[tuple]:
    while first := file.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("not a record")
        head = _fields(file)
        at = file.tell()
        file.readline()
        http = _fields(file)
        left = int(head["content-length"]) - (file.tell() - at)
        page, kind = _page(head["warc-record-id"]), head["warc-type"]
        if kind == "revisit":
            yield page, kind, _page(head["warc-refers-to"]), 0, int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:"), True
            continue
        seen, so_far, number = hashlib.sha1(), 0, 0
        while True:
            data = file.read(min(size, left - so_far))
            if len(data) < min(size, left - so_far):
                raise ValueError("the record is cut off")
            seen.update(data)
            so_far += len(data)
            yield page, kind, None, number, so_far, base32(seen.digest()), so_far >= left
            number += 1
            if so_far >= left:
                break
        if f"sha1:{base32(seen.digest())}" != head["warc-payload-digest"]:
            raise ValueError("the payload does not match its digest")


def round_trip(pages: DataFrame, work: Workspace) -> DataFrame:
    """Write all pages and read them back: one row a page.

    A null html is an empty payload. A very long one is cut into chunks that are written and read one by one. A null
    page_id is written as such and counts as the smallest. Of repeated rows, and of equal payloads of one page_id, one
    is the response. An empty table gives no rows; extra columns are ignored.
    """
    chunks = chunk_table(pages, work)
    archives = write_archives(chunks, record_plan(chunks, work), work)
    work.drop("chunks", "holders")
    return read_archives(archives).where("last").select("page_id", F.col("so_far").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
