"""WARC archives: a writer with revisit records and a sequential reader.

One gzip member per record.  The reader inflates a member piece by piece,
frames header and block by content length, and verifies the block and payload
digests while it reads; it holds one record and one compressed chunk at a time.

Archives are written by tasks into the shared folder, each under a name of its
own attempt; the manifest, a table that Spark commits, names the archives of
the attempts that succeeded, and only those are read.  A lost executor thus
leaves at most an unnamed file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerdesk.llm.common import bounded_batches
from sellerdesk.session import scratch_path, stage

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    name = (urn or "<urn:x-page:none>")[len("<urn:x-page:") : -1]
    return None if name == "none" else int(name)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The bytes of a response (``refers_to`` None) or revisit record, not compressed."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: {_page_urn(page_id)}")
    head.append("WARC-Date: 1970-01-01T00:00:00Z")  # the pages carry no fetch time
    if url:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_page_urn(refers_to)}"]
    head.append(f"WARC-Block-Digest: sha1:{digest32(block)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest32(payload)}")
    head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Pieces:
    """The inflated bytes of one gzip member after another."""

    def __init__(self, stream: BinaryIO, chunk: int):
        self.stream, self.chunk, self.raw = stream, chunk, b""

    def more(self) -> bool:
        """Whether another member follows."""
        self.raw = self.raw or self.stream.read(self.chunk)
        return bool(self.raw)

    def member(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            if not self.more():
                raise ValueError("the archive ends inside a record")
            piece = z.decompress(self.raw, 1 << 20)
            self.raw = z.unused_data if z.eof else z.unconsumed_tail
            if piece:
                yield piece


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_records(stream: BinaryIO, chunk: int = 1 << 18) -> Iterator[dict]:
    """Every record: headers, payload length, digest and (of a response) payload.

    Raises ValueError on a wrong digest, a wrong length or a truncated archive.
    """
    source = _Pieces(stream, chunk)
    while source.more():
        pieces = source.member()
        buffer = b""
        while (cut := buffer.find(b"\r\n\r\n")) < 0:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError("a record has no end of header")
            buffer += piece
        headers = _headers(buffer[:cut])
        left = int(headers["content-length"])
        rest = buffer[cut + 4 :]
        block_hash, block = hashlib.sha1(), []
        while left:
            part, rest = rest[:left], rest[left:]
            block_hash.update(part)
            block.append(part)
            left -= len(part)
            if left:
                rest = next(pieces, None)
                if rest is None:
                    raise ValueError("a record is shorter than its content length")
        if rest + b"".join(pieces) != b"\r\n\r\n":
            raise ValueError("a record does not end where its content length says")
        found = "sha1:" + base64.b32encode(block_hash.digest()).decode()
        if headers.get("warc-block-digest", found) != found:
            raise ValueError(f"wrong block digest: {headers.get('warc-record-id')}")
        http, _, payload = b"".join(block).partition(b"\r\n\r\n")
        length = re.search(rb"(?i)content-length: *(\d+)", http)
        declared = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if headers["warc-type"] == "response" and digest32(payload) != declared:
            raise ValueError(f"wrong payload digest: {headers.get('warc-record-id')}")
        yield {
            "headers": headers,
            "type": headers["warc-type"],
            "payload": payload if headers["warc-type"] == "response" else None,
            "payload_bytes": int(length[1]) if length else len(payload),
            "payload_digest": declared,
        }


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary) and refers_to of every page.

    Equal payloads of at least ``min_bytes`` are compared by SHA-1 and length.
    The winner of a group is found by a maximum (partial, so a hot payload
    costs a row per task) and written, so the join back is one AQE can split.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("sha"),
        F.octet_length(payload).alias("size"),
    )
    winners = rows.groupBy(F.col("sha").alias("w_sha"), F.col("size").alias("w_size")).agg(
        F.max("page_id").alias("winner")
    )
    winners = stage(winners, "winners")
    joined = rows.join(winners, (F.col("sha") == F.col("w_sha")) & (F.col("size") == F.col("w_size")))
    revisit = (F.col("size") >= min_bytes) & ~F.col("winner").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id", "url", "payload", F.when(revisit, F.col("winner")).alias("refers_to")
    )


def write_archives(records: DataFrame, name: str = "warc", roll_bytes: int = 64 << 20) -> DataFrame:
    """Write ``records`` as .warc.gz files in the shared folder; returns the manifest.

    Manifest: path, records, bytes.  A task begins another archive when one
    reaches ``roll_bytes``.
    """
    folder = scratch_path(records.sparkSession, name)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        out, path, n, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            row = {"path": [path], "records": [n], "bytes": [size]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers = (batch.column(c)[i].as_py() for c in range(4))
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(path, compression=None)
                data = gzip_member(build_record(page_id, url, payload, refers))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    bounded_batches(records.sparkSession)
    return stage(records.mapInArrow(write, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Every response and revisit record of the archives in ``manifest(path)``.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to and,
    if asked for, the payload (null for revisits).  One task reads one archive.
    """
    spark = manifest.sparkSession
    folder = scratch_path(spark, "any")  # names the file system of the shared folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        names = RECORD.replace(" long", "").replace(" string", "").split(", ")
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        if payloads:
            names, kinds = [*names, "payload"], [*kinds, pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream):
                        if r["type"] not in ("response", "revisit"):
                            continue
                        h = r["headers"]
                        row = (
                            _page_of(h["warc-record-id"]),
                            r["payload_bytes"],
                            r["payload_digest"],
                            r["type"],
                            _page_of(h.get("warc-refers-to")),
                        )
                        rows.append((*row, r["payload"]) if payloads else row)
                        size += len(r["payload"] or b"") if payloads else 0
                        if len(rows) >= 4096 or size >= 16 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    schema = RECORD + (", payload binary" if payloads else "")
    n = max(1, min(manifest.count(), 20_000))
    return manifest.select("path").repartition(n).mapInArrow(read, schema)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` and read the archives back.

    A null html is an empty payload.  Of equal payloads of at least
    ``min_bytes`` bytes the largest page_id is the response (rows that repeat
    it are responses too) and the others revisit it; a null page_id is smaller
    than any, and if all of a group are null all are responses.  A null url has
    no target header.  An empty table gives no archive and no rows.  Other
    columns are not read.
    """
    return read_archives(write_archives(plan_records(pages, min_bytes)))
