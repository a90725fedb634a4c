"""WARC archives: a writer that marks equal payloads as revisits, and a sequential reader.

Each record is a gzip member of its own. The reader takes a file in blocks through an incremental decompressor,
frames each record by its Content-Length, and checks the block and payload digests; it never holds more than one
record and one block. Files are opened by URI through Arrow, so the shared folder may be in any store it knows.

Writing: payload digests are computed where the pages are; the smallest page_id of each digest comes from a partial
aggregate over narrow rows; the join with it is by digest and leaves busy digests to the skew join. Each task
writes files of about FILE_BYTES under names no other attempt uses, and only the names that a task returned (kept
in a written table) count, so files of lost attempts are never read.

Defined cases: a null html is an empty payload; a null url is an empty target; pages without id are always responses
and have no revisits; rows that share both the smallest page_id and the payload are all responses; an empty
table has no archives and no records; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_file, open_store, shared_path

FILE_BYTES = 64 << 20
READ_BYTES = 1 << 20
LEAST_PAYLOAD = 100
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
RECORDS = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
           "target string, archive string, record_no bigint")


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


class ArchiveError(ValueError):
    """A record that is cut off, badly framed or whose digest differs."""


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit has the HTTP head only, whose Content-Length is that of the full payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response"
    extra = ""
    if refers_to is None:
        block += payload
    else:
        kind = "revisit"
        extra = ("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
                 f"WARC-Refers-To: {_name(refers_to)}\r\n")
    head = (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {_name(page_id)}\r\nWARC-Date: {DATE}\r\n"
            f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}\r\n{extra}"
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nWARC-Payload-Digest: sha256:{digest}\r\n"
            f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def _members(stream: BinaryIO, read_bytes: int) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as decompressed blocks to be used up before the next."""
    rest = stream.read(read_bytes)
    while rest:
        unpack = zlib.decompressobj(31)

        def blocks(unpack=unpack):
            nonlocal rest
            while True:
                while rest and not unpack.eof:
                    out = unpack.decompress(rest, read_bytes)
                    rest = unpack.unconsumed_tail
                    if out:
                        yield out
                if unpack.eof:
                    rest = unpack.unused_data or stream.read(read_bytes)
                    return
                if not (rest := stream.read(read_bytes)):
                    raise ArchiveError("the last record is cut off")

        yield blocks()


def read_records(stream: BinaryIO, read_bytes: int = READ_BYTES) -> Iterator[Record]:
    """The records in order, each framed by Content-Length and checked against its digests."""
    for blocks in _members(stream, read_bytes):
        head, headers, length, parts, got = b"", None, 0, [], 0
        for block in blocks:
            if headers is None:
                head += block
                if (end := head.find(b"\r\n\r\n")) < 0:
                    continue
                first, *lines = head[:end].decode("utf-8").split("\r\n")
                if not first.startswith("WARC/"):
                    raise ArchiveError(f"no WARC record: {first[:40]!r}")
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                length, block = int(headers["content-length"]), head[end + 4:]
            parts.append(block)
            got += len(block)
        body = b"".join(parts)
        if headers is None or got != length + 4 or body[length:] != b"\r\n\r\n":
            raise ArchiveError("a record's length differs from its Content-Length")
        body = body[:length]
        if hashlib.sha256(body).hexdigest() != headers["warc-block-digest"].removeprefix("sha256:"):
            raise ArchiveError(f"wrong block digest in {headers.get('warc-record-id')}")
        record = Record(headers, body)
        if headers["warc-type"] == "response" and hashlib.sha256(payload_of(record)).hexdigest() != payload_digest(record):
            raise ArchiveError(f"wrong payload digest in {headers.get('warc-record-id')}")
        yield record


def payload_of(record: Record) -> bytes:
    return record.block[record.block.index(b"\r\n\r\n") + 4:]


def payload_digest(record: Record) -> str:
    return record.headers["warc-payload-digest"].removeprefix("sha256:")


def payload_length(record: Record) -> int:
    head = record.block[:record.block.index(b"\r\n\r\n")].decode()
    return next(int(x.partition(":")[2]) for x in head.split("\r\n") if x.lower().startswith("content-length:"))


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the pages as archives in folder; the result names the files written. Run it once, into a table."""
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    # The narrow side is aggregated from the pages' own columns, before any shuffle of payloads.
    least = (rows.where(F.col("page_id").isNotNull() & (F.octet_length("payload") >= LEAST_PAYLOAD))
             .groupBy(F.col("digest").alias("of")).agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
             .where("n > 1").select("of", "least"))
    refers = F.when((F.col("least") != F.col("page_id")) & (F.octet_length("payload") >= LEAST_PAYLOAD), F.col("least"))
    marked = rows.join(least, F.col("digest") == F.col("of"), "left").select(
        "page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, name, size, n = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([n], pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in range(5)]
                if out is None:
                    name, size, n = new_file(root, ".warc.gz"), 0, 0
                    out = store.open_output_stream(name, compression=None)
                data = encode_record(*row)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return marked.mapInArrow(write, "archive string, records bigint")


def read_archives(names: DataFrame, folder: str) -> DataFrame:
    """The records of the archives named, one file after the other in each task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(name, compression=None) as stream:
                    for i, r in enumerate(read_records(stream)):
                        refers = r.headers.get("warc-refers-to")
                        rows.append((_page(r.headers["warc-record-id"]), payload_length(r), payload_digest(r),
                                     r.headers["warc-type"], refers and _page(refers), r.headers["warc-target-uri"],
                                     name, i))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return names.select("archive").mapInArrow(read, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder, manifest = shared_path(spark, "warc"), shared_path(spark, "warc-names")
    write_archives(pages, folder).write.parquet(manifest)
    names = spark.read.parquet(manifest)
    files = max(1, names.count())
    return read_archives(names.repartition(min(files, 10_000)), folder)
