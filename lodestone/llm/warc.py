"""WARC archives: a writer, a normaliser and a reader.

The writer puts the records of a task into one gzip stream. The normaliser inflates
such a file once, front to back, rewrites every record as a gzip member of its own
and writes a sidecar index (one JSON line a record: offset, length, type, id), so
that single records can be read by seeking. It holds one record at a time.

Archives live in the shared folder. A task writes under a name of its own attempt
and reports it in its result rows, so a task that runs twice leaves an unread file,
never a half-read one. Ids are integers; a column of another type raises.

Results for odd input: a null page is an empty payload; a null id is written as
``null`` and read back as null, and is never referred to; rows that repeat an id and
its payload are responses together if theirs is the smallest; a null url becomes
``about:blank``; line breaks in a url are escaped; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import filesystem, fresh_dir, stored

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
URN = "urn:page:"
MOST_HEADER = 1 << 22
GZIP = 31  # window bits of zlib for the gzip container


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header and leaves the body out."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = (url if url is not None else "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(data: bytes) -> tuple[dict[str, str], int]:
    """The header fields (lower-case names) and where the block begins."""
    end = data.index(b"\r\n\r\n")
    fields = {}
    for line in data[:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


def inflated(source: BinaryIO, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or more members, in pieces of at most
    ``chunk``. A file that ends inside a member raises."""
    z, inside = zlib.decompressobj(GZIP), False
    while data := source.read(chunk):
        while data:
            if z.eof:
                z = zlib.decompressobj(GZIP)
            yield z.decompress(data, chunk)
            inside = not z.eof
            data = z.unused_data if z.eof else z.unconsumed_tail
    while inside and (piece := z.decompress(b"", chunk)):
        yield piece
        inside = not z.eof
    if inside:
        raise ValueError("the archive ends inside a gzip member")


def split_records(plain: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, each with its closing blank lines."""
    held = bytearray()
    need = -1
    for piece in plain:
        held += piece
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    if len(held) > MOST_HEADER:
                        raise ValueError("a record's header has no end")
                    break
                fields, begin = headers_of(bytes(held[: end + 4]))
                need = begin + int(fields["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held.strip(b"\r\n"):
        raise ValueError("the archive ends inside a record")


def normalise(source: BinaryIO, target: BinaryIO, index: BinaryIO, level: int = 6) -> int:
    """Rewrite a gzip archive record by record; the number of records."""
    offset = n = 0
    for data in split_records(inflated(source)):
        fields, _ = headers_of(data)
        z = zlib.compressobj(level, zlib.DEFLATED, GZIP)
        member = z.compress(data) + z.flush()
        target.write(member)
        line = {"offset": offset, "length": len(member), "type": fields["warc-type"], "id": fields["warc-record-id"]}
        index.write(json.dumps(line).encode() + b"\n")
        offset += len(member)
        n += 1
    return n


def read_indexed(archive, index: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each record, read member by member."""
    for line in index.read().decode().splitlines():
        entry = json.loads(line)
        archive.seek(entry["offset"])
        data = zlib.decompress(archive.read(entry["length"]), GZIP)
        fields, begin = headers_of(data)
        block = data[begin : begin + int(fields["content-length"])]
        yield fields, block


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """id, url, html, payload digest and size, and for revisits refers_to."""
    if not isinstance(pages.select(id_col).schema[0].dataType, IntegralType):
        raise TypeError(f"{id_col} holds no integers")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        html.alias("html"),
        F.sha2(html.cast("binary"), 256).alias("digest"),
        F.octet_length(html).cast("long").alias("size"),
    )
    # Few digests repeat; the first holder of those that do is a small table.
    first = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").drop("n")
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", "size", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, level: int = 6) -> DataFrame:
    """Write, then normalise, one archive per task under ``folder``. Returns
    (archive, index, records), one row an archive, kept in the shared folder."""
    rows = plan_records(pages, id_col, url_col, html_col, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        n = 0
        z = zlib.compressobj(1, zlib.DEFLATED, GZIP)
        with fs.open_output_stream(f"{root}/{name}.whole.gz", compression=None) as whole:
            for batch in batches:
                for page_id, url, html, digest, size, refers in zip(*(c for c in batch.columns), strict=True):
                    payload = html.as_buffer().to_pybytes() if refers.as_py() is None else b""
                    data = record(page_id.as_py(), url.as_py(), payload, digest.as_py(), size.as_py(), refers.as_py())
                    whole.write(z.compress(data))
                    n += 1
            whole.write(z.flush())
        if n:
            with (
                fs.open_input_stream(f"{root}/{name}.whole.gz", compression=None) as source,
                fs.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as target,
                fs.open_output_stream(f"{root}/{name}.idx", compression=None) as index,
            ):
                if normalise(source, target, index, level) != n:
                    raise ValueError("records were lost")
        fs.delete_file(f"{root}/{name}.whole.gz")
        found = [name] if n else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{x}.warc.gz" for x in found], pa.string()), pa.array([f"{folder}/{x}.idx" for x in found], pa.string()), pa.array([n] * len(found), pa.int64())],
            names=["archive", "index", "records"],
        )

    return stored(rows.mapInArrow(run, "archive string, index string, records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every
    record. A response's digest and size are taken from its payload and must agree
    with its header; a revisit's come from its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = filesystem(archive)
                rows = []
                with fs.open_input_file(path) as data, fs.open_input_stream(filesystem(index)[1], compression=None) as lines:
                    for fields, block in read_indexed(data, lines):
                        http, begin = headers_of(block)
                        digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"])
                        if fields["warc-type"] == "response":
                            payload = block[begin:]
                            if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{archive}: {fields['warc-record-id']} does not match its digest")
                        rows.append((_number(fields["warc-record-id"]), size, digest, fields["warc-type"], _number(fields.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.select("archive", "index").mapInArrow(run, schema)


def _number(urn: str | None) -> int | None:
    text = urn[1 + len(URN) : -1] if urn else "null"
    return None if text == "null" else int(text)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives and read them back."""
    spark = pages.sparkSession
    written = write_archives(pages, fresh_dir(spark, "warc"))
    n = written.count()
    return read_archives(written.repartition(max(1, n)))
