"""WARC archives: write responses, resolve revisits by payload digest, rewrite, read back.

``write_archives`` has every task write one archive after another (a gzip member per record) into
a shared folder and returns the records' headers as a stored table. ``resolve`` shuffles these
headers by payload digest, never payloads: of equal payloads of at least ``min_bytes`` the record
with the smallest page id stays a response, the others become revisits of it. ``rewrite`` sends
each archive's decisions to one task, which copies the archive with fresh headers and without the
payloads of revisits. ``read_archives`` streams archives record by record, recomputes digests, and
``resolved`` joins revisits to the responses they refer to.

A digest with a third of all records is summed up before its shuffle; the joins are of two stored
tables, whose large partitions the engine splits. An archive is named anew by every attempt of a
task and counts only when it is in a stored manifest, so lost executors leave stray files at most.

Null payloads are empty. A null page id has no header and comes back null; it is the response only
if no equal payload has an id. Of repeated rows one is the response and the others revisit it.
Control characters in urls are percent-encoded. An empty table gives no archives and an empty
result. Only the named columns are read.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Bytes after which a task begins a new archive; compression level; bytes read at once.
ARCHIVE_BYTES, LEVEL, CHUNK = 1 << 30, 4, 1 << 20

HEADER = "archive string, offset long, size long, page_id long, uri string, date string, record_id string, payload_digest string, payload_bytes long"
RECORD = "page_id long, uri string, date string, record_type string, record_id string, refers_to_id string, payload_digest string, payload_bytes long, verified boolean, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member: version, fields, block."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    raw = f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


def common_fields(kind: str, record_id: str, page_id, uri: str, date: str, digest: str, block: bytes) -> list[tuple[str, str]]:
    page = [] if page_id is None else [("X-Page-Id", str(page_id))]
    return [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date), *([("WARC-Target-URI", uri)] if uri else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), *page, ("Content-Type", "application/http; msgtype=response"),
    ]


def clean_uri(uri: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in uri or "")


class ArchiveWriter:
    """Archives of one task in a folder of any file system that pyarrow can open."""

    def __init__(self, folder: str):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.folder, self.stream = folder, None
        self.fs.create_dir(self.path, recursive=True)

    def add(self, data: bytes) -> tuple[str, int, int]:
        """Archive, offset and size of the record."""
        if self.stream is not None and self.at >= ARCHIVE_BYTES:
            self.close()
        if self.stream is None:
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.stream = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
        place = (f"{self.folder}/{self.name}", self.at, len(data))
        self.stream.write(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def members(archive: str) -> Iterator[bytes]:
    """Unpacked gzip members, one at a time."""
    fs, path = pafs.FileSystem.from_uri(archive)
    with fs.open_input_stream(path, compression=None) as f:
        data = f.read(CHUNK)
        while data:
            unpacker, out = zlib.decompressobj(31), []
            while True:
                out.append(unpacker.decompress(data))
                if unpacker.eof:
                    break
                data = f.read(CHUNK)
                if not data:
                    raise ValueError(f"{archive} ends inside a record")
            yield b"".join(out)
            data = unpacker.unused_data or f.read(CHUNK)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records in an unpacked member: lower-case field names, block."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in raw[at:end].decode().split("\r\n")[1:]))
        size = int(fields["content-length"])
        yield fields, raw[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def bare(value: str) -> str:
    return value.removeprefix("<urn:uuid:").removesuffix(">")


def write_archives(pages: DataFrame, folder: str, date: str | None = None, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write every row as a response; the stored headers of all records."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, task, n = ArchiveWriter(f"{folder}/originals"), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for page_id, uri, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                body, uri = payload.as_py(), clean_uri(uri)
                digest, record_id = digest_of(body), str(uuid.uuid5(uuid.NAMESPACE_URL, f"{folder}/{task}/{n}"))
                block = HTTP % len(body) + body
                place = writer.add(record_bytes(common_fields("response", record_id, page_id, uri, date, digest, block), block))
                rows.append((*place, page_id, uri, date, record_id, digest, len(body)))
                n += 1
            if rows:
                yield _batch(rows, HEADER)
        writer.close()

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    return stored(picked.mapInArrow(run, HEADER), folder, "headers")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows), types)], names=list(names))


def resolve(headers: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Stored headers -> headers with ``original``: null for responses, else (record_id, uri, date, page_id) of the response."""
    order = F.struct(F.col("page_id").isNull().alias("blank"), "page_id", "record_id", "uri", "date")
    equal = headers.where(F.col("payload_bytes") >= min_bytes)
    first = stored(equal.groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), folder, "first")
    joined = headers.join(first, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("first").isNotNull() & (F.col("first.record_id") != F.col("record_id"))
    return joined.withColumn("original", F.when(revisit, F.col("first"))).drop("first")


def rewrite(decided: DataFrame, folder: str) -> DataFrame:
    """Copy each archive with fresh headers; revisits lose their payload. Stored manifest: archive, records."""

    def copy(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("offset")
        fs, path = pafs.FileSystem.from_uri(rows.column("archive")[0].as_py())
        writer, names = ArchiveWriter(f"{folder}/deduplicated"), {}
        with fs.open_input_file(path) as f:
            for batch in rows.to_batches(max_chunksize=1000):
                for r in batch.to_pylist():
                    ((fields, block),) = parse(zlib.decompress(f.read_at(r["size"], r["offset"]), 31))
                    http, _, payload = block.partition(b"\r\n\r\n")
                    original = r["original"]
                    block = block if original is None else http + b"\r\n\r\n"
                    kind = "response" if original is None else "revisit"
                    record_id = str(uuid.uuid5(uuid.NAMESPACE_URL, "deduplicated/" + r["record_id"]))
                    out = common_fields(kind, record_id, r["page_id"], r["uri"], r["date"], r["payload_digest"], block)
                    if original is not None:
                        refers = str(uuid.uuid5(uuid.NAMESPACE_URL, "deduplicated/" + original["record_id"]))
                        out += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{refers}>"), ("WARC-Refers-To-Date", original["date"])]
                        out += [("WARC-Refers-To-Target-URI", original["uri"])] if original["uri"] else []
                    name = writer.add(record_bytes(out, block))[0]
                    names[name] = names.get(name, 0) + 1
        writer.close()
        return pa.table({"archive": pa.array(list(names), pa.string()), "records": pa.array(list(names.values()), pa.int64())})

    return stored(decided.groupBy("archive").applyInArrow(copy, "archive string, records long"), folder, "manifest")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the archives in column ``archive``; payloads only if asked. For revisits payload_bytes is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows, size = [], 0
                for fields, block in (x for raw in members(archive) for x in parse(raw)):
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    page, refers = fields.get("x-page-id"), fields.get("warc-refers-to")
                    rows.append((
                        None if page is None else int(page), fields.get("warc-target-uri", ""), fields["warc-date"], kind, bare(fields["warc-record-id"]), refers and bare(refers),
                        digest, None if payload is None else len(payload), None if payload is None else digest_of(payload) == digest, payload if payloads else None,
                    ))
                    size += len(block) if payloads else 200
                    if size > 1 << 23:
                        yield _batch(rows, RECORD)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, RECORD)

    n = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    return archives.select("archive").repartition(n).mapInArrow(run, RECORD)


def resolved(records: DataFrame, folder: str) -> DataFrame:
    """Every record with payload_bytes and refers_to (page id of its response; null for responses)."""
    records = stored(records.drop("payload"), folder, "records")
    originals = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"))
    revisits = records.where("record_type = 'revisit'").join(originals, "refers_to_id", "left").withColumn("payload_bytes", F.col("n"))
    responses = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "verified"]
    return responses.select(names).unionByName(revisits.select(names))


def deduplicate_pages(pages: DataFrame, min_bytes: int = 0, folder: str | None = None, date: str | None = None) -> DataFrame:
    """Write, resolve, rewrite and read back; archives stay in ``folder`` (by default a scratch folder)."""
    folder = folder or scratch(pages.sparkSession, "warc")
    headers = write_archives(pages, folder, date)
    manifest = rewrite(resolve(headers, folder, min_bytes), folder)
    return resolved(read_archives(manifest), folder)
