"""WARC archives: write, normalise monolithic gzip files, index, and read back.

1. ``write_archives``: each task writes its rows as WARC/1.1 records into archives
   that are one gzip stream each (monolithic), about ``ARCHIVE_BYTES`` of records long.
2. ``normalise``: each archive is inflated once, as a stream; every record is
   written again as a gzip member of its own, and a sidecar index lists the members'
   offsets and lengths.
3. ``read_back``: members are fetched by the index; a record whose payload does
   not match its digest fails the job.

A payload that several rows share is stored once: the row with the largest id is the
response, the others are revisit records that name it. Shared payloads are found on
digests alone, combined before the shuffle; a payload of very many rows is a skewed
join of stored tables, which adaptive execution splits.

Files go to the shared folder under names with the attempt's number, so that a
repeated task never touches another attempt's files; manifests are stored tables and
name only the files of attempts that succeeded.

Edge cases: a null payload is an empty one; a null id makes a record with no id and
comes last; rows that repeat an id and payload: one is the response; a null or empty
url becomes ``urn:none``; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 20
#: The date of all records; archives of equal rows are equal.
DATE = b"2024-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, record_type string, page_id long, refers_to long"


def digest_text(raw: bytes) -> str:
    """Bare upper-case base32 of a SHA-1 digest."""
    return base64.b32encode(raw).decode()


def record_id(page_id: int | None) -> bytes:
    return b"<urn:page:%d>" % page_id if page_id is not None else b"<urn:page:none>"


def record(page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit holds no payload; its true length is in a header of its own."""
    uri = quote(url or "urn:none", safe="!#$%&'()*+,/:;=?@[]~-._").encode()
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + record_id(page_id), b"WARC-Date: " + DATE, b"WARC-Target-URI: " + uri, b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Payload-Length: %d" % len(payload)]
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + record_id(refers_to)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def page_of(value: str | None) -> int | None:
    name = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name not in ("", "none") else None


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, whole record)`` of each record of an inflated stream, in bounded memory."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = stream.read(max(CHUNK, n - len(held)))
            if not more:
                return False
            held.extend(more)
        return True

    while fill(1):
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if not fill(len(held) + 1):
                raise EOFError("an archive ends within a header")
        head = headers(bytes(held[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        if not fill(size):
            raise EOFError("an archive ends within a record")
        yield head, bytes(held[:size])
        del held[:size]


def _store(folder: str):
    """The store of the shared folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _uri(folder: str) -> str:
    return folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder


def _attempt() -> str:
    context = TaskContext.get()
    return f"p{context.partitionId():06d}-a{context.taskAttemptId()}"


def plan(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to, revisit`` of each row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text_of("html").cast("binary").alias("payload"))
    digest = F.unhex(F.sha1("payload"))
    firsts = rows.select("page_id", digest.alias("digest")).groupBy("digest").agg(F.max("page_id").alias("first"))
    firsts = common.cut(firsts)
    rows = rows.withColumn("digest", digest).join(firsts, "digest")
    return rows.withColumn("revisit", F.coalesce(F.col("page_id") < F.col("first"), F.col("first").isNotNull()))


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Write ``planned`` as monolithic archives; ``archive, n_records`` of each."""
    folder = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        name, out, size, n, made = "", None, 0, 0, []
        for batch in batches:
            for page_id, url, payload, digest, first, revisit in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if out is None:
                    name, size, n = f"{path}/{_attempt()}-{len(made):05d}.warc.gz", 0, 0
                    sink = store.open_output_stream(name, compression=None)
                    out = gzip.GzipFile(fileobj=sink, mode="wb", compresslevel=1, mtime=0)
                data = record(page_id, url, digest_text(digest), payload, first, revisit)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close(), sink.close()
                    made.append((name, n))
                    out = None
        if out is not None:
            out.close(), sink.close()
            made.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["archive", "n_records"])

    return planned.select("page_id", "url", "payload", "digest", "first", "revisit").mapInArrow(run, "archive string, n_records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each monolithic archive with a gzip member for each record; the index of all members."""
    folder = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                name = f"{path}/{archive.rsplit('/', 1)[-1].removesuffix('.warc.gz')}-{_attempt()}"
                rows, offset = [], 0
                with store.open_input_stream(archive, compression=None) as source, store.open_output_stream(f"{name}.warc.gz", compression=None) as sink:
                    for head, data in records(gzip.GzipFile(fileobj=source)):
                        member = gzip.compress(data, 5, mtime=0)
                        sink.write(member)
                        rows.append((f"{name}.warc.gz", offset, len(member), head["warc-type"], page_of(head["warc-record-id"]), page_of(head.get("warc-refers-to"))))
                        offset += len(member)
                with store.open_output_stream(f"{name}.cdx", compression=None) as sink:  # the sidecar
                    sink.write("".join(f"{o} {n} {kind} {page}\n" for _, o, n, kind, page, _ in rows).encode())
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["archive", "offset", "length", "record_type", "page_id", "refers_to"])

    return archives.select("archive").mapInArrow(run, INDEX)


_READ = {"page_id": ("long", pa.int64()), "url": ("string", pa.string()), "payload_bytes": ("long", pa.int64()), "payload_digest": ("string", pa.string()), "record_type": ("string", pa.string()), "refers_to": ("long", pa.int64()), "payload": ("binary", pa.binary())}


def members(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    """The records that ``archive, offset, length`` rows name, in batches of about ``ARROW_BYTES`` whatever the size of payloads."""
    names = list(_READ) if payloads else list(_READ)[:-1]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _READ[name][1]) for i, name in enumerate(names)], names=names)

    name, file = None, None
    for batch in batches:
        rows, size = [], 0
        for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if archive != name:
                if file is not None:
                    file.close()
                store, path = _store(archive)
                name, file = archive, store.open_input_file(path)
            file.seek(offset)
            data = zlib.decompress(file.read(length), 31)
            end = data.index(b"\r\n\r\n")
            head = headers(data[:end])
            block = data[end + 4 : end + 4 + int(head["content-length"])]
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            revisit = head["warc-type"] == "revisit"
            if not revisit and digest_text(hashlib.sha1(payload).digest()) != digest:
                raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
            rows.append((page_of(head["warc-record-id"]), head["warc-target-uri"], int(head["x-payload-length"]), digest, head["warc-type"], page_of(head.get("warc-refers-to")), *([None if revisit else payload] if payloads else [])))
            size += len(payload) if payloads else 0
            if size >= common.ARROW_BYTES:
                yield packed(rows)
                rows, size = [], 0
        yield packed(rows)


def read_back(index: DataFrame, payloads: bool = True) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` and, if asked for, ``payload``, read member by member."""
    kind = ", ".join(f"{name} {_READ[name][0]}" for name in _READ if payloads or name != "payload")
    return index.select("archive", "offset", "length").mapInArrow(lambda batches: members(batches, payloads), kind)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write and normalise archives of ``pages``; the index of their records."""
    spark = pages.sparkSession
    common.bound_batches(spark)
    folder = folder or common.new_path(spark, "warc")
    first = common.cut(write_archives(plan(pages), f"{folder}/monolithic"))
    n = max(1, first.count())
    index = common.written(normalise(first.repartition(n), f"{folder}/records"), "warc-index")
    common.remove_path(spark, f"{folder}/monolithic")
    return index


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` and read the archives: one row per page, without payloads."""
    return read_back(archive(pages), payloads=False).drop("url")
