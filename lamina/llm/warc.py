"""WARC archives: a deduplicating writer and a splittable reader.

Each record is a gzip member of its own. The writer gives equal payloads one response
record and revisit records that refer to it. The reader cuts archives into byte ranges; a
task looks for gzip magic in its range, takes a place for a member only if it decodes to a
WARC header, owns the records that start inside its range, and follows the last of them
past the range's end.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import payloads, pick, prepare, scratch_path, stored

MIN_BYTES = 1000
MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive that one range has, and that a file gets before the next begins.
SPLIT_BYTES = 8 << 20
FILE_BYTES = 256 << 20
#: Bytes read at once while a record is followed.
STEP = 1 << 20
#: A hot digest is spread over so many join keys.
SALT = 32
WHEN = "2024-01-01T00:00:00Z"
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string"


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI; file:/x and plain paths are local or mounted."""
    if re.match(r"file:/+", path):
        path = "/" + re.sub(r"^file:/+", "", path)
    if path.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(path)


def clean(value: str | None) -> str:
    """A header's value: control characters percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record, uncompressed. With refers_to it is a revisit, without payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {WHEN}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """The row of an uncompressed record; of a response, size and digest are those of the
    payload that it holds, and must agree with its header."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "replace").split("\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1])
    if head["warc-type"] == "response":
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {head['warc-record-id']} isn't what its digest says")
    number = lambda k: int(head[k]) if k in head else None
    return {"page_id": number("x-page-id"), "record_type": head["warc-type"], "refers_to": number("x-refers-to-page-id"), "payload_bytes": size, "payload_digest": digest, "url": head.get("warc-target-uri")}


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        names, sizes, sink, size, name = [], [], None, 0, ""

        def close() -> None:
            sink.close()
            # an attempt's files have names of their own, and only those of the attempt
            # that ends well are listed
            fs.move(f"{root}/.{name}", f"{root}/{name}")
            names.append(f"{root}/{name}")
            sizes.append(size)

        for b in batches:
            for page, url, html, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), payloads(b.column(2)), b.column(3).to_pylist(), strict=True):
                if sink is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    sink = fs.open_output_stream(f"{root}/.{name}", compression=None)
                member = gzipped(record(page, url, html, hashlib.sha1(html).digest(), refers))
                sink.write(member)
                size += len(member)
                if size >= FILE_BYTES:
                    close()
                    sink = None
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) into archives in folder,
    and returns their (path, size).

    Of rows with equal payloads of MIN_BYTES or more, those with the largest page_id are
    responses and the others revisit it; all other rows are responses. A null html is an
    empty payload; a null page_id is smaller than any other. Rows repeated with the largest
    page_id are each a response. An empty table gives no archive.
    """
    prepare(pages.sparkSession)
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pick(pages, "page_id", "url", "html").withColumn("sha", F.when(F.length(html) >= MIN_BYTES, F.unhex(F.sha1(html))))
    same = rows.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = same.select(F.col("sha").alias("k"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")
    joined = rows.withColumn("salt", salt).join(same, (F.col("sha") == F.col("k")) & (F.col("salt") == F.col("s")), "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first")), F.col("first"))
    return stored(joined.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_write(folder), "path string, size long"), "archives")


def _valid(head: bytes) -> bool:
    """Does a member that decodes to a WARC header begin here?"""
    try:
        return zlib.decompressobj(31).decompress(head, 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


class Member:
    """Reads one member from a place of a file, however long it is."""

    def __init__(self, file: pa.NativeFile, at: int, size: int):
        z, parts = zlib.decompressobj(31), []
        file.seek(at)
        read = 0
        while not z.eof and at + read < size:
            data = file.read(STEP)
            if not data:
                break
            read += len(data)
            parts.append(z.decompress(data))
        if not z.eof:
            raise EOFError(f"the member at {at} has no end")
        self.data, self.end = b"".join(parts), at + read - len(z.unused_data)


DAMAGED = {"page_id": None, "record_type": "damaged", "refers_to": None, "payload_bytes": None, "payload_digest": None, "url": None}


def records(file: pa.NativeFile, start: int, end: int, size: int) -> Iterator[dict]:
    """Rows of the records that start in [start, end) of a file of that size, without damaged ones."""
    return (r for r in members(file, start, end, size) if r is not DAMAGED)


def members(file: pa.NativeFile, start: int, end: int, size: int) -> Iterator[dict]:
    """Rows of the members that start in [start, end) of a file of that size.

    Once a member is found, the next begins where it ends; only if nothing valid begins
    there, or a member is damaged, is the magic looked for again. A damaged member, one that
    begins like a record but can't be read whole, is a row too, of the type "damaged".
    """
    at, known = start, False
    while at < end:
        if not known:
            file.seek(at)
            data = file.read(min(STEP, size - at))
            hit = data.find(MAGIC)
            if hit < 0:
                at += max(1, len(data) - len(MAGIC) + 1)
                if not data:
                    return
                continue
            at += hit
            if at >= end:
                return
            file.seek(at)
            if not _valid(file.read(4096)):
                at += 1
                continue
        try:
            member = Member(file, at, size)
            if not member.data.startswith(b"WARC/1."):
                raise ValueError("not a record")
            row = parse(member.data)
        except (zlib.error, EOFError, ValueError, KeyError):
            yield DAMAGED
            at, known = at + 1, False
            continue
        yield row
        at, known = member.end, True
        if at < end:
            file.seek(at)
            known = file.read(3) == MAGIC


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
            fs, name = filesystem(path)
            with fs.open_input_file(name) as file:
                rows = list(members(file, start, min(size, start + SPLIT_BYTES), size))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


SCHEMA = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("url", pa.string())])


def read_archives(files: DataFrame) -> DataFrame:
    """A row for each record of the archives in files (path, size), and one of the type
    "damaged", otherwise null, for each member that begins like a record but can't be read.
    Files of null or no bytes, and an empty table, give no rows; repeated files are each read."""
    spark = files.sparkSession
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(SPLIT_BYTES).cast("long")))
    splits = files.where("size > 0").select("path", "size", starts.alias("start"))
    return splits.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start").mapInArrow(_read, RECORD)


def archive_table(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of the archives in a folder."""
    fs, root = filesystem(folder)
    found = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
    rows = [(f.path, f.size) for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and not os.path.basename(f.path).startswith(".")]
    return spark.createDataFrame(rows, "path string, size long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back: (page_id,
    payload_bytes, payload_digest, record_type, refers_to) of each record, by the rules of
    write_archives. Columns besides page_id, url and html are ignored."""
    files = write_archives(pages, scratch_path(pages.sparkSession, "warc"))
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
