"""Operator 4, WARC records in ZIP-packaged archives.

An archive is a ZIP file with two stored (not compressed) members: a file of
WARC records, each its own gzip member, and an index of their places. The
reader parses the end record, the ZIP64 end record if there is one, and the
central directory, finds where a stored member's bytes begin, reads the index,
and then reads each record by its range. Nothing is extracted: it needs only a
function that returns the bytes of a range.

Archives are files of the shared folder, bounded in size, each under a name of
its own: a task that is lost or runs twice writes others, and only those that the
written table of archives names are read. Reading takes two steps: a task per
archive reads its directories and index, and gives ranges of neighbouring records
of about ``RANGE_BYTES``; these are dealt over all tasks, which read each range
and nothing else.

Records with equal payloads of at least ``REVISIT_BYTES`` are written once: the
largest page_id is the response, the others are revisits that carry the HTTP
headers, the digest and the id they refer to, without the payload.

Defined cases: null html is an empty payload; shorter payloads are all
responses; a null url is left out; a null page_id comes back as null and is a
response only if no other row has its payload; rows that repeat a page_id and
its payload are one response each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialise, releasing, shared_dir
from .exact_dedup import find_repeats

REVISIT_BYTES = 1000
#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 4_000_000
#: Bytes of neighbouring records that are read at a time.
RANGE_BYTES = 1_000_000
#: Ranges that a task reads, about.
TASK_RANGES = 16
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ID = "urn:page:"
READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"

# Fixed values of the ZIP format: signatures and fixed parts of its records.
END, END64_PLACE, END64 = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06"
ENTRY, LOCAL = b"PK\x01\x02", b"PK\x03\x04"


class ZipDirectory:
    """Members of a ZIP archive, from its directories. ``read(start, length)`` gives bytes of it."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail_at = max(0, size - 22 - 65535)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(END)
        if at < 0:
            raise ValueError("no end record of a ZIP archive")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            place = read(tail_at + at - 20, 20)
            if place[:4] != END64_PLACE:
                raise ValueError("no ZIP64 locator")
            end64 = read(struct.unpack_from("<Q", place, 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
        self.members: dict[str, tuple[int, int, int]] = {}
        directory, at = read(start, length), 0
        for _ in range(count):
            if directory[at : at + 4] != ENTRY:
                raise ValueError("bad entry in the central directory")
            method, packed, full, n_name, n_extra, n_note = struct.unpack_from("<10xH8xIIHHH", directory, at)
            (local,) = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            full, packed, local = self._wide(extra, full, packed, local)
            self.members[name] = (method, local, packed)
            at += 46 + n_name + n_extra + n_note

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """The ZIP64 extra field holds, in order, the values that don't fit 32 bits."""
        at, wide = 0, b""
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = extra[at + 4 : at + 4 + n]
            at += 4 + n
        out, used = [], 0
        for v in values:
            if v == 0xFFFFFFFF and len(wide) >= used + 8:
                (v,) = struct.unpack_from("<Q", wide, used)
                used += 8
            out.append(v)
        return out

    def place(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        method, local, length = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members have ranges")
        head = self.read(local, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return local + 30 + n_name + n_extra, length


def file_store(path: str):
    """The file system of a path, by pyarrow, and the path there."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    local = re.match("file:/+", path)
    return (fs.LocalFileSystem(), "/" + path[local.end() :]) if local else fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def range_reader(path: str) -> tuple[Callable[[int, int], bytes], int]:
    """Ranges of a file by any file system that pyarrow knows, and its size."""
    store, inner = file_store(path)
    source = store.open_input_file(inner)
    return (lambda start, length: source.read_at(length, start)), source.size()


def bytes_reader(content: bytes) -> tuple[Callable[[int, int], bytes], int]:
    view = memoryview(content)
    return (lambda start, length: bytes(view[start : start + length])), len(view)


def warc_record(page_id, url, kind: str, refers_to, payload: bytes, length: int, sha1: str) -> bytes:
    """One record, its payload left out of a revisit."""
    digest = base64.b32encode(binascii.unhexlify(sha1)).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, rest[: int(headers["content-length"])]


class ArchiveWriter:
    def __init__(self):
        self.data, self.index, self.n, self.at = [], [], 0, 0

    def add(self, page_id, record: bytes) -> None:
        gz = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = gz.compress(record) + gz.flush()
        self.index.append(json.dumps({"page_id": page_id, "offset": self.at, "length": len(packed)}))
        self.data.append(packed)
        self.at += len(packed)
        self.n += 1

    def close(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, body in ((RECORDS, b"".join(self.data)), (INDEX, "\n".join(self.index).encode())):
                z.writestr(zipfile.ZipInfo(name), body)
        return out.getvalue()


def record_places(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[int, int]]:
    """Where each record that the archive's indexes list begins, and its length."""
    zip_ = ZipDirectory(read, size)
    start, length = zip_.place(RECORDS)
    for name in (n for n in zip_.members if n.startswith("indexes/")):
        at, n = zip_.place(name)
        for line in zip_.read(at, n).splitlines():
            entry = json.loads(line)
            if entry["offset"] + entry["length"] > length:
                raise ValueError("the index points past the records")
            yield start + entry["offset"], entry["length"]


def archive_records(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record that the archive's indexes list, each read by its range."""
    for at, n in record_places(read, size):
        yield parse_record(zlib.decompress(read(at, n), 31))


def neighbouring(places: Iterator[tuple[int, int]], limit: int) -> Iterator[list[tuple[int, int]]]:
    """Places that follow each other, up to about ``limit`` bytes together; a longer record is alone."""
    held: list[tuple[int, int]] = []
    for at, n in places:
        if held and (at != sum(held[-1]) or at + n - held[0][0] > limit):
            yield held
            held = []
        held.append((at, n))
    if held:
        yield held


def plan_records(pages: DataFrame, n_rows: int | None = None) -> DataFrame:
    """page_id, url, payload, its length and SHA-1, record_type and refers_to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "sha1": F.sha1("payload"), "key": F.sha2("payload", 256)})
    short = rows.where(F.col("payload_bytes") < REVISIT_BYTES).withColumn("keep_id", F.col("page_id"))
    long = rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
    keys = materialise(long.select("page_id", "key"), "payloads")
    long = find_repeats(keys, "key", "page_id", n_rows, F.max).mark(long, "key", "page_id").drop("group_size")
    is_first = F.col("page_id").eqNullSafe(F.col("keep_id"))
    return short.unionByName(long).select(
        "page_id", "url", "payload_bytes", "sha1",
        F.when(is_first, F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
        F.when(is_first, "response").otherwise("revisit").alias("record_type"),
        F.when(~is_first, F.col("keep_id")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, n_rows: int | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """path, n_records and size of bounded archives, written when the result is (which has to be kept: it alone says which count)."""
    folder = f"{shared_dir(pages.sparkSession)}/lodestack/archives-{uuid.uuid4().hex}"

    @releasing
    def run(batches):
        store, inner = file_store(folder)
        store.create_dir(inner, recursive=True)

        def closed(writer: ArchiveWriter) -> pa.RecordBatch:
            name, body = f"{uuid.uuid4().hex}.zip", writer.close()
            with store.open_output_stream(f"{inner}/{name}") as out:
                out.write(body)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([writer.n], pa.int64()), pa.array([len(body)], pa.int64())], names=["path", "n_records", "size"])

        writer = ArchiveWriter()
        names = ("page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "sha1")
        for part in chunks(batches, "payload"):
            for row in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                writer.add(row[0], warc_record(*row))
                if writer.at >= archive_bytes:
                    yield closed(writer)
                    writer = ArchiveWriter()
        if writer.n:
            yield closed(writer)

    return plan_records(pages, n_rows).mapInArrow(run, "path string, n_records bigint, size bigint")


RANGES = "path string, places array<struct<at:bigint,n:bigint>>"


def record_ranges(archives: DataFrame, limit: int = RANGE_BYTES) -> DataFrame:
    """path and places: the neighbouring records of each range."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                read, size = range_reader(path)
                found = [{"path": path, "places": [{"at": at, "n": n} for at, n in part]} for part in neighbouring(record_places(read, size), limit)]
                yield pa.RecordBatch.from_pylist(found, pa.schema([("path", pa.string()), ("places", pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())])))]))

    return archives.select("path").mapInArrow(run, RANGES)


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of archives (path), read by ranges; digests are taken anew from payloads."""
    of_id = lambda s: int(x) if (x := s.strip("<>").removeprefix(ID)) else None

    def row_of(raw: bytes) -> tuple:
        head, block = parse_record(zlib.decompress(raw, 31))
        http, _, payload = block.partition(b"\r\n\r\n")
        kind = head["warc-type"]
        stated = binascii.hexlify(base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))).decode()
        if kind == "revisit":
            n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            digest = stated
        else:
            n, digest = len(payload), hashlib.sha1(payload).hexdigest()
            if digest != stated:
                raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
        refers = of_id(head["warc-refers-to"]) if "warc-refers-to" in head else None
        return (of_id(head["warc-record-id"]), head.get("warc-target-uri"), n, digest, kind, refers, *([payload] if with_payload else []))

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if with_payload else [])]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]

    @releasing
    def run(batches):
        opened: tuple = (None, None)
        for batch in batches:
            for path, places in zip(batch.column("path").to_pylist(), batch.column("places").to_pylist(), strict=True):
                if opened[0] != path:
                    opened = path, range_reader(path)[0]
                begin = places[0]["at"]
                raw = opened[1](begin, places[-1]["at"] + places[-1]["n"] - begin)
                rows = [row_of(raw[x["at"] - begin :][: x["n"]]) for x in places]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    # a row for a range: these are small, so a number of tasks by their bytes would be one for them all
    ranges = materialise(record_ranges(archives), "ranges")
    tasks = -(-ranges.count() // TASK_RANGES) or 1
    return ranges.repartition(tasks, "path", "places").mapInArrow(run, READ + (", payload binary" if with_payload else ""))
