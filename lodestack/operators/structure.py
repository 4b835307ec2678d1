"""Program files as tables: header, buckets, names, sections and trailers.

A file that doesn't fit the format gives one row with an error and never ends a job.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.batches import slices

# Fixed values of the format: magic byte; version byte and by how much its layout is shifted; places of the words of the header.
MAGIC, SHIFT = 0xFC, {0: 0, 2: 1}
FLAGS_AT, CODE_AT, BUCKETS_AT, END_AT, NAMES_AT, BUCKETS = 19, 26, 28, 110, 114, 41
TABS = 128
TRAILER, TRAILER_FIELDS = struct.Struct("<8H"), ("h0", "h1", "h2", "h3", "line_count", "included_count", "unknown", "kind")
_ENTRY, _PREAMBLE = struct.Struct("<HBB"), struct.Struct("<BBBH")

NAMES_SCHEMA = "names array<struct<ref:int,link:int,flags:int,payload:binary>>, error string"
SECTIONS_SCHEMA = (
    "sections array<struct<section:int,offset:int,name:string,proc_kind:int,return_type:int,kind_byte:int,declared_length:int,body:binary,trailer:struct<"
    + ",".join(f"{f}:int" for f in TRAILER_FIELDS)
    + ">>>, tail binary, error string"
)


def byte_at(content: Column, at: Column | int) -> Column:
    """Unsigned byte, from 0; null past the end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when((at >= 0) & (at < F.length(content)), F.conv(F.hex(F.substring(content, at + 1, F.lit(1))), 16, 10).cast("int"))


def word_at(content: Column, at: Column | int) -> Column:
    """Unsigned little-endian word."""
    at = F.lit(at) if isinstance(at, int) else at
    return byte_at(content, at) + 256 * byte_at(content, at + 1)


def header(files: DataFrame, *keep: str) -> DataFrame:
    """files: path, content (read, not computed: each column here looks at it). path, what is to be kept, version, shift, uses_tabs, code_at, names_end and error; all built-in functions."""
    head = F.hex(F.substring("content", 1, NAMES_AT + 1))
    byte = lambda at: F.conv(F.substring(F.col("__head"), 2 * at + 1, F.lit(2)), 16, 10).cast("int")
    word = lambda at: byte(at) + 256 * byte(at + 1)
    rows = files.select("path", *keep, F.length("content").alias("__size"), head.alias("__head"))
    version, size = byte(F.lit(1)), F.col("__size")
    rows = rows.withColumns({"version": version, "shift": F.when(version == 0, 0).when(version == 2, 1)})
    shift = F.col("shift")
    base = BUCKETS_AT + shift
    rows = rows.withColumns({"code_at": word(F.lit(CODE_AT) + shift) + base, "names_end": word(F.lit(END_AT) + shift) + base})
    error = (
        F.when(size.isNull() | (size == 0), "empty file").when(byte(F.lit(0)) != MAGIC, "wrong magic").when(shift.isNull(), "unknown version")
        .when(size < NAMES_AT + shift, "truncated header").when(~F.col("names_end").between(NAMES_AT + shift, size), "name table outside file")
        .when(~((F.col("code_at") >= NAMES_AT + shift) & (F.col("code_at") < size)), "code outside file")
    )
    return rows.select("path", *keep, "version", "shift", (byte(F.lit(FLAGS_AT)).bitwiseAND(F.lit(TABS)) != 0).alias("uses_tabs"), "code_at", "names_end", error.alias("error"))


def buckets(files: DataFrame) -> DataFrame:
    """path, bucket, head of files with a whole header."""
    c = F.col("content")
    known = header(files, "content").where("error is null")
    rows = known.select("path", "content", "shift", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket"))
    return rows.select("path", "bucket", word_at(c, BUCKETS_AT + F.col("shift") + 2 * F.col("bucket")).alias("head"))


def layout_shift(data: bytes) -> int:
    """The layout's shift, or ValueError."""
    if not data:
        raise ValueError("empty file")
    if data[0] != MAGIC:
        raise ValueError("wrong magic")
    if data[1:2] not in (b"\0", b"\2"):
        raise ValueError("unknown version")
    shift = SHIFT[data[1]]
    if len(data) < NAMES_AT + shift:
        raise ValueError("truncated header")
    return shift


def _base_word(data: bytes, at: int, shift: int) -> int:
    return int.from_bytes(data[at + shift : at + shift + 2], "little") + BUCKETS_AT + shift


def read_names(data: bytes) -> list[dict]:
    """Entries of the name table, in its order."""
    shift = layout_shift(data)
    end, found = _base_word(data, END_AT, shift), []
    if not NAMES_AT + shift <= end <= len(data):
        raise ValueError("name table outside file")
    table, at = memoryview(data)[:end], NAMES_AT + shift
    while at < end:
        if end - at < _ENTRY.size:
            raise ValueError("name entry past the table")
        link, flags, size = _ENTRY.unpack_from(table, at)
        payload = bytes(table[at + _ENTRY.size :][:size])
        if len(payload) < size:
            raise ValueError("name entry past the table")
        found.append({"ref": at - BUCKETS_AT - shift, "link": link, "flags": flags, "payload": payload})
        at += _ENTRY.size + size
    return found


def read_sections(data: bytes) -> tuple[list[dict], bytes]:
    """The module's section, then the procedures', and what is left after the last trailer."""
    shift = layout_shift(data)
    at, found = _base_word(data, CODE_AT, shift), []
    if not NAMES_AT + shift <= at < len(data):
        raise ValueError("code outside file")
    while at + 2 <= len(data):
        row = {"section": len(found), "offset": at, "name": None, "proc_kind": None, "return_type": None, "kind_byte": None}
        if found:
            named = at + 3 + data[at + 1]
            if named + _PREAMBLE.size > len(data):
                raise ValueError("procedure header past the file")
            row["name"] = data[at + 3 : named].decode("latin-1")
            row["proc_kind"], row["return_type"], row["kind_byte"], size = _PREAMBLE.unpack_from(data, named)
            begin = named + _PREAMBLE.size
        else:
            size, begin = int.from_bytes(data[at : at + 2], "little"), at + 2
        at = begin + size + TRAILER.size
        if at > len(data):
            raise ValueError("section past the file")
        found.append(row | {"declared_length": size, "body": data[begin : begin + size], "trailer": dict(zip(TRAILER_FIELDS, TRAILER.unpack_from(data, begin + size), strict=True))})
    return found, data[at:]


def _tried(read, data: bytes | None, blank: tuple) -> tuple:
    try:
        found = read(data or b"")
        return (*(found if isinstance(found, tuple) else (found,)), None)
    except ValueError as e:
        return (*blank, str(e))


def _names(content: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in slices(content):
        yield pd.DataFrame([_tried(read_names, b, (None,)) for b in batch], columns=["names", "error"])


def _sections(content: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in slices(content):
        yield pd.DataFrame([_tried(read_sections, b, (None, None)) for b in batch], columns=["sections", "tail", "error"])


def parse_names(files: DataFrame) -> DataFrame:
    """files: path, content. path, ref, link, flags, payload, name (Latin-1, or a line number) and error; a bad file is one row."""
    rows = files.select("path", F.pandas_udf(_names, NAMES_SCHEMA)("content").alias("n")).select("path", "n.error", F.explode_outer("n.names").alias("e")).select("path", "e.*", "error")
    number = F.when(F.length("payload") >= 2, word_at(F.col("payload"), 0).cast("string"))
    return rows.withColumn("name", F.when(F.col("flags").isin(2, 6), number).otherwise(F.decode("payload", "ISO-8859-1")))


def parse_sections(files: DataFrame) -> DataFrame:
    """files: path, content. path, version, the section's fields, its trailer's, and error; a bad file is one row."""
    rows = files.select("path", byte_at(F.col("content"), 1).alias("version"), F.pandas_udf(_sections, SECTIONS_SCHEMA)("content").alias("s"))
    return rows.select("path", "version", "s.error", F.explode_outer("s.sections").alias("e")).select("path", "version", "e.*", "error")
