"""Help databases: contexts, topics and their display lines, one file to a row of an Arrow batch."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import slices
from .binary import scan_binary

# Fixed values of the format: magic, places of the counts, the name and the six section offsets, words of the code tree.
MAGIC, COUNTS_AT, NAME_AT, SECTIONS_AT, TREE_WORDS = b"LN", 8, 16, 34, 512
LEAF = 0x8000

#: Records that make or continue a display line.
_RECORD = re.compile(rb"\x02(?P<raw>[\0\2])|\x04\0")
#: What a segment is made of; the first alternative ends it.
_PIECE = re.compile(rb"(?P<end>\x02[\0-\2]|[\x04\x0e]\0)|(?P<word>[\x10-\x17].)|\x18(?P<blanks>.)|\x1a.|\xff[^\0]*(?:\0|\Z)|[\0-\x1f]|(?P<plain>[\x20-\xfe])", re.DOTALL)

SCHEMA = "name string, contexts array<struct<context:string,topic:int>>, topics array<array<string>>, error string"


class Coder:
    """A code tree as an automaton over bytes, whose moves are kept once made (at most words x 256)."""

    def __init__(self, tree: tuple[int, ...]):
        self.tree, self.moves = tree, {}

    def _move(self, at: int, byte: int) -> tuple[bytes, int | None]:
        made, key = bytearray(), (at, byte)
        for bit in f"{byte:08b}":
            at = at + 1 if bit == "1" else self.tree[at] >> 1
            if at >= len(self.tree):
                return self.moves.setdefault(key, (bytes(made), None))
            if self.tree[at] & LEAF:
                made.append(self.tree[at] & 255)
                at = 0
        return self.moves.setdefault(key, (bytes(made), at))

    def decode(self, blob: bytes) -> bytes:
        """The first word is the decoded size; a walk that leaves the tree ends the text."""
        size, made, at = int.from_bytes(blob[:2], "little"), bytearray(), 0
        for byte in blob[2:]:
            if at is None or len(made) >= size:
                break
            more, at = self.moves.get((at, byte)) or self._move(at, byte)
            made += more
        return bytes(made[:size])


def declared_length(byte: Column) -> Column:
    """Characters that a record's first byte declares; none if it could be a control code."""
    return F.when(byte >= 32, byte - 1)


def _segment(raw: bytes, at: int, most: int | None, words: list[bytes]) -> tuple[str, int]:
    made = bytearray()
    while (most is None or len(made) < most) and (piece := _PIECE.match(raw, at)) and piece["end"] is None:
        at = piece.end()
        if word := piece["word"]:
            index = (word[0] & 3) << 8 | word[1]
            if index < len(words):
                made += words[index] + b" " * (word[0] >= 0x14)
        elif piece["blanks"]:
            made += b" " * piece["blanks"][0]
        else:
            made += piece["plain"] or b""
    return made.decode("latin-1"), at


def display_lines(raw: bytes, words: list[bytes]) -> list[str]:
    """Lines of a decoded topic. A continuation joins the line before it."""
    lines, at = [], 0
    while record := _RECORD.search(raw, at):
        at, kind = record.end(), record["raw"]
        if at == len(raw) and kind == b"\0":
            break
        declared = raw[at] - 1 if at < len(raw) and raw[at] >= 32 else None
        if declared is not None and kind != b"\2":
            at += 1
        text, at = _segment(raw, at, declared, words)
        if kind is None and lines:
            lines[-1] += text
        else:
            lines.append(text)
    return lines


def _dictionary(packed: bytes) -> list[bytes]:
    words, at = [], 0
    while at < len(packed) and packed[at]:
        words.append(packed[at + 1 : at + 1 + packed[at]])
        at += 1 + packed[at]
    return words


def parse(data: bytes) -> dict:
    """One database. What doesn't fit the format gives an error instead of topics."""
    nothing = {"name": None, "contexts": None, "topics": None}
    if data[:2] != MAGIC:
        return nothing | {"error": "not a help file"}
    try:
        topics, contexts = struct.unpack_from("<2H", data, COUNTS_AT)
        index_at, names_at, map_at, words_at, tree_at, _ = struct.unpack_from("<6I", data, SECTIONS_AT)
        tree = struct.unpack_from(f"<{TREE_WORDS}H", data, tree_at)
        index = struct.unpack_from(f"<{topics + 1}I", data, index_at)
        topic_of = struct.unpack_from(f"<{contexts}H", data, map_at)
    except struct.error:
        return nothing | {"error": "truncated"}
    words, coder = _dictionary(data[words_at:tree_at]), Coder(tree)
    names = [n.decode("latin-1") for n in data[names_at:map_at].split(b"\0") if n]
    return {
        "name": data[NAME_AT:SECTIONS_AT].split(b"\0")[0].decode("latin-1"),
        "contexts": [{"context": c, "topic": t} for c, t in dict(zip(names, topic_of, strict=False)).items()],
        "topics": [display_lines(coder.decode(data[a:b]), words) for a, b in zip(index, index[1:], strict=False)],
        "error": None,
    }


def _parsed(content: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in slices(content):
        yield pd.DataFrame([parse(b or b"") for b in batch], columns=["name", "contexts", "topics", "error"])


def scan_hlp(spark: SparkSession, path: str, glob: str = "*.[Hh][Ll][Pp]") -> DataFrame:
    """path, name, contexts, topics, error of the databases below path."""
    return parse_hlp(scan_binary(spark, path, glob))


def parse_hlp(files: DataFrame) -> DataFrame:
    """files: path, content."""
    return files.select("path", F.pandas_udf(_parsed, SCHEMA)("content").alias("h")).select("path", "h.*")


def hlp_contexts(helps: DataFrame) -> DataFrame:
    """path, context, topic, place: a context named twice keeps its first place and its last topic."""
    return helps.select("path", F.posexplode("contexts").alias("place", "c")).select("path", "place", "c.*")


def hlp_lines(helps: DataFrame, body: bool = False) -> DataFrame:
    """path, topic, line_no, line. body leaves out each topic's first line, the browser's menu."""
    lines = helps.select("path", F.posexplode("topics").alias("topic", "lines")).select("path", "topic", F.posexplode("lines").alias("line_no", "line"))
    return lines.where("line_no > 0") if body else lines


def hlp_topic_for(contexts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: path, asked. The context of that very name, else the first that differs in case only; null if there is none."""
    same = (F.col("w.path") == F.col("c.path")) & (F.lower("w.asked") == F.lower("c.context"))
    best = F.min_by("c.topic", F.struct(F.col("c.context") != F.col("w.asked"), F.col("c.place")))
    return wanted.distinct().alias("w").join(contexts.alias("c"), same, "left").groupBy("w.path", "w.asked").agg(best.alias("topic"))


def hlp_dump(helps: DataFrame, body: bool = False) -> DataFrame:
    """path, file, text: a text file for each topic, named after its number and the first context that leads to it."""
    first = hlp_contexts(helps).groupBy("path", "topic").agg(F.min_by("context", "place").alias("context"))
    topics = helps.select("path", F.posexplode("topics").alias("topic", "lines"))
    stem = F.regexp_replace(F.coalesce("context", F.lit("topic")), r"[^\p{L}\p{N}._$-]", "_")
    lines = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))) if body else F.col("lines")
    return topics.join(first, ["path", "topic"], "left").select(
        "path", F.concat(F.lpad(F.col("topic").cast("string"), 4, "0"), F.lit("_"), stem, F.lit(".txt")).alias("file"), F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text")
    )
