"""What a file is, from its first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import looks_like_text
from ..sources.binary import scan_heads

HEAD_BYTES = 512
# Kinds by first byte, and by the second after FC.
KINDS = {
    252: "QuickBASIC 4.5", 253: "QuickBASIC 4.0", 254: "QuickBASIC 3 or earlier", 255: "GW-BASIC, BASICA or MSX-BASIC",
    249: "older Microsoft BASIC", 241: "older Microsoft BASIC", 243: "older Microsoft BASIC",
}
VERSIONS = {0: "QuickBASIC 4.5", 2: "BASIC 7 PDS"}
#: What reads a file, by first byte.
OWN, UNTESTED, OTHER = "this engine", "untested here", "another tool"
TOOLS = {252: OWN, 253: UNTESTED, 254: UNTESTED}


def _by_byte(first: Column, values: dict, default) -> Column:
    out = default
    for k, v in values.items():
        out = F.when(first == k, v).otherwise(out)
    return out


def kind_of(first: Column, second: Column, text: Column) -> Column:
    """first and second: bytes as numbers, null where the file ends before; text: whether the head looks like text."""
    out = _by_byte(first, KINDS, F.when(text, "plain text").otherwise("unrecognised"))
    for k, v in VERSIONS.items():
        out = F.when((first == 252) & (second == k), v).otherwise(out)
    return F.when(first.isNull(), "empty").otherwise(out)


def verdict(first: Column, second: Column, text: Column) -> dict[str, Column]:
    """kind, tool, detail and convertible."""
    plain = ~first.isin(*KINDS) & text
    tool = _by_byte(first, dict.fromkeys(KINDS, OTHER) | TOOLS, F.when(text, "nothing to do").otherwise("none"))
    detail = F.when(first == 254, "may be a protected save").when(plain, "already source").otherwise("")
    return {"kind": kind_of(first, second, text), "tool": F.coalesce(F.when(first.isNull(), "none"), tool), "detail": F.coalesce(F.when(first.isNull(), ""), detail), "convertible": convertible(first)}


def convertible(first: Column) -> Column:
    """Whether the decoder may read it: an FC file, whatever its version says."""
    return F.coalesce(first == 252, F.lit(False))


def triage(files: DataFrame) -> DataFrame:
    """files: path, content (a head will do). One row each: first_byte, kind, tool, detail and convertible."""
    head = F.substring("content", 1, HEAD_BYTES)
    byte = lambda i: F.conv(F.hex(F.substring("content", i, 1)), 16, 10).cast("int")
    rows = files.select("path", head.alias("head"), byte(1).alias("first_byte"), byte(2).alias("second"), *(["error"] if "error" in files.columns else []))
    said = verdict(F.col("first_byte"), F.col("second"), looks_like_text(F.decode("head", "ISO-8859-1")))
    if "error" in files.columns:
        lost = F.col("error").isNotNull()
        said |= {"kind": F.when(lost, "unreadable").otherwise(said["kind"]), "tool": F.when(lost, "none").otherwise(said["tool"]), "detail": F.coalesce("error", said["detail"])}
    return rows.select("path", "first_byte", *(c.alias(k) for k, c in said.items()))


def triage_scan(spark: SparkSession, path: str, glob: str = "*.[Bb][Aa][Ss]") -> DataFrame:
    """Triage of the files below path, by path. Tasks read the heads only."""
    return triage(scan_heads(spark, path, glob, HEAD_BYTES)).orderBy("path")


def triage_report(found: DataFrame) -> DataFrame:
    """Files by kind, most first. (What a caller hides of the rows still counts.)"""
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")
