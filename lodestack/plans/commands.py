"""The commands as functions: each takes a folder (or a table of path and content), gives a DataFrame and leaves it as the view ``lodestack_<name>``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import wraps

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mbf, text
from ..operators import decode, program, render, report, source, structure, symbols, triage
from ..sources import binary, files, helpfile
from ..sources.batches import slices
from ..sources.opcodes import DEFAULT, table

COMMANDS: dict = {}


def _command(run):
    @wraps(run)
    def called(spark: SparkSession, where, *args, **kwargs) -> DataFrame:
        rows = binary.scan_binary(spark, where) if isinstance(where, str) else where
        found = run(rows, *args, **kwargs)
        found.createOrReplaceTempView(f"lodestack_{run.__name__}")
        return found

    COMMANDS[run.__name__] = called
    return called


def _sections(rows: DataFrame) -> DataFrame:
    return structure.parse_sections(rows)


@_command
def dump(rows: DataFrame) -> DataFrame:
    """A row a section: the file's size, header and names, and the section's place and trailer."""
    head = structure.header(rows, "content").select("path", F.length("content").alias("n_bytes"), program.standard_header(F.col("content")).alias("standard_header"), "version", "uses_tabs", "code_at", "names_end", "error")
    counted = structure.parse_names(rows).groupBy("path").agg(F.count("ref").alias("n_names"), F.count_if(F.col("flags").bitwiseAND(F.lit(64)) != 0).alias("n_subs"))
    parts = _sections(rows).where("error is null").select("path", "section", "name", "offset", "declared_length", "trailer")
    return head.join(counted, "path", "left").join(parts, "path", "left").orderBy("path", "section")


@_command
def names(rows: DataFrame, procedures: bool = False) -> DataFrame:
    """Entries of name tables: ref, place in the file, link, kind and what is shown."""
    found = structure.parse_names(rows)
    if procedures:
        found = symbols.subs(found)
    kind = symbols.name_properties(F.col("flags"), F.col("name"))["kind"]
    # files of the later product begin one byte later
    shift = structure.header(rows).select("path", "shift")
    place = (F.col("ref") + structure.BUCKETS_AT + F.col("shift")).alias("place")
    return found.join(shift, "path", "left").select("path", "ref", place, "link", kind.alias("kind"), "name", "error").orderBy("path", "ref")


@_command
def sections(rows: DataFrame, index: int | None = None, with_bytes: bool = False) -> DataFrame:
    """Sections with their places; with_bytes: a row for each 16 bytes of their streams."""
    found = _sections(rows)
    if index is not None:
        found = found.where(F.col("section") == index)
    found = found.select("path", "section", F.coalesce("name", F.lit("<module text>")).alias("name"), "offset", "declared_length", "body", "error")
    if with_bytes:
        found = found.select("path", "section", "name", F.inline_outer(text.hexdump(F.col("body"))))
        return found.orderBy("path", "section", "off")
    return found.drop("body").orderBy("path", "section")


@_command
def lines(rows: DataFrame, index: int | None = None, opcodes: str = DEFAULT) -> DataFrame:
    """Decoded lines, each as the mnemonics and operands of its instructions; operands that are references show the name."""
    decoded = decode.decode_sections(_sections(rows), opcodes)
    if index is not None:
        decoded = decoded.where(F.col("section") == index)
    instrs = decode.instr_rows(decoded)
    known = structure.parse_names(rows).where("ref is not null").select("path", F.col("ref").alias("word"), F.when(F.col("flags").isin(2, 4, 6), F.concat(F.lit("@"), "name")).otherwise(F.col("name")).alias("named"))
    words = instrs.select("path", "section", "line_no", "instr_no", F.posexplode("operands").alias("k", "word")).join(known, ["path", "word"], "left")
    shown = F.coalesce("named", F.concat(F.lit("0x"), F.lower(F.lpad(F.hex("word"), 4, "0"))))
    said = words.groupBy("path", "section", "line_no", "instr_no").agg(F.array_sort(F.collect_list(F.struct("k", shown.alias("s")))).alias("o"))
    texts = render.text_rows(instrs).select("path", "section", "line_no", "instr_no", "text")
    each = instrs.select("path", "section", "line_no", "instr_no", F.coalesce("mnemonic", F.concat(F.lit("?"), F.hex("code"))).alias("m")).join(said, ["path", "section", "line_no", "instr_no"], "left").join(texts, ["path", "section", "line_no", "instr_no"], "left")
    word = F.concat_ws(" ", "m", F.array_join("o.s", " "), F.when(F.col("text").isNotNull(), F.concat(F.lit("'"), "text", F.lit("'"))))
    whole = each.select("path", "section", "line_no", F.struct("instr_no", F.trim(word).alias("w")).alias("i")).groupBy("path", "section", "line_no").agg(F.array_join(F.array_sort(F.collect_list("i")).w, " ").alias("instructions"))
    heads = decode.line_rows(decoded).select("path", "section", "line_no", "indent", "label_ref")
    return heads.join(whole, ["path", "section", "line_no"], "left").orderBy("path", "section", "line_no")


@_command
def stats(rows: DataFrame, opcodes: str = DEFAULT) -> DataFrame:
    """Opcodes and unidentified ones by section, by file and in total."""
    decoded = decode.decode_sections(_sections(rows), opcodes)
    found = decode.instr_rows(decoded).select("path", F.col("section").cast("string").alias("section"), F.when(F.col("mnemonic").isNull(), "unidentified").otherwise("opcode").alias("class"))
    return report.stats(found.withColumnRenamed("path", "file"), "file", "section")


@_command
def detok(rows: DataFrame, opcodes: str = DEFAULT) -> DataFrame:
    """Text files of programs: path, content (Latin-1, CRLF) and has_error, true where a line or the file couldn't be read."""
    return files.text_image(render.render_files(rows, opcodes))


def _as_text(rows: DataFrame) -> DataFrame:
    return rows if "text" in rows.columns else rows.select("path", F.decode("content", "ISO-8859-1").alias("text"))


@_command
def tok(rows: DataFrame, opcodes: str = DEFAULT, texts: DataFrame | None = None) -> DataFrame:
    """Program files of source: path, content and error."""
    return program.tokenize(_as_text(rows), opcodes, texts)


@_command
def fmt(rows: DataFrame, opcodes: str = DEFAULT) -> DataFrame:
    """Source as the product writes it: path, before, after, changed, error and diff. Nothing is written in place."""
    found = program.fmt(_as_text(rows), opcodes)
    return found.join(source.fmt_diff(found.where("changed")), "path", "left")


@_command
def lint(rows: DataFrame, opcodes: str = DEFAULT) -> DataFrame:
    """Findings, gravest first."""
    return report.ranked(report.lint_check(rows, opcodes))


@_command
def triage_files(rows: DataFrame, convertible_only: bool = False) -> DataFrame:
    """What each file is, by path."""
    found = triage.triage(rows)
    return (found.where("convertible") if convertible_only else found).orderBy("path")


@_command
def hlp_list(rows: DataFrame) -> DataFrame:
    """Contexts of help databases, by name."""
    return helpfile.hlp_contexts(helpfile.parse_hlp(rows)).orderBy("path", F.lower("context"), "place")


@_command
def hlp_show(rows: DataFrame, topic: str | int, body: bool = False) -> DataFrame:
    """Lines of one topic, by number or by a context's name; body leaves out the first."""
    helps = helpfile.parse_hlp(rows)
    found = helpfile.hlp_lines(helps, body)
    if isinstance(topic, int):
        found = found.where(F.col("topic") == topic)
    else:
        asked = helps.select("path", F.lit(topic).alias("asked"))
        found = found.join(helpfile.hlp_topic_for(helpfile.hlp_contexts(helps), asked).select("path", "topic"), ["path", "topic"], "left_semi")
    return found.orderBy("path", "topic", "line_no")


@_command
def hlp_dump(rows: DataFrame, body: bool = False) -> DataFrame:
    """A text file for each topic: path, file and text."""
    return helpfile.hlp_dump(helpfile.parse_hlp(rows), body)


def register(spark: SparkSession, opcodes: str = DEFAULT) -> None:
    """SQL functions: tokenize_basic(text), render_program(content), mbf_single(hex), mbf_double(hex)."""
    ops = table(opcodes)

    def tokenize_basic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in slices(batches):
            yield pd.Series([_tried(lambda t: program.tokenize_text(t, ops), x) for x in batch], dtype=object)

    def render_program(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in slices(batches):
            yield pd.Series([_tried(lambda c: "\n".join(x for x, _ in render.Program.read(c, ops).text(ops)), x) for x in batch], dtype=object)

    spark.udf.register("tokenize_basic", F.pandas_udf(tokenize_basic, "binary"))
    spark.udf.register("render_program", F.pandas_udf(render_program, "string"))


def _tried(read, value):
    try:
        return None if value is None else read(value)
    except ValueError:
        return None


def mbf_table(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """rows with the value of an old float (bits: 24 or 56)."""
    return rows.withColumn("value", mbf.decode(F.col(column), bits))
