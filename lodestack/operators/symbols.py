"""Names: interning, layout, chains, resolution, as joins and windows within a file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.batches import slices

# Place of the first name, length of an entry's head, end of a label chain.
FIRST_REF, HEAD, END_OF_CHAIN = 86, 4, 65535


def intern_names(names: DataFrame) -> DataFrame:
    """names: file_id, flags, name, pos. The first spelling of each name, case aside; ties of pos go to the smaller spelling."""
    rows = names.groupBy("file_id", "flags", F.lower("name").alias("folded")).agg(F.min(F.struct("pos", "name")).alias("first"))
    return rows.select("file_id", "flags", "first.name", "first.pos")


def name_layout(names: DataFrame) -> DataFrame:
    """names: file_id, pos, name, bucket. Reference of each entry, and the next in its bucket (0 at the end)."""
    before = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = names.withColumn("ref", FIRST_REF + F.coalesce(F.sum(HEAD + F.length("name")).over(before), F.lit(0)))
    chain = Window.partitionBy("file_id", "bucket").orderBy("ref")
    return placed.withColumn("link", F.coalesce(F.lead("ref").over(chain), F.lit(0)))


def bucket_heads(placed: DataFrame) -> DataFrame:
    return placed.groupBy("file_id", "bucket").agg(F.min("ref").alias("head"))


def label_chain(lines: DataFrame) -> DataFrame:
    """lines: file_id, off of labelled lines. Each links two bytes past the next."""
    w = Window.partitionBy("file_id").orderBy("off")
    return lines.withColumn("link", F.coalesce(F.lead("off").over(w) + 2, F.lit(END_OF_CHAIN)))


WALKED = "array<struct<bucket:int,ref:bigint,step:bigint,error:string>>"


def walk_chains(heads: DataFrame, entries: DataFrame) -> DataFrame:
    """Follow the links from heads (file_id, bucket, head) through entries (file_id, ref, link).

    Returns file_id, bucket, ref, step and error. A link to nothing is a row with
    an error, and so is the entry that a chain comes back to; the chain ends there.
    References have 16 bits, so a file's entries are a bounded array.
    """

    @F.pandas_udf(WALKED)
    def walk(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for starts, tables in slices(batches):
            yield pd.Series([list(_chains(h, {e["ref"]: e["link"] for e in t})) for h, t in zip(starts, tables, strict=True)], dtype=object)

    tables = entries.groupBy("file_id").agg(F.collect_list(F.struct(F.col("ref").cast("bigint").alias("ref"), F.col("link").cast("bigint").alias("link"))).alias("entries"))
    starts = heads.groupBy("file_id").agg(F.collect_list(F.struct(F.col("bucket").cast("int").alias("bucket"), F.col("head").cast("bigint").alias("head"))).alias("heads"))
    found = starts.join(tables, "file_id", "left").withColumn("entries", F.coalesce("entries", F.array().cast("array<struct<ref:bigint,link:bigint>>")))
    return found.select("file_id", F.inline(walk("heads", "entries")))


def _chains(heads, links: dict[int, int]) -> Iterator[tuple]:
    for h in heads:
        ref, seen, step = h["head"], set(), 0
        while ref:
            if ref in seen or ref not in links:
                yield h["bucket"], ref, step, "cycle" if ref in seen else "unknown reference"
                break
            yield h["bucket"], ref, step, None
            seen.add(ref)
            ref, step = links[ref], step + 1


def subs(names: DataFrame) -> DataFrame:
    """Entries that name procedures."""
    return names.where(F.col("flags").bitwiseAND(F.lit(64)) != 0)


def name_properties(flags: Column, name: Column) -> dict[str, Column]:
    """Kind of an entry, sub before label before name before line number."""
    is_sub = flags.bitwiseAND(F.lit(64)) != 0
    is_label = flags.bitwiseAND(F.lit(4)) != 0
    # a number beyond a word's range is kept as a label's name
    numeric = flags.isin(2, 6) | (flags == 4) & F.coalesce(name.rlike("^[0-9]+$"), F.lit(False))
    return {"is_sub": is_sub, "is_label": is_label & ~numeric, "kind": F.when(is_sub, "sub").when(numeric, "line").when(flags == 4, "label").otherwise("name")}


def resolve(instrs: DataFrame, names: DataFrame) -> DataFrame:
    """Left join of references to names; what isn't known shows as hex."""
    found = instrs.join(names.select("file_id", "ref", "name"), ["file_id", "ref"], "left")
    return found.withColumn("name", F.coalesce("name", F.concat(F.lit("<"), F.lower(F.lpad(F.hex("ref"), 4, "0")), F.lit(">"))))


def unknown_codes(instrs: DataFrame, opcodes: DataFrame) -> DataFrame:
    """Codes that neither the table nor a family names: a left anti join."""
    from ..functions.words import family_mnemonic

    return instrs.join(F.broadcast(opcodes.where("not later").select("code")), "code", "left_anti").where(family_mnemonic(F.col("code")).isNull())
