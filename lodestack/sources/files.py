"""Sinks of one file a row, and files that sources include."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value of the language: the metacommand that includes a file.
INCLUDE = r"(?i)^\s*(?:'|REM\s)\s*\$INCLUDE\s*:\s*'([^']*)"


def text_image(lines: DataFrame) -> DataFrame:
    """lines: path, line_no, line, optionally error. path, content (Latin-1 with CRLF, in order of line_no) and has_error.

    A file is gathered in one row, since it becomes one object.
    """
    failed = F.coalesce(F.max(F.col("error").isNotNull()), F.lit(False)) if "error" in lines.columns else F.lit(False)
    rows = lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("line", F.lit("")).alias("line")))).alias("all"), failed.alias("has_error"))
    text = F.concat(F.array_join(F.col("all.line"), "\r\n"), F.lit("\r\n"))
    return rows.select("path", F.encode(text, "ISO-8859-1").alias("content"), "has_error")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """rows: file (a name below folder), content (binary or string). file and length of what was written.

    folder has to be one that all executors share. Each file is written beside
    its place and moved there, so a task that runs twice does no harm. Names
    that lead out of folder are an error. Nothing is written until the result is read.
    """
    root = os.path.abspath(folder)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["file"], batch["content"], strict=True):
                place = os.path.abspath(os.path.join(root, name))
                if os.path.commonpath([root, place]) != root or place == root:
                    raise ValueError(f"outside the folder: {name}")
                os.makedirs(os.path.dirname(place), exist_ok=True)
                beside = f"{place}.{uuid.uuid4().hex}"
                with open(beside, "wb") as f:
                    f.write(content or b"")
                os.replace(beside, place)
            yield pd.DataFrame({"file": batch["file"], "length": batch["content"].map(lambda b: len(b or b""))})

    content = F.col("content")
    if dict(rows.dtypes)["content"] == "string":
        content = F.encode(content, "ISO-8859-1")
    return rows.select("file", content.alias("content")).mapInPandas(put, "file string, length long")


def include_resolve(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """lines: path, line_no, line of sources. texts: path, line_no, line of all files that may be included.

    One row per line of an included file: path, line_no (of the metacommand),
    include, which (the number of that name in its source, by first use, case
    aside, from 1), included_no, line, error. Files are looked for beside the
    source, case aside (of several, the smallest path). A file that isn't there is one row with an error.
    """
    folder = lambda p: F.regexp_replace(p, "[^/]*$", "")
    name = F.trim(F.regexp_extract("line", INCLUDE, 1))
    asked = lines.where(F.col("line").rlike(INCLUDE)).select("path", "line_no", name.alias("include"), F.upper(F.concat(folder(F.col("path")), name)).alias("place"))
    # a source names few files: numbers come from its distinct names
    first = asked.groupBy("path", F.upper("include").alias("folded")).agg(F.min("line_no").alias("line_no"))
    order = F.expr("transform(array_sort(collect_list(struct(line_no, folded))), (x, i) -> struct(x.folded as folded, i + 1 as which))")
    numbers = first.groupBy("path").agg(order.alias("all")).select("path", F.inline("all"))
    asked = asked.withColumn("folded", F.upper("include")).join(numbers, ["path", "folded"])
    files = texts.groupBy(F.upper("path").alias("place")).agg(F.min("path").alias("found"))
    where = asked.join(files, "place", "left")
    body = texts.select(F.col("path").alias("found"), F.col("line_no").alias("included_no"), "line")
    error = F.when(F.col("found").isNull(), F.concat(F.lit("include file not found: "), "include"))
    return where.join(body, "found", "left").select("path", "line_no", "include", "which", "included_no", "line", error.alias("error"))
