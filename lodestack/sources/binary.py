"""Reading archives, and writing what ends a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def scan_binary(spark: SparkSession, path: str, glob: str = "*.[Bb][Aa][Ss]") -> DataFrame:
    """path, content, length of the files below path whose names match, case aside. Spark's reader passes over empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content", "length")


def scan_heads(spark: SparkSession, path: str, glob: str = "*.[Bb][Aa][Ss]", n: int = 512) -> DataFrame:
    """path, content (the first n bytes) and error. The listing reads no content; tasks read each head by its range."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, *_head(p, n)) for p in batch["path"]], columns=["path", "content", "error"])

    return files.mapInPandas(heads, "path string, content binary, error string")


def _head(path: str, n: int) -> tuple[bytes | None, str | None]:
    from pyarrow import fs

    local = re.match("file:/+", path)
    try:
        store, inner = (fs.LocalFileSystem(), unquote("/" + path[local.end() :])) if local else fs.FileSystem.from_uri(path)
        with store.open_input_file(inner) as source:
            return source.read_at(min(n, source.size()), 0), None
    except OSError as e:
        return None, str(e)


def scan_text(spark: SparkSession, path: str, glob: str = "*.[Bb][Aa][Ss]") -> DataFrame:
    """path, line_no, line: source read as Latin-1, split where that encoding has line ends."""
    from ..functions.text import LINE_END

    text = F.decode("content", "ISO-8859-1")
    return scan_binary(spark, path, glob).select("path", F.posexplode(F.split(text, LINE_END)).alias("line_no", "line"))


def pack(files: DataFrame, path: str) -> DataFrame:
    """Many small files as one table."""
    files.write.mode("overwrite").parquet(path)
    return files.sparkSession.read.parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. A folder of our own only where there are no other machines; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lodestack-"))
    return _own[0]


def spill(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the cluster's shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/lodestack/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_spilled(spark: SparkSession) -> None:
    """Remove what ``spill`` and the training-data operators wrote to the shared folder, once a job is over."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{shared_dir(spark)}/lodestack")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
