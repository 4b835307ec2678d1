"""Triage as a stream of arriving files: the same stateless transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.triage import triage

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def triage_stream(spark: SparkSession, path: str, glob: str = "*.[Bb][Aa][Ss]") -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return triage(files.select("path", "content"))
