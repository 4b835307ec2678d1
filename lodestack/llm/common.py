"""What several operators share: shared storage, and batches bounded in bytes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.batches import release
from ..sources.binary import shared_dir

#: White space of the word operators: space, and tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = r"[\x20\x09-\x0D]+"
#: Characters of text that a Python worker holds as words at a time.
CHUNK_CHARS = 2_000_000
#: Rows of a slice; their numbers fit 16 bits.
MAX_ROWS = 50_000

_held: dict = {}


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/lodestack/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(key, make):
    """The table that a worker keeps between tasks. It keeps one: an operator's table goes when another's is asked for."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that releases what it no longer uses when its task ends."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_thirds(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the split between learning and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices whose texts hold about ``limit`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > limit or i - start >= MAX_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def text_slices(texts: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """The same for a column, as strings: null reads as empty."""
    for part in chunks(iter([pa.RecordBatch.from_arrays([texts], names=["t"])]), "t", limit):
        yield [t or "" for t in part.column("t").to_pylist()]


import pyarrow.compute  # noqa: E402,F401  (pa.compute)
