"""Batches for Python, bounded in bytes: Arrow counts rows, and a row may be a whole file."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes or characters that a worker turns into objects at a time, and values. What is made of them takes up to a hundred times as much.
SLICE_BYTES, SLICE_ROWS = 1 << 18, 1 << 10
#: Partitions for a core where Python does the work.
PIECES = 4

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library than glibc
    _trim = None


def release() -> None:
    """Give memory that no object uses back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _size(value) -> int:
    if isinstance(value, (bytes, str)):
        return len(value)
    if isinstance(value, dict):
        return sum(map(_size, value.values()))
    return 8 if not hasattr(value, "__len__") else sum(map(_size, value))


def slices(batches: Iterable[pd.Series | tuple[pd.Series, ...]], limit: int = SLICE_BYTES) -> Iterator:
    """Cut batches (a column, or a tuple of them) so that each slice holds about ``limit`` bytes; a longer row is a slice of its own.

    For functions of an iterator, which may give away what they make of a slice
    before they take the next. Rows stay in order, and none is left out.
    """
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        start = held = 0
        for i, row in enumerate(zip(*columns, strict=True)):
            n = sum(map(_size, row))
            if i > start and (held + n > limit or i - start >= SLICE_ROWS):
                yield _cut(batch, start, i)
                start, held = i, 0
            held += n
        yield _cut(batch, start, len(columns[0]))
        del batch, columns
    release()


def _cut(batch, start: int, end: int):
    cut = lambda c: c.iloc[start:end].reset_index(drop=True)
    return tuple(map(cut, batch)) if isinstance(batch, tuple) else cut(batch)


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to all cores: a small table that takes Python long to read comes in few partitions."""
    return rows.repartition(PIECES * rows.sparkSession.sparkContext.defaultParallelism)
