"""Operator 2, best-fit packing of token sequences.

Documents are tokenised and only longer ones cut into pieces of the sequence
length. Pieces are packed online: a fixed number of bins is open, a bitset has
a bit for each amount of free space that some open bin has, and a piece goes
where the least space is left (the lowest set bit at or above its length). When
one bin too many is open, the fullest closes.

Each task packs a bounded number of pieces. What is still open at its end is
packed again, together with what other tasks left open, until few tasks remain;
so every task holds a bounded number of bins and pieces.

Defined cases: null text counts as empty, and an empty document is a piece of
one token, the end mark; a document as long as a sequence fills one; pieces of
equal length go in the order read; repeated rows are packed each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import word_table
from .common import chunks, materialise, releasing

LENGTH = 4096
OPEN_BINS = 1024
PIECES_A_TASK = 200_000
#: Tasks whose open bins meet in one task of the next round.
FAN_IN = 64
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = PIECE + ", sequence_id bigint, offset bigint, open boolean"


class BestFit:
    """Bins in a bitset keyed by free space. Items carry a length and anything else."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.by_free = 0, [[] for _ in range(capacity + 1)]
        self.n_open = 0

    def _put(self, free: int, bin_: list) -> None:
        self.by_free[free].append(bin_)
        self.bits |= 1 << free

    def _take(self, free: int) -> list:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        return bin_

    def add(self, length: int, item) -> list | None:
        """Place an item; returns a bin that closes by that: a list of (offset, item)."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, []
            self.n_open += 1
        bin_.append((self.capacity - free, item))
        free -= length
        if not free:
            self.n_open -= 1
            return bin_
        self._put(free, bin_)
        if self.n_open > self.most:
            self.n_open -= 1
            return self._take((self.bits & -self.bits).bit_length() - 1)
        return None

    def rest(self) -> Iterator[list]:
        while self.bits:
            yield self._take((self.bits & -self.bits).bit_length() - 1)


def tokenised_pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, and its ids if asked for in ``with_ids``."""

    @releasing
    def run(batches):
        coder = word_table(path)
        for part in chunks(batches, "text"):
            rows: list[tuple] = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), coder.encode_texts([t or "" for t in part.column("text").to_pylist()]), strict=True):
                raw = ids.astype("<u4").tobytes() + end.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(raw), 4 * length)):
                    cut = raw[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def _packed(pieces: DataFrame, tasks: int, round_: int, length: int, open_bins: int) -> DataFrame:
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())

    def run(batches):
        task = TaskContext.get().partitionId()
        packer, made = BestFit(length, open_bins), 0

        def rows(bins, still_open):
            nonlocal made
            out = []
            for bin_ in bins:
                sequence = round_ << 58 | task << 34 | made
                made += 1
                out += [(*item, sequence, at, still_open) for at, item in bin_]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[*names, "sequence_id", "offset", "open"])

        for batch in batches:
            closed = [b for item in zip(*(batch.column(c).to_pylist() for c in names), strict=True) if (b := packer.add(item[3], item))]
            yield from rows(closed, False)
        yield from rows(list(packer.rest()), True)

    return pieces.select(names).repartition(tasks).mapInArrow(run, PLACED)


def pack_pieces(pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """pieces (written, so that a second reading gives the same) with sequence_id and offset."""
    tasks = max(1, -(-pieces.count() // pieces_a_task))
    parts, round_ = [], 0
    while True:
        placed = _packed(pieces, tasks, round_, length, open_bins)
        if tasks == 1:
            parts.append(placed)
            break
        placed = materialise(placed, f"packed{round_}")
        parts.append(placed.where("not open"))
        pieces, tasks, round_ = placed.where("open"), -(-tasks // FAN_IN), round_ + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("open")


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end: int = 1, open_bins: int = OPEN_BINS) -> DataFrame:
    return pack_pieces(materialise(tokenised_pieces(docs, path, length, end), "pieces"), length, open_bins)
