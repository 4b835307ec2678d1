"""Operator 1, exact dedup, in DataFrame functions only.

Two passes over the keys. A key has two bits in one 64-bit word of a Bloom
filter. The first pass finds the words and bit pairs that more than one row has
(counted where the rows are before anything moves) and keeps their bits. The
second tests every row against those words; only rows whose bits are all there
can be repeated, and only they shuffle: their groups are counted, and the groups
of more than one row go back to the rows.

The words that hold a repeated key are fewer than the repeated keys, whatever
the table's size; they and the groups are written and counted, and broadcast up
to ``BROADCAST_ROWS`` rows. Beyond it the words are joined by their number, with
keys and ids only, and of the rows those that passed the filter are joined with
their groups; the rest pass straight through. The groups that hold over a
thousandth of these rows (a thousand at most, by pigeonhole) are broadcast even
then, so no key is collected.

Defined cases: null text counts as empty; texts that differ only in runs of
white space are equal; of equal texts the smallest doc_id stays; rows that
repeat a doc_id and its text are one document listed twice, each row is
reported, and all of them carry ``kept`` (``drop_duplicates`` leaves one), as do
all rows of a group without any doc_id; a null doc_id sorts after all others; an
empty table gives an empty result; other columns pass through, and those named
like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise

#: Rows of the filter, or of groups, that may be broadcast.
BROADCAST_ROWS = 1 << 19
#: Cells of the filter to a row.
CELLS_PER_ROW = 16
RESULT = ("keep_id", "group_size", "kept")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def text_key(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def filter_words(n_rows: int) -> int:
    """Size of the filter in words of 64 cells: a power of two."""
    return 1 << max(10, (CELLS_PER_ROW * max(n_rows, 1) // 64).bit_length())


def with_cells(rows: DataFrame, key: str, words: int) -> DataFrame:
    """rows with the key's word and its bits there."""
    h = F.xxhash64(F.col(key))
    one = lambda at: f"shiftleft(1L, cast({at} & 63 as int))"
    return rows.withColumn("__h", h).withColumn("__word", F.shiftrightunsigned("__h", 12).bitwiseAND(F.lit(words - 1))).withColumn("__bits", F.expr(f"{one('__h')} | {one('shiftrightunsigned(__h, 6)')}")).drop("__h")


def repeated_words(rows: DataFrame, key: str, words: int) -> DataFrame:
    """First pass: words of the filter, with the bits that more than one row has."""
    hit = with_cells(rows.select(key), key, words)
    twice = hit.groupBy("__word", "__bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy("__word").agg(F.bit_or("__bits").alias("__filter"))


@dataclass
class Repeats:
    """What the two passes find: the filter's words, and the groups of more than one row (__key, keep_id, group_size)."""

    words: int
    filter: DataFrame
    groups: DataFrame
    small_filter: bool
    small_groups: bool

    def tested(self, rows: DataFrame, key: str) -> DataFrame:
        """rows with __maybe: whether the key may be repeated."""
        found = F.broadcast(self.filter) if self.small_filter else self.filter
        joined = with_cells(rows, key, self.words).join(found, "__word", "left")
        return joined.withColumn("__maybe", F.coalesce(F.col("__filter").bitwiseAND(F.col("__bits")) == F.col("__bits"), F.lit(False))).drop("__word", "__bits", "__filter")

    def mark(self, rows: DataFrame, key: str, order: str) -> DataFrame:
        """rows with keep_id and group_size."""
        rows = rows.drop("keep_id", "group_size")
        alone = {"keep_id": F.coalesce("keep_id", F.when(F.col("group_size").isNull(), F.col(order))), "group_size": F.coalesce("group_size", F.lit(1).cast("bigint"))}
        if self.small_groups:
            return rows.join(F.broadcast(self.groups), F.col(key) == F.col("__key"), "left").drop("__key").withColumns(alone)
        tested = self.tested(rows, key)
        straight = tested.where("not __maybe").drop("__maybe").withColumns({"keep_id": F.col(order), "group_size": F.lit(1).cast("bigint")})
        candidates = tested.where("__maybe").drop("__maybe")
        floor = self.groups.agg(F.greatest(F.lit(64), F.sum("group_size") / 1000).alias("floor"))
        hot = self.groups.join(F.broadcast(floor), F.col("group_size") > F.col("floor")).drop("floor")
        in_hot = candidates.join(F.broadcast(hot), F.col(key) == F.col("__key")).drop("__key")
        cold = candidates.join(F.broadcast(hot.select("__key")), F.col(key) == F.col("__key"), "left_anti")
        in_cold = cold.join(self.groups, F.col(key) == F.col("__key"), "left").drop("__key").withColumns(alone)
        return straight.unionByName(in_hot).unionByName(in_cold)


def find_repeats(rows: DataFrame, key: str, order: str, n_rows: int | None = None, pick=F.min) -> Repeats:
    """rows (read twice, so best written): key and order. keep_id is ``pick`` of ``order`` over equal keys."""
    rows = rows.select(key, order)
    words = filter_words(rows.count() if n_rows is None else n_rows)
    found = materialise(repeated_words(rows, key, words), "filter")
    made = Repeats(words, found, found, found.count() <= BROADCAST_ROWS, False)
    maybe = made.tested(rows, key).where("__maybe")
    groups = maybe.groupBy(F.col(key).alias("__key")).agg(pick(order).alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    made.groups = materialise(groups, "groups")
    made.small_groups = made.groups.count() <= BROADCAST_ROWS
    return made


def mark_repeats(rows: DataFrame, key: str, order: str, n_rows: int | None = None, pick=F.min) -> DataFrame:
    """rows with keep_id and group_size."""
    return find_repeats(rows, key, order, n_rows, pick).mark(rows, key, order)


def mark_duplicates(docs: DataFrame, n_rows: int | None = None) -> DataFrame:
    """docs with text_sha256, keep_id, group_size and kept."""
    rows = docs.drop(*RESULT).withColumn("text_sha256", text_key(F.col("text")))
    keys = materialise(rows.select("doc_id", "text_sha256"), "keys")
    marked = find_repeats(keys, "text_sha256", "doc_id", n_rows).mark(rows, "text_sha256", "doc_id")
    return marked.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each text, with the columns of docs. Rows that can't be repeated don't shuffle."""
    rows = docs.withColumn("__sha", text_key(F.col("text")))
    keys = materialise(rows.select("doc_id", "__sha"), "keys")
    found = find_repeats(keys, "__sha", "doc_id")
    # a document listed twice: only keys whose smallest id comes more than once are gathered
    again = found.mark(keys, "__sha", "doc_id").where("group_size > 1 and doc_id <=> keep_id").groupBy("__sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__sha")
    twice = materialise(again, "twice")
    marked = found.mark(rows, "__sha", "doc_id").where("doc_id <=> keep_id")
    if not twice.limit(1).count():
        return marked.select(docs.columns)
    alone = marked.join(twice, "__sha", "left_anti").select(docs.columns)
    first = marked.join(twice, "__sha", "left_semi").dropDuplicates(["__sha"]).select(docs.columns)
    return alone.unionByName(first)
