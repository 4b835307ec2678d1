"""Operator 5, the n-gram Jaccard join.

A document's set is its distinct shingles of five words. Two documents link when
100 times their intersection is at least 80 times their union, so the larger
shares at least four fifths of its set. The join is exact:

1. Tokens (64-bit hashes of shingles) go to buckets, which find the ones that
   more than one document has; only those return to their documents. A slice of
   documents sends a token once, with how many of its sets have it, so a token
   that a third of all documents hold is one entry a slice in its bucket. A token
   that no other document has can't be shared, but it counts in the set's size,
   and stands first in the order of rarity.
2. Equal sets collapse to the smallest doc_id, and tokens are counted again
   among what remains.
3. Prefixes. In the order of rarity, two sets that link share at least one token
   among the first ``n - t + 1``, where ``t`` is four fifths of ``n``, rounded
   up, and at least two among the first ``n - t + 2``. Tokens of the rare class
   (in at most ``RARE`` sets) are keys by themselves. For the frequent class the
   prefix is extended by one and the keys are combinations of two tokens. Sets
   of ``LONG`` tokens and more, whose combinations would grow with the square of
   their prefix, have single tokens as keys for both classes, and so have the
   shorter ones that can link with them, of four fifths of ``LONG`` and more.
4. Before that, each set is verified against the smallest doc_id of each of its
   tokens. What links there is one component, whatever else is in it, and tokens
   all of whose sets are in one component need no further keys. So a group of
   thousands of near copies costs a few verifications each, not all pairs.
5. Pairs of sets in different components that share a key are verified, unless
   they were before, or their sizes and the key's places in their orders leave
   too few tokens to share.

Verification counts the tokens two sets share; components are joined over all
links. Nothing is capped: what the star of step 4 doesn't link is compared in
step 5.

Defined cases: null text, or text without words, has the empty set, links with
nothing and is its own component; fewer than five words are one shingle; rows
that repeat a doc_id with the same text are one document listed twice; a null
doc_id is its own component (null); an empty table gives an empty result; other
columns are not read. The input must be read twice alike, as files or written
tables are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held, materialise, release, releasing
from .components import components, looked_up
from .exact_dedup import mark_repeats

WORDS = 5
#: Similarity, as a fraction.
PART, WHOLE = 80, 100
RARE = 16
#: Tokens of a set from which its frequent tokens aren't combined.
LONG = 4096
BUCKET_ENTRIES = 1_000_000
LEAST_BUCKETS = 256
SLICE_BYTES = 2_000_000
#: Hashes of words that a worker keeps.
MAX_HASHES = 60_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _WordHash(dict):
    """Hashes of words, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_HASHES:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Distinct shingles of a text as sorted 64-bit hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(held("hashes", _WordHash).__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, np.uint64(min(size, len(words))))
    for k in range(min(size, len(words))):
        part = h[k : k + n]
        out = (out ^ part) * _MIX[k % 5]
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def least_shared(n):
    """Four fifths of n, rounded up."""
    return -(-n * PART // WHOLE)


#: Tokens of a slice, and its directory (with ids): which row has a token, or has it too, and how many sets do.
ENTRY = "chunk bigint, bucket bigint, tokens binary, rows binary, counts binary, ids binary, sizes binary, sigs binary"
_ENTRY_NAMES = [x.split()[0] for x in ENTRY.split(", ")]
_ENTRY_TYPES = (pa.int64(), pa.int64(), *[pa.binary()] * 6)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where a value of a sorted array stands first."""
    return np.r_[True, x[1:] != x[:-1]] if len(x) else np.empty(0, bool)


def _send(sets_of, buckets: int):
    """Mapper: (ids, sizes, sets) of slices to a directory row and the slices' tokens by bucket."""

    @releasing
    def run(batches):
        task = TaskContext.get().partitionId()
        for k, (ids, sizes, sets) in enumerate(sets_of(batches)):
            chunk = task << 32 | k
            row = np.repeat(np.arange(len(sets), dtype=np.uint16), list(map(len, sets)))
            token = np.concatenate([np.empty(0, np.uint64), *sets])
            order = np.argsort(token, kind="stable")
            token, row = token[order], row[order]
            new = _starts(token)
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(token))).astype(np.uint16)
            sigs = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
            # the directory passes through a bucket of its own, with the further rows of tokens that a slice has more than once
            ids = np.array(ids, np.int64).tobytes()
            out = [(chunk, buckets + chunk % buckets, token[~new].tobytes(), row[~new].tobytes(), None, ids, np.array(sizes, np.int64).tobytes(), sigs)]
            token, row = token[first], row[first]
            bucket = (token >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            token, row, count, bucket = token[order], row[order], count[order], bucket[order]
            start = np.flatnonzero(_starts(bucket))
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(bucket)], strict=False):
                out.append((chunk, int(bucket[a]), token[a:b].tobytes(), row[a:b].tobytes(), count[a:b].tobytes(), None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ENTRY_TYPES, strict=True)], names=_ENTRY_NAMES)

    return run


def _repeated(part: pa.Table) -> pa.Table:
    """Reducer of a bucket: tokens that occur more than once, back to their slices with their counts."""
    if part.column("ids")[0].as_py() is not None:
        return part
    tokens = [np.frombuffer(x.as_py(), np.uint64) for x in part.column("tokens")]
    every = np.concatenate(tokens)
    times = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in part.column("counts")]).astype(np.int64)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(_starts(every))
    counts = np.add.reduceat(times[order], first)
    again = counts > 1
    found, counts = every[first][again], counts[again]
    every = times = order = first = again = None
    out = []
    if len(found):
        bucket = part.column("bucket")[0].as_py()
        for c, mine, rows in zip(part.column("chunk").to_pylist(), tokens, part.column("rows"), strict=True):
            at = np.minimum(np.searchsorted(found, mine), len(found) - 1)
            hit = found[at] == mine
            if hit.any():
                out.append((c, bucket, mine[hit].tobytes(), np.frombuffer(rows.as_py(), np.uint16)[hit].tobytes(), counts[at[hit]].tobytes(), None, None, None))
    columns = zip(*out, strict=True) if out else [[] for _ in _ENTRY_TYPES]
    made = pa.table([pa.array(c, t) for c, t in zip(columns, _ENTRY_TYPES, strict=True)], names=_ENTRY_NAMES)
    out = columns = tokens = found = counts = None
    release()
    return made


LISTS = "doc_id bigint, n bigint, sig string, tokens binary, n_rare bigint"


def _gather(part: pa.Table) -> pa.Table:
    """A slice's sets again: only tokens that others have, the rarest first; none where the prefix ends before them."""
    token, row, count = [np.empty(0, np.uint64)], [np.empty(0, np.uint16)], [np.empty(0, np.int64)]
    ids = sizes = np.empty(0, np.int64)
    sigs, more, more_row = b"", np.empty(0, np.uint64), np.empty(0, np.uint16)
    for t, r, c, i, s, g in zip(*(part.column(x) for x in ("tokens", "rows", "counts", "ids", "sizes", "sigs")), strict=True):
        if (raw := i.as_py()) is not None:
            ids, sizes, sigs = np.frombuffer(raw, np.int64), np.frombuffer(s.as_py(), np.int64), g.as_py()
            more, more_row = np.frombuffer(t.as_py(), np.uint64), np.frombuffer(r.as_py(), np.uint16)
        else:
            token.append(np.frombuffer(t.as_py(), np.uint64))
            row.append(np.frombuffer(r.as_py(), np.uint16))
            count.append(np.frombuffer(c.as_py(), np.int64))
    token, row, count = np.concatenate(token), np.concatenate(row), np.concatenate(count)
    if len(more):  # their tokens have all come back
        by = np.argsort(token)
        count = np.concatenate((count, count[by[np.searchsorted(token, more, sorter=by)]]))
        token, row = np.concatenate((token, more)), np.concatenate((row, more_row))
    order = np.lexsort((token, count, row))
    token, row, count = token[order], row[order], count[order]
    cut = np.searchsorted(row, np.arange(len(ids) + 1))
    rare = np.concatenate(([0], np.cumsum(count <= RARE)))
    out = []
    for k in range(len(ids)):
        a, b, n = cut[k], cut[k + 1], int(sizes[k])
        linked = b - a >= least_shared(n) and n > 0
        out.append((int(ids[k]), n, sigs[16 * k : 16 * k + 16].hex(), token[a:b].tobytes() if linked else None, int(rare[b] - rare[a]) if linked else 0))
    types = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64())
    columns = zip(*out, strict=True) if out else [[] for _ in types]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n", "sig", "tokens", "n_rare"])


def shared_tokens(rows: DataFrame, sets_of, entries: int) -> DataFrame:
    """doc_id, n, sig and the tokens that other rows have too, in the order of rarity."""
    buckets = max(LEAST_BUCKETS, entries // BUCKET_ENTRIES)
    return rows.mapInArrow(_send(sets_of, buckets), ENTRY).groupBy("bucket").applyInArrow(_repeated, ENTRY).groupBy("chunk").applyInArrow(_gather, LISTS)


def _text_sets(batches):
    for part in chunks(batches, "text", SLICE_BYTES):
        sets = [shingles(t) for t in part.column("text").to_pylist()]
        yield part.column("doc_id").to_pylist(), list(map(len, sets)), sets


def _token_sets(batches):
    for part in chunks(batches, "tokens", SLICE_BYTES):
        sets = [np.frombuffer(t, np.uint64) for t in part.column("tokens").to_pylist()]
        yield part.column("doc_id").to_pylist(), part.column("n").to_pylist(), sets


def _prefix_entries(batches):
    """(token, doc_id, n, pos, rare) of each set's prefix of n - t + 2 tokens; tokens that no other set has stand before them all."""
    for batch in batches:
        token, doc, size, pos, rare = [], [], [], [], []
        for d, n, raw, r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "tokens", "n_rare")), strict=True):
            have = np.frombuffer(raw, np.uint64)
            take = max(0, min(len(have), n - least_shared(n) + 2 - (n - len(have))))
            token.append(have[:take].view(np.int64))
            doc.append(np.full(take, d, np.int64))
            size.append(np.full(take, n, np.int64))
            pos.append(np.arange(n - len(have), n - len(have) + take))
            rare.append(np.arange(take) < r)
        if token:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, doc, size, pos, rare)], names=["token", "doc_id", "n", "pos", "rare"])


def _verify(batches):
    """Pairs that link, and for the others nothing."""
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        out = []
        for x, y, nx, ny, tx, ty in zip(a, b, *(batch.column(c).to_pylist() for c in ("na", "nb", "ta", "tb")), strict=True):
            both = np.sort(np.concatenate((np.frombuffer(tx, np.uint64), np.frombuffer(ty, np.uint64))))
            shared = int((both[1:] == both[:-1]).sum())
            if WHOLE * shared >= PART * (nx + ny - shared):
                out.append((x, y))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(_verify, "a bigint, b bigint")


def _combinations(batches):
    """A key for each two of a set's frequent tokens, in the order of rarity, with both positions."""
    for batch in batches:
        for d, n, c, found in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "n", "component", "tokens")), strict=True):
            found.sort(key=lambda x: x["pos"])
            t = np.array([x["token"] for x in found], np.int64).view(np.uint64)
            pos = np.array([x["pos"] for x in found], np.int64)
            first, second = np.triu_indices(len(t), 1)
            if len(first):
                keys = ((t[first] * _MIX[0]) ^ t[second]) * _MIX[1]
                same = lambda x: pa.array(np.full(len(first), x, np.int64))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), same(d), same(n), pa.array(pos[first]), pa.array(pos[second]), same(c)], names=["token", "doc_id", "n", "pos", "pos2", "component"])


def _can_link(x: str, y: str, pos: str = "pos", before: int = 0):
    """Two sets of these sizes whose shared tokens start at these places (``before`` of them earlier) can still share enough."""
    size = lambda a: F.col(f"{a}.n")
    left = before + F.least(size(x) - F.col(f"{x}.{pos}"), size(y) - F.col(f"{y}.{pos}"))
    return (PART + WHOLE) * left >= PART * (size(x) + size(y))


def linked_sets(sets: DataFrame) -> DataFrame:
    """Components (id, component) of sets (doc_id, n, tokens, n_rare), for ids with a link."""
    entries = materialise(sets.select("doc_id", "n", "tokens", "n_rare").mapInArrow(_prefix_entries, "token bigint, doc_id bigint, n bigint, pos bigint, rare boolean"), "prefix")
    pivots = entries.groupBy("token").agg(F.min(F.struct("doc_id", "n", "pos")).alias("y"), F.count(F.lit(1)).alias("m")).where("m > 1").select("token", "y")
    star = looked_up(entries.select("token", F.struct("doc_id", "n", "pos").alias("x")), pivots, "token").where((F.col("x.doc_id") != F.col("y.doc_id")) & _can_link("x", "y"))
    tested = materialise(star.select(F.col("y.doc_id").alias("a"), F.col("x.doc_id").alias("b")).distinct(), "star")
    links = materialise(verified(tested, sets), "links")
    first = components(links)
    placed = entries.join(first.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = materialise(placed, "placed")
    live = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    placed = materialise(looked_up(placed, live, "token"), "live")
    single = placed.where(F.col("rare") | (WHOLE * F.col("n") >= PART * LONG))
    frequent = placed.where(~F.col("rare") & (F.col("n") < LONG)).groupBy("doc_id", "n", "component").agg(F.collect_set(F.struct("token", "pos")).alias("tokens"))
    frequent = frequent.mapInArrow(_combinations, "token bigint, doc_id bigint, n bigint, pos bigint, pos2 bigint, component bigint")

    def across(keys: DataFrame, last: str, before: int, more) -> DataFrame:
        # in the smaller set of a pair the shared tokens start within the first ninth: both sets share eight ninths of it
        x = keys.where((PART + WHOLE) * (before + F.col("n") - F.col(last)) >= 2 * PART * F.col("n")).alias("x")
        y = keys.alias("y")
        met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.n") <= F.col("y.n")) & _can_link("x", "y") & more)
        return met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))

    pairs = across(single, "pos", 0, F.col("x.rare") | (F.col("y.n") >= LONG)).unionByName(across(frequent, "pos2", 1, _can_link("x", "y", "pos2", 1))).distinct()
    pairs = materialise(pairs.join(tested, ["a", "b"], "left_anti"), "cross")
    return components(links.unionByName(verified(pairs, sets)))


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lists = materialise(shared_tokens(rows.where("doc_id is not null"), _text_sets, size // 6), "lists")
    # equal sets: the smallest doc_id stands for all
    alone = lists.where("tokens is null").select("doc_id", "n", F.col("doc_id").alias("keep_id"))
    marked = mark_repeats(lists.where("tokens is not null"), "sig", "doc_id")
    marked = materialise(marked, "sets")
    sets = materialise(marked.where("doc_id = keep_id").dropDuplicates(["doc_id"]).select("doc_id", "n", "tokens"), "distinct")
    entries = sets.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    sets = materialise(shared_tokens(sets, _token_sets, entries // 8).where("tokens is not null"), "shared")
    found = linked_sets(sets)
    members = alone.unionByName(marked.select("doc_id", "n", "keep_id"))
    out = members.join(found.withColumnRenamed("id", "keep_id"), "keep_id", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "keep_id").alias("component_id"))
    no_id = rows.where("doc_id is null").mapInArrow(_count_only, "doc_id bigint, n_shingles bigint, component_id bigint")
    return out.unionByName(no_id)


def _count_only(batches):
    for part in chunks(batches, "text"):
        n = [len(shingles(t)) for t in part.column("text").to_pylist()]
        none = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), none], names=["doc_id", "n_shingles", "component_id"])


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their group: the smallest doc_id of each component, and rows without an id."""
    dropped = link_documents(docs).where("component_id <> doc_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
