"""Operator 7, language-model scores by context-tree weighting.

Texts are their words, lower-cased, joined by blanks and closed by a line end,
as bytes. A byte is eight binary decisions; each has a node in the tree of the
bytes before it, down to ``DEPTH``. A node's Krichevsky-Trofimov estimate of its
counts and the product of its children are mixed with weights one half, from
the deepest contexts up; scoring mixes the predictions along the path of a byte.
Since KT estimates depend on counts alone, the tree that the whole corpus gives
is computed from the counts of its byte n-grams.

Counts come from all learning documents. Documents are dealt into groups of
bounded size by a hash of their id. A group sends the distinct words (as 64-bit
hashes) and n-grams it holds with its counts to buckets; a bucket adds them up
and answers each group that asked; then each group scores its documents. So no
task holds the vocabulary, and a word in every document costs one entry a group.
Every context that was learned from has its nodes, however rare. N-grams go to
buckets by the last ``SPLIT`` bytes of their context, so a bucket holds whole
subtrees; what it sends up gives the nodes of shorter contexts, which are
broadcast (their number is bounded by the bytes there are, not by a limit). Each
bucket then scores its n-grams and answers the groups that hold them.

Defined cases: null text counts as empty; an empty text is one token, the end;
a null doc_id is neither learned from nor held out; with nothing to learn from
each bit has probability one half; repeated rows count and are scored each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _Numbered
from .common import in_thirds, materialise

#: Bytes of a context. Held-out bits a byte on sf0.1: 2.34 (3), 2.19 (4), 2.10 (5), 2.04 (6); with six, what the groups send doubles
#: (disk 5.6 x input on 0.10 GB, 2.7 with five), more than the 4 allowed.
DEPTH = 5
#: Contexts of this length and longer are kept in buckets, shorter ones are broadcast.
SPLIT = 3
#: Bytes of text in a group, and entries in a bucket, about.
GROUP_BYTES = 10_000_000
SLICE_CHARS = 2_000_000
BUCKET_ENTRIES = 1_500_000
LEAST_BUCKETS = 256
END = b""
UPPER_OF = -3
GRAMS_OF = -2
TOTALS_OF = -1


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words, the end last. Bytes split at exactly the white space of the word pattern."""
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def gram_codes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a byte and the DEPTH bytes before it, for all bytes of the texts; how many each text has."""
    lead = b"\n" * DEPTH
    raw = [lead + b" ".join(words[:-1]) + b"\n" for words in texts]
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    codes = np.zeros(len(b), np.int64)
    for d in range(DEPTH + 1):
        codes[DEPTH:] |= b[DEPTH - d : len(b) - d] << (8 * d)
    own = np.ones(len(b), bool)
    starts = np.cumsum(sizes) - sizes
    for d in range(DEPTH):
        own[starts + d] = False
    return codes[own], sizes - DEPTH


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 1/2: Stirling's series at x + 8, stepped down."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _ln_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


@dataclass
class Level:
    """Nodes of contexts of one length: keys (context, place in the byte's tree), counts, weight of their own estimate."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    own: np.ndarray


def _nodes(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    byte, context = grams & 255, grams >> 8
    keys = np.concatenate([context << 8 | (1 << k) | byte >> (8 - k) for k in range(8)])
    bits = np.concatenate([byte >> (7 - k) & 1 for k in range(8)]).astype(bool)
    keys, at = np.unique(keys, return_inverse=True)
    n = np.tile(counts.astype(np.float64), 8)
    return keys, np.bincount(at, n * ~bits, len(keys)), np.bincount(at, n * bits, len(keys))


def _upwards(keys: np.ndarray, d: int, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of the values of nodes of contexts of d bytes at their parents, whose keys come first."""
    # a child's context is its parent's and one byte before it
    parents, at = np.unique((keys >> 8 & (1 << 8 * (d - 1)) - 1) << 8 | keys & 255, return_inverse=True)
    return parents, *(np.bincount(at, v, len(parents)) for v in values)


def _level(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None = None) -> tuple[Level, np.ndarray]:
    """A level, and the ln of its nodes' weighted probabilities; children: those of the level below, summed."""
    own = _ln_kt(zeros, ones)
    if children is None:
        return Level(keys, zeros, ones, np.ones(len(keys))), own
    mix = 1 / (1 + np.exp(np.clip(children - own, -700, 700)))
    return Level(keys, zeros, ones, mix), np.logaddexp(own, children) - math.log(2)


def _above(up: tuple[np.ndarray, ...], d: int) -> list[Level]:
    """Levels of contexts of 0 to d bytes, from the sums that their longest nodes get from below: keys, weighted, zeros, ones."""
    levels: list[Level] = []
    for length in range(d, -1, -1):
        keys, children, zeros, ones = up
        level, weighted = _level(keys, zeros, ones, children)
        levels.append(level)
        if length:
            up = _upwards(keys, length, weighted, zeros, ones)
    return levels[::-1]


def _subtrees(grams: np.ndarray, counts: np.ndarray, first: int) -> tuple[list[Level], tuple[np.ndarray, ...]]:
    """Levels of contexts of ``first`` to DEPTH bytes, of all n-grams that have the same last bytes, and what they send up."""
    keys, zeros, ones = _nodes(grams, counts)
    level, weighted = _level(keys, zeros, ones)
    levels = [level]
    for d in range(DEPTH, first, -1):
        keys, children, zeros, ones = _upwards(keys, d, weighted, zeros, ones)
        level, weighted = _level(keys, zeros, ones, children)
        levels.append(level)
    return levels[::-1], _upwards(keys, first, weighted, zeros, ones)


@dataclass
class ContextTree:
    levels: list[Level]

    @classmethod
    def build(cls, by_length: list[tuple[np.ndarray, np.ndarray]]) -> ContextTree:
        """by_length: n-grams (contexts of 0, 1, ... bytes and a byte) and their counts."""
        d = len(by_length) - 1
        keys, zeros, ones = _nodes(*by_length[d])
        level, weighted = _level(keys, zeros, ones)
        return cls([*(_above(_upwards(keys, d, weighted, zeros, ones), d - 1) if d else []), level])

    def score(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each n-gram's last byte after the bytes before it."""
        total = np.zeros(len(grams))
        byte = grams & 255
        for k in range(8):
            place, bit = (1 << k) | byte >> (8 - k), byte >> (7 - k) & 1
            # from the root down: each level's share of what is left, until a context was never seen
            p, left, open_ = np.zeros(len(grams)), np.ones(len(grams)), np.ones(len(grams), bool)
            for d, level in enumerate(self.levels):
                key = ((grams >> 8 & (1 << 8 * d) - 1) << 8 | place)
                at = np.minimum(np.searchsorted(level.keys, key), max(len(level.keys) - 1, 0))
                there = open_ & (level.keys[at] == key) if len(level.keys) else np.zeros(len(grams), bool)
                p += np.where(open_ & ~there, left / 2, 0)
                open_ = there
                if not open_.any():
                    break
                a, b = level.zeros[at], level.ones[at]
                own = np.where(there, level.own[at], 0)
                p += np.where(there, left * own * (np.where(bit == 1, b, a) + 0.5) / (a + b + 1), 0)
                left = left * np.where(there, 1 - own, 1)
            total += np.log10(np.maximum(p, 1e-300))
        return total


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys ordered by bucket and key, their buckets, and each given key's place among them."""
    distinct, at = np.unique(keys, return_inverse=True)
    bucket = (distinct % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], bucket[order], place[at]


def _cut(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(buckets) else np.empty(0, np.int64)
    return start, np.r_[start[1:], len(buckets)] if len(start) else start


def _coded(texts: list, learn: list[bool]):
    """Slice by slice: places of the bytes among the slice's distinct n-grams, these, their learned counts, and how many bytes each text has."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size < SLICE_CHARS):
            size += len(texts[to] or "")
            to += 1
        codes, sizes = gram_codes([words_of(t) for t in texts[at:to]])
        which, distinct = pd.factorize(codes)
        taught = np.bincount(which[np.repeat(np.array(learn[at:to], bool), sizes)], minlength=len(distinct))
        yield which.astype(np.int32), distinct, taught, sizes
        at = to


def _gram_order(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted n-grams by bucket, and their buckets: one for all that share the last SPLIT bytes of their context."""
    ends = (grams >> 8 & (1 << 8 * SPLIT) - 1).astype(np.uint64)
    mixed = ((ends * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(mixed, kind="stable")
    return order, mixed[order]


def ask(texts: list, learn: list[bool], buckets: int):
    """What a group sends: (bucket, kind, keys, counts) for its words (kind 0) and n-grams (kind 1), with how often it learns from each."""
    index = _Numbered()
    rows = [np.fromiter(map(index.__getitem__, words_of(t)), np.int32) for t in texts]
    taught = [r for r, ok in zip(rows, learn, strict=True) if ok]
    n = np.bincount(np.concatenate(taught), minlength=len(index)) if taught else np.zeros(len(index), np.int64)
    keys, bucket, place = _by_bucket(_hashes(list(index)), buckets)
    counts = np.bincount(place, n, len(keys)).astype(np.int64)
    for a, b in zip(*_cut(bucket), strict=True):
        yield int(bucket[a]), 0, keys[a:b], counts[a:b]
    del index, rows, taught
    found = [(distinct, n) for _, distinct, n, _ in _coded(texts, learn)]
    if found:
        grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)
        order, mixed = _gram_order(grams, buckets)
        grams, counts = grams[order], counts[order]
        for a, b in zip(*_cut(mixed), strict=True):
            yield buckets + int(mixed[a]), 1, grams[a:b], counts[a:b]


ASKED = "group bigint, bucket bigint, kind int, keys binary, counts binary"
ANSWER = "group bigint, bucket bigint, tokens bigint, types bigint, keys binary, counts binary"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _answers(asked: pa.Table) -> pa.Table:
    """Sums of a bucket: for words an answer to each group; for n-grams the sums, where each group's are among them, and what shorter contexts get."""
    groups, kinds = asked.column("group").to_pylist(), asked.column("kind").to_pylist()
    keys = [np.frombuffer(x.as_py(), np.int64 if kinds[0] else np.uint64) for x in asked.column("keys")]
    counts = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in asked.column("counts")])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(at, counts, len(distinct)).astype(np.int64)
    bucket = asked.column("bucket")[0].as_py()
    if kinds[0] == 1:
        _, (parents, *sums) = _subtrees(distinct[totals > 0], totals[totals > 0], SPLIT)
        rows = [(GRAMS_OF, bucket, 0, 0, distinct.tobytes(), totals.tobytes()), (UPPER_OF, bucket, 0, 0, parents.tobytes(), np.concatenate(sums).tobytes())]
        told = at.astype(np.int32)
    else:
        rows = [(TOTALS_OF, bucket, int(totals.sum()), int((totals > 0).sum()), None, None)]
        told = totals[at]
    ends = np.cumsum(list(map(len, keys)))
    rows += [(g, bucket, 0, 0, None, told[e - len(k) : e].tobytes()) for g, k, e in zip(groups, keys, ends.tolist(), strict=True)]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["group", "bucket", "tokens", "types", "keys", "counts"])


def _upper(answers: DataFrame) -> list[Level]:
    """Levels of the contexts shorter than SPLIT, added up in the order of the buckets."""
    sent = sorted(answers.where(F.col("group") == UPPER_OF).select("bucket", "keys", "counts").collect())
    keys = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r["keys"], np.int64) for r in sent)])
    sums = np.concatenate([np.empty((3, 0)), *(np.frombuffer(r["counts"], np.float64).reshape(3, -1) for r in sent)], axis=1)
    parents, at = np.unique(keys, return_inverse=True)
    return _above((parents, *(np.bincount(at, v, len(parents)) for v in sums)), SPLIT - 1)


def score_documents(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    split = in_thirds("doc_id", modulus)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n_groups = max(1, -(-size // GROUP_BYTES))
    buckets = max(LEAST_BUCKETS, int(size * 0.03) // BUCKET_ENTRIES)
    rows = docs.select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("string"),
        F.coalesce(split != held, F.lit(False)).alias("learn"), F.coalesce(split == held, F.lit(False)).alias("held_out"),
        # by the row's place in the input, which is read twice alike: no id and no text that many rows share makes a group large
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups)).alias("group"),
    )

    def send(part: pa.Table) -> pa.Table:
        group = part.column("group")[0].as_py()
        sent = [(group, b, kind, k.tobytes(), c.tobytes()) for b, kind, k, c in ask(part.column("text").to_pylist(), part.column("learn").to_pylist(), buckets)]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*sent, strict=True), types, strict=True)], names=["group", "bucket", "kind", "keys", "counts"])

    answers = materialise(rows.groupBy("group").applyInArrow(send, ASKED).groupBy("bucket").applyInArrow(_answers, ANSWER), "lm")
    tokens, types = answers.where(F.col("group") == TOTALS_OF).agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = tokens or 0, types or 0
    upper = spark.sparkContext.broadcast(_upper(answers))
    unit = math.log10(tokens + types + 1)

    def score_grams(part: pa.Table) -> pa.Table:
        """A bucket's n-grams are scored once, and each group gets those of its own."""
        groups = part.column("group").to_pylist()
        own = groups.index(GRAMS_OF)
        grams, totals = (np.frombuffer(part.column(c)[own].as_py(), np.int64) for c in ("keys", "counts"))
        levels, _ = _subtrees(grams[totals > 0], totals[totals > 0], SPLIT)
        logs = ContextTree([*upper.value, *levels]).score(grams)
        told = [(g, logs[np.frombuffer(x.as_py(), np.int32)].tobytes()) for g, x in zip(groups, part.column("counts"), strict=True) if g >= 0]
        bucket = [part.column("bucket")[0].as_py()] * len(told)
        return pa.table([pa.array([g for g, _ in told], pa.int64()), pa.array(bucket, pa.int64()), pa.array([x for _, x in told], pa.binary())], names=["group", "bucket", "counts"])

    def score(part: pa.Table, heard: pa.Table) -> pa.Table:
        texts = part.column("text").to_pylist()
        index = _Numbered()
        words = [np.fromiter(map(index.__getitem__, words_of(t)), np.int32) for t in texts]
        told = sorted(zip(heard.column("bucket").to_pylist(), heard.column("counts"), strict=True), key=lambda x: x[0]) if texts else []
        n = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(c.as_py(), np.int64) for b, c in told if b < buckets)])
        logs_of = np.concatenate([np.empty(0), *(np.frombuffer(c.as_py(), np.float64) for b, c in told if b >= buckets)])
        del told
        _, _, place = _by_bucket(_hashes(list(index)), buckets)
        n = n[place] if len(place) else n
        logs, known = np.log10(n + 1.0), n > 0
        base = [float(logs[w].sum()) - len(w) * unit for w in words]
        n_known = [int(known[w].sum()) for w in words]
        sizes_of = list(map(len, words))
        del index, words, place, n, logs, known
        slices = [(which, distinct, sizes) for which, distinct, _, sizes in _coded(texts, [False] * len(texts))]
        grams, at = np.unique(np.concatenate([np.empty(0, np.int64), *(d for _, d, _ in slices)]), return_inverse=True)
        order, _ = _gram_order(grams, buckets)
        values = np.empty(len(grams))
        values[order] = logs_of
        scores: list[float] = []
        start = 0
        for which, distinct, sizes in slices:
            here = values[at[start : start + len(distinct)]][which]
            scores += np.add.reduceat(here, np.cumsum(sizes) - sizes).tolist()
            start += len(distinct)
        return pa.table(
            [part.column("doc_id"), part.column("held_out"), pa.array(sizes_of, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    of_grams = answers.where((F.col("bucket") >= buckets) & (F.col("group") != UPPER_OF)).select("group", "bucket", "keys", "counts")
    told = answers.where((F.col("group") >= 0) & (F.col("bucket") < buckets)).select("group", "bucket", "counts")
    told = told.unionByName(of_grams.groupBy("bucket").applyInArrow(score_grams, "group bigint, bucket bigint, counts binary"))
    scored = rows.drop("learn").groupBy("group").cogroup(told.groupBy("group")).applyInArrow(score, SCORED)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("bigint"))
