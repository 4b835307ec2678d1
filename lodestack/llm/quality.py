"""Operator 10, quality by nearest-neighbour voting.

A text's terms are its words (lower case) and its run trigrams: runs are letters
by case and length, digits, blanks, line ends and each other ASCII character. Both
are counted in hashed buckets, weighted by rarity, each half brought to a length of
its own, and projected to the latent semantic space of a bounded sample of labelled
documents (``FIT_ROWS``, by a hash of the id, and of the row where ids repeat), so
that what a text says and what it looks like both count. The driver holds the
sample's counts packed and works on a block of them at a time. The sample's vectors are
broadcast; every document's cosine with each of them is taken in blocks, exactly,
and the nearest vote with their similarity as weight.

Defined cases: null and empty texts have no direction and score the share of
good labels; with nothing to learn from all score 0.5; null labels and ids teach
nothing; a document labelled or listed twice votes twice, as far as the sample
goes; ties among neighbours go to the smaller place in the sample, which is ordered
by id; repeated rows are each scored; an empty table gives an empty result; other
columns pass through, and ones named score or predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held, materialise, release, releasing, text_slices

#: About so many labelled rows are learned from and broadcast.
FIT_ROWS = 4_000
#: Buckets of run trigrams, and of words.
BUCKETS = 2_048
WORD_BUCKETS = 2_048
#: Length of the half of the words; that of the runs is 1.
WORD_LENGTH = 0.5
RANK = 64
NEIGHBOURS = 25
#: Weight of a neighbour: its cosine to this power.
SHARPNESS = 4
GOOD = 0.7
BLOCK = 256
#: Characters in work at a time.
SLICE_CHARS = 1_000_000


def _classes() -> np.ndarray:
    """Run class of each character: 0 to 127 its own if ASCII and no letter or digit, 128 lower, 129 upper, 130 digit, 131 other, 32 blank, 10 line end."""
    ascii_ = np.arange(128, dtype=np.uint8)
    for c in range(128):
        x = chr(c)
        ascii_[c] = 129 if x.isupper() else 128 if x.isalpha() else 130 if x.isdigit() else 10 if x in "\r\n" else 32 if x.isspace() else c
    wide = np.array([129 if (x := chr(c)).isupper() else 128 if x.isalpha() else 130 if x.isdigit() else 32 if x.isspace() else 131 for c in range(128, 0x3000)], np.uint8)
    return np.concatenate((ascii_, wide))


_CLASSES = _classes()
_LAST = len(_CLASSES)


class _WordBucket(dict):
    """Buckets of words, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 60_000:
            self.clear()
        self[word] = b = xxhash.xxh3_64_intdigest(word) % WORD_BUCKETS
        return b


def counts_of(texts: list[str]) -> np.ndarray:
    """Run trigrams and words of each text in hashed buckets, as log(1 + count)."""
    return np.hstack((_runs(texts, BUCKETS), _words(texts)))


def _words(texts: list[str]) -> np.ndarray:
    bucket = held("word buckets", _WordBucket).__getitem__
    out = np.zeros((len(texts), WORD_BUCKETS), np.float32)
    for row, t in zip(out, texts, strict=True):
        words = t.encode("utf-8", "surrogatepass").lower().split()
        row += np.bincount(np.fromiter(map(bucket, words), np.int64, len(words)), minlength=WORD_BUCKETS)
    return np.log1p(out)


def _runs(texts: list[str], buckets: int) -> np.ndarray:
    framed = [f"\n\n{t}\n\n" for t in texts]
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), list(map(len, framed)))
    kind = np.where(codes < _LAST, _CLASSES[np.minimum(codes, _LAST - 1)], 128)
    start = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])]) if len(kind) else np.empty(0, np.int64)
    length = np.diff(np.r_[start, len(kind)])
    run = kind[start].astype(np.uint64) * 4 + np.digitize(length, (2, 5, 13)).astype(np.uint64)
    who = owner[start]
    out = np.zeros((len(texts), buckets), np.float32)
    if len(run) >= 3:
        same = who[:-2] == who[2:]
        mixed = (run[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ run[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ run[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
        bucket = (mixed >> np.uint64(40)).astype(np.int64) % buckets
        at, n = np.unique((who[:-2] * buckets + bucket)[same], return_counts=True)
        out.ravel()[at] = np.log1p(n)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def _halves(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Weighted counts, runs and words each brought to a length of their own."""
    weighted = counts * rarity
    return np.hstack((_unit(weighted[:, :BUCKETS]), WORD_LENGTH * _unit(weighted[:, BUCKETS:])))


def _packed(counts: np.ndarray) -> list[bytes]:
    """Rows in half precision: places and values of what isn't zero, or all values where that is no longer."""
    out = []
    for row in counts.astype(np.float16):
        at = np.flatnonzero(row)
        out.append(at.astype(np.uint16).tobytes() + row[at].tobytes() if 2 * len(at) < len(row) else row.tobytes())
    return out


def _unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), BUCKETS + WORD_BUCKETS), np.float32)
    for to, row in zip(out, rows, strict=True):
        both = np.frombuffer(row, np.uint16)
        if len(both) == len(to):
            to[:] = both.view(np.float16)
        else:
            at, value = np.split(both, 2)
            to[at] = value.view(np.float16)
    return out


def _leading(blocks: Callable[[], Iterator[np.ndarray]], rows: int, rank: int) -> np.ndarray:
    """The leading right singular vectors of so many rows, which come in blocks, by subspace iteration."""
    width = BUCKETS + WORD_BUCKETS
    q = np.random.default_rng(11).standard_normal((width, min(rank + 16, rows, width))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(sum(b.T @ (b @ q) for b in blocks()))
    _, _, turned = np.linalg.svd(np.vstack([b @ q for b in blocks()]), full_matrices=False)
    return (q @ turned.T)[:, :rank]


@dataclass
class Model:
    """Rarity of terms, projection, the sample's vectors and labels, and the share of good labels."""

    rarity: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    base: float

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.base)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return out
        for at in range(0, len(texts), BLOCK):
            v = _unit(_halves(counts_of(texts[at : at + BLOCK]), self.rarity) @ self.projection)
            cosines = v @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(float) ** SHARPNESS
            total = weight.sum(axis=1)
            voted = (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
            out[at : at + BLOCK] = np.where(total > 0, np.clip(voted, 0, 1), self.base)
        return out


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Model:
    """labelled: doc_id, text, label (0 or 1), all to be learned from, and votes if a row stands for several; read twice, and alike.

    The driver gets about ``rows`` rows of packed counts at most, not texts, however often
    ids and rows repeat: beyond an eighth more, each row stays by a hash, and equal
    ones come once with how many of them stay. It unpacks ``BLOCK`` of them at a time.
    """
    labelled = labelled.where("label is not null and doc_id is not null")
    votes = F.col("votes") if "votes" in labelled.columns else F.lit(1).cast("bigint")
    labelled = labelled.select(F.col("doc_id").cast("bigint"), F.col("label").cast("int"), F.coalesce("text", F.lit("")).alias("text"), votes.alias("votes")).withColumn("row", F.xxhash64("doc_id", "label", "text"))
    equal = materialise(labelled.groupBy("row").agg(F.sum("votes").alias("n")), "labelled")
    total = equal.agg(F.sum("n")).first()[0] or 0
    share = 1.0 if total <= rows * 9 // 8 else rows / total
    by_chance = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 20)) / (1 << 20)
    copies = equal.select("row", F.floor(F.col("n") * share + by_chance).cast("bigint").alias("copies")).where("copies > 0")
    once = labelled.drop("votes").join(F.broadcast(copies), "row").dropDuplicates(["row"]).repartition(labelled.sparkSession.sparkContext.defaultParallelism)

    @releasing
    def vectors(batches):
        for part in chunks(batches, "text", SLICE_CHARS):
            for i in range(0, part.num_rows, BLOCK):
                block = part.slice(i, BLOCK)
                packed = _packed(counts_of(block.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([*map(block.column, ("doc_id", "label", "row", "copies")), pa.array(packed, pa.binary())], names=["doc_id", "label", "row", "copies", "v"])

    found = once.select("doc_id", "label", "row", "copies", "text").mapInArrow(vectors, "doc_id bigint, label int, row bigint, copies bigint, v binary").collect()
    found = [r for r in sorted(found, key=lambda r: (r.doc_id, r.row)) for _ in range(r.copies)]
    labels = np.array([r.label for r in found], float)
    if not found:
        return Model(np.zeros(BUCKETS + WORD_BUCKETS, np.float32), np.zeros((BUCKETS + WORD_BUCKETS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)

    def counts() -> Iterator[np.ndarray]:
        return (_unpacked([r.v for r in found[at : at + BLOCK]]) for at in range(0, len(found), BLOCK))

    rarity = (np.log((1 + len(found)) / (1 + sum((c > 0).sum(axis=0) for c in counts()))) + 0.1).astype(np.float32)

    def weighted() -> Iterator[np.ndarray]:
        return (_halves(c, rarity) for c in counts())

    projection = _leading(weighted, len(found), RANK)
    model = Model(rarity, projection, np.vstack([_unit(w @ projection) for w in weighted()]), labels, float(labels.mean()))
    del found
    release()
    return model


def sample_labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, label and votes of the documents of about ``rows`` labelled ids. labels: doc_id, label; only the sample is broadcast.

    An id that is labelled alike more than once has so many votes; one that
    documents repeat gives all its rows, of which ``fit`` takes a bounded part.
    """
    labels = labels.where("label is not null and doc_id is not null").groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    share = min(1.0, rows / max(labels.count(), 1))
    chosen = labels.where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def scorer(model: Model):
    """Arrow UDF: text to the score; the model goes out once, as a broadcast."""
    from pyspark.sql import SparkSession

    sent = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    @releasing
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.concatenate([np.empty(0), *(sent.value.score(part) for part in text_slices(texts, SLICE_CHARS))]))

    return score


def with_quality(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted."""
    scored = docs.drop("score", "predicted").withColumn("score", scorer(model)(F.col("text")))
    return scored.withColumn("predicted", F.when(F.col("score") >= GOOD, 1).otherwise(0))
