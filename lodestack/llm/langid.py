"""Operator 8, language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point. A
trigram is its three letters' vectors, permuted by their place and bound by
multiplication; a document is the bundle (sum) of its trigrams, a language the
bundle of its learning documents, and a document gets the language whose
prototype has the largest cosine with it. Runs of other characters are one
blank; trigrams whose middle is blank are left out.

Fitting takes a bounded sample of the rows to learn from (``FIT_ROWS``, by a
hash of the id); prediction covers whole texts, a slice of text at a time.

Defined cases: null text, or text without a letter, is ``und`` with score 0;
with nothing to learn from all is ``und``; rows without lang teach nothing; ties
go to the language first by name; repeated rows are each predicted; an empty
table gives an empty result; other columns pass through, and ones named
lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, held, releasing, text_slices

DIM = 512
#: About so many rows are learned from, chosen by a hash of the id.
FIT_ROWS = 20_000
MAX_GRAMS = 16_384
#: Characters in work at a time.
SLICE_CHARS = 1_000_000
UNKNOWN = "und"
#: Cosines of unrelated vectors spread by 1 / sqrt(DIM); three times that is beyond chance.
CHANCE = 3 / DIM**0.5
#: Letters kept at a time.
MAX_LETTERS = 4_096
#: Code points are below 2**21, so three fit a long.
BITS = 21


class LetterSpace:
    """Letter numbers and trigram vectors of a worker; letters' and trigrams' vectors are bounded and rebuilt when full."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        #: A letter's number is its code point, that of any other character 0; not asked yet: -1.
        self.number = np.full(0x110000, -1, np.int32)
        self.reset()

    def _vector(self, code: int) -> np.ndarray:
        bits = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, self.dim)
        return (2 * bits - 1).astype(np.float32)

    def _letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            if len(self.letters) >= MAX_LETTERS:
                self.letters.clear()
            v = self.letters[code] = self._vector(code)
        return v

    def reset(self) -> None:
        self.row: dict[int, int] = {}
        self.letters: dict[int, np.ndarray] = {}
        self.vectors = np.empty((1024, self.dim), np.float32)

    def _numbers(self, codes: np.ndarray) -> np.ndarray:
        out = self.number[codes]
        if (new := np.unique(codes[out < 0])).size:
            for c in new.tolist():
                self.number[c] = c if chr(c).isalpha() else 0
            out = self.number[codes]
        return out

    def _rows(self, grams: np.ndarray) -> np.ndarray:
        if len(self.row) + len(grams) > MAX_GRAMS:
            self.reset()
        out = np.empty(len(grams), np.int64)
        for i, g in enumerate(grams.tolist()):
            k = self.row.get(g)
            if k is None:
                k = self.row[g] = len(self.row)
                if k == len(self.vectors):
                    self.vectors = np.concatenate((self.vectors, np.empty_like(self.vectors)))
                a, b, c = g >> 2 * BITS, g >> BITS & (1 << BITS) - 1, g & (1 << BITS) - 1
                self.vectors[k] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
            out[i] = k
        return out

    def encode(self, texts: list[str]) -> np.ndarray:
        """A vector for each text; zero if it has no letter."""
        out = np.zeros((len(texts), self.dim), np.float32)
        lowered = [f" {t.lower()} " for t in texts]
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), list(map(len, lowered)))
        n = self._numbers(codes)
        kept = np.flatnonzero((n != 0) | np.r_[True, n[:-1] != 0])
        n, owner = n[kept].astype(np.int64), owner[kept]
        if len(n) < 3:
            return out
        middle = np.flatnonzero(n[1:-1])
        grams = n[middle] << 2 * BITS | n[middle + 1] << BITS | n[middle + 2]
        which, distinct = pd.factorize(grams)
        if not len(which):
            return out
        both, counts = np.unique(owner[middle + 1].astype(np.int64) * len(distinct) + which, return_counts=True)
        doc, gram = both // len(distinct), both % len(distinct)
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        rows = self._rows(distinct) if len(distinct) <= MAX_GRAMS else None
        weights = counts.astype(np.float32)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(doc)], strict=True):
            for c in range(a, b, MAX_GRAMS):
                part = slice(c, min(b, c + MAX_GRAMS))
                here = self.vectors[rows[gram[part]]] if rows is not None else self.vectors[self._rows(distinct[gram[part]])]
                out[doc[a]] += weights[part] @ here
        return out


def letter_space() -> LetterSpace:
    return held("letters", LetterSpace)


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def fit(train: DataFrame, rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """Prototypes of the languages of train (doc_id, text, lang)."""
    train = train.where("lang is not null and text is not null")
    total = train.count()
    share = min(1.0, rows / max(total, 1))
    sample = train.where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)).select("lang", "text")

    @releasing
    def sums(batches):
        space, found = letter_space(), {}
        for part in chunks(batches, "text", SLICE_CHARS):
            for lang, v in zip(part.column("lang").to_pylist(), _unit(space.encode(part.column("text").to_pylist())), strict=True):
                found[lang] = found.get(lang, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = sample.mapInArrow(sums, "lang string, v array<double>")
    # a language's sum is a few hundred numbers, whatever was learned from
    totals = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("s")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("v"))
    return {r.lang: _unit(np.array([x.s for x in r.v])).astype(np.float32) for r in sorted(totals.collect(), key=lambda r: r.lang)}


def predictor(prototypes: dict[str, np.ndarray]):
    """Arrow UDF: text to lang_pred and score."""
    names = sorted(prototypes)
    matrix = np.stack([prototypes[x] for x in names]).T if names else np.zeros((DIM, 1), np.float32)

    @F.arrow_udf("lang_pred string, score double")
    @releasing
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        space = letter_space()
        for texts in batches:
            langs: list[str] = []
            scores: list[float] = []
            for part in text_slices(texts, SLICE_CHARS):
                v = space.encode(part)
                found = v.any(axis=1) & bool(names)
                cosines = np.clip(_unit(v) @ matrix, 0, 1)
                best = cosines.argmax(axis=1)
                langs += [names[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), found.tolist(), strict=True)]
                scores += np.where(found, cosines[np.arange(len(best)), best], 0.0).astype(float).tolist()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return predict


def with_language(docs: DataFrame, prototypes: dict[str, np.ndarray], text: Column | None = None) -> DataFrame:
    """docs with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    guess = predictor(prototypes)(F.col("text") if text is None else text)
    return docs.withColumn("__p", guess).select(*docs.columns, "__p.lang_pred", "__p.score")
