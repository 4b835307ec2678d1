"""Operator 3, byte-pair encoding and decoding with a public vocabulary.

A partition's text is cut into words, each distinct word is laid out once as a
linked list of symbols, and an index maps every pair that has a merge rank to
all its positions. Active ranks are applied in ascending order: all positions of
the pair are merged at once, and the pairs that appear beside them enter the
index (with higher ranks: a symbol exists only after the rank that makes it).
Stale positions are recognised when their rank comes up.

The word table of a worker is bounded (``MAX_WORDS``) and rebuilt when it is
full; text is taken ``CHUNK_CHARS`` at a time.

Defined cases: null text counts as empty; an empty text has no ids and decodes
to an empty text; the strings of special tokens in a text are those tokens;
texts of any length are taken whole; repeated rows are each encoded; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, releasing, text_slices

MAX_WORDS = 120_000
GAP = np.int64(-1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairIndexBPE:
    """Encodes words (byte strings) by the pair occurrence index."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str = ""):
        letters = byte_letters()
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        self.last_id = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 20 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where each word's ids begin and the last end)"""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(words) else 0
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = np.empty(n + 1, np.int64)
        sym[:n], sym[n] = self.byte_id[raw], GAP
        last = ends[lengths > 0] - 1
        sym[last] = self.last_id[raw[last]]
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[last] = n
        prv[(ends - lengths)[lengths > 0]] = n
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def add(at: np.ndarray, keys: np.ndarray) -> None:
            ranks = self._rank(keys)
            good = ranks >= 0
            if not good.any():
                return
            at, ranks = at[good], ranks[good]
            if len(at) == 1:
                found = [(int(ranks[0]), at)]
            else:
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                found = zip(ranks[np.r_[0, cut]].tolist(), np.split(at, cut), strict=True)
            for rank, part in found:
                if rank not in index:
                    heapq.heappush(heap, rank)
                index[rank].append(part)

        inner = np.flatnonzero(nxt[:n] < n)
        if len(inner):
            add(inner, sym[inner] << 20 | sym[inner + 1])
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            if len(parts) > 1 or self.left[rank] == self.right[rank]:  # else each position is there once
                at = np.unique(at)
            a, b, new = self.left[rank], self.right[rank], self.made[rank]
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
            if a == b and len(at) > 1:
                first = np.r_[True, at[1:] != nxt[at[:-1]]]
                run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = new, GAP
            nxt[at], prv[after] = after, at
            before = prv[at]
            left, right = before < n, after < n
            add(
                np.concatenate((before[left], at[right])),
                np.concatenate((sym[before[left]] << 20 | new, new << 20 | sym[after[right]])),
            )
        live = sym[:n] != GAP
        counts = np.concatenate(([0], np.cumsum(live)))
        return sym[:n][live].astype(np.int32), counts[np.concatenate(([0], ends))]


class _Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class WordTable:
    """Distinct words seen by a worker and their ids, each encoded once."""

    def __init__(self, path: str):
        spec = json.load(open(path))
        model = spec["model"]
        end = model.get("end_of_word_suffix") or ""
        self.bpe = PairIndexBPE(model["vocab"], model["merges"], end)
        self.lower = any(x.get("type") == "Lowercase" for x in (spec["normalizer"] or {}).get("normalizers", []))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pattern = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+" if self.lower else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        by_letter = {c: b for b, c in enumerate(byte_letters())}
        self.token_bytes: list[bytes] = [b""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for word, i in model["vocab"].items():
            self.token_bytes[i] = bytes(by_letter[c] for c in word if c in by_letter)
        for word, i in self.special.items():
            self.token_bytes[i] = word.encode()
        self.token_text = [str(i) for i in range(len(self.token_bytes))]
        self.reset()

    def reset(self) -> None:
        self.index = _Numbered()
        self.flat, self.first, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _words(self, text: str) -> list:
        if self.special and "<|" in text:
            out: list = []
            for part in self.split_special.split(text):
                out += [(part,)] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not self.lower:
            return self.pattern.findall(text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        # no token holds white space, so a word between spaces is encoded alone
        return text.split() if not regex.search(r"[\x1c-\x1f]", text) else regex.split(r"\s+", text)

    def _learn(self, words: list) -> None:
        """Encode new words; a word may fall into several pieces of the pattern."""
        pieces: list[bytes] = []
        cut = [0]
        for w in words:
            if isinstance(w, tuple):
                pass
            elif not self.lower:
                pieces.append(w.encode())
            elif w.isalpha() and w.isascii():
                pieces.append(w.encode())
            else:
                pieces += [p.encode() for p in self.pattern.findall(w)]
            cut.append(len(pieces))
        ids, starts = self.bpe.encode(pieces)
        first = starts[np.array(cut)]
        base, size = len(self.flat), np.diff(first)
        first = first[:-1] + base
        extra = []
        for i, w in enumerate(words):
            if isinstance(w, tuple):
                first[i], size[i] = base + len(ids) + len(extra), 1
                extra.append(self.special[w[0]])
        self.flat = np.concatenate((self.flat, ids, np.array(extra, np.int32)))
        self.first, self.size = np.concatenate((self.first, first)), np.concatenate((self.size, size))

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. The texts together are of bounded length."""
        if len(self.index) > MAX_WORDS:
            self.reset()
        index, known = self.index, len(self.index)
        rows: list[np.ndarray] = []
        for text in texts:
            words = self._words(text)
            rows.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
        if len(index) > known:
            self._learn(list(index)[known:])
        at = np.concatenate(rows) if rows else np.empty(0, np.int32)
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.first[at] - (ends - size), size) + np.arange(total)]
        cut = np.concatenate(([0], ends))[np.cumsum([0, *map(len, rows)])]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def word_table(path: str) -> WordTable:
    """One table a worker and vocabulary."""
    return held(("words", path), lambda: WordTable(path))


def encode_column(path: str):
    """Arrow UDF: text to the ids."""

    @F.arrow_udf("array<int>")
    @releasing
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = word_table(path)
        for texts in batches:
            yield pa.array([ids for part in text_slices(texts) for ids in coder.encode_texts(part)], pa.list_(pa.int32()))

    return encode


def decode_column(path: str):
    """Arrow UDF: ids to the text; null ids read as none."""

    @F.arrow_udf("string")
    @releasing
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = word_table(path)
        for lists in batches:
            yield pa.array([coder.decode(x.as_py() or []) for x in lists], pa.string())

    return decode


def encode_digests(path: str):
    """Arrow UDF: text to the number of ids, the digest of the ids and the digest of the text decoded from them."""

    @F.arrow_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    @releasing
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = word_table(path)
        name = coder.token_text.__getitem__
        for texts in batches:
            out = []
            for part in text_slices(texts):
                for found in coder.encode_texts(part):
                    ids = found.tolist()
                    listed = hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest()
                    out.append((len(ids), listed, hashlib.sha256(coder.decode(ids).encode()).hexdigest()))
            columns = zip(*out, strict=True) if out else ([], [], [])
            types = (pa.int64(), pa.string(), pa.string())
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs with token_ids."""
    return docs.withColumn("token_ids", encode_column(path)(F.col("text")))


def decode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs with the text of token_ids as decoded."""
    return docs.withColumn("decoded", decode_column(path)(F.col("token_ids")))
