"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its defined cases."""

import hashlib
import io
import math
import os
import re
import tracemalloc
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("lodestack.llm")

import corpus_pipeline  # noqa: E402
from lodestack.llm import ann, bpe, common, exact_dedup, langid, license_scan, lm, ngram_join, packing, quality, queries, warc  # noqa: E402
from lodestack.llm.components import components, looked_up  # noqa: E402

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SF = "/root/testdata/sf0.001"
SPACES = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "a b  c"), (5, "a b c"), (6, "a\tb\nc"), (7, "Σίσυφος İstanbul é ½ x²"), (8, "a\x1cb \x85 \x00 e f"), (9, "<|endoftext|>hi <|startoftext|>"),
    (10, "aaaa" * 50 + " " + "ab" * 40), (11, "日本語 한국어 😀👍🏽"), (12, "word " * 9000), (12, "word " * 9000), (13, "A B C"), (14, "don't I'LL 'S 123 _"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash") for r in ODD], SCHEMA + ", score string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


# 1


def test_exact_dedup_brute_force(odd, empty):
    got = sorted((r.doc_id, r.text_sha256, r.keep_id, r.group_size, r.kept, r.score) for r in exact_dedup.mark_duplicates(odd).collect())
    norm = [(i, SPACES.sub(" ", t or "")) for i, t in ODD]
    want = []
    for i, t in norm:
        same = [j for j, u in norm if u == t]
        want.append((i, hashlib.sha256(t.encode()).hexdigest(), min(same), len(same), i == min(same), "clash"))
    assert got == sorted(want)
    kept = exact_dedup.drop_duplicates(odd)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({min(j for j, u in norm if u == t) for _, t in norm}) and kept.columns == odd.columns
    assert exact_dedup.mark_duplicates(empty).count() == 0


@pytest.mark.parametrize("most", [exact_dedup.BROADCAST_ROWS, 0])
def test_exact_dedup_hot_group(spark, monkeypatch, most):
    """Alike whether the filter and the groups are broadcast or joined by shuffles."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", most)
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.mark_duplicates(rows).where("group_size > 1").agg(F.count(F.lit(1)), F.max("group_size"), F.sum(F.col("kept").cast("int")), F.max("keep_id")).first()
    assert tuple(got) == (1334, 1334, 1, 0)
    assert exact_dedup.mark_duplicates(rows).where("group_size = 1 and kept and keep_id = doc_id").count() == 2666
    assert exact_dedup.drop_duplicates(rows.unionByName(rows)).count() == 2667


# 2


def test_packing_places_every_piece_once(spark, odd, empty):
    got = packing.pack_documents(odd, WORDS).collect()
    coder = tokenizers.Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in ODD:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_bins(got, 4096)
    assert packing.pack_documents(empty, WORDS).count() == 0


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_in_rounds_stays_close_to_the_bound(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 100, 5000))]
    pieces = spark.createDataFrame(rows, packing.PIECE)
    got = packing.pack_pieces(pieces, 100, 20, 700).collect()
    assert sorted(r.doc_id for r in got) == list(range(5000))
    assert check_bins(got, 100) <= 1.06 * sum(r[3] for r in rows) / 100


# 3


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_bpe_equals_the_library(docs, path):
    coder, table = tokenizers.Tokenizer.from_file(path), bpe.WordTable(path)
    texts = [t or "" for _, t in ODD] + [t for _, t in docs]
    for want, got in zip(coder.encode_batch(texts, add_special_tokens=False), table.encode_texts(texts), strict=True):
        assert want.ids == got.tolist()
        if path == BYTE:
            assert coder.decode(want.ids, skip_special_tokens=False) == table.decode(got.tolist())


def test_bpe_columns_round_trip(odd, empty):
    back = bpe.decode_documents(bpe.encode_documents(odd, BYTE), BYTE)
    assert all((r.text or "") == r.decoded and r.score == "clash" for r in back.collect())
    assert bpe.encode_documents(empty, BYTE).count() == 0


def test_bpe_table_rebuilds_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 10)
    table, coder = bpe.WordTable(BYTE), tokenizers.Tokenizer.from_file(BYTE)
    for k in range(5):
        text = " ".join(f"word{k}x{j}" for j in range(20))
        assert table.encode_texts([text])[0].tolist() == coder.encode(text).ids


# 4


def test_warc_round_trip(spark):
    big = "é<p>" * 400
    rows = [(1, "http://a/ü x", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "x" * 1000), (7, "u", "x" * 1000), (9, "u", big), (None, "u", "lost")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    got = sorted(((r.page_id, bytes(r.payload), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages, archive_bytes=200), True).collect()), key=repr)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        last = max(j for j, _, g in rows if g == h and j is not None) if len(raw) >= 1000 else i
        want.append((i, raw if i == last else b"", len(raw), hashlib.sha1(raw).hexdigest(), "response" if i == last else "revisit", None if i == last else last))
    assert got == sorted(want, key=repr)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    archives = common.materialise(warc.write_archives(pages, archive_bytes=1 << 20), "archives")
    ranges = warc.record_ranges(archives, 600).collect()
    assert sum(len(r.places) for r in ranges) == len(rows) and len(ranges) > archives.count()
    assert warc.read_archives(archives).count() == len(rows)


def test_neighbouring_ranges():
    places = [(0, 5), (5, 5), (10, 20), (30, 1), (40, 2)]
    assert list(warc.neighbouring(iter(places), 12)) == [[(0, 5), (5, 5)], [(10, 20)], [(30, 1)], [(40, 2)]]


def test_zip64_directories(monkeypatch, tmp_path):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    writer = warc.ArchiveWriter()
    writer.add(5, warc.warc_record(5, "u", "response", None, b"body", 4, hashlib.sha1(b"body").hexdigest()))
    content = writer.close()
    assert warc.END64 in content
    (tmp_path / "a.wacz").write_bytes(content)
    (head, block), = warc.archive_records(*warc.range_reader(str(tmp_path / "a.wacz")))
    assert head["warc-type"] == "response" and block.endswith(b"\r\n\r\nbody")


def test_compressed_members_have_no_ranges():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 100)
    with pytest.raises(ValueError, match="compressed"):
        warc.ZipDirectory(*warc.bytes_reader(out.getvalue())).place("a")


# 5


def brute_links(rows):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low.setdefault(find(i), []).append(doc)
    return sorted((doc, len(sets[i]), min(low[find(i)])) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize(("long", "hot"), [(4096, 100_000), (90, 5)])
def test_join_brute_force(spark, monkeypatch, long, hot):
    monkeypatch.setattr(ngram_join, "LONG", long)
    monkeypatch.setattr("lodestack.llm.components.HOT", hot)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(i, t) for i, t in ODD if i != 12]
    base = [list(rng.choice(vocabulary, 120)) for _ in range(6)]
    for k in range(240):  # near copies at every distance, in one large group and several small ones
        words = list(base[0] if k % 2 else base[k % 6])
        for at in rng.integers(0, 120, rng.integers(0, 9)):
            words[at] = str(rng.choice(vocabulary))
        rows.append((100 + k, " ".join(words[: rng.integers(90, 121)])))
    passage = " ".join(rng.choice(vocabulary, 60))
    rows += [(500 + k, passage + " " + " ".join(rng.choice(vocabulary, rng.integers(0, 30)))) for k in range(60)]
    got = ngram_join.link_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_links(rows)


def test_join_on_documents_and_defined_cases(spark, docs, empty):
    got = ngram_join.link_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_links(docs)
    assert ngram_join.link_documents(empty).count() == 0
    none = ngram_join.link_documents(spark.createDataFrame([(None, "a b c d e f"), (1, "x"), (1, "x")], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in none), key=repr) == [(1, 1, 1), (1, 1, 1), (None, 2, None)]


def test_a_slice_sends_a_token_once(spark):
    rng = np.random.default_rng(4)
    common = np.sort(rng.integers(1, 1 << 63, 50, np.uint64))
    sets = [np.sort(np.concatenate((common, rng.integers(1, 1 << 63, 5, np.uint64)))) for _ in range(400)]
    rows = spark.range(400, numPartitions=1).withColumnRenamed("id", "doc_id")
    made = ngram_join.shared_tokens(rows, lambda batches: [(list(range(400)), list(map(len, sets)), sets) for _ in [list(batches)]], 0)
    sent = rows.mapInArrow(ngram_join._send(lambda batches: [(list(range(400)), list(map(len, sets)), sets) for _ in [list(batches)]], 256), ngram_join.ENTRY)
    assert sum(len(r.tokens) // 8 for r in sent.collect() if r.ids is None) == 50 + 400 * 5
    got = made.collect()
    assert len(got) == 400
    assert all(np.array_equal(np.sort(np.frombuffer(r.tokens, np.uint64)), common) and r.n == 55 for r in got)


def test_looked_up_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr("lodestack.llm.components.HOT", 10)
    rows = common.materialise(spark.range(300).select("id", F.when(F.col("id") < 200, 1).otherwise(F.col("id")).alias("k")), "rows")
    table = spark.range(0, 250).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = looked_up(rows, table, "k")
    assert sorted((r.id, r.k, r.v) for r in got.collect()) == sorted((i, k, 2 * k) for i in range(300) for k in [1 if i < 200 else i] if k < 250)


def test_components_around_a_hub(spark, monkeypatch):
    monkeypatch.setattr("lodestack.llm.components.HOT", 20)
    edges = [(500, i) for i in range(600, 700)] + [(i, i + 1) for i in range(30)] + [(30, 650)] + [(900, 901)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for e in edges[:-1] for i in e} | {900: 900, 901: 900}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}


# 6


def test_neighbours_recall_ties_and_defined_cases(spark):
    rng = np.random.default_rng(5)
    e = rng.standard_normal((700, 16)).astype(np.float32)
    e[100:160] = e[40]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(e)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] + [0.0] * 14), (2080, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 20))
    wide, hit = e.astype(float), 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21)) and q not in [x[1] for x in found]
        s = wide @ wide[q]
        assert all(abs(x[2] - s[x[1]]) < 1e-9 for x in found)
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(700), -s))[:20]) & {x[1] for x in found})
    assert hit / (20 * len(got)) >= 0.9
    again = ann.search(df.unionByName(df).withColumn("score", F.lit("clash")), F.col("vec_id") % 20 == 0)
    assert {(r.query_id, r.rank, r.vec_id) for r in again.collect()} == {(q, x[0], x[1]) for q, found in got.items() for x in found}
    few = ann.search(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def _recall(got, e, queries, k=20):
    hit = 0
    for q in queries:
        s = e @ e[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:k].tolist()) & {r.vec_id for r in got if r.query_id == q})
    return hit / (k * len(queries))


def test_neighbours_come_from_the_descent(spark):
    """Over many blocks, the start knows few neighbours, and the search on it finds few; the descent finds them."""
    rng = np.random.default_rng(9)
    e = (rng.standard_normal((400, 24))[rng.integers(0, 400, 6000)] + 0.7 * rng.standard_normal((6000, 24))).astype(np.float32)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "vec_id long, embedding array<float>")
    rows = ann.usable(df).select(F.col("vec_id").alias("node"), "e")
    nodes = common.materialise(ann._nodes(rows), "nodes")
    truth = [set(np.argsort(-(e @ e[i]))[1:21].tolist()) for i in range(0, 6000, 50)]

    def known(graph):
        near = {}
        for r in graph.where("node % 50 = 0").collect():
            near.setdefault(r.node, []).append((r.score, r.near))
        return sum(len(t & {x for _, x in sorted(near[50 * i])[::-1][:20]}) for i, t in enumerate(truth)) / (20 * len(truth))

    assert known(ann.neighbour_graph(nodes, 25, iterations=0)) < 0.6
    assert known(ann.neighbour_graph(nodes, 25)) >= 0.9


def test_one_long_vector_takes_nothing_from_the_others(spark):
    rng = np.random.default_rng(2)
    e = rng.standard_normal((1200, 12))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    e[7] *= 1e6
    e[8] *= 1e-6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    assert _recall(got, e, range(0, 1200, 20)) >= 0.9


# 7


def test_lm_counts_and_scores(spark, docs, empty):
    got = {r.doc_id: r for r in lm.score_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in docs}
    c = Counter(w for i, ws in tokens.items() if crc(i, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 7) == 2, len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert lm.score_documents(empty).count() == 0


def test_lm_keeps_every_context(spark, docs):
    """Scores are those of the tree of all learned n-grams, those seen once in the corpus among them."""
    got = {r.doc_id: r.score for r in lm.score_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    codes, _ = lm.gram_codes([lm.words_of(t) for i, t in docs if crc(i, 7) != 2])
    grams, n = np.unique(codes, return_counts=True)
    by_length = []
    for d in range(lm.DEPTH + 1):
        keys, at = np.unique(grams & (1 << 8 * (d + 1)) - 1, return_inverse=True)
        by_length.append((keys, np.bincount(at, n)))
    tree = lm.ContextTree.build(by_length)
    for i, t in docs:
        assert math.isclose(got[i], tree.score(lm.gram_codes([lm.words_of(t)])[0]).sum(), rel_tol=1e-6)


def test_lm_beats_the_base_on_held_out_documents(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    train, held = ([lm.words_of(t) for i, t in docs if (crc(i, 7) != 2) == learn] for learn in (True, False))
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    base = sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for ws in held for w in ws)
    grams, counts = np.unique(lm.gram_codes(train)[0], return_counts=True)
    by_length = []
    for d in range(lm.DEPTH + 1):
        keys, at = np.unique(grams & (1 << 8 * (d + 1)) - 1, return_inverse=True)
        by_length.append((keys, np.bincount(at, counts)))
    asked, n_asked = np.unique(lm.gram_codes(held)[0], return_counts=True)
    assert (lm.ContextTree.build(by_length).score(asked) * n_asked).sum() > 0.97 * base


def test_lm_defined_cases(spark):
    """One id on all rows, null ids and texts, repeated rows, other columns, a long text; and nothing to learn from."""
    rows = [(None, "a b c", 1)] * 40 + [(3, None, 2), (3, "a b", 2), (4, "w " * 30000, 3)]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)).collect()
    assert len(got) == len(rows) and all(r.score < 0 for r in got) and len({r.score for r in got if r.doc_id is None}) == 1
    assert {r.n_tokens for r in got if r.doc_id == 3} == {1, 3} and not any(r.held_out for r in got if r.doc_id is None)
    held = next(i for i in range(100) if crc(i, 7) == 2)
    (one,) = lm.score_documents(spark.createDataFrame([(held, "a b")], SCHEMA)).collect()
    assert (one.held_out, one.train_tokens, one.n_known) == (True, 0, 0) and one.score < 0


def test_context_tree_against_recursion(monkeypatch):
    """The batch tree gives what the definition of context-tree weighting gives, by recursion over contexts."""
    monkeypatch.setattr(lm, "DEPTH", 2)
    texts = [lm.words_of("abracadabra abba"), lm.words_of("cab bab")]
    codes, _ = lm.gram_codes(texts)
    grams, n = np.unique(codes, return_counts=True)
    by_length = []
    for d in range(3):
        keys, at = np.unique(grams & (1 << 8 * (d + 1)) - 1, return_inverse=True)
        by_length.append((keys, np.bincount(at, n)))
    tree = lm.ContextTree.build(by_length)

    def counts(place, k, context, d):
        zeros = ones = 0
        for g, m in zip(grams.tolist(), n.tolist(), strict=True):
            byte = g & 255
            if (g >> 8) & (1 << 8 * d) - 1 == context and (1 << k | byte >> (8 - k)) == place:
                ones, zeros = ones + m * (byte >> (7 - k) & 1), zeros + m * (1 - (byte >> (7 - k) & 1))
        return zeros, ones

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(place, k, context, d, more=None):
        a, b = counts(place, k, context, d)
        extra = more is not None and more[0] & (1 << 8 * d) - 1 == context
        a, b = a + (extra and more[1] == 0), b + (extra and more[1] == 1)
        if a + b == 0:
            return 0.0
        if d == 2:
            return kt(a, b)
        children = sum(weighted(place, k, x << 8 * d | context, d + 1, more) for x in {*(g >> 8 * (d + 1) & 255 for g in grams.tolist()), *([more[0] >> 8 * d & 255] if more else [])})
        return np.logaddexp(kt(a, b), children) - math.log(2)

    for context, byte in [(ord("a") << 8 | ord("b"), ord("r")), (ord("c") << 8 | ord("a"), ord("b"))]:
        p = 0.0
        for k in range(8):
            place, bit = 1 << k | byte >> (8 - k), byte >> (7 - k) & 1
            p += weighted(place, k, 0, 0, (context, bit)) - weighted(place, k, 0, 0)
        assert math.isclose(tree.score(np.array([context << 8 | byte]))[0], p / math.log(10), rel_tol=1e-5)


# 8


def test_language_id(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    prototypes = langid.fit(docs.where(~held))
    found = langid.with_language(docs.where(held), prototypes).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert found[0] >= 0.97 and 0 <= found[1] <= found[2] <= 1
    strange = spark.createDataFrame([(*r, 1) for r in ODD], SCHEMA + ", lang_pred int")
    guesses = {r.doc_id: (r.lang_pred, r.score) for r in langid.with_language(strange, prototypes).collect()}
    assert all(guesses[i] == ("und", 0.0) for i in (1, 2, 3)) and guesses[12][0] != "und"
    assert langid.with_language(empty, prototypes).count() == 0
    assert [r.lang_pred for r in langid.with_language(strange.limit(2), langid.fit(docs.limit(0))).collect()] == ["und", "und"]


# 9


def test_licences(spark, odd, empty):
    rows = [(1, "Text.\nReleased under the MIT License.\nmore"), (2, "a mit licence"), (3, "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (4, None)]
    found = {r.doc_id: r.licences for r in license_scan.scan_licences(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: ["MIT"], 2: [], 3: ["Apache-2.0", "CC-BY-NC-4.0", "MIT"], 4: []}
    assert license_scan.scan_licences(odd).count() == len(ODD) and license_scan.scan_licences(empty).count() == 0


def test_licences_in_full_and_wrapped(spark):
    """The genuine texts, wrapped, bare and as comments; a blank line ends a sentence."""
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
    bsd = """All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
    rows = [(1, mit), (2, " * " + gpl.replace("\n", "\r\n * ")), (3, bsd), (4, "Released under\n\nthe MIT License"), (5, "words before\nReleased under the\nMIT License\nwords after")]
    found = {r.doc_id: r for r in license_scan.scan_licences(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: r.licences for i, r in found.items()} == {1: ["MIT"], 2: ["GPL-3.0-or-later"], 3: ["BSD-2-Clause"], 4: [], 5: ["MIT"]}
    assert found[1].sentence_ids == ["mit-grant", "mit-notice", "as-is"] and found[2].sentence_ids == ["gpl3-terms", "gpl-hope"]


def test_licence_names_and_identifiers(spark):
    rows = ["Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "Licensed under the BSD 3-Clause License", "// SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under the Mozilla Public License 2.0.", "Licensed under the GNU Lesser General Public License,\nversion 2.1.", "x\n\nSPDX-License-Identifier: Apache-2.0\n\ny", "MIT " * 5000]
    got = {r.doc_id: r.licences for r in license_scan.scan_licences(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)], SCHEMA + ", licences string")).collect()}
    assert got == {0: ["MIT"], 1: ["MIT"], 2: ["BSD-3-Clause"], 3: ["GPL-2.0-or-later"], 4: ["MPL-2.0"], 5: ["LGPL-2.1-only"], 6: ["Apache-2.0"], 7: []}


def test_licences_whatever_stands_between_words(spark):
    rows = [(i, t) for i, t in enumerate(["All  rights reserved.", "All rights\treserved", "All Rights-Reserved"])]
    assert {r.doc_id: r.licences for r in license_scan.scan_licences(spark.createDataFrame(rows, SCHEMA)).collect()} == {i: ["proprietary"] for i in range(3)}


# 10


def test_quality(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality.fit(quality.sample_labelled(docs, labels.where(~held)))
    found = quality.with_quality(docs.join(labels.where(held), "doc_id"), model)
    assert found.agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0] >= 0.95
    scores = [r.score for r in quality.with_quality(odd, model).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert quality.with_quality(empty, model).count() == 0
    assert quality.fit(quality.sample_labelled(docs, labels.limit(0))).score(["x", ""]).tolist() == [0.5, 0.5]


def test_quality_by_brute_force(spark):
    """Scores are the votes of the nearest by a plain loop over the model's vectors; words count, not shapes alone; ties and odd labels."""
    good, bad = "calm river water flows down", "spend money quick cheap deal"
    rows = [(i, f"{good if i % 2 else bad} {i % 5}", i % 2) for i in range(80)] + [(200, "x", None), (1, f"{good} 1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(docs)
    texts = [good, bad, "", "water river", f"{good} 1"]
    got = quality.with_quality(spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], SCHEMA + ", score double"), model).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        v = (quality._halves(quality.counts_of([t]), model.rarity) @ model.projection)[0]
        v = v / (np.linalg.norm(v) or 1)
        cosines = [float(v @ w) for w in model.vectors]
        near = sorted(range(len(cosines)), key=lambda k: -cosines[k])[: quality.NEIGHBOURS]
        weights = [max(cosines[k], 0) ** quality.SHARPNESS for k in near]
        if len({round(cosines[k], 5) for k in near}) == len(near):
            assert math.isclose(r.score, sum(w * model.labels[k] for w, k in zip(weights, near, strict=True)) / sum(weights), abs_tol=1e-4)
    assert got[0].score > 0.9 and got[1].score < 0.1 and len(model.labels) == 81


def test_quality_learns_bounded_rows(spark):
    """Ids that documents and labels repeat don't multiply what is learned from; below the bound every row counts."""
    texts = [f"{'calm river water flows down' if i % 2 else 'spend money quick cheap deal'} {i}" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 20, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 20, "doc_id long, label int")
    model = quality.fit(quality.sample_labelled(docs, labels, 200), 200)
    assert 100 <= len(model.labels) <= 300 and 0.3 < model.base < 0.7
    got = model.score(["calm river water flows", "spend money quick cheap"])
    assert got[0] > 0.9 and got[1] < 0.1
    one_id = docs.limit(1200).select(F.lit(5).cast("long").alias("doc_id"), F.concat("text", F.lit(" "), F.monotonically_increasing_id().cast("string")).alias("text"))
    one_id = common.materialise(one_id, "one_id")  # read twice, so written
    assert 50 <= len(quality.fit(quality.sample_labelled(one_id, labels, 100), 100).labels) <= 150
    few = quality.fit(quality.sample_labelled(docs.dropDuplicates(["doc_id"]), labels.where("doc_id < 10").unionByName(labels.where("doc_id = 0").limit(2))))
    assert len(few.labels) == 10 * 20 + 2 and few.labels.sum() == 5 * 20


def test_quality_learns_in_blocks(spark):
    """The driver holds no table of all counts, and finds the model that one would give; long and empty texts, rows that repeat."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.when(F.col("id") % 50 == 0, 9000).otherwise(60)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(5000) + F.col("id") % 2 * 3000))))
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 500 != 7, words).alias("text"), (F.col("id") % 2).cast("int").alias("label"))
    rows = common.materialise(rows.unionByName(rows.where("doc_id < 20")), "rows")
    quality.fit(rows.limit(10))
    tracemalloc.start()
    try:
        model = quality.fit(rows)
        assert tracemalloc.get_traced_memory()[1] < 50e6
    finally:
        tracemalloc.stop()
    given = sorted(((r.doc_id, r.text or "", r.label) for r in rows.collect()), key=lambda r: r[0])
    counts = np.vstack([quality.counts_of([t]) for _, t, _ in given]).astype(np.float16).astype(np.float32)
    assert model.labels.tolist() == [label for _, _, label in given] and model.base == model.labels.mean()
    assert np.array_equal(model.rarity, (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.1).astype(np.float32))
    table = quality._halves(counts, model.rarity).astype(float)
    want = quality._unit(table @ model.projection.astype(float))
    assert np.allclose(model.vectors, want, atol=1e-4) and model.vectors.shape == (2020, quality.RANK)
    assert np.allclose(model.projection.T @ model.projection, np.eye(quality.RANK), atol=1e-4)
    most = (np.linalg.eigvalsh(table @ table.T)[-quality.RANK :]).sum()
    assert (np.square(table @ model.projection)).sum() > 0.97 * most
    for c in (counts[:3], counts[-1:] * 0):
        assert np.array_equal(quality._unpacked(quality._packed(c)), c)


def test_language_by_brute_force(spark):
    """Cosines of plainly bound and bundled vectors."""
    train = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "der hund lief durch das haus", "de"), (3, None, "fr"), (4, "x", None)], SCHEMA + ", lang string")
    prototypes = langid.fit(train)
    space = langid.LetterSpace()

    def bundle(text):
        kept = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        kept = re.sub(" +", " ", kept)
        v = np.zeros(langid.DIM)
        for a, b, c in zip(kept, kept[1:], kept[2:], strict=False):
            if b != " ":
                one = lambda x: space._vector(0 if x == " " else ord(x))
                v += np.roll(one(a), 2) * np.roll(one(b), 1) * one(c)
        return v / (np.linalg.norm(v) or 1)

    want = {k: bundle(t) for k, t in (("en", "the cat sat on the mat"), ("de", "der hund lief durch das haus"))}
    assert sorted(prototypes) == ["de", "en"] and all(np.allclose(prototypes[k], want[k], atol=1e-5) for k in want)
    texts = ["the dog sat", "das haus", "Ein, Hund!", "123", None, "日本語"]
    got = langid.with_language(spark.createDataFrame(list(enumerate(texts)), SCHEMA), prototypes).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        cosines = {k: max(0.0, float(bundle(t or "") @ w)) for k, w in want.items()}
        if t is None or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert math.isclose(r.score, max(cosines.values()), abs_tol=1e-5)
            assert max(cosines.values()) == 0 or r.lang_pred == max(cosines, key=cosines.get)


# all


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_whole_tables(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name != "op2_best_fit_packing" and name != "op6_nearest_neighbours":
        assert len(got) == spark.read.parquet(f"{SF}/{'pages' if name == 'op4_warc' else 'documents'}.parquet").count()
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.execute(queries.ORACLE_SQL[name]).df()
        clean = lambda d: sorted(repr(tuple(None if str(v) in ("nan", "<NA>", "None") else float(v) if isinstance(v, (int, float)) else str(v) for v in row)) for row in d[sorted(d.columns)].astype(object).values.tolist())
        assert clean(got) == clean(want)


def test_pipeline_stages_on_nulls_and_nothing(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, None, None, None, None), (None, "null id here", "en", None, 1), (2, "a short clean text", None, "s", 1), (3, "a short  clean text", None, "s", 1), (2, "a short clean text", None, "s", 1)]
    for given in ([], rows):
        docs = spark.createDataFrame(given, schema)
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        for name, stage in corpus_pipeline.STAGES:
            docs = common.materialise(stage(spark, docs, str(tmp_path)), name)
            if name == "language_id":
                assert docs.count() == max(0, len(given) - 1)  # nothing learned: texts with a letter stay
            if name == "exact_dedup":
                assert docs.count() == (2 if given else 0)
                docs = docs.where("true")
        assert docs.count() == (0 if not given else docs.count())


def test_pipeline_against_its_parts(spark, docs):
    """What is left is what brute force leaves of the documents that both classifiers keep."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_classifier(spark, corpus_pipeline.language_id(spark, frame, SF), SF)
    assert kept.columns == frame.columns
    left = {r.doc_id: r.text for r in kept.collect()}
    first = {}
    for i in sorted(left):
        first.setdefault(SPACES.sub(" ", left[i] or ""), i)
    rows = [(i, left[i]) for i in sorted(first.values())]
    want = {doc for doc, _, low in brute_links(rows) if doc == low}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == want
    check_bins(got, 4096)
