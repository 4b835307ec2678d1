"""Operator 6, approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node of the graph. Nodes start with the neighbours found
in two orders of small blocks (nodes on the same side of random hyperplanes), a
start that knows few of the true neighbours. In each iteration every node's
neighbours and reverse neighbours are joined with their vectors and compared
with each other; pairs better than what a node has become its neighbours.
Iterations go on until less than ``SETTLED`` of the edges are new.

A query starts at its own node. In each round the best nodes found so far whose
neighbours are not known yet are joined with the graph, their neighbours scored,
and the best ``POOL`` kept, until nothing new is among them. The pool is scored
again in double precision on the original vectors, and equal vectors are
expanded to their rows, smallest vec_id first.

For inner products of vectors of different length, nodes fall in classes of
length, each up to twice the one before. A class has a graph of its own, on
vectors with one more component that makes the class's norms equal, so near in
the graph is near by the product. A query also starts at ``ENTRIES`` nodes of
every other class and keeps a pool for each; searching uses the plain product.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, as query or candidate; vectors of different dimension
have no product, and only those of the commonest dimension take part; rows that
repeat a vec_id and its vector are one; if there are fewer candidates than asked
for, those found are returned; an empty table gives an empty result; other
columns are not read. Compared vectors are in half precision, over the length of
their class, while searching; results are exact scores.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .exact_dedup import mark_repeats

NEIGHBOURS = 40
#: Nodes of a block of the start.
BLOCK = 512
#: Orders that cut nodes into blocks; with one alone the graph would fall into its blocks.
TABLES = 2
#: Iterations end when fewer than this share of the edges is new.
SETTLED = 0.01
POOL = 100
#: Nodes of each other class of length that a query starts at.
ENTRIES = 64
SEED = 7
NODE = "node bigint, class int, scale double, v binary"
EDGE = "node bigint, near bigint, score float"


def _matrix(column: pa.Array) -> np.ndarray:
    """Half-precision vectors of a binary column, as rows."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), -1).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and e (doubles) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null and e is not null and size(e) > 0")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists("e", odd) & F.exists("e", lambda x: x != 0))
    common = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("e") == (common["d"] if common else 0))


def _nodes(rows: DataFrame) -> DataFrame:
    """node, class, scale and v: the vector, with one more component, over the class's greatest length."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                e = batch.column("e")
                m = e.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                # a first division keeps squares of very long and very short vectors finite
                most = np.abs(m).max(axis=1)
                length = most * np.sqrt(((m / most[:, None]) ** 2).sum(axis=1))
                # a class ends at the root of 2 times a power of 2, so that vectors of length 1 are well within one
                part, exponent = np.frexp(length * 0.5**0.5)
                scale = np.ldexp(2**0.5, exponent)
                v = np.column_stack((m / scale[:, None], np.sqrt(1 - part**2))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(exponent, pa.int32()), pa.array(scale, pa.float64()), pa.array([x.tobytes() for x in v], pa.binary())], names=["node", "class", "scale", "v"])

    return rows.select("node", "e").mapInArrow(run, NODE)


def _best(edges: DataFrame, k: int, of: str = "node", other: str = "near") -> DataFrame:
    """The k best edges of each node; tasks drop what can't be among them before the shuffle."""
    w = Window.partitionBy(of).orderBy(F.desc("score"), other)
    return edges.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def _block_edges(nodes: DataFrame, dim: int, which: int, k: int, n: int) -> DataFrame:
    """Nearest nodes of the same class within blocks of the order that random hyperplanes give. Quantiles cut the blocks, whatever the partitions are."""
    planes = np.random.default_rng((SEED, which)).standard_normal((dim, 24)).astype(np.float32)

    def coded(bounds: np.ndarray):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    bits = (_matrix(batch.column("v")) @ planes > 0) @ (1 << np.arange(23, -1, -1))
                    # equal codes are told apart by the node; classes follow each other
                    code = bits + batch.column("node").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) / 2.0**64
                    code += batch.column("class").to_numpy() * 2.0**24
                    block = np.searchsorted(bounds, code, "right")
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "class", "v")), pa.array(code, pa.float64()), pa.array(block, pa.int64())], names=["node", "class", "v", "code", "block"])

        return nodes.select("node", "class", "v").mapInArrow(run, "node bigint, class int, v binary, code double, block bigint")

    def compare(part: pa.Table) -> pa.Table:
        ids, classes, vectors = part.column("node").to_numpy(), part.column("class").to_numpy(), _matrix(part.column("v"))
        if len(ids) < 2:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float32())], names=["node", "near", "score"])
        return pa.Table.from_batches([_top(ids, classes, vectors, a, min(len(ids), a + BLOCK), k) for a in range(0, len(ids), BLOCK)])

    blocks = n // BLOCK
    bounds = coded(np.empty(0)).approxQuantile("code", [i / blocks for i in range(1, blocks)], 0.1 / blocks) if blocks > 1 else []
    return coded(np.array(sorted(bounds))).groupBy("block").applyInArrow(compare, EDGE)


def _top(ids: np.ndarray, classes: np.ndarray, vectors: np.ndarray, a: int, b: int, k: int) -> pa.RecordBatch:
    """The k nearest in the block of its rows a to b."""
    scores = vectors[a:b] @ vectors.T
    scores[classes[a:b, None] != classes] = -np.inf
    scores[np.arange(b - a), np.arange(a, b)] = -np.inf
    k = min(k, len(ids) - 1)
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    best = np.take_along_axis(scores, near, 1)
    there = np.isfinite(best).ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:b], k)[there]), pa.array(ids[near].ravel()[there]), pa.array(best.ravel()[there].astype(np.float32))], names=["node", "near", "score"])


def _local_joins(batches):
    """Sorted by meeting node: compare all that meet there, unless both have met before, and give each what beats the worst neighbour it has."""

    def compared(ids, vectors, worst, fresh):
        scores = vectors @ vectors.T
        better = (scores > worst[:, None]) & (fresh | fresh[:, None])
        np.fill_diagonal(better, False)
        i, j = np.nonzero(better)
        return ids[i], ids[j], scores[i, j]

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = (batch.column("at").to_numpy(), batch.column("near").to_numpy(), _matrix(batch.column("v")), batch.column("worst").to_numpy(), batch.column("fresh").to_numpy(zero_copy_only=False))
        if held is not None:
            now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
        cut = np.flatnonzero(np.r_[True, now[0][1:] != now[0][:-1]])
        out = [compared(*(x[a:b] for x in now[1:])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        held = tuple(x[cut[-1] :] for x in now)
        if out:
            yield _edges(out)
    if held is not None:
        yield _edges([compared(*held[1:])])


def _edges(parts: list) -> pa.RecordBatch:
    a, b, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float32())], names=["node", "near", "score"])


def neighbour_graph(nodes: DataFrame, dim: int, k: int = NEIGHBOURS, iterations: int | None = None) -> DataFrame:
    """node, near, score: the k nearest that NN-descent finds. nodes (written): node, class, v. iterations: fewer than it takes, to see what the start knows."""
    n = nodes.count()
    start = reduce(DataFrame.unionByName, [_block_edges(nodes, dim, t, k, n) for t in range(TABLES)])
    edges = materialise(_best(start.groupBy("node", "near").agg(F.max("score").alias("score")), k).withColumn("fresh", F.lit(True)), "graph")
    done = 0
    while iterations is None or done < iterations:
        worst = edges.groupBy("node").agg(F.min("score").alias("w"), F.count(F.lit(1)).alias("m")).select("node", F.when(F.col("m") < k, F.lit(-2.0)).otherwise(F.col("w")).cast("float").alias("worst"))
        about = nodes.join(worst, "node", "left").select(F.col("node").alias("near"), "v", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
        back = _best(edges.select(F.col("near").alias("at"), F.col("node").alias("near"), "score", "fresh"), k, "at", "near")
        # pairs that met before bring nothing: one of the two has to be new here
        meet = edges.select(F.col("node").alias("at"), "near", "fresh").unionByName(back.select("at", "near", "fresh")).groupBy("at", "near").agg(F.max("fresh").alias("fresh"))
        lively = edges.where("fresh").select(F.col("node").alias("at")).unionByName(edges.where("fresh").select(F.col("near").alias("at"))).distinct()
        met = meet.join(lively, "at", "left_semi").join(about, "near").select("at", "near", "v", "worst", "fresh")
        found = met.repartition("at").sortWithinPartitions("at").mapInArrow(_local_joins, EDGE)
        pool = edges.select("node", "near", "score", F.lit(False).alias("fresh")).unionByName(found.withColumn("fresh", F.lit(True)))
        pool = pool.groupBy("node", "near").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
        edges, done = materialise(_best(pool, k), "graph"), done + 1
        held, fresh = edges.agg(F.count(F.lit(1)), F.count_if("fresh")).first()
        if fresh <= SETTLED * held:
            break
    return edges.select("node", "near", "score")


def _scored(batches):
    for batch in batches:
        if batch.num_rows:
            q, v = _matrix(batch.column("qv")), _matrix(batch.column("v"))
            # neither has its additional component; lengths of both classes come back
            s = np.einsum("ij,ij->i", q[:, :-1], v[:, :-1]) * batch.column("scale").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("node"), batch.column("class"), pa.array(s.astype(np.float64))], names=["q", "node", "class", "score"])


def graph_search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, pool_size: int = POOL) -> DataFrame:
    """q, node: the best nodes of each class found for each q of queries, q itself among them."""
    back = _best(graph.select(F.col("near").alias("node"), F.col("node").alias("near"), "score"), NEIGHBOURS)
    links = materialise(graph.select("node", "near").unionByName(back.select("node", "near")).distinct(), "links")
    qv = nodes.select(F.col("node").alias("q"), F.col("v").alias("qv"))
    of_class = Window.partitionBy("class").orderBy("h", "node")
    firsts = nodes.select("class", "node", F.xxhash64("node").alias("h")).withColumn("__r", F.row_number().over(of_class)).where(F.col("__r") <= ENTRIES)
    entries = firsts.select(F.col("class").alias("other"), "node").collect()

    def score(pairs: DataFrame) -> DataFrame:
        return pairs.join(nodes, "node").join(qv, "q").select("q", "node", "class", "scale", "qv", "v").mapInArrow(_scored, "q bigint, node bigint, class int, score double")

    def best(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("q", "class").orderBy(F.desc("score"), "node")
        return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= pool_size).drop("__r")

    starts = queries.select("q", F.col("q").alias("node"))
    if len({r.other for r in entries}) > 1:
        # a bounded number of nodes of each class of length, for the queries of the others
        table = F.array(*(F.struct(F.lit(r.other).alias("other"), F.lit(r.node).alias("node")) for r in entries))
        own = nodes.select(F.col("node").alias("q"), F.col("class").alias("own"))
        starts = starts.unionByName(queries.join(own, "q").select("q", "own", F.inline(table)).where("other <> own").select("q", "node"))
    pool = materialise(score(starts).withColumn("known", F.lit(False)), "pool")
    while pool.where("not known").limit(1).count():
        ahead = pool.where("not known").select("q", "node").join(links, "node").select("q", F.col("near").alias("node")).distinct()
        ahead = ahead.join(pool.select("q", "node"), ["q", "node"], "left_anti")
        grown = pool.select("q", "node", "class", "score", F.lit(True).alias("known")).unionByName(score(ahead).withColumn("known", F.lit(False)))
        pool = materialise(best(grown), "pool")
    return pool.select("q", "node")


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: for each query row its k nearest other rows."""
    rows = usable(vectors.withColumn("__q", is_query).select("vec_id", "embedding"))
    key = F.sha2(F.array_join(F.col("e").cast("array<string>"), ","), 256)
    rows = materialise(rows.withColumn("key", key).dropDuplicates(["vec_id", "key"]), "vectors")
    marked = mark_repeats(rows, "key", "vec_id").select("vec_id", F.col("keep_id").alias("node"), "e")
    first = materialise(marked, "marked")
    own = first.where("vec_id = node").select("node", "e")
    (dim,) = own.agg(F.max(F.size("e"))).first()
    nodes = materialise(_nodes(own), "nodes")
    graph = neighbour_graph(nodes, (dim or 0) + 1)
    asked = first.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q"))
    found = graph_search(nodes, graph, asked.select("q").distinct())
    exact = found.join(own.select(F.col("node").alias("q"), F.col("e").alias("qe")), "q").join(own, "node")
    exact = exact.select("q", "node", F.aggregate(F.zip_with("qe", "e", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("score"))
    # of equal vectors the k + 1 smallest ids can matter: one may be the query itself
    few = first.select("node", "vec_id").withColumn("__r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("__r") <= k + 1).drop("__r")
    near = _best(exact, 2 * k + 1, "q", "node").join(few, "node").select("q", "vec_id", "score")
    near = _best(near, k + 1, "q", "vec_id")
    out = asked.join(near, "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
