"""Connected components of an edge table by smallest label and pointer jumping, each round written to the shared folder.

Defined cases: no edges give no rows; loops and repeated edges change nothing;
ends are integers, never null. A node that very many edges name, or a label that
very many nodes have, doesn't gather them in one task: see ``looked_up``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


#: Rows from which a key is hot, and the most keys that can be.
HOT = 100_000
HOT_KEYS = 10_000


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of a written table with one that has a row for each key.

    Rows of hot keys stay where they are, and get the table's rows by broadcast:
    a hot key has at least one in ``HOT_KEYS`` of the rows, so there are no more
    than ``HOT_KEYS`` of them at any size. The rest is joined by a shuffle.
    """
    n = rows.count()
    least = max(HOT, -(-n // HOT_KEYS))
    if n < least:
        return rows.join(table, key)
    hot = materialise(rows.groupBy(key).agg(F.count(F.lit(1)).alias("many")).where(F.col("many") >= least).select(key), "hot")
    of_hot = materialise(table.join(F.broadcast(hot), key, "left_semi"), "of_hot")
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(table, key)
    return rest.unionByName(rows.join(F.broadcast(of_hot), key))


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns id and component, the smallest id reachable, for ids that have an edge."""
    both = edges.where("a <> b").select("a", "b")
    both = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        told = looked_up(both, labels.select(F.col("id").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("l"))
        low = materialise(labels.join(told, "id").select("id", F.least("label", "l").alias("new"), "label"), "low")
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        step = materialise(looked_up(low, jump, "new").select("id", F.least("new", "far").alias("new"), "label"), "labels")
        changed = step.where("new <> label").limit(1).count()
        labels = step.select("id", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")
