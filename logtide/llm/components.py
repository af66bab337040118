"""Connected components of a graph in a table, by alternating large-star and small-star steps.

Each step is a map-side combined minimum and a join on the node; after few steps every node points at the
smallest node of its component. The edges stay in tables; the driver sees their number and a checksum. Up to
``one_task`` edges are united in one task instead, with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.plans.materialize import materialize, release


def _united(batches):
    """Reads a bounded number of edges (a, b); gives every node that is not the smallest of its component, and that."""
    read = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not read:
        return
    nodes, at = np.unique(np.concatenate([x for ab in zip(*read) for x in ab]), return_inverse=True)
    a, b = at[:len(at) // 2], at[len(at) // 2:]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(after, end, least)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.filter("b > a").join(least, "a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def component_roots(edges: DataFrame, one_task: int = 0) -> DataFrame:
    """(node, root) for every node with an edge that is not its component's smallest node.

    ``edges`` has columns a and b of one type; loops and repeated edges are allowed. Without edges the
    result is empty. With ``one_task`` they are longs.
    """
    current = materialize(edges.filter("a <> b").distinct())
    seen = _checksum(current)
    if 0 < seen[0] <= one_task:
        rows = current.select("a", "b").coalesce(1).mapInArrow(_united, "a long, b long")
        united = materialize(rows)
        release(current)
        return united.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while seen[0]:
        following = materialize(_small_star(_large_star(current)))
        release(current)
        current, before, seen = following, seen, _checksum(following)
        if seen == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
