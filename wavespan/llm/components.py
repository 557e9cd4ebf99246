"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespan.session import stored, unstore


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node that the given edges connect each to; roots are left out."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(codes[:len(a)].tolist(), codes[len(a):].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    top = np.array([find(x) for x in range(len(nodes))], dtype=np.int64)
    child = top != np.arange(len(nodes))
    return nodes[child], nodes[top[child]]


def _within_batches(edges: DataFrame) -> DataFrame:
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, root = roots(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)],
                                             names=["node", "root"])

    return edges.mapInArrow(contract, "node bigint, root bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) whose component has a lesser node.

    Batches of edges are first contracted where they lie. Then large and small stars alternate: a
    node hands its greater neighbours, and next its lesser ones, to the least of its
    neighbourhood. Every step aggregates before it joins, and a node with very many neighbours is
    an ordinary skewed join key. Ends when all edges point from a child to its one root.
    """
    stars = stored(_within_batches(edges.select("a", "b").where("a <> b")))
    while True:
        parents = stars.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("top"))
        twice = parents.where("root <> top").limit(1).count()
        if not twice and not parents.join(
                stars.select(F.col("root").alias("node")).distinct(), "node", "left_semi").limit(
                1).count():
            return stars.distinct()
        both = stars.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(
            stars.select(F.col("root").alias("u"), F.col("node").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("node"), F.col("m").alias("root")).distinct())
        large = stored(large)
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        joined = large.join(least, "node")
        small = joined.select("root", "m").where("root <> m").toDF("node", "root").unionByName(
            least.toDF("node", "root")).distinct()
        before, stars = stars, stored(_within_batches(small))
        unstore(before, large)
