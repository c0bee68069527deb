"""Connected components of an edge table by alternating large-star and small-star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage


class UnionFind:
    """Keeps only what it has linked; ``add`` returns the links that joined two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def add(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        new = []
        for x, y in zip(a, b):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                new.append((x, y))
        return new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars around each tree's smallest node."""
    trees = UnionFind()
    for batch in batches:
        trees.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
    nodes = list(trees.parent)
    for at in range(0, len(nodes), 20000):
        part = nodes[at : at + 20000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([trees.find(x) for x in part], pa.int64())], names=["a", "b"])


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) long -> node, root: each node that has an edge, with its component's smallest node.

    Every round's edges are a written table; the driver sees two numbers of each.
    """
    edges = edges.where("a <> b").mapInArrow(_forest, "a long, b long")
    edges = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "components-large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stage(small.where("u <> v").distinct(), "components-small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
