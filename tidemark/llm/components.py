"""Connected components of a graph whose edges are a table, by alternating large and small stars.

Each round replaces the edges by stars around smaller nodes; rounds are few (they grow with the logarithm of the longest
path). Minima are pre-aggregated, each half of a round is written to the shared folder, and the joins are plain equi-joins on written
tables, so adaptive execution can split a hub. Nothing but a checksum of two numbers reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task, contracted to stars around the smallest node of each local component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for k in range(0, len(nodes), 100_000):
        some = nodes[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(np.array([root(x) for x in some], np.int64))], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: bigint) -> (node, component): each node of an edge and the smallest node that it reaches."""
    edges = written(edges.where("a <> b").mapInArrow(_forest, "a long, b long"))
    before = None
    while (now := edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != before and now[0]:
        before = now
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = written(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = written(small.union(low).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
