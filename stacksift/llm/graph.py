"""Connected components of an edge table, by the smallest node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges (16 bytes each) that one task may join by itself; more are joined in distributed rounds, with equal results.
SMALL = 1_000_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the smallest node of each one's component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        while (new != new[new]).any():
            new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges (a, b); written.

    Beyond SMALL edges, every round hangs each node's neighbours below the smallest of them (large star, then small
    star), until no edge changes; rounds are written to the shared folder. Minima are folded in every task before they
    move; rows of a node with very many neighbours are joined to one row, which Spark may deal to several tasks.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if e.limit(SMALL + 1).count() <= SMALL:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(np.asarray(t.column("a"), np.int64), np.asarray(t.column("b"), np.int64)) for t in batches]
            if held:
                node, root = joined(*(np.concatenate(x) for x in zip(*held, strict=True)))
                yield pa.RecordBatch.from_pydict({"node": pa.array(node), "root": pa.array(root)})

        return written(e.coalesce(1).mapInArrow(run, "node long, root long"))
    before, e = None, written(e.distinct())
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("k"), F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "k")
        small = large.join(low, F.col("a") == F.col("k")).select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        e = written(small.filter("a <> b").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first())
        if now == before:
            break
        before = now
    return written(e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
