"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import stage

#: Edges that a task joins at once.
HELD = 1_000_000


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of all nodes of the edges but the smallest ones themselves."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = np.split(at, 2)
    root = np.arange(len(names))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        live = low < high
        if not live.any():
            break
        x, y = x[live], y[live]
        np.minimum.at(root, high[live], low[live])
        while (root[root] < root).any():
            root = root[root]
    leaf = np.flatnonzero(root < np.arange(len(names)))
    return names[leaf], names[root[leaf]]


def contracted(edges: DataFrame) -> DataFrame:
    """u, v with u > v that join the same nodes: a star for each component of every HELD edges that a task reads."""
    kind = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in joined(t.column(0).to_numpy(), t.column(1).to_numpy())], schema=kind)

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= HELD:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for every node of the long columns a, b that has an edge to another;
    loops and repeats don't matter.

    Each task first joins what it reads; then large-star and small-star steps alternate, which never grow the edge
    table and end after about log² rounds. Each round is written down and contracted again where it is read; minima are
    taken with partial aggregation. The rounds end when every node has one smaller neighbour or larger ones only."""
    e = stage(contracted(edges.filter("a <> b").select("a", "b")), "edges")
    while True:
        e = stage(contracted(e), "edges")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        less = F.when(F.col("v") < F.col("u"), F.col("v"))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m"), (F.max(less) > F.min(less)).alias("several"), (F.min("v") < F.col("u")).alias("has_less"), F.max(F.col("v") > F.col("u")).alias("has_more")), "minima")
        if not low.filter("several or has_less and has_more").limit(1).count():
            return low.select(F.col("u").alias("node"), F.least("u", "m").alias("label"))
        low = low.select(F.col("u").alias("w"), "m")
        large = e.join(low, F.col("v") == F.col("w")).select("u", F.least("v", "m").alias("v"))
        large = large.unionByName(low.filter("m < w").select(F.col("w").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = stage(small.distinct(), "edges")
