"""Connected components: label spreading on arrays in one task for few edges, alternating large-star and small-star steps for many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


#: Up to so many edges (16 bytes each) go through one task.
FEW = 500_000


def _joined(batches):
    """(node, root) of all nodes of the edges in this task."""
    parts = [np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]) for b in batches if b.num_rows]
    if not parts:
        return
    edges = np.concatenate(parts, axis=1)
    nodes, index = np.unique(edges, return_inverse=True)
    a, b = index.reshape(2, -1)
    low = np.arange(len(nodes))
    while True:  # every node takes the least label of its neighbours, then of that label; few rounds, as labels double their reach
        new = low.copy()
        np.minimum.at(new, low[a], low[b])
        np.minimum.at(new, low[b], low[a])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, low):
            break
        low = new
    root = nodes[low]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "root"])


def components(edges: DataFrame, scratch: Scratch, few: int = FEW) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; the root is the smallest node that it can reach.

    Beyond ``few`` edges both steps are an aggregation to each node's smallest neighbour and a join back, so a hub with very many
    neighbours is combined before the shuffle and never gathered. Each round is written to the shared folder.
    Loops and repeated edges are allowed; an empty table gives an empty one. ``edges`` is read twice, so it should be a written table.
    """
    edges = edges.select("a", "b").where("a <> b")
    if edges.count() <= few:
        return scratch.table(edges.repartition(1).mapInArrow(_joined, "node long, root long"), "roots")
    star = scratch.table(edges.distinct(), "edges")
    if star.count() <= few:
        return scratch.table(star.repartition(1).mapInArrow(_joined, "node long, root long"), "roots")
    known = None
    while True:
        both = star.select("a", "b").union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.table(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        after = scratch.table(small, "small")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        scratch.drop(large, star)
        star = after
        if state == known:
            break
        known = state
    return scratch.table(star.select(F.col("a").alias("node"), F.col("b").alias("root")).union(star.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct(), "roots")
