"""Connected components: few edges by one task, more by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfell.checkpoints import release

from .common import cut

#: Up to so many distinct edges (16 bytes each) meet in one task.  Steps over few edges cost the driver
#: far more than the executors: each is six shuffles, with their plans, threads and tasks.
ONE_TASK_EDGES = 1 << 20


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), sorted, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            return nodes, nodes[root]
        least = np.minimum(rx, ry)
        np.minimum.at(root, rx, least)
        np.minimum.at(root, ry, least)
        while (root != (up := root[root])).any():
            root = up


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[batch.column(k).to_numpy() for k in range(2)] for batch in batches]
    if held:
        made = least_reached(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["node", "root"])


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """node, root for every node of edges (a, b), longs: root is the smallest node it reaches.

    Beyond one_task_edges distinct edges there are steps.  Each joins edges with the least neighbour per node, which is summed before it meets, so a
    node with very many edges is spread by adaptive execution.  Lineage is cut after every round, and the round before deleted.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    now = cut(edges.where("a <> b").select(low, high).distinct())
    stamp = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).alias("x")
    before = now.agg(stamp).first()["x"]
    if before["n"] <= one_task_edges:
        return now.repartition(1).mapInArrow(_in_one_task, "node long, root long")
    while before["n"]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        near = large.groupBy("b").agg(F.min("a").alias("m"))
        linked = large.join(near, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b")))).alias("e"))
        held, now = now, cut(linked.select("e.a", "e.b").where("a <> b").distinct())
        release(held)
        after = now.agg(stamp).first()["x"]
        if after == before:
            break
        before = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", F.col("a").alias("root")).distinct())
