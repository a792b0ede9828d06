"""Extraction of a dense bidirectional mesh by iterative degree pruning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfell.checkpoints import cut, release

RATIO, DECAY, MIN_NODES, MIN_RATIO = 0.8, 0.9, 500, 0.05


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("addr")).union(edges.select(F.col("dst").alias("addr"))).distinct()


def induced(edges: DataFrame, pool: DataFrame) -> DataFrame:
    """Edges whose ends both survive, self pairs included."""
    return edges.join(pool.select(F.col("addr").alias("src")), "src", "left_semi").join(pool.select(F.col("addr").alias("dst")), "dst", "left_semi").select("src", "dst", "rtt")


def degrees(edges: DataFrame, pool: DataFrame) -> DataFrame:
    """addr, out_degree, in_degree within the pool, self pairs left out, isolated nodes with zeros."""
    own = induced(edges, pool).where("src <> dst")
    ends = own.select(F.explode(F.array(F.struct(F.col("src").alias("addr"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("addr"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    counted = ends.groupBy("e.addr").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return pool.join(counted, "addr", "left").select("addr", zero("out_degree"), zero("in_degree"))


def prune_round(edges: DataFrame, pool: DataFrame, ratio: float, n: int) -> DataFrame:
    """The pool without all nodes whose degree in either direction is below ratio * (n - 1)."""
    bound = ratio * (n - 1)
    return degrees(edges, pool).where((F.col("out_degree") >= bound) & (F.col("in_degree") >= bound)).select("addr")


def prune(edges: DataFrame, ratio: float = RATIO) -> tuple[DataFrame, int]:
    """Survivors of pruning to a fixpoint, and the rounds that removed something.

    Every round works on the edges that the one before left, and cuts its lineage; what that one left is deleted.
    """
    pool, given = cut(nodes(edges)), edges
    n, rounds = pool.count(), 0
    while n > 1:
        left = cut(prune_round(edges, pool, ratio, n))
        m = left.count()
        if m == n:
            release(left)
            break
        before, edges = edges, cut(induced(edges, left))
        if before is not given:
            release(before)
        release(pool)
        pool, n, rounds = left, m, rounds + 1
    return pool, rounds


@dataclass
class Mesh:
    nodes: DataFrame
    ratio: float
    relaxations: int
    enough: bool


def adaptive(edges: DataFrame, ratio: float = RATIO, decay: float = DECAY, min_nodes: int = MIN_NODES, min_ratio: float = MIN_RATIO) -> Mesh:
    """Pruning with a ratio that is relaxed until enough nodes survive.

    Where the graph has fewer nodes than asked for, or the ratio falls below min_ratio, the mesh
    with the most nodes so far is returned with ``enough`` false.
    """
    total, tries, best = nodes(edges).count(), 0, None
    while True:
        pool, _ = prune(edges, ratio)
        n = pool.count()
        if best is None or n > best[1]:
            best = pool, n, ratio
        if n >= min_nodes:
            return Mesh(pool, ratio, tries, True)
        if total < min_nodes or ratio * decay < min_ratio:
            return Mesh(best[0], best[2], tries, False)
        ratio, tries = ratio * decay, tries + 1


def mesh_edges(edges: DataFrame, pool: DataFrame) -> DataFrame:
    return induced(edges, pool)


def mesh_locations(locations: DataFrame, pool: DataFrame) -> DataFrame:
    return locations.join(pool, "addr", "left_semi")


def density(edges: DataFrame, pool: DataFrame) -> DataFrame:
    """n_nodes, n_edges, density = edges / n(n-1), self pairs among the edges."""
    n = pool.agg(F.count("*").alias("n_nodes"))
    e = induced(edges, pool).agg(F.count("*").alias("n_edges"))
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return n.crossJoin(e).withColumn("density", F.when(possible > 0, F.col("n_edges") / possible))  # one row each
