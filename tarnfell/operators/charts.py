"""Tables behind the charts: latency against distance, degree distributions, labels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfell.checkpoints import cut
from tarnfell.functions.geo import capitalised, min_possible_rtt

from .latency import with_distance


def latency_vs_distance(edges: DataFrame, locations: DataFrame) -> DataFrame:
    return with_distance(edges.where(F.col("rtt").isNotNull()), locations).select("src", "dst", "dist_km", F.col("rtt").alias("min_rtt"))


def percentile(rows: DataFrame, column: str, share: float) -> DataFrame:
    """One row, ``p``: the exact percentile, interpolated between the two ranks around it (null if there are no values).

    The values are sorted by range, so no task holds more than a part of them; the driver sees a
    count for each part.
    """
    values = rows.select(F.col(column).alias("v")).where("v IS NOT NULL").repartitionByRange("v").sortWithinPartitions("v")
    placed = cut(values.withColumn("id", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("id", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    total = sum(r["n"] for r in sizes)
    at = (total - 1) * share
    low, high = math.floor(at), math.ceil(at)

    def id_of(rank: int) -> int:
        for r in sizes:
            if rank < r["n"]:
                return (r["part"] << 33) + rank
            rank -= r["n"]
        return -1

    around = placed.where(F.col("id").isin(id_of(low), id_of(high))).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return around.select((F.col("a") + (F.col("b") - F.col("a")) * (at - low)).alias("p"))


def latency_summary(points: DataFrame) -> DataFrame:
    """n_pairs, max_dist_km, and the RTT where the chart is cut (99th percentile, interpolated)."""
    sums = points.agg(F.count("*").alias("n_pairs"), F.max("dist_km").alias("max_dist_km"))
    return sums.crossJoin(percentile(points, "min_rtt", 0.99).withColumnRenamed("p", "p99_rtt"))  # one row each


def sol_line(points: DataFrame) -> DataFrame:
    """The two ends of the line of light in fibre."""
    ends = points.agg(F.max("dist_km").alias("m")).select(F.explode(F.array(F.lit(0.0), F.col("m"))).alias("dist_km"))
    return ends.select("dist_km", min_possible_rtt(F.col("dist_km")).alias("rtt"))


def degree_cdf(edges: DataFrame) -> DataFrame:
    """direction, degree, p: empirical distribution of out- and in-degrees, a step for every node.

    Counts per degree are laid out first, so the ranking window sees one row per distinct degree.
    """
    valid = F.count("rtt")
    out = edges.groupBy("src").agg(valid.alias("degree")).select(F.lit("out").alias("direction"), "degree")
    into = edges.where(F.col("rtt").isNotNull()).groupBy("dst").agg(valid.alias("degree")).select(F.lit("in").alias("direction"), "degree")
    counts = out.unionByName(into).groupBy("direction", "degree").agg(F.count("*").alias("k"))
    upto = Window.partitionBy("direction").orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("direction")
    steps = counts.withColumns({"last": F.sum("k").over(upto), "n": F.sum("k").over(whole)})
    steps = steps.withColumn("i", F.explode(F.sequence(F.col("last") - F.col("k") + 1, F.col("last"))))
    return steps.select("direction", "degree", (F.col("i") / F.col("n")).alias("p"))


def mesh_ideal(edges: DataFrame) -> DataFrame:
    """Where a full mesh would be: distinct sources, and destinations with a valid measurement."""
    return edges.agg(F.countDistinct("src").alias("n_sources"), F.countDistinct(F.when(F.col("rtt").isNotNull(), F.col("dst"))).alias("n_destinations"))


def curve_labels(strategies: DataFrame, column: str = "strategy") -> DataFrame:
    return strategies.select(column, capitalised(F.col(column)).alias("label"))
