"""From pings between subnets to the graph of least plausible RTTs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfell.functions.geo import haversine, min_possible_rtt


def located(pairs: DataFrame, locations: DataFrame) -> DataFrame:
    """Rows of pairs (src, dst, ...) whose ends both have a location, with src_lat ... dst_lon.

    Locations are one row per /24, so at most 2**24; Spark broadcasts them below its threshold and
    joins by shuffle beyond it.
    """
    at = {end: locations.select(F.col("addr").alias(end), F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon")) for end in ("src", "dst")}
    return pairs.join(at["src"], "src").join(at["dst"], "dst")


def with_distance(pairs: DataFrame, locations: DataFrame) -> DataFrame:
    """The located rows with dist_km."""
    rows = located(pairs, locations)
    distance = haversine(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))
    return rows.withColumn("dist_km", distance).drop("src_lat", "src_lon", "dst_lat", "dst_lon")


def plausible(pings: DataFrame, locations: DataFrame) -> DataFrame:
    """Pings no faster than light in fibre over the distance of their ends."""
    return with_distance(pings, locations).where(F.col("rtt") >= min_possible_rtt(F.col("dist_km")))


def plausible_lists(lists: DataFrame, locations: DataFrame) -> DataFrame:
    """The same over RTT lists (src, dst, rtts): implausible elements go, then empty lists."""
    rows = with_distance(lists, locations)
    bound = min_possible_rtt(F.col("dist_km"))
    return rows.withColumn("rtts", F.filter("rtts", lambda r: r >= bound)).where(F.size("rtts") > 0)


def min_rtt_edges(pings: DataFrame, locations: DataFrame) -> DataFrame:
    """src, dst, rtt: the least plausible RTT of each pair (the filter comes before the minimum)."""
    return plausible(pings, locations).groupBy("src", "dst").agg(F.min("rtt").alias("rtt"))


def explode_sources(by_src: DataFrame, column: str = "dsts") -> DataFrame:
    """src, dst, rtt of a row a source (and hour) with a map destination -> RTT list."""
    return by_src.select("src", F.explode(column).alias("dst", "rtts")).select("src", "dst", F.explode("rtts").alias("rtt"))


def explode_summary(summaries: DataFrame, column: str = "summary") -> DataFrame:
    """src, dst, rtt of nested maps source -> destination -> RTT list, as whole summary files have them."""
    return explode_sources(summaries.select(F.explode(column).alias("src", "dsts")))


def available(edges: DataFrame) -> DataFrame:
    """dst and its vantage points (sorted)."""
    return edges.where(F.col("rtt").isNotNull()).groupBy("dst").agg(F.sort_array(F.collect_set("src")).alias("srcs"))


def targets(edges: DataFrame) -> DataFrame:
    return edges.select("dst").distinct()


def without_self(edges: DataFrame) -> DataFrame:
    """Edges between different subnets only (by default a target may be located by itself)."""
    return edges.where(F.col("src") != F.col("dst"))
