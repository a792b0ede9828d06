"""Which measurements to take under a budget: random, oracle, and greedy orders.

Every strategy makes one order of (src, dst) pairs, numbered by ``seq``; a budget is a prefix.
All orders are total: ties go by src, targets by dst, so results do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfell.checkpoints import cut, release
from tarnfell.functions.geo import EXPECTED_INFLATION, KM_PER_MS, MAX_REGION_KM, UNMEASURED_UTILITY, haversine

from .region import Region, distance_km

CANDIDATES = 50
SEED = 42


def numbered(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with seq from 1; only those reach the one task that numbers them."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("seq", F.row_number().over(Window.orderBy(*order)).cast("long"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key to as many tasks as the session shuffles to: few bytes, but much to compute,
    so adaptive execution must not gather them in one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def picks(rows: DataFrame, strategy: str) -> DataFrame:
    return rows.select(F.lit(strategy).alias("strategy"), "seq", "src", "dst", "rtt")


def random_order(seed: int = SEED) -> Column:
    """A seeded shuffle that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), "src", "dst").cast("binary"))


def random_picks(edges: DataFrame, limit: int, seed: int = SEED) -> DataFrame:
    return picks(numbered(edges.withColumn("key", random_order(seed)), [F.col("key"), F.col("src"), F.col("dst")], limit), "random")


def oracle_candidates(edges: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """The n nearest sources (by RTT) of every target, ranked from 1."""
    nearest = Window.partitionBy("dst").orderBy("rtt", "src")
    return edges.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= n)


def _candidates_at(edges: DataFrame, locations: DataFrame, n: int) -> DataFrame:
    """Candidates that have a location, of targets that have one."""
    vp = locations.select(F.col("addr").alias("src"), F.col("lat").alias("vp_lat"), F.col("lon").alias("vp_lon"))
    truth = locations.select(F.col("addr").alias("dst"), "lat", "lon")
    return oracle_candidates(edges, n).join(vp, "src").join(truth, "dst")


def oracle_first(edges: DataFrame, locations: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """The oracle's first pick of each target: the candidate nearest to where the target is."""
    rows = _candidates_at(edges, locations, n).withColumn("error_km", haversine(F.col("vp_lat"), F.col("vp_lon"), F.col("lat"), F.col("lon")))
    best = F.min_by(F.struct("src", "rtt", "error_km"), F.struct("error_km", "rtt", "src"))
    return rows.groupBy("dst").agg(best.alias("b")).select("dst", "b.*")


def interleave(ranked: DataFrame, limit: int) -> DataFrame:
    """Round robin: the first of every target, then the second of every target, ..."""
    return numbered(ranked, [F.col("rank"), F.col("dst")], limit)


def depth_for(counts: DataFrame, limit: int) -> int:
    """Smallest depth R at which targets' first R picks reach the limit (counts: dst, n)."""
    by = counts.groupBy("n").agg(F.count("*").alias("k")).orderBy("n").collect()  # at most CANDIDATES rows
    depth = 0
    while sum(min(depth, r["n"]) * r["k"] for r in by) < limit and any(r["n"] > depth for r in by):
        depth += 1
    return depth


def oracle_picks(edges: DataFrame, locations: DataFrame, limit: int, n: int = CANDIDATES) -> DataFrame:
    """The oracle: per target, again and again the candidate after which the estimate is nearest the truth.

    Ranks beyond what the round robin can use within the limit are not computed.
    """
    rows = _candidates_at(edges, locations, n)
    depth = depth_for(rows.groupBy("dst").agg(F.count("*").alias("n")), limit)

    def rank(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rtt", "src"])
        left = np.arange(len(group))
        lat, lon, rtt = (group[c].to_numpy() for c in ("vp_lat", "vp_lon", "rtt"))
        true_lat, true_lon = group["lat"].iloc[0], group["lon"].iloc[0]
        region, order = Region(), []
        while len(left) and len(order) < depth:
            guess, la, lo, ra = region.with_each(lat[left], lon[left], rtt[left])
            best = int(np.argmin(distance_km(guess[:, 0], guess[:, 1], true_lat, true_lon)))
            region.guess, region.lat, region.lon, region.radius = guess[best], la[best], lo[best], ra[best]
            order.append(left[best])
            left = np.delete(left, best)
        out = group.iloc[order][["dst", "src", "rtt"]]
        return out.assign(rank=np.arange(1, len(order) + 1))

    ranked = spread(rows, "dst").groupBy("dst").applyInPandas(rank, "dst string, src string, rtt double, rank int")
    return picks(interleave(ranked, limit), "smart_perfect")


def greedy_as_written(edges: DataFrame, limit: int) -> DataFrame:
    """Greedy order where only a target's first measurement has a utility: one source for every target,
    then all other sources of the first target, of the second, ..."""
    rows = edges.withColumn("rn", F.row_number().over(Window.partitionBy("dst").orderBy("src")))
    return picks(numbered(rows, [F.col("rn") > 1, F.col("dst"), F.col("rn")], limit), "iterative_greedy")


def greedy_order(utilities: DataFrame, limit: int) -> DataFrame:
    """Global greedy order of per-target sequences (dst, k, utility): by the least utility so far, then dst, k.

    Equal to taking, again and again, the target whose next utility is largest.
    """
    so_far = Window.partitionBy("dst").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = utilities.withColumn("bound", F.min("utility").over(so_far))
    return numbered(rows, [F.col("bound").desc(), F.col("dst"), F.col("k")], limit)


def model_rtt(lat: np.ndarray, lon: np.ndarray, region: Region) -> np.ndarray:
    """Default model of the RTT from vantage points to the current guess."""
    return distance_km(lat, lon, region.guess[0], region.guess[1]) * EXPECTED_INFLATION / KM_PER_MS


def shrinkage(lat: np.ndarray, lon: np.ndarray, region: Region, rtt_model: Callable) -> np.ndarray:
    """Default utility: how much the region's size would fall with the RTT that the model expects."""
    guess, la, lo, ra = region.with_each(lat, lon, rtt_model(lat, lon, region))
    return region.size() - Region.sizes(guess, la, lo, ra)


TRACE = "dst string, k int, src string, rtt double, utility double, actual_util double, predicted_rtt double"


def greedy_trace(
    edges: DataFrame, locations: DataFrame, depth: int, utility: Callable = shrinkage, rtt_model: Callable = model_rtt, priors: DataFrame | None = None, known: DataFrame | None = None
) -> DataFrame:
    """Per target the first ``depth`` greedy picks with expected and actual utility (TRACE).

    utility and rtt_model see one target's region only, so targets are independent of each other.
    known (dst, k) names targets' first picks; their regions are carried on from there and only the
    picks after them are returned.
    """
    vp = locations.select(F.col("addr").alias("src"), F.col("lat").alias("vp_lat"), F.col("lon").alias("vp_lon"))
    rows = edges.join(vp, "src")
    if priors is not None:
        rows = rows.join(priors.select("dst", F.col("lat").alias("prior_lat"), F.col("lon").alias("prior_lon")), "dst", "left")
    else:
        rows = rows.withColumns({"prior_lat": F.lit(0.0), "prior_lon": F.lit(0.0)})
    rows = rows.withColumn("k", F.lit(None).cast("int")) if known is None else rows.join(known.select("dst", "src", "k"), ["dst", "src"], "left")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("src")
        lat, lon, rtt = (group[c].to_numpy() for c in ("vp_lat", "vp_lon", "rtt"))
        prior = group[["prior_lat", "prior_lon"]].fillna(0.0).iloc[0]
        region, left, out, size = Region((prior.iloc[0], prior.iloc[1])), np.arange(len(group)), [], MAX_REGION_KM
        done = np.flatnonzero(group["k"].notna().to_numpy())
        for k in done[np.argsort(group["k"].to_numpy()[done])]:
            region.add(lat[k], lon[k], rtt[k])
        if len(done):
            size, left = region.size(), np.delete(left, done)
        while len(left) and len(done) + len(out) < depth:
            gains = utility(lat[left], lon[left], region, rtt_model) if len(region.lat) else np.full(len(left), UNMEASURED_UTILITY)
            best = int(np.argmax(gains))
            k = left[best]
            region.add(lat[k], lon[k], rtt[k])
            now = region.size()
            predicted = float(rtt_model(lat[k : k + 1], lon[k : k + 1], region)[0])
            out.append((group["dst"].iloc[0], len(done) + len(out) + 1, group["src"].iloc[k], rtt[k], float(gains[best]), size - now, predicted))
            size, left = now, np.delete(left, best)
        return pd.DataFrame(out, columns=["dst", "k", "src", "rtt", "utility", "actual_util", "predicted_rtt"])

    return spread(rows, "dst").groupBy("dst").applyInPandas(run, TRACE)


def greedy_picks_intended(edges: DataFrame, locations: DataFrame, limit: int, depth: int | None = None, **options) -> DataFrame:
    """Greedy picks with utilities that are taken anew after each measurement; columns of the trace and seq.

    Sequences are computed to a depth, which is doubled for those targets only whose whole prefix
    is within the limit while they have more sources to offer; they go on from where they were.
    """
    sizes = edges.groupBy("dst").agg(F.count("*").alias("n"))
    n_targets = sizes.count()
    depth = depth or max(2, -(-2 * limit // max(1, n_targets)))
    trace = cut(greedy_trace(edges, locations, depth, **options).withColumn("depth", F.lit(depth)))
    while True:
        ordered = cut(greedy_order(trace, limit))
        deepest = ordered.groupBy("dst", "depth").agg(F.max("k").alias("k")).where(F.col("k") == F.col("depth"))
        more = cut(deepest.join(sizes, "dst").where(F.col("n") > F.col("depth")).select("dst"))
        if not more.limit(1).count():
            return ordered.drop("depth")
        depth *= 2
        known = trace.join(more, "dst", "left_semi")
        deeper = greedy_trace(edges.join(more, "dst", "left_semi"), locations, depth, known=known, **options)
        rest = trace.join(more, "dst", "left_anti")
        before, trace = trace, cut(rest.unionByName(known.drop("depth").unionByName(deeper).withColumn("depth", F.lit(depth))))
        for old in (before, ordered, more):
            release(old)


class Strategy(Protocol):
    """Orders measurements: picks (strategy, seq, src, dst, rtt), of which a budget takes a prefix."""

    def __call__(self, edges: DataFrame, locations: DataFrame, limit: int) -> DataFrame: ...


def rtt_rank_picks(edges: DataFrame, limit: int, n: int = CANDIDATES) -> DataFrame:
    """A round robin by RTT rank, without looking at where anything is."""
    return picks(interleave(oracle_candidates(edges, n), limit), "rtt_rank")


#: By name; others can be added.
STRATEGIES: dict[str, Strategy] = {
    "smart_perfect": oracle_picks,
    "random": lambda edges, locations, limit: random_picks(edges, limit),
    "iterative_greedy": lambda edges, locations, limit: greedy_as_written(edges, limit),
    "intended_greedy": lambda edges, locations, limit: picks(greedy_picks_intended(edges, locations, limit), "intended_greedy"),
    "rtt_rank": lambda edges, locations, limit: rtt_rank_picks(edges, limit),
}
#: Those that are compared unless told otherwise.
COMPARED = ("smart_perfect", "random", "iterative_greedy")


def strategy(name: str) -> Strategy:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; one of {sorted(STRATEGIES)}")
    return STRATEGIES[name]


def all_picks(edges: DataFrame, locations: DataFrame, limit: int, names: Iterable[str] = COMPARED) -> DataFrame:
    """The picks of several strategies under each other."""
    return reduce(DataFrame.unionByName, [strategy(name)(edges, locations, limit) for name in names])


def remaining(edges: DataFrame, used: DataFrame) -> DataFrame:
    """Pairs that have not been measured yet."""
    return edges.join(used.select("src", "dst"), ["src", "dst"], "left_anti")
