"""From picks to estimated positions to error against budget."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfell.checkpoints import cut
from tarnfell.functions.geo import haversine
from tarnfell.sources import landing

from .region import centroid, constraints, seeds
from .selection import COMPARED, strategy

BUDGETS = range(100, 2501, 100)
MISSING_KM = 10_000.0
MODES = ("nearest_neighbor", "great_circle_overlap_centroid")


def budgets_frame(spark: SparkSession, budgets=BUDGETS) -> DataFrame:
    return spark.createDataFrame([(int(b),) for b in budgets], "budget int")


def within_budgets(picks: DataFrame, budgets: DataFrame) -> DataFrame:
    """Each pick once per budget that reaches it (budgets is a short list, so it is broadcast)."""
    return picks.join(F.broadcast(budgets), F.col("seq") <= F.col("budget"))


def nearest(measured: DataFrame, locations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, src, lat, lon: the vantage point with the least RTT of all, if it has a location.

    The least is taken first, so a nearest one without location gives no estimate.
    """
    best = measured.groupBy(*keys).agg(F.min_by(F.struct("src", "rtt"), F.struct("rtt", "src")).alias("b")).select(*keys, "b.src")
    return best.join(locations.select(F.col("addr").alias("src"), "lat", "lon"), "src").select(*keys, "src", "lat", "lon")


def single(measured: DataFrame, locations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lat, lon where exactly one vantage point has a location: its position."""
    only = seeds(measured, locations, keys)
    return only.where("n_vps = 1").select(*keys, F.col("seed_lat").alias("lat"), F.col("seed_lon").alias("lon"))


def overlap_centroid(measured: DataFrame, locations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_vps, lat, lon: the point that fits all circles best, found from the mean of their centres."""
    rows = constraints(measured, locations, keys)
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)  # few bytes, much to compute
    mean = lambda field: F.aggregate("constraints", F.lit(0.0), lambda s, c: s + c[field]) / F.size("constraints")
    rows = rows.withColumns({"seed_lat": mean("lat"), "seed_lon": mean("lon")})
    return rows.select(*keys, F.size("constraints").alias("n_vps"), centroid("constraints", "seed_lat", "seed_lon").alias("p")).select(*keys, "n_vps", "p.lat", "p.lon")


class Converter(Protocol):
    """From measurements (keys, src, rtt) to positions (keys, lat, lon); no row where it has none."""

    def __call__(self, measured: DataFrame, locations: DataFrame, keys: list[str]) -> DataFrame: ...


#: By mode; others can be added.
CONVERTERS: dict[str, Converter] = dict(zip(MODES, (nearest, overlap_centroid)))


def estimate(measured: DataFrame, locations: DataFrame, keys: list[str], mode: str = MODES[1]) -> DataFrame:
    if mode not in CONVERTERS:
        raise ValueError(f"unknown mode {mode!r}; one of {sorted(CONVERTERS)}")
    return CONVERTERS[mode](measured, locations, keys).select(*keys, "lat", "lon")


def estimate_asof(picks: DataFrame, budgets: DataFrame) -> DataFrame:
    """strategy, budget, dst, src, rtt: the nearest vantage point as of the last pick within each budget.

    A running minimum per target is taken once for all budgets, then looked up by budget.
    """
    so_far = Window.partitionBy("strategy", "dst").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    running = picks.withColumn("best", F.min(F.struct("rtt", "src")).over(so_far))
    return within_budgets(running, budgets).groupBy("strategy", "budget", "dst").agg(F.max_by("best", "seq").alias("b")).select("strategy", "budget", "dst", "b.src", "b.rtt")


def budget_curve(picks: DataFrame, edges: DataFrame, locations: DataFrame, budgets: DataFrame, mode: str = MODES[0]) -> DataFrame:
    """strategy, budget, targets_found, n_targets, avg_error_km over all targets of the mesh.

    Targets that have a true position but no estimate count MISSING_KM; those without a true
    position count as found if they are estimated, and are left out of the mean.
    """
    found = estimate(within_budgets(picks, budgets), locations, ["strategy", "budget", "dst"], mode)
    truth = locations.select(F.col("addr").alias("dst"), F.col("lat").alias("true_lat"), F.col("lon").alias("true_lon"))
    goals = edges.select("dst").distinct().join(truth, "dst", "left")
    every = picks.select("strategy").distinct().crossJoin(F.broadcast(budgets)).crossJoin(goals)  # strategies x budgets x targets: the result's own grain
    error = F.when(F.col("true_lat").isNotNull(), F.coalesce(haversine(F.col("lat"), F.col("lon"), F.col("true_lat"), F.col("true_lon")), F.lit(MISSING_KM)))
    rows = every.join(found, ["strategy", "budget", "dst"], "left").withColumn("error_km", error)
    return rows.groupBy("strategy", "budget").agg(F.count("lat").alias("targets_found"), F.count("*").alias("n_targets"), F.avg("error_km").alias("avg_error_km"))


def compare(edges: DataFrame, locations: DataFrame, names: Iterable[str] = COMPARED, budgets=BUDGETS, mode: str = MODES[1], cache: str | None = None) -> DataFrame:
    """The budget curves of several strategies, by their own picks up to the largest budget.

    With a folder as cache, each strategy's curve is kept there under its name, the mode, the budgets
    and a fingerprint of edges and locations, and read back where nothing of that has changed.
    """
    spark, budgets = edges.sparkSession, sorted(budgets)

    def curve(name: str) -> DataFrame:
        chosen = cut(strategy(name)(edges, locations, budgets[-1]))
        return budget_curve(chosen, edges, locations, budgets_frame(spark, budgets), mode)

    if cache is None:
        return reduce(DataFrame.unionByName, [curve(name) for name in names])
    kept = [landing.cached(spark, cache, f"curve-{name}", lambda name=name: curve(name), (edges, locations), strategy=name, mode=mode, budgets=budgets) for name in names]
    return reduce(DataFrame.unionByName, kept)


def utility_snapshot(trace: DataFrame, window: int = 500) -> DataFrame:
    """Per ping_num of the trace: averages over the last ``window`` pings, and the one furthest off."""
    last = Window.orderBy("ping_num").rowsBetween(-(window - 1), 0)  # the trace is as long as the budget
    worst = F.max_by(F.struct("ping_num", "error"), F.struct(F.abs("error"), -F.col("ping_num"))).over(last)
    rows = trace.select("ping_num", F.avg("expected_util").over(last).alias("avg_expected_km"), F.avg("actual_util").over(last).alias("avg_actual_km"), worst.alias("w"))
    return rows.select("ping_num", "avg_expected_km", "avg_actual_km", F.col("w.ping_num").alias("worst_ping"), F.col("w.error").alias("worst_error_km"))
