"""Feasible regions: circles around vantage points, their size, and the best guess inside them.

Sizes and objectives at a given centre are Column expressions.  The minimiser is a bounded
Nelder-Mead (Nelder & Mead 1965) over many problems at once in numpy, behind a pandas function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfell.functions.geo import CENTRE_PULL, EARTH_RADIUS_KM, KM_PER_MS, MAX_REGION_KM, haversine, max_radius_km, penalty

TOLERANCE, MAX_ITERATIONS = 1.0, 200
LOWER, UPPER = np.array([-90.0, -180.0]), np.array([90.0, 180.0])


def distance_km(lat1, lon1, lat2, lon2) -> np.ndarray:
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(x, float)) for x in (lat1, lon1, lat2, lon2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def objective(points: np.ndarray, lat: np.ndarray, lon: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Per problem: squared excess over each radius, a gentle pull inside.  Unused places have radius NaN."""
    d = distance_km(points[:, :1], points[:, 1:], lat, lon)
    cost = np.where(d > radius, (d - radius) ** 2, CENTRE_PULL * d)
    return np.where(np.isnan(radius), 0.0, cost).sum(1)


def minimise(start: np.ndarray, lat: np.ndarray, lon: np.ndarray, radius: np.ndarray, tol: float = TOLERANCE, iterations: int = MAX_ITERATIONS) -> np.ndarray:
    """Nelder-Mead for n problems (start n x 2, constraints n x k); the best point of each."""
    n = len(start)
    value = lambda p, k: objective(p, lat[k], lon[k], radius[k])
    first = np.clip(start, LOWER, UPPER)
    simplex = np.repeat(first[:, None, :], 3, 1)
    for axis in range(2):
        x = simplex[:, axis + 1, axis]
        simplex[:, axis + 1, axis] = np.where(x != 0, 1.05 * x, 0.00025)
    simplex = np.clip(np.where(simplex > UPPER, 2 * UPPER - simplex, simplex), LOWER, UPPER)
    every = np.arange(n)
    f = np.stack([value(simplex[:, j], every) for j in range(3)], 1)

    def ordered(k: np.ndarray) -> None:
        order = np.argsort(f[k], 1, kind="stable")
        f[k] = np.take_along_axis(f[k], order, 1)
        simplex[k] = np.take_along_axis(simplex[k], order[:, :, None], 1)

    ordered(every)
    live = every
    for _ in range(iterations - 1):
        flat = np.abs(simplex[live, 1:] - simplex[live, :1]).max((1, 2)) <= tol
        flat &= np.abs(f[live, 1:] - f[live, :1]).max(1) <= tol
        live = live[~flat]
        if not len(live):
            break
        s, g = simplex[live], f[live]
        mid, worst = s[:, :2].mean(1), s[:, 2]
        step = lambda a: np.clip(mid + a[:, None] * (worst - mid), LOWER, UPPER)
        ones = np.ones(len(live))
        reflected = step(-ones)
        fr = value(reflected, live)
        best, good = fr < g[:, 0], fr < g[:, 1]
        # one more trial: expand after a new best, else contract outside or inside
        trial = step(np.where(best, -2.0, np.where(fr < g[:, 2], -0.5, 0.5)))
        ft = value(trial, live)
        take_trial = np.where(best, ft < fr, np.where(good, False, np.where(fr < g[:, 2], ft <= fr, ft < g[:, 2])))
        take_reflected = ~take_trial & good
        new = np.where(take_trial[:, None], trial, reflected)
        moved = take_trial | take_reflected
        simplex[live[moved], 2] = new[moved]
        f[live[moved], 2] = np.where(take_trial, ft, fr)[moved]
        shrunk = live[~moved]
        if len(shrunk):
            for j in (1, 2):
                simplex[shrunk, j] = np.clip(simplex[shrunk, 0] + 0.5 * (simplex[shrunk, j] - simplex[shrunk, 0]), LOWER, UPPER)
                f[shrunk, j] = value(simplex[shrunk, j], shrunk)
        ordered(live)
    return simplex[:, 0]


class Region:
    """A target's constraints and best guess (used inside group functions; values, never shared)."""

    def __init__(self, guess: tuple[float, float] = (0.0, 0.0)):
        self.guess = np.array(guess, float)
        self.lat, self.lon, self.radius = np.zeros(0), np.zeros(0), np.zeros(0)

    def size(self) -> float:
        return float(self.sizes(self.guess[None, :], self.lat[None, :], self.lon[None, :], self.radius[None, :])[0])

    @staticmethod
    def sizes(guess: np.ndarray, lat: np.ndarray, lon: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """max(0, least distance from each guess to the edge of a circle); the largest region without circles."""
        if not lat.shape[1]:
            return np.full(len(guess), MAX_REGION_KM)
        return np.maximum(0.0, (radius - distance_km(guess[:, :1], guess[:, 1:], lat, lon)).min(1))

    def with_each(self, lat: np.ndarray, lon: np.ndarray, rtt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Guesses and constraints after adding each of these measurements alone."""
        n = len(lat)
        wide = lambda own, new: np.concatenate([np.broadcast_to(own, (n, len(own))), np.asarray(new, float)[:, None]], 1)
        la, lo, ra = wide(self.lat, lat), wide(self.lon, lon), wide(self.radius, np.asarray(rtt) * KM_PER_MS)
        if not len(self.lat):
            return np.stack([lat, lon], 1).astype(float), la, lo, ra
        return minimise(np.repeat(self.guess[None, :], n, 0), la, lo, ra), la, lo, ra

    def add(self, lat: float, lon: float, rtt: float) -> None:
        guess, la, lo, ra = self.with_each(np.array([lat]), np.array([lon]), np.array([rtt]))
        self.guess, self.lat, self.lon, self.radius = guess[0], la[0], lo[0], ra[0]


def constraints(measured: DataFrame, locations: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the constraints of each group as array<struct<src, lat, lon, radius_km>>, sorted by src."""
    at = locations.select(F.col("addr").alias("src"), "lat", "lon")
    circle = F.struct("src", "lat", "lon", max_radius_km(F.col("rtt")).alias("radius_km"))
    return measured.join(at, "src").groupBy(*keys).agg(F.sort_array(F.collect_set(circle)).alias("constraints"))


def exact_mean(column: str, digits: int | None = None) -> Column:
    """The mean of degrees, summed as decimals: a sum of doubles depends on the order of the rows, and with it a mean
    halfway between two rounded values (groups with NaN, infinite or over ten digits before the point keep doubles).
    Digits round the mean while it is a decimal; the double nearest to it may lie on the other side of halfway."""
    exact = F.col(column).try_cast("decimal(30,20)")
    mean, plain = F.avg(exact), F.avg(column)
    if digits is not None:
        mean, plain = F.round(mean, digits), F.round(plain, digits)
    return F.when(F.count(exact) == F.count(column), mean.cast("double")).otherwise(plain)


def seeds(measured: DataFrame, locations: DataFrame, keys: list[str], digits: int | None = None) -> DataFrame:
    """keys, n_vps, seed_lat, seed_lon: the plain mean of the vantage points' positions, rounded if digits are given."""
    at = locations.select(F.col("addr").alias("src"), "lat", "lon")
    return measured.join(at, "src").groupBy(*keys).agg(F.count("*").alias("n_vps"), exact_mean("lat", digits).alias("seed_lat"), exact_mean("lon", digits).alias("seed_lon"))


def at_centre(measured: DataFrame, locations: DataFrame, centres: DataFrame, key: str = "dst") -> DataFrame:
    """key, region_size_km and penalty of its constraints seen from a centre (key, lat, lon)."""
    at = locations.select(F.col("addr").alias("src"), F.col("lat").alias("vp_lat"), F.col("lon").alias("vp_lon"))
    rows = measured.join(at, "src").join(centres, key)
    d, r = haversine(F.col("lat"), F.col("lon"), F.col("vp_lat"), F.col("vp_lon")), max_radius_km(F.col("rtt"))
    return rows.groupBy(key).agg(F.greatest(F.lit(0.0), F.coalesce(F.min(r - d), F.lit(MAX_REGION_KM))).alias("region_size_km"), F.sum(penalty(d, r)).alias("penalty"))


@F.pandas_udf(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
def centroid(circles: pd.Series, seed_lat: pd.Series, seed_lon: pd.Series) -> pd.DataFrame:
    """The estimate for arrays of constraints: their only centre, or the minimum found from the seed."""
    n = len(circles)
    out = np.full((n, 2), np.nan)
    counts = np.array([0 if c is None else len(c) for c in circles], int)
    for k in np.flatnonzero(counts == 1):
        out[k] = circles.iloc[k][0]["lat"], circles.iloc[k][0]["lon"]
    many = np.flatnonzero(counts > 1)
    for part in np.array_split(many[np.argsort(counts[many], kind="stable")], max(1, len(many) // 256)):
        if not len(part):
            continue
        wide = counts[part].max()
        table = np.full((3, len(part), wide), np.nan)
        for row, k in enumerate(part):
            for j, c in enumerate(circles.iloc[k]):
                table[:, row, j] = c["lat"], c["lon"], c["radius_km"]
        lat, lon = (np.nan_to_num(x) for x in table[:2])
        out[part] = minimise(np.stack([seed_lat.iloc[part], seed_lon.iloc[part]], 1), lat, lon, table[2])
    return pd.DataFrame({"lat": out[:, 0], "lon": out[:, 1]})
