from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnfell.functions import geo
from tarnfell.operators import evaluate, region

A, B, C = (52.37, 4.90), (48.86, 2.35), (50.11, 8.68)


def test_haversine_golden(spark):
    pairs = [(*A, *B, 429.699746), (*A, *C, 363.772399), (*B, *C, 477.748366), (0.0, 179.5, 0.0, -179.5, 111.194927), (0.0, 0.0, 0.0, 180.0, 20015.086796), (*A, *A, 0.0)]
    rows = spark.createDataFrame(pairs, "a double, b double, c double, d double, want double")
    for r in rows.withColumn("got", geo.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect():
        assert r["got"] == pytest.approx(r["want"], abs=1e-6)
        assert region.distance_km(r["a"], r["b"], r["c"], r["d"]) == pytest.approx(r["want"], abs=1e-6)


def test_slash24_and_labels(spark):
    rows = spark.createDataFrame([("1.2.3.4",), ("10.0",), (None,)], "a string").select(geo.slash24(F.col("a")).alias("s"))
    assert [r["s"] for r in rows.collect()] == ["1.2.3.0", "10.0.0", None]
    assert spark.createDataFrame([("smart_Perfect",)], "a string").select(geo.capitalised(F.col("a")).alias("x")).first()["x"] == "Smart_perfect"


LOCATIONS = [("a", *A), ("b", *B), ("c", *C)]


def _at_seed(spark, rtts):
    at = spark.createDataFrame(LOCATIONS, "addr string, lat double, lon double")
    measured = spark.createDataFrame([(s, "t", r) for s, r in zip("abc", rtts)], "src string, dst string, rtt double")
    seed = region.seeds(measured, at, ["dst"])
    s = seed.first()
    assert (s["seed_lat"], s["seed_lon"]) == pytest.approx((50.446666666666665, 5.31))
    return region.at_centre(measured, at, seed.select("dst", F.col("seed_lat").alias("lat"), F.col("seed_lon").alias("lon"))).first()


def test_size_and_objective_at_seed(spark):
    r = _at_seed(spark, [9.0, 7.0, 6.0])
    assert (r["region_size_km"], r["penalty"]) == pytest.approx((357.641095, 0.734714), abs=1e-6)
    r = _at_seed(spark, [2.0, 7.0, 6.0])
    assert (r["region_size_km"], r["penalty"]) == pytest.approx((0.0, 248.463867), abs=1e-6)


def test_region_of_none_and_one():
    r = region.Region()
    assert r.size() == 20037.0
    r.add(*A, 9.0)
    assert tuple(r.guess) == A and r.size() == pytest.approx(900.0)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(-80, 80), st.floats(-170, 170), st.floats(1, 60)), min_size=2, max_size=6), st.tuples(st.floats(-80, 80), st.floats(-170, 170)))
def test_minimiser_never_ends_above_its_start(circles, start):
    lat, lon, rtt = (np.array([x]) for x in zip(*circles))
    first = np.array([start])
    found = region.minimise(first, lat, lon, rtt * 100)
    assert region.objective(found, lat, lon, rtt * 100)[0] <= region.objective(first, lat, lon, rtt * 100)[0] + 1e-9
    assert (np.abs(found[0]) <= [90, 180]).all()


def test_minimiser_converges_with_a_small_tolerance():
    lat, lon = np.array([[A[0], B[0], C[0]]]), np.array([[A[1], B[1], C[1]]])
    radius = np.array([[200.0, 250.0, 280.0]])
    found = region.minimise(np.array([[50.4, 5.3]]), lat, lon, radius, tol=1e-9, iterations=2000)
    grid = np.stack(np.meshgrid(np.linspace(48, 53, 201), np.linspace(2, 9, 281)), -1).reshape(-1, 2)
    best = min(region.objective(grid, *(np.repeat(x, len(grid), 0) for x in (lat, lon, radius))))
    assert region.objective(found, lat, lon, radius)[0] <= best + 1e-6


def test_estimates(spark):
    at = spark.createDataFrame([*LOCATIONS], "addr string, lat double, lon double")
    measured = spark.createDataFrame([("a", "one", 3.0), ("nowhere", "two", 1.0), ("b", "two", 5.0), ("a", "three", 9.0), ("b", "three", 7.0), ("c", "three", 6.0)], "src string, dst string, rtt double")
    nn = {r["dst"]: r["src"] for r in evaluate.nearest(measured, at, ["dst"]).collect()}
    assert nn == {"one": "a", "three": "c"}  # the nearest of "two" has no location: no estimate
    made = {r["dst"]: (r["lat"], r["lon"]) for r in evaluate.estimate(measured, at, ["dst"]).collect()}
    assert made["one"] == A and made["two"] == B
    circles = np.array([[x] for x in zip(*[(*A, 900.0), (*B, 700.0), (*C, 600.0)])])
    seed = np.array([[50.446666666666665, 5.31]])
    assert region.objective(np.array([made["three"]]), *circles)[0] <= region.objective(seed, *circles)[0]
    with pytest.raises(ValueError):
        evaluate.estimate(measured, at, ["dst"], "else")


def test_seeds_are_exact_means_in_any_order(spark):
    cents = [k * 3701 % 13000 - 6000 for k in range(256)]
    cents[-1] += sum(cents) % 2 == 0  # an odd sum: the mean lies halfway between two ninth decimals
    want = float((Decimal(sum(cents)) / 25600).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    for order in (cents, cents[::-1], sorted(cents), sorted(cents, key=abs), sorted(cents, key=lambda c: c * 7919 % 9973)):
        at = spark.createDataFrame([(str(i), c / 100, -c / 100) for i, c in enumerate(order)], "addr string, lat double, lon double").coalesce(1)
        seen = at.select(F.col("addr").alias("src"), F.lit("t").alias("dst"))
        (r,) = region.seeds(seen, at, ["dst"]).withColumns({"la": F.round("seed_lat", 9), "lo": F.round("seed_lon", 9)}).collect()
        assert (r["n_vps"], r["seed_lat"], r["seed_lon"], r["la"], r["lo"]) == (256, sum(cents) / 25600, -sum(cents) / 25600, want, -want)


def test_seeds_of_positions_that_are_no_numbers(spark):
    at = spark.createDataFrame([("a", 1.5, 2.0), ("b", float("nan"), 4.0), ("c", float("inf"), 6.0)], "addr string, lat double, lon double")
    seen = spark.createDataFrame([("a", "nan"), ("b", "nan"), ("a", "inf"), ("c", "inf"), ("a", "one")], "src string, dst string")
    made = {r["dst"]: (r["seed_lat"], r["seed_lon"]) for r in region.seeds(seen, at, ["dst"]).collect()}
    assert math.isnan(made["nan"][0]) and made["nan"][1] == 3.0 and made["inf"] == (math.inf, 4.0) and made["one"] == (1.5, 2.0)
