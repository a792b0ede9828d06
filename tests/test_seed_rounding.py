"""The seeds of the query are rounded as decimals, not from the nearest doubles."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from tarnfell.plans import catalog


def test_means_just_short_of_halfway_round_down(spark):
    # the mean 67.330848591499998 is nearest to the double 67.3308485915, which would go up
    at = spark.createDataFrame([("a", 71.26, -71.26), ("b", 63.401697182999996, -63.401697182999996)], "addr string, lat double, lon double")
    edges = at.select(F.col("addr").alias("src"), F.lit("t").alias("dst"))
    (r,) = catalog.centroid_seed(SimpleNamespace(edges=edges, locations=at)).collect()
    assert (r["n_vps"], r["seed_lat"], r["seed_lon"]) == (2, 67.330848591, -67.330848591)
