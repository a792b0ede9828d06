"""The registered queries take the whole of their input, beyond the 200 suppliers of the SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarnfell.plans import catalog


@pytest.fixture(scope="module")
def many_suppliers(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("many"))
    spark.range(250).select(F.col("id").alias("s_suppkey")).write.parquet(f"{path}/supplier.parquet")
    i = F.col("id")
    spark.range(1000).select(
        i.alias("l_orderkey"), ((i * 7 + F.floor(i / 250)) % 5000).alias("l_partkey"), (i % 250).alias("l_suppkey"), (i % 6 + 1).cast("int").alias("l_linenumber"),
        (i % 50 + 1).cast("double").alias("l_quantity"), F.lit(0.05).alias("l_discount"), F.lit(0.0).alias("l_tax"),
    ).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_every_supplier_is_a_node(spark, many_suppliers):
    d = catalog.Data(spark, many_suppliers)
    assert {r["prb_id"] for r in d.probes.collect()} == set(range(250))
    tier = lambda k: k * 7 % 10
    ends = [(i % 250, (i * 7 + i // 250) % 5000 % 250) for i in range(1000)]
    want = sorted(s for s, t in ends if s == t or (s * 31 + t * 17) % 100 < 25 + 12 * min(tier(s), tier(t)))
    assert sorted(r["prb_id"] for r in d.pings.collect()) == want and max(want) > 200


def test_centroid_curve_has_the_strategies_of_the_reference(spark, many_suppliers):
    rows = catalog.queries()["budget_curve_centroid"](spark, many_suppliers).collect()
    assert {r["strategy"] for r in rows} == {"smart_perfect", "random", "iterative_greedy"}
    assert {r["budget"] for r in rows} == set(range(100, 2501, 100)) and len(rows) == 75


def test_orders_go_on_to_the_last_budget(spark, many_suppliers):
    n = min(catalog.MAX_BUDGET, catalog.Data(spark, many_suppliers).edges.count())
    for name in ("oracle_picks", "greedy_picks_intended"):
        assert catalog.queries()[name](spark, many_suppliers).count() == n > 400
