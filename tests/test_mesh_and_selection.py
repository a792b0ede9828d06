from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tarnfell.operators import charts, evaluate, mesh, selection

EDGES = "src string, dst string, rtt double"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, float(k)) for k, (a, b) in enumerate(pairs, 1)], EDGES)


def survivors(spark, pairs, ratio):
    pool, rounds = mesh.prune(edges(spark, pairs), ratio)
    return sorted(r["addr"] for r in pool.collect()), rounds


def test_prune_in_rounds(spark):
    both = lambda a, b: [(a, b), (b, a)]
    pairs = [(a, b) for a in "abcdef" for b in "abcdef" if a != b]
    pairs += [p for x in "abchi" for p in both("g", x)]
    assert survivors(spark, pairs, 0.6) == (list("abcdef"), 2)


def test_prune_edge_cases(spark):
    assert survivors(spark, [], 0.8) == ([], 0)
    assert survivors(spark, [("a", "a")], 0.8) == (["a"], 0)
    full = [(a, b) for a in "abc" for b in "abc" if a != b] + [("x", b) for b in "abc"]
    assert survivors(spark, full, 0.5)[0] == ["a", "b", "c"]  # full out-degree does not make up for no in-degree


def test_relaxation_ends(spark):
    pairs = [(a, b) for a in "abcd" for b in "abcd" if a < b]
    found = mesh.adaptive(edges(spark, pairs), min_nodes=500)
    assert not found.enough and found.relaxations == 0
    found = mesh.adaptive(edges(spark, pairs), min_nodes=4, min_ratio=0.3)
    assert not found.enough
    ring = [(a, b) for a in range(6) for b in range(6) if (a - b) % 6 in (1, 2, 5)]
    found = mesh.adaptive(edges(spark, [(f"n{a}", f"n{b}") for a, b in ring]), min_nodes=6)
    assert found.enough and found.relaxations == 3 and found.nodes.count() == 6


def test_self_pairs_stay_in_the_mesh(spark):
    df = edges(spark, [("a", "b"), ("b", "a"), ("a", "a"), ("a", "z")])
    pool = spark.createDataFrame([("a",), ("b",)], "addr string")
    assert {(r["src"], r["dst"]) for r in mesh.mesh_edges(df, pool).collect()} == {("a", "b"), ("b", "a"), ("a", "a")}
    assert mesh.density(df, pool).first()["density"] == 1.5
    assert {r["addr"]: (r["out_degree"], r["in_degree"]) for r in mesh.degrees(df, pool).collect()} == {"a": (1, 1), "b": (1, 1)}


@pytest.mark.parametrize("pairs, want", [("px qx py ry", "px py qx ry"), ("px qx sx py ry", "px py qx sx ry")])
def test_greedy_as_written(spark, pairs, want):
    rows = selection.greedy_as_written(edges(spark, [tuple(p) for p in pairs.split()]), 10).orderBy("seq").collect()
    assert " ".join(r["src"] + r["dst"] for r in rows) == want


def test_greedy_order_golden_and_naive(spark):
    def ordered(utilities, limit):
        rows = [(d, k, float(u)) for d, us in utilities.items() for k, u in enumerate(us, 1)]
        return [(r["dst"], r["k"]) for r in selection.greedy_order(spark.createDataFrame(rows, "dst string, k int, utility double"), limit).orderBy("seq").collect()]

    assert ordered({"x": [5, 1, 4], "y": [3, 3]}, 9) == [("x", 1), ("y", 1), ("y", 2), ("x", 2), ("x", 3)]
    rng = random.Random(3)
    for _ in range(4):
        us = {d: [rng.randrange(4) for _ in range(rng.randrange(1, 7))] for d in "abcd"}
        at, want = dict.fromkeys(us, 0), []
        while len(want) < 9 and any(at[d] < len(us[d]) for d in us):
            d = max((d for d in sorted(us) if at[d] < len(us[d])), key=lambda d: us[d][at[d]])
            at[d] += 1
            want.append((d, at[d]))
        assert ordered(us, 9) == want


def test_interleave_and_depth(spark):
    ranked = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", 2), ("y", 3)], "dst string, rank int")
    assert [(r["dst"], r["rank"]) for r in selection.interleave(ranked, 9).orderBy("seq").collect()] == [("x", 1), ("y", 1), ("x", 2), ("y", 2), ("y", 3)]
    counts = spark.createDataFrame([("x", 2), ("y", 3)], "dst string, n long")
    assert [selection.depth_for(counts, b) for b in (1, 2, 3, 4, 5, 99)] == [1, 1, 2, 2, 3, 3]


def test_random_order_is_seeded_and_a_prefix(spark):
    df = edges(spark, [(f"s{a}", f"d{b}") for a in range(6) for b in range(5)])
    few, many = ([(r["src"], r["dst"]) for r in selection.random_picks(df, n).orderBy("seq").collect()] for n in (7, 99))
    assert many[:7] == few and len(set(many)) == 30
    one = spark.createDataFrame([("10.0.0.0", "10.0.1.0")], "src string, dst string")
    assert one.select(selection.random_order().alias("k")).first()["k"] == "657924743e567586a699b9afb16dee0c"


def _world(spark, n=7, seed=1):
    rng = random.Random(seed)
    at = [(f"n{k}", rng.uniform(-50, 50), rng.uniform(-150, 150)) for k in range(n)]
    locations = spark.createDataFrame(at, "addr string, lat double, lon double")
    pairs = [(a[0], b[0], 5.0 + rng.random() * 100) for a in at for b in at if rng.random() < 0.8]
    return locations, spark.createDataFrame(pairs, EDGES)


def test_oracle_first_pick_is_the_nearest_candidate(spark):
    locations, df = _world(spark)
    first = {r["dst"]: r["src"] for r in selection.oracle_first(df, locations).collect()}
    picks = selection.oracle_picks(df, locations, 1000).orderBy("seq").collect()
    by: dict[str, list[str]] = {}
    for r in picks:
        by.setdefault(r["dst"], []).append(r["src"])
    assert {d: s[0] for d, s in by.items()} == first
    assert all(len(set(s)) == len(s) for s in by.values()) and len(picks) == df.count()
    few = [(r["src"], r["dst"]) for r in selection.oracle_picks(df, locations, 9).orderBy("seq").collect()]
    assert few == [(r["src"], r["dst"]) for r in picks[:9]]  # shallower, same prefix


def test_intended_greedy_is_the_sequential_one(spark):
    locations, df = _world(spark, 5)
    whole = selection.greedy_trace(df, locations, 99).toPandas()
    seqs = {d: g.sort_values("k") for d, g in whole.groupby("dst")}
    at, want = dict.fromkeys(seqs, 0), []
    while len(want) < 11:
        d = max((d for d in sorted(seqs) if at[d] < len(seqs[d])), key=lambda d: seqs[d]["utility"].iloc[at[d]])
        want.append((seqs[d]["src"].iloc[at[d]], d))
        at[d] += 1
    got = selection.greedy_picks_intended(df, locations, 11).orderBy("seq").collect()
    assert [(r["src"], r["dst"]) for r in got] == want


def test_own_utility_functions(spark):
    locations, df = _world(spark, 4)
    last = lambda lat, lon, region, model: lat  # noqa: E731  the northernmost comes next
    rows = selection.greedy_trace(df, locations, 3, utility=last).toPandas()
    north = {r["addr"]: r["lat"] for r in locations.collect()}
    for d, g in rows[rows["k"] > 1].groupby("dst"):
        assert list(g.sort_values("k")["src"].map(north)) == sorted(g["src"].map(north), reverse=True)


def test_curve(spark):
    locations = spark.createDataFrame([("p", 0.0, 0.0), ("x", 0.0, 0.0)], "addr string, lat double, lon double").unionByName(spark.createDataFrame([("y", 5.0, 5.0)], "addr string, lat double, lon double"))
    df = spark.createDataFrame([("p", "x", 1.0), ("gone", "y", 1.0), ("p", "untrue", 1.0)], EDGES)
    picks = spark.createDataFrame([("s", 1, "p", "x", 1.0), ("s", 2, "gone", "y", 1.0), ("s", 3, "p", "untrue", 1.0)], "strategy string, seq long, src string, dst string, rtt double")
    rows = evaluate.budget_curve(picks, df, locations, evaluate.budgets_frame(spark, [1, 3, 99])).orderBy("budget").collect()
    assert [(r["targets_found"], r["n_targets"], r["avg_error_km"]) for r in rows] == [(1, 3, 5000.0), (2, 3, 5000.0), (2, 3, 5000.0)]


def test_remaining_and_charts(spark):
    df = edges(spark, [("a", "x"), ("a", "y"), ("b", "x")])
    assert selection.remaining(df, df.limit(0)).count() == 3
    rows = charts.degree_cdf(df).where("direction = 'out'").orderBy("degree", "p").collect()
    assert [(r["degree"], r["p"]) for r in rows] == [(1, 0.5), (2, 1.0)]
    points = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 10.0)], "dist_km double, min_rtt double")
    assert charts.latency_summary(points).first()["p99_rtt"] == pytest.approx(9.84)
    assert [tuple(r) for r in charts.sol_line(points).collect()] == [(0.0, 0.0), (3.0, 0.03)]
    trace = spark.createDataFrame([(k, 10.0, float(k)) for k in range(1, 5)], "ping_num long, expected_util double, actual_util double").withColumn("error", F.col("expected_util") - F.col("actual_util"))
    last = evaluate.utility_snapshot(trace, 2).orderBy("ping_num").collect()[-1]
    assert (last["avg_actual_km"], last["worst_ping"], last["worst_error_km"]) == (3.5, 3, 7.0)
