"""From a landing folder to the mesh, over partitioned layers."""

from __future__ import annotations

import bz2
import json
import os

import pytest
from pyspark.sql import functions as F

from tarnfell.operators import charts, evaluate, latency, selection
from tarnfell.plans.catalog import Data
from tarnfell.sources import archive, ingest, landing

TABLES = "/root/testdata/sf0.001"


def probe(k, lat, lon, address=None):
    return {"id": k, "address_v4": address or f"10.0.{k}.1", "latitude": lat, "longitude": lon}


def ping(src, dst, rtt):
    return json.dumps({"prb_id": src, "src_addr": f"10.9.{src}.1", "dst_addr": f"10.0.{dst}.7", "min": rtt})


def dumps():
    """File name -> lines, of two days of probes and three hours of pings (probe 3 gets its address on the second day)."""
    return {
        "20260223.json.bz2": [json.dumps([probe(1, 0.0, 0.0), probe(2, 0.0, 5.0), {"id": 3}])],
        "20260224.json.bz2": [json.dumps({"objects": [probe(2, 0.0, 6.0), probe(3, 4.0, 0.0)]})],
        "ping-2026-02-24T0000.bz2": [ping(1, 2, 20.0), ping(2, 1, 22.0), ping(1, 2, 1.0), "broken"],
        "ping-2026-02-24T0100.bz2": [ping(1, 2, 18.0), ping(3, 1, 30.0), ping(1, 3, -1)],
        "ping-2026-02-24T0200.bz2": [ping(3, 1, 12.0), ping(2, 3, 40.0)],
    }


def land(folder, names):
    os.makedirs(folder, exist_ok=True)
    for name in names:
        with open(f"{folder}/{name}", "wb") as out:
            out.write(bz2.compress("\n".join(dumps()[name]).encode()))


def test_landing_to_mesh(spark, tmp_path):
    at = archive.Layers(str(tmp_path / "landed"), str(tmp_path / "parsed"))
    names = list(dumps())
    land(at.landed, names[:4])
    assert archive.run(spark, at, "2026-02-23", "2026-02-24") == (2, 2)
    assert archive.run(spark, at, "2026-02-23", "2026-02-24") == (0, 0)  # nothing is parsed twice
    land(at.landed, names[4:])
    assert archive.run(spark, at, "2026-02-23", "2026-02-24") == (0, 1)
    assert sorted((str(r["dump_hour"])[11:13], r["src"], r["dst"], r["rtts"]) for r in archive.hourly(spark, at).collect()) == [
        ("00", "10.0.1.0", "10.0.2.0", [1.0, 20.0]), ("00", "10.0.2.0", "10.0.1.0", [22.0]),
        ("01", "10.0.1.0", "10.0.2.0", [18.0]), ("01", "10.0.3.0", "10.0.1.0", [30.0]),
        ("02", "10.0.2.0", "10.0.3.0", [40.0]), ("02", "10.0.3.0", "10.0.1.0", [12.0]),
    ]
    edges, locations = archive.measured(spark, at, None)
    assert {(r["src"], r["dst"]): r["rtt"] for r in edges.collect()} == {("10.0.1.0", "10.0.2.0"): 18.0, ("10.0.2.0", "10.0.1.0"): 22.0, ("10.0.3.0", "10.0.1.0"): 12.0, ("10.0.2.0", "10.0.3.0"): 40.0}
    assert {r["addr"]: r["lon"] for r in locations.collect()} == {"10.0.1.0": 0.0, "10.0.2.0": 6.0, "10.0.3.0": 0.0}
    early, _ = archive.measured(spark, at, 1)
    assert {(r["src"], r["dst"]): r["rtt"] for r in early.collect()} == {("10.0.1.0", "10.0.2.0"): 20.0, ("10.0.2.0", "10.0.1.0"): 22.0}
    for hours, n_edges, n_nodes in ((1, 2, 2), (None, 4, 3)):  # the ratio is relaxed to 0.441 where the graph is sparser
        kept, where = archive.load_mesh(spark, at, hours, ratio=0.9, min_nodes=2, decay=0.7)
        assert kept.count() == n_edges and where.count() == n_nodes


def test_download_then_parse(spark, tmp_path):
    at, asked = archive.Layers(str(tmp_path / "landed"), str(tmp_path / "parsed")), []

    def fetch(url, to):
        asked.append((url, to))
        name = os.path.basename(to)
        if name in dumps():
            land(at.landed, [name])
        return name in dumps()

    assert archive.run(spark, at, "2026-02-24", "2026-02-24", ("http://p", "http://m"), fetch=fetch) == (1, 3)
    assert len(asked) == 25 and ("http://m/2026-02-24/ping-2026-02-24T0100.bz2", f"{at.landed}/ping-2026-02-24T0100.bz2") in asked
    with pytest.raises(Exception):
        archive.run(spark, archive.Layers(str(tmp_path / "nowhere"), at.parsed), "2026-02-24", "2026-02-24")


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")
def test_first_hours_prune_partitions(spark):
    layer = Data(spark, TABLES).hourly_layer
    early = ingest.first_hours(layer, 3)
    plan = early._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "hr#" in filters and " IN " in filters
    assert {r["hr"] for r in early.select("hr").distinct().collect()} == {0, 1, 2}
    scan = early.select("src").withColumn("file", F.input_file_name())
    read = {r["file"].split("hr=")[1].split("/")[0] for r in scan.select("file").distinct().collect()}
    assert read == {"0", "1", "2"} and layer.select("hr").distinct().count() == 24


def test_ping_lines_in_one_parse(spark):
    lines = ['{"prb_id":1,"dst_addr":"a","min":1e-3,"more":{"min":null}}', '{"prb_id":1,"src_addr":null,"dst_addr":7,"min":null}', '{"prb_id":1,"min":"1.5"}', '{"prb_id":1,"min":{"x":1}}', '{"prb_id":1.5,"min":2}', '{"prb_id":2,"min":12345678901234567890}', "{", "null", '"x"', "7"]
    rows = ingest.parse_pings(spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "k int, value string")).orderBy("k").collect()
    assert [r["corrupt"] for r in rows] == [False, False, True, True, True, False, True, True, True, True]
    assert [tuple(rows[k][c] for c in ("prb_id", "src_addr", "dst_addr", "rtt")) for k in (0, 1, 5)] == [(1, "", "a", 0.001), (1, None, "7", None), (2, "", "", 12345678901234567890.0)]
    plan = ingest.parse_pings(spark.createDataFrame([("{}",)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan


def test_summary_maps(spark):
    nested = spark.createDataFrame([({"s": {"d": [1.0, 2.0], "e": []}, "t": {"d": [3.0]}},)], "summary map<string,map<string,array<double>>>")
    want = [("s", "d", 1.0), ("s", "d", 2.0), ("t", "d", 3.0)]
    assert sorted(map(tuple, latency.explode_summary(nested).collect())) == want
    by_src = spark.createDataFrame([("s", {"d": [1.0, 2.0]}), ("t", {"d": [3.0]})], "src string, dsts map<string,array<double>>")
    assert sorted(map(tuple, latency.explode_sources(by_src).collect())) == want


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_percentile_by_ranks(spark, n):
    rows = spark.range(n).select((F.col("id") * 37 % 101).cast("double").alias("x")).unionByName(spark.createDataFrame([(None,)], "x double"))
    for share in (0.0, 0.25, 0.99, 1.0):
        got, want = charts.percentile(rows, "x", share).first()["p"], rows.agg(F.percentile("x", share)).first()[0]
        assert got == want or got == pytest.approx(want)


def test_picks_as_nested_maps(spark):
    df = spark.createDataFrame([(f"s{a}", f"d{b}", a + b / 10) for a in range(3) for b in range(4)], "src string, dst string, rtt double")
    maps = selection.random_picks(df, 9).groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", F.array("rtt").alias("rtts")))).alias("dsts"))
    picked = {(r["src"], r["dst"]): r["rtt"] for r in selection.random_picks(df, 9).collect()}
    assert {(r["src"], d): x for r in maps.collect() for d, (x,) in r["dsts"].items()} == picked and len(picked) == 9


def test_trace_window_binds(spark):
    trace = [(k, float(k % 17), float(k % 13)) for k in range(1, 1301)]
    rows = spark.createDataFrame([(k, e, a, e - a) for k, e, a in trace], "ping_num long, expected_util double, actual_util double, error double")
    for r in evaluate.utility_snapshot(rows).collect():
        last = trace[max(0, r["ping_num"] - 500) : r["ping_num"]]
        worst = max(last, key=lambda t: (abs(t[1] - t[2]), -t[0]))
        assert (r["avg_expected_km"], r["avg_actual_km"]) == pytest.approx((sum(e for _, e, _ in last) / len(last), sum(a for _, _, a in last) / len(last)))
        assert (r["worst_ping"], r["worst_error_km"]) == (worst[0], worst[1] - worst[2])


def test_strategies_and_cached_curves(spark, tmp_path, monkeypatch):
    locations = spark.createDataFrame([(f"n{k}", 10.0 * k, 5.0 * k) for k in range(6)], "addr string, lat double, lon double")
    df = spark.createDataFrame([(f"n{a}", f"n{b}", 5.0 + 3 * abs(a - b)) for a in range(6) for b in range(6) if a != b], "src string, dst string, rtt double")
    for name in selection.STRATEGIES:
        rows = selection.strategy(name)(df, locations, 7)
        assert rows.columns == ["strategy", "seq", "src", "dst", "rtt"] and [r["seq"] for r in rows.orderBy("seq").collect()] == list(range(1, 8))
    with pytest.raises(ValueError):
        selection.strategy("guess")
    calls = []
    monkeypatch.setitem(selection.STRATEGIES, "own", lambda e, at, limit: calls.append(limit) or selection.random_picks(e, limit, 7).withColumn("strategy", F.lit("own")))
    monkeypatch.setitem(evaluate.CONVERTERS, "first", lambda m, at, keys: m.groupBy(*keys).agg(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")))
    run = lambda e: evaluate.compare(e, locations, ("own", "random"), (5, 10), "first", str(tmp_path))
    want = sorted(map(tuple, run(df).collect()))
    assert sorted(map(tuple, run(df.repartition(3)).collect())) == want and calls == [10] and len(want) == 4
    run(df.withColumn("rtt", F.col("rtt") + 1)).count()  # other data, other results
    assert len(calls) == 2
    assert landing.fingerprint(df) == landing.fingerprint(df.repartition(2)) != landing.fingerprint(df.where("rtt > 9"))
