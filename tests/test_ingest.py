from __future__ import annotations

import bz2
import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from tarnfell.operators.latency import min_rtt_edges, plausible_lists
from tarnfell.sources import ingest, landing
from tarnfell.streaming import hourly

PROBES = [(1, "1.2.3.4"), (2, None)]


@pytest.fixture()
def pings(spark, tmp_path):
    ok = {"prb_id": 1, "src_addr": "10.0.0.1", "dst_addr": "5.6.7.8", "min": 1.5}
    without = lambda k: {a: b for a, b in ok.items() if a != k}
    lines = [json.dumps(x) for x in (ok, ok | {"min": -1}, without("min"), ok | {"dst_addr": "2001:db8::1"}, ok | {"prb_id": 2}, ok | {"prb_id": 99}, without("src_addr") | {"min": 2.5}, ok | {"src_addr": None}, ok | {"min": None}, ok | {"min": -5}, ok | {"prb_id": "x"})]
    lines += ["not json", "", "[1, 2]"]
    (tmp_path / "ping-2026-02-24T0700.bz2").write_bytes(bz2.compress("\n".join(lines).encode()))
    return ingest.read_pings(spark, str(tmp_path))


def test_ping_ingest(spark, pings):
    probes = spark.createDataFrame(PROBES, "prb_id long, address_v4 string")
    rows = ingest.to_subnets(ingest.usable(pings.where(~F.col("corrupt"))), probes).orderBy("rtt").collect()
    assert [(r["src"], r["dst"], r["rtt"]) for r in rows] == [("1.2.3.0", "5.6.7.0", x) for x in (-5.0, 1.5, 2.5)]
    assert {str(r["dump_hour"]) for r in rows} == {"2026-02-24 07:00:00"}


def test_snapshots_of_both_shapes(spark, tmp_path):
    days = {"20260222": [{"id": 3}, {"id": 4}, {"latitude": 1.0}], "20260221": {"objects": [{"id": 1, "latitude": 5.5, "asn_v4": 7}, {"id": 2}]}, "20260223": {"objects": [{"id": 1, "latitude": None}]}}
    for day, data in days.items():
        (tmp_path / f"{day}.json.bz2").write_bytes(bz2.compress(json.dumps(data, indent=1).encode()))
    (tmp_path / "20260224.json.bz2").write_bytes(bz2.compress(b"no json"))
    daily = ingest.read_snapshots(spark, str(tmp_path))
    assert daily.count() == 6
    latest = {r["prb_id"]: r for r in ingest.latest_probes(daily).collect()}
    assert sorted(latest) == [1, 2, 3, 4]
    assert latest[1]["latitude"] is None and latest[1]["asn_v4"] is None  # the record is replaced whole
    assert str(latest[1]["first_seen"]["snapshot_date"]) == "2026-02-21"


def test_targets(spark):
    assert ingest.date_targets(spark, "2026-02-27", "2026-03-01").count() == 3
    assert ingest.date_targets(spark, "2026-03-02", "2026-03-01").count() == 0
    assert ingest.hourly_targets(spark, "2026-03-01", "2026-03-01").count() == 24


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "hourly")
    for rows in ([("h1", 1), ("h2", 2)], [("h2", 3)]):
        ingest.write_partitioned(spark.createDataFrame(rows, "h string, x int"), path, "h")
    assert sorted((r["h"], r["x"]) for r in spark.read.parquet(path).collect()) == [("h1", 1), ("h2", 3)]
    assert [r["h"] for r in ingest.pending(spark.createDataFrame([("h1",), ("h9",)], "h string"), spark.read.parquet(path), "h").collect()] == ["h9"]


def test_implausible_minimum_falls_back(spark):
    at = spark.createDataFrame([("s", 0.0, 0.0), ("d", 0.0, 9.0)], "addr string, lat double, lon double")
    pings = spark.createDataFrame([("s", "d", 1.0), ("s", "d", 12.0), ("s", "d", 11.0), ("s", "x", 50.0)], "src string, dst string, rtt double")
    assert [tuple(r) for r in min_rtt_edges(pings, at).collect()] == [("s", "d", 11.0)]
    lists = spark.createDataFrame([("s", "d", [1.0, 12.0]), ("d", "s", [1.0]), ("s", "d", [])], "src string, dst string, rtts array<double>")
    assert [r["rtts"] for r in plausible_lists(lists, at).collect()] == [[12.0]]


def test_location_of_a_subnet_is_its_last_probes(spark):
    probes = spark.createDataFrame([(1, "1.1.1.1", 1.0, 1.0), (2, "1.1.1.9", 2.0, 2.0), (3, "1.1.1.7", None, 3.0), (4, None, 4.0, 4.0)], "prb_id long, address_v4 string, latitude double, longitude double")
    assert [tuple(r) for r in ingest.subnet_locations(probes).collect()] == [("1.1.1.0", 2.0, 2.0)]


def test_fetch(tmp_path):
    calls = []

    def opener(answers):
        def run(url):
            calls.append(url)
            if isinstance(x := answers.pop(0), Exception):
                raise x
            return io.BytesIO(x)

        return run

    gone, broken = urllib.error.HTTPError("u", 404, "", {}, None), OSError("line")
    pauses: list[float] = []
    to = str(tmp_path / "raw" / "f")
    assert landing.fetch("u", to, opener=opener([broken, b"data"]), sleep=pauses.append) and open(to, "rb").read() == b"data"
    assert pauses == [5.0]
    assert landing.fetch("u", to, opener=opener([])) and len(calls) == 2
    assert not landing.fetch("u", str(tmp_path / "g"), opener=opener([gone, b""]))
    assert [p.name for p in tmp_path.iterdir()] == ["raw"]


def test_results_are_cached_by_configuration(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for budget in (1, 1, 2):
        assert landing.cached(spark, str(tmp_path), "curve", make, budget=budget).count() == 3
    assert len(made) == 2


def test_stream_of_hours(spark, tmp_path):
    at = spark.createDataFrame([("1.2.3.0", 0.0, 0.0), ("5.6.7.0", 0.0, 1.0)], "addr string, lat double, lon double")
    probes = spark.createDataFrame(PROBES, "prb_id long, address_v4 string")
    land, out, state = (str(tmp_path / x) for x in ("land", "out", "state"))
    (tmp_path / "land").mkdir()
    for hour, rtts in enumerate(([9.0, 7.0], [8.0], [5.0, 0.5])):
        (tmp_path / "land" / f"h{hour}.json").write_text("\n".join(json.dumps({"prb_id": 1, "dst_addr": "5.6.7.8", "min": x}) for x in rtts))
        hourly.follow(spark, land, probes, at, out, state).awaitTermination()
    assert [tuple(r) for r in hourly.edges(spark, out).collect()] == [("1.2.3.0", "5.6.7.0", 5.0)]
