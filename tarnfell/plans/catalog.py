"""The registered latency-geolocation queries, each a thin use of the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfell.checkpoints import checkpoint_root, cut
from tarnfell.functions import geo
from tarnfell.operators import charts, evaluate, latency, mesh, region, selection
from tarnfell.sources import ingest

from . import oracles
from .fixture import Fixture

Query = Callable[[SparkSession, str], DataFrame]

START, END = "2026-02-23", "2026-02-26"
PROBE_ARCHIVE, PING_ARCHIVE = "https://archive.invalid/probes", "https://archive.invalid/pings"
RATIO, ADAPTIVE_MIN_NODES = 0.6, 50
MAX_BUDGET = 2500
_QUERIES: dict[str, Query] = {}


class Data(Fixture):
    """The fixture with the layers that most queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        self._edges: DataFrame | None = None

    @property
    def locations(self) -> DataFrame:
        return ingest.subnet_locations(self.probes)

    @property
    def usable(self) -> DataFrame:
        return ingest.usable(self.pings)

    @property
    def subnets(self) -> DataFrame:
        return ingest.to_subnets(self.usable, self.probes)

    @property
    def lazy_edges(self) -> DataFrame:
        return latency.min_rtt_edges(self.subnets, self.locations)

    @property
    def edges(self) -> DataFrame:
        """Written once per query, as several plans read them."""
        if self._edges is None:
            self._edges = cut(self.lazy_edges)
        return self._edges

    @property
    def ranked(self) -> DataFrame:
        return selection.oracle_candidates(self.edges)

    def picks(self, limit: int = MAX_BUDGET) -> DataFrame:
        return cut(selection.all_picks(self.edges, self.locations, limit, ("random", "iterative_greedy", "rtt_rank")))

    @property
    def hourly_layer(self) -> DataFrame:
        """The hourly summaries, written by partition and read back."""
        path = f"{checkpoint_root(self.spark)}/hours-{uuid.uuid4().hex}"
        ingest.write_partitioned(ingest.hourly_summary(self.subnets), path, "hr")
        return self.spark.read.schema("src string, dst string, rtts array<double>, hr long").parquet(path)


def query(make: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
    _QUERIES[make.__name__] = lambda spark, sf_dir: make(Data(spark, sf_dir))
    return make


def r6(column, name: str | None = None):
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 6).alias(name) if name else F.round(column, 6)


def as_text(rtts):
    """An RTT list as text, three decimals an element."""
    return F.array_join(F.transform(rtts, lambda r: r.cast("decimal(12,3)").cast("string")), ",")


# --- targets and ingest -------------------------------------------------------------------------
@query
def date_targets(d: Data) -> DataFrame:
    return ingest.date_targets(d.spark, START, END).select(F.col("day").cast("string").alias("day"))


@query
def hourly_targets(d: Data) -> DataFrame:
    return ingest.hourly_targets(d.spark, START, END).select(F.col("day").cast("string").alias("day"), "hour")


@query
def probe_urls(d: Data) -> DataFrame:
    return ingest.date_targets(d.spark, START, END).select(ingest.probe_url(PROBE_ARCHIVE, F.col("day")).alias("url"))


@query
def ping_urls(d: Data) -> DataFrame:
    return ingest.hourly_targets(d.spark, START, END).select(ingest.ping_url(PING_ARCHIVE, F.col("day"), F.col("hour")).alias("url"))


@query
def parsed_names(d: Data) -> DataFrame:
    days = ingest.date_targets(d.spark, START, END)
    hours = ingest.hourly_targets(d.spark, START, END)
    probes = days.select(ingest.parsed_probe_name(ingest.probe_file(F.col("day"))).alias("name"))
    return probes.union(hours.select(ingest.parsed_ping_name(ingest.ping_file(F.col("day"), F.col("hour")))))


@query
def pending_hours(d: Data) -> DataFrame:
    parsed = d.pings.where("hr % 3 = 0").select("hr")
    return ingest.pending(d.pings.select("hr").distinct(), parsed, "hr")


def _documents(d: Data) -> DataFrame:
    """Three snapshots as whole documents, of both shapes."""
    days = d.sql(
        """SELECT '2026-02-22' AS day, prb_id, address_v4, latitude, longitude FROM probes
        UNION ALL SELECT '2026-02-23', prb_id, address_v4, latitude + 0.5e0, longitude FROM probes WHERE prb_id % 3 <> 0
        UNION ALL SELECT '2026-02-24', CASE WHEN prb_id % 10 = 0 THEN NULL ELSE prb_id END, address_v4, NULL, longitude FROM probes WHERE prb_id % 5 = 0"""
    )
    record = F.struct(F.col("prb_id").alias("id"), "address_v4", F.lit("XX").alias("country_code"), "latitude", "longitude", F.lit("Connected").alias("status_name"))
    listed = days.groupBy("day").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("prb_id", F.lit(-1)).alias("o"), record.alias("r")))).alias("rs"))
    bare = F.to_json(F.transform("rs", lambda x: x["r"]))
    wrapped = F.concat(F.lit('{"objects":'), bare, F.lit("}"))
    return listed.select(F.to_date("day").alias("snapshot_date"), F.when(F.col("day") == "2026-02-23", bare).otherwise(wrapped).alias("value"))


@query
def probe_parse(d: Data) -> DataFrame:
    rows = ingest.parse_snapshots(_documents(d))
    return rows.select(F.col("snapshot_date").cast("string").alias("snapshot_date"), "pos", "prb_id", "address_v4", "country", r6("latitude", "latitude"), r6("longitude", "longitude"), "asn_v4", "status")


@query
def latest_probes(d: Data) -> DataFrame:
    rows = ingest.latest_probes(ingest.parse_snapshots(_documents(d)))
    return rows.select("prb_id", "address_v4", r6("latitude", "latitude"), r6("longitude", "longitude"), F.col("snapshot_date").cast("string").alias("snapshot_date"), F.col("first_seen.snapshot_date").cast("string").alias("first_seen"))


@query
def probe_count(d: Data) -> DataFrame:
    return ingest.parse_snapshots(_documents(d)).agg(F.countDistinct("prb_id").alias("n_probes"))


def _lines(d: Data) -> DataFrame:
    """Pings as JSON lines; some are not JSON, lack fields, or hold nulls."""
    return d.sql(
        """SELECT CASE
          WHEN prb_id % 19 = 3 AND hr = 5 THEN 'not json'
          WHEN prb_id % 19 = 4 AND hr = 6 THEN concat('{{"prb_id":', prb_id, ',"dst_addr":"', dst_addr, '"}}')
          WHEN prb_id % 19 = 5 AND hr = 7 THEN concat('{{"prb_id":', prb_id, ',"src_addr":"10.9.9.9","dst_addr":"', dst_addr, '","min":null}}')
          WHEN prb_id % 19 = 6 AND hr = 8 THEN concat('{{"prb_id":', prb_id, ',"src_addr":null,"dst_addr":"', dst_addr, '","min":', rtt, '}}')
          WHEN prb_id % 19 = 7 AND hr = 9 THEN concat('{{"prb_id":"x', prb_id, '","dst_addr":"', dst_addr, '","min":', rtt, '}}')
          ELSE concat('{{"prb_id":', prb_id, ',"src_addr":"10.9.9.9","dst_addr":"', dst_addr, '","min":', rtt, '}}') END AS value
        FROM pings"""
    )


@query
def ping_scan(d: Data) -> DataFrame:
    return ingest.parse_pings(_lines(d)).where(~F.col("corrupt")).select("prb_id", "src_addr", "dst_addr", "rtt")


@query
def ping_corrupt_count(d: Data) -> DataFrame:
    return ingest.parse_pings(_lines(d)).groupBy("corrupt").agg(F.count("*").alias("n"))


@query
def ping_filter(d: Data) -> DataFrame:
    return d.usable.select("prb_id", "dst_addr", "rtt", "hr")


@query
def to_slash24(d: Data) -> DataFrame:
    return d.probes.select("prb_id", geo.slash24(F.col("address_v4")).alias("subnet"))


@query
def ping_to_subnet(d: Data) -> DataFrame:
    return d.subnets.select("src", "dst", "rtt", "hr")


@query
def hourly_summary(d: Data) -> DataFrame:
    return ingest.hourly_summary(d.subnets).select("hr", "src", "dst", as_text("rtts").alias("rtts"))


@query
def explode_summary(d: Data) -> DataFrame:
    by_src = ingest.hourly_summary(d.subnets).groupBy("hr", "src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "rtts"))).alias("dsts"))
    return latency.explode_sources(by_src)


@query
def export_latest(d: Data) -> DataFrame:
    return ingest.merge_hours(d.hourly_layer).select("src", "dst", as_text("rtts").alias("rtts"))


@query
def first_n_hours(d: Data) -> DataFrame:
    early = ingest.first_hours(d.hourly_layer)
    return early.select("hr", "src", "dst", as_text("rtts").alias("rtts"))


@query
def subnet_locations(d: Data) -> DataFrame:
    return d.locations.select("addr", r6("lat", "lat"), r6("lon", "lon"))


# --- latency ------------------------------------------------------------------------------------
@query
def haversine(d: Data) -> DataFrame:
    return d.sql("SELECT s.k AS sk, d.k AS dk, s.glat AS la, s.glon AS lo, d.glat AS lb, d.glon AS lp FROM pair JOIN nodes s ON s.k = sk JOIN nodes d ON d.k = dk").select(
        "sk", "dk", r6(geo.haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")), "dist_km")
    )


@query
def located_pairs(d: Data) -> DataFrame:
    return latency.with_distance(d.subnets, d.locations).select("src", "dst", "hr", "rtt", r6("dist_km", "dist_km"))


@query
def sol_filter(d: Data) -> DataFrame:
    return latency.plausible(d.subnets, d.locations).select("src", "dst", "hr", "rtt", r6(geo.min_possible_rtt(F.col("dist_km")), "min_rtt"))


@query
def sol_filter_array(d: Data) -> DataFrame:
    lists = ingest.merge_hours(ingest.hourly_summary(d.subnets))
    return latency.plausible_lists(lists, d.locations).select("src", "dst", as_text("rtts").alias("rtts"))


@query
def array_min_rtt(d: Data) -> DataFrame:
    lists = ingest.merge_hours(ingest.hourly_summary(d.subnets))
    return latency.plausible_lists(lists, d.locations).select("src", "dst", F.array_min("rtts").alias("rtt"))


@query
def min_rtt_edges(d: Data) -> DataFrame:
    return d.lazy_edges


@query
def rtt_wrap(d: Data) -> DataFrame:
    return d.lazy_edges.select("src", "dst", as_text(F.array("rtt")).alias("rtts"))


@query
def invert_min(d: Data) -> DataFrame:
    return latency.plausible(d.subnets, d.locations).groupBy("dst", "src").agg(F.min("rtt").alias("rtt"))


@query
def available_vps(d: Data) -> DataFrame:
    return latency.available(d.lazy_edges).select("dst", F.array_join("srcs", ",").alias("srcs"))


@query
def remaining_vps(d: Data) -> DataFrame:
    used = selection.random_picks(d.edges, 1000)
    return selection.remaining(d.edges, used).select("src", "dst", "rtt")


@query
def all_targets(d: Data) -> DataFrame:
    return latency.targets(d.lazy_edges)


# --- mesh ---------------------------------------------------------------------------------------
@query
def mesh_nodes(d: Data) -> DataFrame:
    return mesh.nodes(d.edges)


@query
def mesh_degrees(d: Data) -> DataFrame:
    return mesh.degrees(d.edges, mesh.nodes(d.edges))


@query
def mesh_prune_round(d: Data) -> DataFrame:
    pool = mesh.nodes(d.edges)
    return mesh.prune_round(d.edges, pool, RATIO, pool.count())


@query
def mesh_prune(d: Data) -> DataFrame:
    return mesh.prune(d.edges, RATIO)[0]


@query
def mesh_adaptive(d: Data) -> DataFrame:
    found = mesh.adaptive(d.edges, min_nodes=ADAPTIVE_MIN_NODES)
    return found.nodes.select("addr", r6(F.lit(found.ratio), "ratio"), F.lit(found.relaxations).alias("relaxations"))


@query
def mesh_defaults(d: Data) -> DataFrame:
    """With the reference's ratio, decay and least size; without SQL, as that has its own."""
    found = mesh.adaptive(d.edges)
    return found.nodes.select("addr", r6(F.lit(found.ratio), "ratio"), F.lit(found.relaxations).alias("relaxations"), F.lit(found.enough).alias("enough"))


@query
def mesh_edges(d: Data) -> DataFrame:
    return mesh.mesh_edges(d.edges, mesh.prune(d.edges, RATIO)[0])


@query
def mesh_locations(d: Data) -> DataFrame:
    return mesh.mesh_locations(d.locations, mesh.prune(d.edges, RATIO)[0]).select("addr", r6("lat", "lat"), r6("lon", "lon"))


@query
def mesh_density(d: Data) -> DataFrame:
    return mesh.density(d.edges, mesh.prune(d.edges, RATIO)[0]).select("n_nodes", "n_edges", r6("density", "density"))


# --- regions ------------------------------------------------------------------------------------
@query
def constraint_radius(d: Data) -> DataFrame:
    return d.lazy_edges.select("src", "dst", r6(geo.max_radius_km(F.col("rtt")), "radius_km"))


@query
def constraints_array(d: Data) -> DataFrame:
    rows = region.constraints(d.edges, d.locations, ["dst"])
    total = F.aggregate("constraints", F.lit(0.0), lambda s, c: s + c["radius_km"])
    return rows.select("dst", F.size("constraints").alias("n_constraints"), r6(total, "sum_radius_km"), F.element_at("constraints", 1)["src"].alias("first_src"))


@query
def centroid_seed(d: Data) -> DataFrame:
    return region.seeds(d.edges, d.locations, ["dst"], digits=9).select("dst", "n_vps", "seed_lat", "seed_lon")


def _at_seed(d: Data) -> DataFrame:
    centres = region.seeds(d.edges, d.locations, ["dst"]).select("dst", F.col("seed_lat").alias("lat"), F.col("seed_lon").alias("lon"))
    return region.at_centre(d.edges, d.locations, centres)


@query
def penalty_at_seed(d: Data) -> DataFrame:
    return _at_seed(d).select("dst", F.round("penalty", 3).alias("penalty"))


@query
def region_size(d: Data) -> DataFrame:
    return _at_seed(d).select("dst", r6("region_size_km", "region_size_km"))


@query
def expected_rtt(d: Data) -> DataFrame:
    return latency.with_distance(d.edges, d.locations).select("src", "dst", r6(geo.expected_rtt(F.col("dist_km")), "expected_rtt"))


# --- selection ----------------------------------------------------------------------------------
@query
def oracle_candidates(d: Data) -> DataFrame:
    return d.ranked.select("dst", "src", "rtt", "rank")


@query
def oracle_first(d: Data) -> DataFrame:
    return selection.oracle_first(d.edges, d.locations).select("dst", "src", "rtt", r6("error_km", "error_km"))


@query
def interleave(d: Data) -> DataFrame:
    return selection.interleave(d.ranked, MAX_BUDGET).select("seq", "src", "dst")


@query
def random_picks(d: Data) -> DataFrame:
    return selection.random_picks(d.edges, MAX_BUDGET).select("seq", "src", "dst", "rtt")


@query
def greedy_as_written(d: Data) -> DataFrame:
    return selection.greedy_as_written(d.edges, MAX_BUDGET).select("seq", "src", "dst", "rtt")


@query
def greedy_order(d: Data) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("dst").orderBy("rtt", "src"))
    utilities = d.edges.withColumn("k", k).withColumn("utility", (F.col("k") * 31 % 7).cast("double"))
    return selection.greedy_order(utilities, MAX_BUDGET).select("seq", "dst", "k")


@query
def picks_budget(d: Data) -> DataFrame:
    rows = evaluate.within_budgets(d.picks(), evaluate.budgets_frame(d.spark))
    return rows.groupBy("strategy", "budget").agg(F.count("*").alias("n_picks"), F.countDistinct("dst").alias("n_targets"), F.round(F.sum("rtt"), 3).alias("sum_rtt"))


@query
def measurements_map(d: Data) -> DataFrame:
    by_src = selection.random_picks(d.edges, 1000).groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", F.array("rtt").alias("rtts")))).alias("dsts"))
    return by_src.select("src", F.size("dsts").alias("n_dsts"))


@query
def oracle_picks(d: Data) -> DataFrame:
    return selection.oracle_picks(d.edges, d.locations, MAX_BUDGET).select("seq", "src", "dst", "rtt")


def _trace(d: Data) -> DataFrame:
    rows = selection.greedy_picks_intended(d.edges, d.locations, MAX_BUDGET)
    return rows.select(
        F.col("seq").alias("ping_num"), F.col("dst").alias("target"), "src", F.col("utility").alias("expected_util"), "actual_util",
        (F.col("utility") - F.col("actual_util")).alias("error"), "predicted_rtt", F.col("rtt").alias("actual_rtt"),
    )


@query
def greedy_picks_intended(d: Data) -> DataFrame:
    return selection.greedy_picks_intended(d.edges, d.locations, MAX_BUDGET).select("seq", "src", "dst", "rtt")


@query
def utility_trace(d: Data) -> DataFrame:
    return _trace(d)


@query
def utility_snapshot(d: Data) -> DataFrame:
    """Over the first measurement of every target, where the as-written utilities are closed forms."""
    n = latency.targets(d.edges).count()
    first = selection.greedy_as_written(d.edges, n)
    expected, actual = F.lit(geo.UNMEASURED_UTILITY), F.lit(geo.MAX_REGION_KM) - F.greatest(F.lit(0.0), geo.max_radius_km(F.col("rtt")))
    trace = first.select(F.col("seq").alias("ping_num"), expected.alias("expected_util"), actual.alias("actual_util"), (expected - actual).alias("error"))
    rows = evaluate.utility_snapshot(trace)
    return rows.select("ping_num", r6("avg_expected_km", "avg_expected_km"), r6("avg_actual_km", "avg_actual_km"), "worst_ping", r6("worst_error_km", "worst_error_km"))


# --- evaluation ---------------------------------------------------------------------------------
@query
def estimate_nn(d: Data) -> DataFrame:
    return evaluate.nearest(d.edges, d.locations, ["dst"]).select("dst", "src", r6("lat", "lat"), r6("lon", "lon"))


@query
def estimate_single(d: Data) -> DataFrame:
    few = evaluate.within_budgets(d.picks(200), evaluate.budgets_frame(d.spark, [100, 200]))
    return evaluate.single(few, d.locations, ["strategy", "budget", "dst"]).select("strategy", "budget", "dst", r6("lat", "lat"), r6("lon", "lon"))


@query
def estimate_asof(d: Data) -> DataFrame:
    return evaluate.estimate_asof(d.picks(), evaluate.budgets_frame(d.spark))


@query
def estimate_centroid(d: Data) -> DataFrame:
    return evaluate.estimate(d.edges, d.locations, ["dst"]).select("dst", r6("lat", "lat"), r6("lon", "lon"))


@query
def budget_curve(d: Data) -> DataFrame:
    rows = evaluate.budget_curve(d.picks(), d.edges, d.locations, evaluate.budgets_frame(d.spark))
    return rows.select("strategy", "budget", "targets_found", "n_targets", r6("avg_error_km", "avg_error_km"))


@query
def budget_curve_centroid(d: Data) -> DataFrame:
    """The reference's comparison: its three strategies, its budgets, its way to estimate."""
    rows = evaluate.compare(d.edges, cut(d.locations))
    return rows.select("strategy", "budget", "targets_found", "n_targets", r6("avg_error_km", "avg_error_km"))


@query
def budget_curve_nearest(d: Data) -> DataFrame:
    """The same strategies and the intended greedy order, estimated by the nearest vantage point."""
    rows = evaluate.compare(d.edges, cut(d.locations), (*selection.COMPARED, "intended_greedy"), mode=evaluate.MODES[0])
    return rows.select("strategy", "budget", "targets_found", "n_targets", r6("avg_error_km", "avg_error_km"))


# --- chart tables -------------------------------------------------------------------------------
@query
def curve_labels(d: Data) -> DataFrame:
    return charts.curve_labels(d.picks(200).select("strategy").distinct())


@query
def latency_vs_distance(d: Data) -> DataFrame:
    return charts.latency_vs_distance(d.edges, d.locations).select("src", "dst", r6("dist_km", "dist_km"), "min_rtt")


@query
def latency_summary(d: Data) -> DataFrame:
    points = charts.latency_vs_distance(d.edges, d.locations)
    return charts.latency_summary(points).select("n_pairs", r6("max_dist_km", "max_dist_km"), r6("p99_rtt", "p99_rtt"))


@query
def sol_line(d: Data) -> DataFrame:
    return charts.sol_line(charts.latency_vs_distance(d.edges, d.locations)).select(r6("dist_km", "dist_km"), r6("rtt", "rtt"))


@query
def degree_cdf(d: Data) -> DataFrame:
    return charts.degree_cdf(d.edges).select("direction", "degree", r6("p", "p"))


@query
def mesh_ideal(d: Data) -> DataFrame:
    return charts.mesh_ideal(d.edges)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
