"""From a landing folder to parsed layers: what has landed and is not parsed yet is read, reduced and written.

Two layers, Parquet by partition: probe records by ``snapshot_date`` and RTT lists of subnet pairs
by ``dump_hour``.  A partition is written whole or not at all and replaced when parsed again, so an
ingest that was broken off is simply run anew.  A file without any usable record leaves no partition
and is read again each time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tarnfell.operators import latency, mesh

from . import ingest, landing
from .schemas import HOURLY, PROBES_DAILY


@dataclass(frozen=True)
class Layers:
    """Where the raw files land, and the parsed layers."""

    landed: str
    parsed: str

    @property
    def probes(self) -> str:
        return f"{self.parsed}/probes"

    @property
    def hours(self) -> str:
        return f"{self.parsed}/hours"


def landed(spark: SparkSession, folder: str, glob: str, key: Column) -> DataFrame:
    """path, key of the files in folder whose names match; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path").withColumn("key", key).where("key IS NOT NULL")


def _day(path: str = "path") -> Column:
    return F.to_date(F.nullif(F.regexp_extract(path, r"(\d{8})\.json", 1), F.lit("")), "yyyyMMdd")


def _hour(path: str = "path") -> Column:
    return F.to_timestamp(F.nullif(F.regexp_extract(path, r"ping-(\d{4}-\d{2}-\d{2}T\d{2})00", 1), F.lit("")), "yyyy-MM-dd'T'HH")


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A layer, empty where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as why:
        if why.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def _pending(files: DataFrame, layer: DataFrame, key: str) -> list[str]:
    """Paths of files whose partition is not there, a name for each file to read."""
    done = layer.select(F.col(key).alias("key")).distinct()
    return [r["path"] for r in ingest.pending(files, done, "key").select("path").orderBy("path").collect()]


def daily_probes(spark: SparkSession, at: Layers) -> DataFrame:
    return _read(spark, at.probes, PROBES_DAILY)


def hourly(spark: SparkSession, at: Layers) -> DataFrame:
    return _read(spark, at.hours, HOURLY)


def ingest_probes(spark: SparkSession, at: Layers) -> int:
    """Parses the snapshots that are pending; how many files they are."""
    files = _pending(landed(spark, at.landed, "*.json*", _day()), daily_probes(spark, at), "snapshot_date")
    if files:
        ingest.write_partitioned(ingest.read_snapshots(spark, files), at.probes, "snapshot_date")
    return len(files)


def ingest_hours(spark: SparkSession, at: Layers) -> int:
    """Parses the ping dumps that are pending against the newest probe records; how many files they are."""
    files = _pending(landed(spark, at.landed, "ping-*", _hour()), hourly(spark, at), "dump_hour")
    if files:
        pings = ingest.read_pings(spark, files).where(~F.col("corrupt")).drop("corrupt")
        pairs = ingest.to_subnets(ingest.usable(pings), ingest.latest_probes(daily_probes(spark, at)))
        ingest.write_partitioned(ingest.hourly_summary(pairs, "dump_hour"), at.hours, "dump_hour")
    return len(files)


def download(spark: SparkSession, at: Layers, start: str, end: str, probe_archive: str, ping_archive: str, fetch: Callable[..., bool] = landing.fetch) -> int:
    """Fetches the files of all days and hours into the landing folder (a path of the driver's); how many are there."""
    days = ingest.date_targets(spark, start, end).select(ingest.probe_url(probe_archive, F.col("day")).alias("url"), ingest.probe_file(F.col("day")).alias("name"))
    hours = ingest.hourly_targets(spark, start, end).select(ingest.ping_url(ping_archive, F.col("day"), F.col("hour")), ingest.ping_file(F.col("day"), F.col("hour")))
    return sum(fetch(r["url"], f"{at.landed}/{r['name']}") for r in days.union(hours).collect())  # 25 rows a day


def run(spark: SparkSession, at: Layers, start: str, end: str, archives: tuple[str, str] | None = None, **options) -> tuple[int, int]:
    """Downloads (if archives, of probes and of pings, are named) and parses; files parsed of either kind."""
    if archives:
        download(spark, at, start, end, *archives, **options)
    return ingest_probes(spark, at), ingest_hours(spark, at)


def measured(spark: SparkSession, at: Layers, hours: int | None = ingest.FIRST_HOURS) -> tuple[DataFrame, DataFrame]:
    """(edges, locations) from the layers: least plausible RTTs over the first hours, and where subnets are."""
    locations = ingest.subnet_locations(ingest.latest_probes(daily_probes(spark, at)))
    early = ingest.first_hours(hourly(spark, at), hours, "dump_hour")
    pings = early.select("src", "dst", F.explode("rtts").alias("rtt"))
    return latency.min_rtt_edges(pings, locations), locations


def load_mesh(spark: SparkSession, at: Layers, hours: int | None = ingest.FIRST_HOURS, **options) -> tuple[DataFrame, DataFrame]:
    """(edges, locations) of the dense mesh, from the layers."""
    edges, locations = measured(spark, at, hours)
    found = mesh.adaptive(edges, **options)
    return mesh.mesh_edges(edges, found.nodes), mesh.mesh_locations(locations, found.nodes)
