"""Targets, readers and writers of the ingest layer.

Raw files land in a directory (downloading is a driver-side helper, see :mod:`landing`).  Probe
snapshots are whole-document JSON in either of two shapes, ping dumps are JSON lines; both may be
bz2.  Parsed layers are Parquet partitioned by day or hour, overwritten by partition, so a repeated
parse is idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfell.functions.geo import is_ipv6, slash24

from .schemas import PING, PROBE_NAMES, SNAPSHOT_RECORD

#: Hours of the hourly layer that the mesh reads unless told otherwise.
FIRST_HOURS = 10


def date_targets(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every day from start to end, both included; none if end is before start."""
    days = F.when(F.lit(end) < F.lit(start), F.array().cast("array<date>")).otherwise(F.sequence(F.to_date(F.lit(start)), F.greatest(F.to_date(F.lit(start)), F.to_date(F.lit(end)))))
    return spark.range(1).select(F.explode(days).alias("day"))


def hourly_targets(spark: SparkSession, start: str, end: str) -> DataFrame:
    return date_targets(spark, start, end).select("day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))


def probe_file(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit(".json.bz2"))


def probe_url(base: str, day: Column) -> Column:
    return F.concat_ws("/", F.lit(base), F.date_format(day, "yyyy"), F.date_format(day, "MM"), probe_file(day))


def ping_file(day: Column, hour: Column) -> Column:
    return F.concat(F.lit("ping-"), F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.lpad(hour.cast("string"), 2, "0"), F.lit("00.bz2"))


def ping_url(base: str, day: Column, hour: Column) -> Column:
    return F.concat_ws("/", F.lit(base), F.date_format(day, "yyyy-MM-dd"), ping_file(day, hour))


def parsed_probe_name(file: Column) -> Column:
    return F.concat(F.split_part(file, F.lit("."), F.lit(1)), F.lit("_parsed.json"))


def parsed_ping_name(file: Column) -> Column:
    return F.replace(file, F.lit(".bz2"), F.lit("_summary.json"))


def pending(landed: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """What has landed and is not parsed yet."""
    return landed.join(parsed.select(key).distinct(), key, "left_anti")


def _probe_columns(record: str) -> list[Column]:
    return [F.col(f"{record}.{f.name}").alias(PROBE_NAMES.get(f.name, f.name)) for f in SNAPSHOT_RECORD.fields]


def parse_snapshots(documents: DataFrame) -> DataFrame:
    """Probe records of whole documents (snapshot_date, value): a bare list, or a list under ``objects``.

    ``pos`` is a record's place in its document.  Documents that are not JSON give no records.
    """
    listed = T.ArrayType(SNAPSHOT_RECORD)
    wrapped = T.StructType([T.StructField("objects", listed)])
    records = F.coalesce(F.from_json("value", wrapped)["objects"], F.when(F.ltrim("value").startswith("["), F.from_json("value", listed)))
    return documents.select("snapshot_date", F.posexplode(records).alias("pos", "r")).select("snapshot_date", F.col("pos").cast("long").alias("pos"), *_probe_columns("r"))


def read_snapshots(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Snapshot files named by day (YYYYMMDD.json.bz2); one small file is one document."""
    files = spark.read.text(paths, wholetext=True)
    day = F.to_date(F.regexp_extract(F.input_file_name(), r"(\d{8})\.json", 1), "yyyyMMdd")
    return parse_snapshots(files.select(day.alias("snapshot_date"), "value"))


def parse_pings(lines: DataFrame) -> DataFrame:
    """Ping records of JSON lines (value): prb_id, src_addr, dst_addr, rtt, and whether the line is corrupt.

    Missing addresses become "", a missing RTT -1; a JSON null stays null and is dropped later.
    Other columns of lines stay.
    """
    record = F.from_json("value", PING, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.select("*", record.alias("r"))
    kind = F.schema_of_variant("r.min")
    address = lambda field: F.when(F.col(f"r.{field}").isNotNull(), F.try_variant_get(F.col(f"r.{field}"), "$", "string")).otherwise("")
    return rows.select(
        *[c for c in lines.columns if c != "value"],
        F.col("r.prb_id").alias("prb_id"),
        address("src_addr").alias("src_addr"),
        address("dst_addr").alias("dst_addr"),
        F.when(F.col("r.min").isNotNull(), F.try_variant_get(F.col("r.min"), "$", "double")).otherwise(F.lit(-1.0)).alias("rtt"),
        (F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | ~F.ltrim("value").startswith("{") | F.coalesce(kind.rlike("^(STRING|BOOLEAN|OBJECT|ARRAY)"), F.lit(False))).alias("corrupt"),
    )


def read_pings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Ping files (bz2 splits by lines); dump_hour comes from the file's name."""
    files = spark.read.text(paths)
    hour = F.to_timestamp(F.regexp_extract(F.input_file_name(), r"ping-(\d{4}-\d{2}-\d{2}T\d{2})00", 1), "yyyy-MM-dd'T'HH")
    return parse_pings(files.select("value", hour.alias("dump_hour")))


def usable(pings: DataFrame) -> DataFrame:
    """Without failed pings (RTT -1 or null) and IPv6 at either end."""
    return pings.where((F.col("rtt") != -1) & ~is_ipv6(F.col("src_addr")) & ~is_ipv6(F.col("dst_addr")))


def to_subnets(pings: DataFrame, probes: DataFrame) -> DataFrame:
    """Pings between /24s: the source is the probe's own address, unknown probes and those without IPv4 go.

    Probe metadata is one row per probe in the world; Spark broadcasts it while it is below its
    threshold and shuffles by probe beyond it.
    """
    known = probes.where(F.col("address_v4").isNotNull()).select("prb_id", slash24(F.col("address_v4")).alias("src"))
    rest = [c for c in pings.columns if c not in ("prb_id", "src_addr", "dst_addr")]
    return pings.join(known, "prb_id").select("src", slash24(F.col("dst_addr")).alias("dst"), *rest)


def hourly_summary(pings: DataFrame, hour: str = "hr") -> DataFrame:
    """RTT lists by hour and pair, sorted so that equal inputs give equal lists."""
    return pings.groupBy(hour, "src", "dst").agg(F.sort_array(F.collect_list("rtt")).alias("rtts"))


def merge_hours(hourly: DataFrame) -> DataFrame:
    """RTT lists by pair over all hours."""
    return hourly.groupBy("src", "dst").agg(F.sort_array(F.flatten(F.collect_list("rtts"))).alias("rtts"))


def first_hours(hourly: DataFrame, n: int | None = FIRST_HOURS, hour: str = "hr") -> DataFrame:
    """Rows of the n earliest hours.  On the partitioned layer only those partitions are read."""
    if n is None:
        return hourly
    earliest = [r[0] for r in hourly.select(hour).distinct().orderBy(hour).limit(n).collect()]  # n values
    return hourly.where(F.col(hour).isin(earliest))


def latest_probes(daily: DataFrame) -> DataFrame:
    """One row per probe: the whole record of the newest snapshot, of its last row there."""
    last = F.max_by(F.struct(*[c for c in daily.columns if c not in ("prb_id", "pos")]), F.struct("snapshot_date", "pos")).alias("r")
    first = F.min(F.struct("snapshot_date", "pos")).alias("first_seen")
    return daily.where(F.col("prb_id").isNotNull()).groupBy("prb_id").agg(last, first).select("prb_id", "r.*", "first_seen")


def subnet_locations(probes: DataFrame, order: str = "prb_id") -> DataFrame:
    """One location per /24: that of its last probe by ``order`` with an address, latitude and longitude."""
    whole = probes.where(F.col("address_v4").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    # two plain maxima instead of one of a struct: they stay in a hash aggregate (order is unique, so they agree)
    return whole.groupBy(slash24(F.col("address_v4")).alias("addr")).agg(F.max_by("latitude", order).alias("lat"), F.max_by("longitude", order).alias("lon"))


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Parquet by partition; partitions that df has are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
