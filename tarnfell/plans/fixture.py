"""Probes and pings derived from the driver's supplier and lineitem tables.

One WITH clause serves both engines; it is the input of the registered queries only.  The queries
take every supplier as a node (ALL); the SQL of FIXTURES.md stops at 200 of them (FIRST), so the two
are the same up to there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CTES = """z AS (SELECT {count} AS n FROM {supplier}),
nodes AS (
  SELECT s_suppkey AS k,
    CASE WHEN s_suppkey % 17 = 5 THEN NULL
         ELSE concat('10.0.', cast(cast(floor(s_suppkey * 9 / 10e0) AS bigint) AS varchar(20)), '.', cast(1 + s_suppkey % 254 AS varchar(20))) END AS address_v4,
    ((s_suppkey * 3701) % 13000) / 1e2 - 6e1 AS glat,
    ((s_suppkey * 7919) % 36000) / 1e2 - 18e1 AS glon,
    (s_suppkey * 7) % 10 AS tier
  FROM {supplier}{where}),
probes AS (
  SELECT k AS prb_id, address_v4,
    CASE WHEN k % 23 = 7 THEN NULL ELSE glat END AS latitude,
    CASE WHEN k % 23 = 7 THEN NULL ELSE glon END AS longitude
  FROM nodes),
pair AS (
  SELECT s.k AS sk, d.k AS dk, d.address_v4 AS daddr,
    {arc} AS a
  FROM nodes s CROSS JOIN nodes d
  WHERE {linked}),
pings AS (
  SELECT p.sk AS prb_id, l.l_orderkey % 24 AS hr,
    CASE WHEN l.l_tax >= 0.08e0 THEN '2001:db8::1' WHEN p.daddr IS NULL THEN '192.0.2.1' ELSE p.daddr END AS dst_addr,
    CASE WHEN l.l_linenumber = 7 THEN -1e0
         ELSE round(2e0 * 6371e0 * atan2(sqrt(p.a), sqrt(1e0 - p.a)) / 1e2 * (0.93e0 + l.l_quantity / 5e1) + l.l_discount * 1e1, 3) END AS rtt
  FROM (SELECT *, l_suppkey % (SELECT n FROM z) AS lsk, l_partkey % (SELECT n FROM z) AS ldk FROM {lineitem}) l JOIN {links})"""

#: Of two nodes s and d: the haversine term, and whether one pings the other.
_BOTH = {
    "arc": "pow(sin(radians(d.glat - s.glat) / 2e0), 2) + cos(radians(s.glat)) * cos(radians(d.glat)) * pow(sin(radians(d.glon - s.glon) / 2e0), 2)",
    "linked": "s.k = d.k OR ((s.k * 31 + d.k * 17) % 100) < 25 + 12 * least(s.tier, d.tier)",
}
FIRST = _BOTH | {"count": "least(200, count(*))", "where": " WHERE s_suppkey < 200", "links": "pair p ON p.sk = l.lsk AND p.dk = l.ldk"}
#: Links are those of a ping's own ends, as pairs grow with the square of the nodes.
ALL = _BOTH | {
    "count": "count(*)",
    "where": "",
    "links": "nodes s ON s.k = l.lsk JOIN nodes d ON d.k = l.ldk, LATERAL (SELECT s.k AS sk, d.address_v4 AS daddr, {arc} AS a) p WHERE {linked}".format(**_BOTH),
}
SPARK = "WITH " + CTES.format(supplier="{supplier}", lineitem="{lineitem}", **ALL)
#: For DuckDB, where the tables are views of their own names.
DUCK = "WITH " + CTES.format(supplier="supplier", lineitem="lineitem", **FIRST)


class Fixture:
    """The derived tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "lineitem")}

    def sql(self, query: str) -> DataFrame:
        return self.spark.sql(f"{SPARK}\n{query}", **self._tables)

    @property
    def nodes(self) -> DataFrame:
        return self.sql("SELECT * FROM nodes")

    @property
    def probes(self) -> DataFrame:
        return self.sql("SELECT * FROM probes")

    @property
    def pings(self) -> DataFrame:
        return self.sql("SELECT prb_id, '' AS src_addr, dst_addr, rtt, hr FROM pings")
