"""Ping files as a stream: the least plausible RTT per pair, kept up to date as hours land.

Each micro-batch is reduced to its own minima and written under its batch id, so a batch that is
run again after a failure replaces itself; the minimum of minima is the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnfell.operators.latency import min_rtt_edges
from tarnfell.sources import ingest
from tarnfell.sources.schemas import EDGES


def follow(spark: SparkSession, landing: str, probes: DataFrame, locations: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a query over JSON-lines files in landing; with once, it ends when all there is has been read."""
    lines = spark.readStream.schema("value string").text(landing)
    pings = ingest.parse_pings(lines).where(~F.col("corrupt"))
    pairs = ingest.to_subnets(ingest.usable(pings), probes)

    def keep(batch: DataFrame, number: int) -> None:
        min_rtt_edges(batch, locations).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = pairs.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def edges(spark: SparkSession, out: str) -> DataFrame:
    """The edges over all batches so far."""
    return spark.read.schema(EDGES).parquet(f"{out}/batch=*").groupBy("src", "dst").agg(F.min("rtt").alias("rtt"))
