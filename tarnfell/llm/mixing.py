"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in a seeded order, are cut into blocks of ``block_rows``.  With the exact
weights a of the sources that still have blocks (floats as the fractions they are), A their sum, the
j-th block of a source has release floor((j-1)A/a) and deadline ceil(jA/a), and slot after slot the
released block with the earliest deadline is taken, so any prefix deviates from the given targets by
less than one block of any source.  When a source has run out, a new phase begins with the weights
of the others, again on target from there on.  Every row is kept, once.

Only the totals per source come to the driver, which lays out the blocks (a row of numbers for each,
of which there are at most MAX_BLOCKS and one a source); the rows find their slots by a join against
that table.  There is no limit to the number of sources, but each begins a phase when it has run out,
so the driver's work grows with their square.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block, more of them where there would be over MAX_BLOCKS blocks: the driver lays those out.
BLOCK_ROWS, MAX_BLOCKS = 64, 1 << 20
#: Rows of one source that one task puts in order, more of them where there would be over MAX_BUCKETS buckets.
BUCKET_ROWS, MAX_BUCKETS = 2000, 1 << 20
#: A bucket with so many times the rows of an even one holds rows of equal ids; it is divided by their content.
HOT_BUCKET = 8
#: The table of blocks is broadcast up to this length.
BROADCAST_BLOCKS = 1 << 21
#: Without given weights, a source's weight is its share of the rows to this power.
TEMPERATURE_POWER = 0.5


def earliest(weights: list[int]) -> Iterator[tuple[int, int, int]]:
    """Slot by slot without end: the source taken, its block's release and its deadline."""
    total, taken = sum(weights), [0] * len(weights)
    waiting = [(0, i) for i, a in enumerate(weights) if a]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            release, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(taken[i] + 1) * total // weights[i]), i, release))
        deadline, i, release = heapq.heappop(ready)
        yield i, release, deadline
        taken[i] += 1
        slot += 1
        heapq.heappush(waiting, (taken[i] * total // weights[i], i))


def pattern(weights: list[int]) -> list[int]:
    """Slot by slot, the source taken in one period of sum(weights) slots."""
    return [i for i, _, _ in islice(earliest(weights), sum(weights))]


def integer_weights(weights: list[float], denominator: int) -> list[int]:
    """Positive weights as integers that sum to about the denominator, none below 1."""
    total = sum(weights)
    return [max(1, round(denominator * w / total)) for w in weights]


COLUMNS = ("src", "block", "phase", "release", "deadline")


def schedule(blocks: list[int], weights: list[float]) -> dict[str, array]:
    """COLUMNS of every slot: the sources' blocks by their exact weights."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(w.denominator for w in exact)) if exact else 1
    whole = [int(w * scale) for w in exact]
    out = {c: array("q") for c in COLUMNS}
    left, phase = list(blocks), 0
    while any(left):
        active, base = [i for i, n in enumerate(left) if n], len(out["src"])
        for k, release, deadline in earliest([whole[i] for i in active]):
            i = active[k]
            for c, x in zip(COLUMNS, (i, blocks[i] - left[i], phase, base + release, base + deadline)):
                out[c].append(x)
            left[i] -= 1
            if not left[i]:
                break
        phase += 1
    return out


def _plain(kind: T.DataType) -> bool:
    """Whether Spark can hash values of this type."""
    if isinstance(kind, T.StructType):
        return all(_plain(f.dataType) for f in kind.fields)
    return _plain(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def _spread(packed: DataFrame, per_bucket: int) -> DataFrame:
    """packed with _part: parts of the buckets that rows of equal ids make many times larger than even ones."""
    by = ["source", "_bucket"]
    large = packed.groupBy(*by).count().where(F.col("count") > HOT_BUCKET * per_bucket)
    if large.isEmpty():
        return packed.withColumn("_part", F.lit(0))
    # at most 1 / HOT_BUCKET as many as there are buckets
    parts = F.broadcast(large.select(*by, F.ceil(F.col("count") / per_bucket).alias("_parts")))
    content = [F.col(f"row.`{f.name}`") for f in packed.schema["row"].dataType.fields if _plain(f.dataType)]
    part = F.coalesce(F.pmod(F.xxhash64(*content), F.col("_parts")), F.lit(0)).cast("int")
    return packed.join(parts, by, "left").withColumn("_part", part).drop("_parts")


def mix(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, denominator: int | None = None, seed: int = 0,
    id_col: str = "doc_id", source_col: str = "source", bucket_rows: int = BUCKET_ROWS, max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """row (struct of docs' columns) and its place: source, block, slot, phase, weight, release, deadline, place.

    ``place`` is the row's position within its block, so (slot, place) is the training order.
    weights must name every source with a positive number; a null source is a source of its own.
    They hold exactly, unless a denominator asks for whole weights that sum to about it.
    Within a source the order is that of a seeded hash of the id (ties by id; rows with equal ids
    are interchangeable); a null id hashes like any other.  However many rows share an id, they are
    ordered by many tasks, as long as they differ in some column.  An empty table gives no rows.
    docs' columns travel inside ``row``, so their names can't clash with these.
    """
    spark = docs.sparkSession
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.struct(F.col(source_col).cast("string").alias("s")).alias("source"),
        F.col(id_col).alias("_id"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("_h"),
    )
    n_rows = docs.select(id_col).count()
    block_rows = max(block_rows, -(-n_rows // max_blocks))
    n_buckets = min(max(1, n_rows // bucket_rows), MAX_BUCKETS)
    packed = packed.withColumn("_bucket", F.pmod(F.shiftright("_h", 20), F.lit(n_buckets)))
    packed = _spread(packed, max(bucket_rows, n_rows // n_buckets))
    by = ["source", "_bucket", "_part"]
    sizes = packed.groupBy(*by).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("_bucket", "_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_ahead"), "n")
    totals = sizes.groupBy("source").agg(F.sum("n").alias("n")).collect()
    totals = sorted(((r["source"]["s"], r["n"]) for r in totals), key=lambda x: (x[0] is not None, x[0] or ""))
    names = [s for s, _ in totals]
    if weights is None:
        share = [n**TEMPERATURE_POWER for _, n in totals]
    else:
        if missing := [s for s in names if not weights.get(s, 0) > 0]:
            raise ValueError(f"no positive weight for {missing[:5]}")
        share = [float(weights[s]) for s in names]
    if denominator is not None and names:
        share = [float(w) for w in integer_weights(share, max(denominator, 2 * len(names)))]
    laid = schedule([-(-n // block_rows) for _, n in totals], share)
    n_slots = len(laid["src"])
    sources_df = spark.createDataFrame(list(zip(names, range(len(names)), share)), "s string, src long, weight double")
    table = pa.table({c: pa.array(np.frombuffer(x, np.int64) if x else [], pa.int64()) for c, x in laid.items()} | {"slot": pa.array(np.arange(n_slots), pa.int64())})
    slots_df = spark.createDataFrame(table).withColumn("phase", F.col("phase").cast("int"))
    if n_slots <= BROADCAST_BLOCKS:
        slots_df = F.broadcast(slots_df)
        sources_df = F.broadcast(sources_df)  # no more sources than slots
    order = Window.partitionBy(*by).orderBy("_h", "_id")
    ranked = packed.join(sizes.drop("n"), by).withColumn("rank", F.col("_ahead") + F.row_number().over(order) - 1)
    ranked = ranked.select("row", F.col("source.s").alias("s"), F.floor(F.col("rank") / block_rows).alias("block"), (F.col("rank") % block_rows).alias("place"))
    r, t = ranked.alias("r"), sources_df.alias("t")
    held = r.join(t, F.col("r.s").eqNullSafe(F.col("t.s"))).select("row", F.col("r.s").alias("source"), "block", "place", "src", "weight")
    return held.join(slots_df, ["src", "block"]).select("row", "source", "block", "slot", "place", "phase", "weight", "release", "deadline")


def in_order(docs: DataFrame, **options) -> DataFrame:
    """All rows of docs, dealt and sorted so that files and rows follow the schedule."""
    mixed = mix(docs, **options)
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")
