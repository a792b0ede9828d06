"""Exact deduplication by deterministic block naming, with DataFrame functions only.

Every text is cut into blocks of a fixed number of bytes.  The distinct blocks of the whole corpus
are sorted and each gets an integer name that follows the sort order.  Then adjacent names are
paired, the distinct pairs are sorted and named in turn, and so on; a document of n blocks has one
name left after ceil(log2 n) rounds.  (round, name) stands for exactly one content, as every step
names contents and never digests.

The content crosses the network in the naming step only.  To carry a block's name back to its
places, a 128-bit fingerprint and the length are the join key; whether two named blocks share that
key is counted first, and if any do the content itself is the join key, so the result is exact
either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfell.checkpoints import release

from .common import cut, join_classes

BLOCK_BYTES = 4096
#: Blocks are sorted by so many leading bytes, then a hash, then the whole.
LEAD_BYTES = 16
#: Stands for "no right neighbour" in a pair; names are never negative.
ALONE = -1


def _fingerprint(block: Column) -> Column:
    return F.struct(F.xxhash64(block).alias("a"), F.xxhash64(F.lit(17), block).alias("b"), F.length(block).alias("n"))


def _blocks(docs: DataFrame, block_bytes: int, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("sha"), text.cast("binary").alias("body"))
    rows = rows.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.length("body") / F.lit(block_bytes))).cast("int"))
    cuts = F.transform(
        F.sequence(F.lit(0), F.col("n_blocks") - 1),
        lambda i: F.col("body").substr((i * block_bytes + 1).cast("int"), F.lit(block_bytes)),
    )
    return rows.select("doc_id", "sha", "n_blocks", F.posexplode(cuts).alias("pos", "block"))


def _named(contents: DataFrame, spread: list, *keys: str) -> DataFrame:
    """Distinct contents in sorted order with names that follow it.

    spread: short leading sort keys.  They alone deal out the ranges, so that the sample of keys
    that Spark takes to the driver for it does not hold contents.
    """
    lead = {f"_k{i}": k for i, k in enumerate(spread)}
    ranged = contents.distinct().withColumns(lead).repartitionByRange(*lead)
    return ranged.sortWithinPartitions(*lead, *keys).drop(*lead).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", fingerprint=_fingerprint) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, sha, copies, level, name.

    (level, name) is equal for two rows exactly if their texts are identical; copies counts the
    rows that share both doc_id and text.  A null text counts as empty; a null doc_id is kept as a
    value of its own; an empty table gives no rows; other columns are ignored.
    """
    blocks = _blocks(docs, block_bytes, id_col, text_col)
    names = _named(blocks.select("block"), [F.col("block").substr(1, LEAD_BYTES), F.xxhash64("block")], "block")
    by_print = cut(names.select(fingerprint(F.col("block")).alias("print"), "name"), gather=True)
    if by_print.groupBy("print").count().where("count > 1").limit(1).count():
        placed = blocks.join(cut(names), "block")
    else:
        placed = blocks.withColumn("print", fingerprint(F.col("block"))).join(by_print, "print")
    now = cut(placed.select("doc_id", "sha", F.lit(1).cast("long").alias("copies"), F.col("n_blocks").alias("n"), "pos", "name"))
    release(by_print)
    done, level = [], 0
    longest = now.agg(F.max("n")).first()[0] or 0
    while True:
        done.append(now.where("n = 1").groupBy("doc_id", "sha", "name").agg(F.sum("copies").alias("copies")).select("doc_id", "sha", "copies", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        even = F.col("pos") % 2 == 0
        pairs = now.where("n > 1").groupBy("doc_id", "sha", ((F.col("n") + 1) / 2).cast("int").alias("n"), F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.sum(F.when(even, F.col("copies"))).alias("copies"),
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(ALONE)).alias("right"),
        )
        pairs = cut(pairs)
        names = cut(_named(pairs.select("left", "right"), [F.col("left"), F.xxhash64("right")], "left", "right"))
        now = cut(pairs.join(names, ["left", "right"]).select("doc_id", "sha", "copies", "n", "pos", "name"))
        release(pairs)
        release(names)
        longest, level = (longest + 1) // 2, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (of rows that are equal in doc_id too, one
    stays; nulls rank below every id).  Groups are summed before they meet, and those that hold many
    of the rows get their verdict by broadcast.
    """
    found = cut(identities(docs, block_bytes, id_col, text_col))
    verdict = cut(found.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    rows = join_classes(found, verdict, ["level", "name"], "group_size")
    rows = rows.select("doc_id", "sha", "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return rows.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    found = cut(identities(docs, block_bytes, id_col, text_col))
    keep = F.max(F.struct("doc_id", "sha")).alias("k")
    stay = found.groupBy("level", "name").agg(keep).select(F.col("k.doc_id").alias("_keep_id"), F.col("k.sha").alias("_keep_sha"))
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), sha.alias("_sha"))
    rows = packed.join(stay, F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_sha") == F.col("_keep_sha")), "left_semi")
    if found.where("copies > 1").limit(1).count():
        rows = rows.groupBy("_id", "_sha").agg(F.first("_row").alias("_row"))
    return rows.select("_row.*")
