"""Small helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell import checkpoints


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, gather: bool = False) -> DataFrame:
    """Materialise in the shared folder and forget the lineage (survives lost executors).

    gather: deal rows that are few bytes out of a wide step to files of a sensible size first.
    """
    return checkpoints.cut(df.hint("rebalance") if gather else df)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoints.checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Parts that a sample is gathered in; the driver holds one of them beside what it has taken.
SAMPLE_PARTS = 32


def gather_sample(rows: DataFrame, text: str, most_rows: int, most_bytes: int) -> list[tuple]:
    """Distinct rows, sorted, in an order of hashes until there are most_rows or most_bytes of text.

    Which rows these are depends on their content only, whatever ids repeat and however rows lie.
    """
    parts = rows.distinct().repartition(SAMPLE_PARTS, text).sortWithinPartitions(F.xxhash64(text), *rows.columns)
    at, out, weight = rows.columns.index(text), [], 0
    for row in parts.toLocalIterator():
        weight += len(row[at].encode())
        if len(out) == most_rows or weight > most_bytes:
            break
        out.append(tuple(row))
    return sorted(out)


#: A class with more than this share of all rows joins by broadcast; there are at most 1 / share such.
HOT_SHARE = 0.001


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows joined to their class (keys, ...; size says how many rows it has), whatever a class weighs.

    Both sides are read more than once, so they should be materialised.
    """
    total = classes.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) > HOT_SHARE * total
    hot, cold = F.broadcast(classes.where(is_hot)), classes.where(~is_hot)
    return rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys).unionByName(rows.join(hot, keys))


def join_salted(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, by: str) -> DataFrame:
    """join_classes for rows that are read once: a class of many rows is dealt out by the column ``by``.

    Its row in classes (materialised) is copied once for each HOT_SHARE of all rows that it has, so
    at most 2 / HOT_SHARE copies are made, and as many numbers of salts are broadcast at most.
    """
    share = max(1.0, HOT_SHARE * (classes.agg(F.sum(size)).first()[0] or 0))
    salts = F.ceil(F.col(size) / share).cast("int")
    hot = F.broadcast(classes.where(F.col(size) > share).select(*keys, salts.alias("_salts")))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copies = classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def held_out(doc_id, modulus: int, remainder: int):
    """crc32(doc_id as text) mod modulus == remainder; a null doc_id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder
