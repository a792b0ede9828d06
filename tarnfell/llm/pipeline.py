"""Corpus pipeline: documents in, token ids of the kept and mixed documents out.

Stages, in order: language identification (rejected documents go), exact dedup (of equal texts the
largest doc_id stays), n-gram Jaccard join (of each group of near copies the smallest doc_id
stays), mixing sources to target weights (rows and files in training order) and SentencePiece
encoding.  Each stage reads what the one before wrote as Parquet; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.checkpoints import delete_path, temporary

from . import exact_dedup, language_id, mixing, ngram_join, sentencepiece_codec
from .common import held_out, scratch_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose language the model rejects; it learns as the query op4 does."""
    return language_id.keep_known(docs, language_id.fit(docs, ~held_out(F.col("doc_id"), 3, 1)))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces and the scores of the n best segmentations, in the order of docs."""
    made = sentencepiece_codec.encode(docs)
    return made.select("doc_id", "ids", F.size("ids").alias("n_pieces"), F.transform("n_best", lambda p: p["score"]).alias("n_best_scores"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("ngram_jaccard", no_near_copies),
    ("mix_sources", mixed_sources),
    ("sentencepiece", encoded),
]

#: SQL can't express the language model; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote is deleted once the next one is written, the last table stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
