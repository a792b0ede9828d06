from __future__ import annotations

from fractions import Fraction

import pytest

from pyspark.sql import functions as F

from tarnfell.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 0.9995, "b": 0.0005}, {"a": 0.7, "b": 0.2999, "c": 0.0001}])
def test_long_prefixes_keep_the_given_weights(spark, weights):
    sizes = {"a": 60_000, "b": 20_000, "c": 20_000}
    docs = spark.createDataFrame([(i, s) for s in weights for i in range(sizes[s])], "doc_id long, source string")
    order = [(r["source"], r["phase"]) for r in mixing.mix(docs, weights, block_rows=1).select("slot", "source", "phase").orderBy("slot").collect()]
    assert len(order) == sum(sizes[s] for s in weights)
    done, total = dict.fromkeys(weights, 0), sum(weights.values())
    for slot, s in enumerate((s for s, phase in order if phase == 0), 1):
        done[s] += 1
        assert all(abs(done[x] - slot * w / total) < 1 + 1e-6 for x, w in weights.items())
    assert sum(done.values()) > 50_000


@pytest.mark.parametrize("weights", [[1.0, 2.0], [1.0, 1e6], [2**0.5, 3.14159, 1e-3, 7.0], [0.1, 0.2, 0.3]])
def test_no_prefix_is_a_block_off_the_true_weights(weights):
    blocks = [20_000] * len(weights)
    total, done = sum(map(Fraction, weights)), [0] * len(weights)
    laid = mixing.schedule(blocks, weights)
    for slot, i in enumerate((i for i, phase in zip(laid["src"], laid["phase"]) if phase == 0), 1):
        done[i] += 1
        if slot % 7 == 1 or slot < 3000:
            assert all(abs(n * total - slot * Fraction(w)) < total for n, w in zip(done, weights))
    assert max(done) == 20_000


def check_whole(rows, n, block_rows):
    """Every row once, in blocks of one source that are full but for a source's last."""
    assert len(rows) == n == len({(r["slot"], r["place"]) for r in rows})
    sizes, of = {}, {}
    for r in rows:
        sizes[r["slot"]] = sizes.get(r["slot"], 0) + 1
        of.setdefault(r["slot"], (r["source"], r["block"]))
        assert of[r["slot"]] == (r["source"], r["block"])
    assert sorted(sizes) == list(range(len(sizes)))
    last = {}
    for s, b in of.values():
        last[s] = max(b, last.get(s, 0))
    assert all(size == block_rows or of[k][1] == last[of[k][0]] for k, size in sizes.items())


def test_rows_of_one_id_are_ordered_by_many_tasks(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.concat(F.lit("text "), "id").alias("text"), F.create_map(F.lit("k"), "id").alias("m"))
    rows = mixing.mix(df, bucket_rows=50).select("row.text", "source", "block", "slot", "place").collect()
    check_whole(rows, 9000, mixing.BLOCK_ROWS)
    assert len({r["text"] for r in rows}) == 9000
    packed = df.select(F.struct("doc_id", "text", "m").alias("row"), F.struct(F.col("source").alias("s")).alias("source"), F.lit(0).alias("_bucket"))
    sizes = [r["count"] for r in mixing._spread(packed, 50).groupBy("source", "_part").count().collect()]
    assert max(sizes) < 5 * 50 and sum(sizes) == 9000


def test_many_sources_and_few_blocks(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 1500).cast("string").alias("source"))
    check_whole(mixing.mix(df, block_rows=2).select("source", "block", "slot", "place").collect(), 6000, 2)
    wide = mixing.mix(df.withColumn("source", F.lit("one")), block_rows=2, max_blocks=10).select("source", "block", "slot", "place").collect()
    check_whole(wide, 6000, 600)  # larger blocks rather than more than max_blocks of them
