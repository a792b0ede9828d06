"""The pipeline: registered, its stages take effect, and its result is that of a brute-force version."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tarnfell.llm import language_id, mixing
from tarnfell.llm import sentencepiece_codec as codec
from tarnfell.llm.common import held_out

from .test_dedup_ops import components


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    import random

    rng = random.Random(9)
    vocabulary = {"aa": ["thing", "other", "there", "with"], "bb": ["schung", "einer", "weiß", "lich"]}
    rows = []
    for k in range(120):
        lang = rng.choice(["aa", "bb"])
        text = " ".join(rng.choice(vocabulary[lang]) + str(rng.randrange(50)) for _ in range(rng.randrange(12, 60)))
        if k % 9 == 5:
            text = rows[-1][1]
        if k % 9 == 6 and len(text := rows[-1][1] or "") > 150:
            text += " tail"
        rows.append((k * 3, text if k % 31 else "12 34 !!", lang if k % 4 else None, f"src{k % 3 * k % 5}", 7))
    rows += [(1000, None, None, None, None), (1001, "", "aa", "src1", 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    return str(path), rows


def test_pipeline_against_brute_force(spark, documents):
    sf_dir, rows = documents
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs, ~held_out(F.col("doc_id"), 3, 1))
    rejected = {r["doc_id"] for r in language_id.predict(docs, model).where("rejected").collect()}
    assert {1000, 1001, 0} <= rejected and len(rejected) < 15
    left = [r for r in rows if r[0] not in rejected]
    last: dict[str, int] = {}
    for r in left:
        last[r[1]] = max(r[0], last.get(r[1], -1))
    left = [r for r in left if last[r[1]] == r[0]]
    left = [r for r, (i, _, c) in zip(left, components([(r[0], r[1]) for r in left])) if c == i]
    assert len(left) < len(rows) - len(rejected) - 10
    got = corpus_pipeline.run(spark, sf_dir).collect()
    vocabulary = codec.Vocabulary.load(codec.MODEL_PATH)
    assert {r["doc_id"]: codec.decode_ids(vocabulary, r["ids"]) for r in got} == {r[0]: r[1] for r in left}
    assert all(r["n_pieces"] == len(r["ids"]) and list(r["n_best_scores"]) == sorted(r["n_best_scores"], reverse=True) for r in got)
    mixed = mixing.mix(spark.createDataFrame([(r[0], r[3]) for r in left], "doc_id long, source string")).orderBy("slot", "place")
    assert [r["doc_id"] for r in got] == [r["row"]["doc_id"] for r in mixed.collect()]


def test_stages_return_the_columns_of_documents(spark, documents):
    sf_dir, _ = documents
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 11))
