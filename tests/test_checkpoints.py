from __future__ import annotations

import glob

from tarnfell.checkpoints import checkpoint_root, cut, release, temporary


def files(spark):
    return set(glob.glob(f"{checkpoint_root(spark).removeprefix('file:')}/**/part-*", recursive=True))


def test_what_was_cut_is_deleted(spark, tmp_path):
    before = files(spark)
    with temporary(spark):
        first = cut(spark.range(10))
        with temporary(spark):
            cut(first.where("id > 3"))
            last = cut(first.where("id > 5"))
            inner = files(spark) - before
            release(last)
            assert len(files(spark) - before) < len(inner)
        assert 0 < len(files(spark) - before) < len(inner)
        first.write.parquet(str(tmp_path / "kept"))
    assert files(spark) == before and spark.read.parquet(str(tmp_path / "kept")).count() == 10
    kept = cut(spark.range(3))
    assert len(files(spark)) > len(before) and kept.count() == 3
    release(kept)
    assert files(spark) == before
