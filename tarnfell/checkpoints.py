"""Cutting lineage through the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Files that were written within each open scope (see temporary), innermost last.
_scopes: list[list[str]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only where none is named and the master is local."""
    sc = spark.sparkContext
    if root := sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(root)
        return root
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="tarnfell-")
    sc.setCheckpointDir(root)
    return root


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df's rows, written to the shared folder and read back, without their lineage."""
    checkpoint_root(df.sparkSession)
    written = df.checkpoint(eager=True)
    if _scopes:
        _scopes[-1].append(_file(written))
    return written


def _file(written: DataFrame) -> str:
    return written._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()


def release(written: DataFrame) -> None:
    """Deletes what cut wrote, once nothing that is still to run reads it."""
    path = _file(written)
    for scope in _scopes:
        if path in scope:
            scope.remove(path)
    delete_path(written.sparkSession, path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was cut inside; what is wanted of it has been written or counted by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete_path(spark, path)
