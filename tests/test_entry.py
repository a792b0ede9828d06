"""The driver contract, with and without the optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from tarnfell.plans import catalog

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.skipif(not os.path.isdir(__spark_entry__.SMOKE_DIR), reason="the driver's tables are not here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_imports_without_the_optional_subpackage(tmp_path, gone):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    told = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert told.stdout.split() == sorted(catalog.queries())


def test_the_library_does_not_use_the_optional_subpackage():
    for top, _, files in os.walk(os.path.join(REPO, "tarnfell")):
        if "llm" not in os.path.relpath(top, REPO).split(os.sep):
            for name in files:
                if name.endswith(".py"):
                    with open(os.path.join(top, name)) as file:
                        assert "llm" not in file.read(), name
