"""Connected components: both ways give those of a union-find, and few edges take few steps of the driver."""

from __future__ import annotations

import random

import pytest

from tarnfell.llm import graph


def edges():
    rng = random.Random(3)
    path = [(k, k + 1) for k in range(100, 400)]
    star = [(-(1 << 62), k) for k in range(1000, 1200)]
    return [*path, *star, *((rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(130)), (7, 7), (9, 8), (8, 9), (8, 9)]


def expected(pairs):
    root = {x: x for e in pairs if e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in root)


@pytest.mark.parametrize("most", [graph.ONE_TASK_EDGES, 0])
def test_components_against_union_find(spark, most):
    found = graph.components(spark.createDataFrame(edges(), "a long, b long"), most).collect()
    assert sorted((r["node"], r["root"]) for r in found) == expected(edges())
    assert graph.components(spark.createDataFrame([(5, 5)], "a long, b long"), most).count() == 0


def test_few_edges_are_written_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(graph, "cut", lambda df: made.append(1) or df.localCheckpoint())
    monkeypatch.setattr(graph, "release", lambda df: None)
    graph.components(spark.createDataFrame(edges(), "a long, b long")).collect()
    assert len(made) == 1
