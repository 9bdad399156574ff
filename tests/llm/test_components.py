"""Connected components against union-find in plain Python, with and without the contraction inside tasks."""

import random

import pytest

from tessitura.llm import components as module
from tessitura.llm.shared import written


def classes(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def graphs():
    chance = random.Random(5)
    yield []
    yield [(1, 1), (2, 2)]
    yield [(1, 2)] * 20 + [(2, 1)] * 20
    # a path, a hub above its neighbours and one below, and scattered edges, in one table
    path = [(i, i + 1) for i in range(40)]
    hubs = [(1000, 100 + i) for i in range(60)] + [(1000, 2000), (-5, 2000)] + [(-9, 3000 + i) for i in range(60)]
    yield chance.sample(path + hubs, len(path + hubs)) + [(chance.randrange(5000, 5200), chance.randrange(5000, 5200)) for _ in range(90)]


@pytest.mark.parametrize("contract", [True, False])
def test_components(spark, monkeypatch, contract):
    if not contract:
        monkeypatch.setattr(module, "contracted", lambda edges: edges)
    for edges in graphs():
        before = written()
        rows = [tuple(r) for r in module.components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()]
        assert sorted(rows) == sorted(classes(edges).items())
        assert written() == before + 1
