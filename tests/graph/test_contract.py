"""Contraction of edges to roots, in tables and in one task."""

import random

import pytest

from vgraph.kernels import components


def roots(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent if find(x) != x)


def test_contraction_against_plain_python(spark, monkeypatch):
    rng = random.Random(4)
    ids = rng.sample(range(-500, 10**6), 120)
    edges = list(zip(ids[:40], ids[1:41], strict=True))  # a long way
    edges += [(ids[50], x) for x in ids[51:70]] + [(ids[60], ids[60])]  # a star, and a loop
    edges += [(rng.choice(ids[70:]), rng.choice(ids[70:])) for _ in range(60)] + [(ids[80], ids[81])] * 3
    df = spark.createDataFrame([*edges, (None, 5)], "a bigint, b bigint")
    for limit in (500_000, 0):
        monkeypatch.setattr(components, "LOCAL_EDGES", limit)
        assert sorted(tuple(r) for r in components.contract(df).collect()) == roots(edges), limit


@pytest.mark.parametrize("leaves", [0, 3])
def test_contraction_writes_a_few_times_its_edges(spark, monkeypatch, leaves):
    monkeypatch.setattr(components, "LOCAL_EDGES", 64)
    rng = random.Random(6)
    ids = rng.sample(range(10**9), 2000)
    edges = list(zip(ids, ids[1:], strict=False)) + [(x, 10**9 + k * 5000 + i) for i, x in enumerate(ids) for k in range(leaves)]
    rng.shuffle(edges)
    written, keep = [], components.materialize

    def counted(df, name):
        out = keep(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(components, "materialize", counted)
    assert sorted(tuple(r) for r in components.contract(spark.createDataFrame(edges, "a bigint, b bigint").repartition(16)).collect()) == roots(edges)
    assert sum(written) < 7 * len(edges)
