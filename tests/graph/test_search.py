"""Searches by the driver's rounds, by tables, and from one to the other."""

import random

import pytest
from pyspark.sql import functions as F

from vgraph.graph import Direction, Graph
from vgraph.kernels import betweenness, pagerank, paths
from vgraph.plans import search as plan


def graph(spark, edges, n=None):
    return Graph.from_edges(spark.createDataFrame(edges, "src bigint, dst bigint, w bigint"), n)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def reached(edges, roots):
    """dist, pred of shortest ways and level, paths of searches, in plain Python."""
    dist, level = {r: (0, None) for r in roots}, {r: (0, 1) for r in roots}
    for _ in range(60):
        best = dict(dist)
        for s, d, w in edges:
            if s in dist and (d not in best or (dist[s][0] + w, s) < (best[d][0], best[d][1] if best[d][1] is not None else -1)):
                best[d] = (dist[s][0] + w, s)
        dist = best
    step = 0
    while True:
        new = {}
        for s, d, _ in edges:
            if s in level and level[s][0] == step and d not in level:
                new[d] = (step + 1, new.get(d, (0, 0))[1] + level[s][1])
        if not new:
            return sorted((v, *x) for v, x in dist.items()), sorted((v, *x) for v, x in level.items())
        level |= new
        step += 1


@pytest.mark.parametrize("frontier, held", [(10_000, 100_000), (0, 100_000), (6, 2)])
def test_rounds_of_all_kinds_give_the_same(spark, monkeypatch, frontier, held):
    monkeypatch.setattr(plan, "FRONTIER", frontier)
    monkeypatch.setattr(plan, "HELD", held)
    rng = random.Random(7)
    # a long way, then a dense region, then a long way
    edges = [(k, k + 1, 2) for k in range(6)] + [(rng.randrange(6, 16), rng.randrange(6, 16), rng.randint(1, 9)) for _ in range(30)] + [(15, 16, 1), (16, 17, 1), (17, 18, 1), (18, 0, 1), (20, 21, 1), (7, 7, 1)]
    edges += [(6, 15, 40), (6, 15, 40)]
    g = graph(spark, edges)
    dist, level = reached(edges, [0])
    assert rows(paths.sssp(g, paths.roots(g, 0)).state) == dist
    assert rows(betweenness.forward(g, paths.roots(g, 0)).state) == level
    found = paths.bfs(g, paths.roots(g, 0))
    assert rows(found.state.select("vid", "level")) == [(v, x) for v, x, _ in level]
    assert found.converged and found.metrics[-1]["active"] == 0
    assert sum(m["messages"] for m in found.metrics) == sum(s in {v for v, *_ in level} for s, _, _ in edges)
    both = reached([*edges, *[(d, s, w) for s, d, w in edges]], [3, 20])[1]
    assert rows(paths.bfs(g, paths.roots(g, 3, 20, 99), Direction.BOTH).state.select("vid", "level")) == [(v, x) for v, x, _ in both]
    capped = paths.bfs(g, paths.roots(g, 0), max_supersteps=2)
    assert not capped.converged and rows(capped.state.select("vid", "level")) == [(0, 0), (1, 1), (2, 2)]


def test_a_search_writes_no_table_while_its_frontier_is_small(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a table of states is written")

    monkeypatch.setattr(plan, "bucketed", never)
    g = graph(spark, [(k, k + 1, 1) for k in range(12)], 1_000_000)
    assert rows(paths.bfs(g, paths.roots(g, 5)).state.select("vid", "level")) == [(k, k - 5) for k in range(5, 13)]


@pytest.mark.parametrize("frontier", [10_000, 0])
def test_a_search_stays_among_the_vertices(spark, monkeypatch, frontier):
    monkeypatch.setattr(plan, "FRONTIER", frontier)
    edges = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (0, -1, 1)]
    g = graph(spark, edges, 3)
    assert rows(paths.sssp(g, paths.roots(g, 0, 7)).state) == [(0, 0, None), (1, 1, 0), (2, 2, 1)]
    sparse = Graph(spark.createDataFrame([(0,), (1,), (3,)], "vid bigint"), g.edges)
    assert rows(paths.bfs(sparse, paths.roots(g, 0, 2)).state.select("vid", "level")) == [(0, 0), (1, 1)]
    empty = graph(spark, [], 2)
    assert rows(paths.bfs(empty, paths.roots(empty, 0)).state.select("vid")) == [(0,)]
    assert rows(paths.bfs(g, paths.roots(g, 0).where(F.lit(False))).state) == []


def test_edges_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 3, 1), (5, 6, 1)], "src bigint, dst bigint, w bigint")
    g = Graph.from_edges(df.mapInArrow(lambda bs: ((seen.add(b.num_rows), b)[1] for b in bs), df.schema), 7)
    assert rows(betweenness.dependency(g, paths.roots(g, 0)).state) == [(0, 3.0), (1, 2.0), (2, 1.0), (3, 0.0), (4, 0.0), (5, 0.0), (6, 0.0)]
    assert seen.value == 4
    pagerank.pagerank_power(g, 1).state.count()
    assert seen.value == 4
