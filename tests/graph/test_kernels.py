"""Kernels on graphs small enough to know the answer."""

import random

import pytest
from pyspark.sql import functions as F

from vgraph import queries
from vgraph.errors import NotConverged
from vgraph.graph import Direction, Graph
from vgraph.kernels import betweenness, components, degree, pagerank, paths
from vgraph.operators import traversal, vertex_sets
from vgraph.plans import program
from vgraph.plans.program import VertexProgram, run

PATH4 = [(0, 1, 1), (1, 2, 1), (2, 3, 1)]
DIAMOND = [(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 1)]
MULTI = [(0, 1, 1), (0, 1, 1), (1, 1, 1)]
CYCLE3 = [(0, 1, 1), (1, 2, 1), (2, 0, 1)]
WEIGHTS = [(0, 1, 5), (0, 2, 1), (2, 1, 1)]


def graph(spark, edges, n=None):
    return Graph.from_edges(spark.createDataFrame(edges, "src bigint, dst bigint, w bigint"), n)


def by_vid(df, *columns):
    rows = df.collect()
    out = {r.vid: (r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns)) for r in rows}
    assert len(out) == len(rows)
    return out


def test_path(spark):
    g = graph(spark, PATH4)
    root = paths.roots(g, 0)
    assert by_vid(paths.bfs(g, root).state, "level", "parent") == {0: (0, None), 1: (1, 0), 2: (2, 1), 3: (3, 2)}
    assert by_vid(betweenness.dependency(g, root).state, "delta") == {0: 3, 1: 2, 2: 1, 3: 0}
    ranks = by_vid(pagerank.pagerank_delta(g, 10).state, "pr")
    assert [round(ranks[k], 10) for k in range(4)] == [0.15, 0.2775, 0.385875, 0.47799375]
    assert by_vid(paths.bfs(g, paths.roots(g, 3), Direction.IN).state, "level") == {3: 0, 2: 1, 1: 2, 0: 3}


def test_diamond(spark):
    g = graph(spark, DIAMOND)
    root = paths.roots(g, 0)
    assert by_vid(betweenness.forward(g, root).state, "level", "paths") == {0: (0, 1), 1: (1, 1), 2: (1, 1), 3: (2, 2)}
    assert by_vid(betweenness.dependency(g, root).state, "delta") == {0: 3.0, 1: 0.5, 2: 0.5, 3: 0.0}


def test_parallel_edges_and_loops_count(spark):
    g = graph(spark, MULTI)
    assert by_vid(degree.degree(g), "degree") == {0: 2, 1: 1}
    assert by_vid(degree.degree(g, Direction.BOTH), "degree") == {0: 2, 1: 4}
    assert by_vid(betweenness.forward(g, paths.roots(g, 0)).state, "paths")[1] == 2
    assert by_vid(traversal.scatter_step(g, F.lit(1), Direction.BOTH), "value") == {0: 2, 1: 4}
    assert g.symmetrize().edges.where("src = 1 and dst = 1").count() == 2
    assert degree.edge_totals(g).first().asDict() == {"out_edges": 3, "in_edges": 3}
    assert [tuple(r) for r in g.simple().edges.collect()] == [(0, 1)]


def test_islands_keep_isolated_vertices(spark):
    g = graph(spark, [(0, 1, 1), (3, 2, 1)], 6)
    weak = components.weak(g)
    assert by_vid(weak, "component") == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}
    assert components.count(weak).first()[0] == 4
    assert by_vid(components.min_label(g).state, "component") == by_vid(weak, "component")
    assert {r.component: r.vertices for r in components.sizes(weak).collect()} == {0: 2, 2: 2, 4: 1, 5: 1}


def test_cycle(spark):
    g = graph(spark, CYCLE3)
    delta = pagerank.pagerank_delta(g, 1024)
    assert all(abs(x - 0.99995) < 2e-5 for x in by_vid(delta.state, "pr").values())
    assert delta.metrics[-1]["active"] == 0
    assert all(abs(x - 0.2775) < 1e-12 for x in by_vid(pagerank.pagerank_frozen(g), "pr").values())
    assert abs(pagerank.total(pagerank.pagerank_power(g, 60).state).first()[0] - 3) < 1e-3
    assert set(by_vid(components.strong(g), "component").values()) == {0}


def test_shortest_paths(spark):
    g = graph(spark, WEIGHTS)
    root = paths.roots(g, 0)
    assert by_vid(paths.sssp(g, root).state, "dist", "pred") == {0: (0, None), 1: (2, 2), 2: (1, 0)}
    assert by_vid(paths.sssp(g, root, max_supersteps=1).state, "dist")[1] == 5
    assert by_vid(paths.sssp(g, root, None).state, "dist") == {0: 0, 1: 1, 2: 1}


def test_paths_longer_than_any_default_cap(spark, monkeypatch):
    g = graph(spark, [(k, k + 1, 2) for k in range(140)])
    assert by_vid(paths.sssp(g, paths.roots(g, 0)).state, "dist") == {k: 2 * k for k in range(141)}
    # the bound of programs that never rest is not one of searches
    monkeypatch.setattr(program, "MAX_SUPERSTEPS", 3)
    short = graph(spark, [(k, k + 1, 2) for k in range(6)])
    assert len(by_vid(paths.sssp(short, paths.roots(short, 0)).state, "dist")) == 7


@pytest.fixture(params=[500_000, 10, 0])
def local_edges(request, monkeypatch):
    """How much of a graph one task may finish: all, a little, nothing."""
    monkeypatch.setattr(components, "LOCAL_EDGES", request.param)


def test_strong_components(spark, local_edges):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 4), (6, 6)]
    g = graph(spark, [(a, b, 1) for a, b in edges])
    assert by_vid(components.strong(g), "component") == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6}


def test_strong_components_against_brute_force(spark, local_edges):
    rng = random.Random(2)
    for n, m in ((12, 20), (25, 40)):
        edges = [(rng.randrange(n), rng.randrange(n), 1) for _ in range(m)]
        reach = [{k} for k in range(n)]
        for _ in range(n):
            for a, b, _ in edges:
                reach[a] |= reach[b]
        want = {k: min(x for x in reach[k] if k in reach[x]) for k in range(n)}
        assert len(set(want.values())) not in (1, n)
        assert by_vid(components.strong(graph(spark, edges, n)), "component") == want


def test_strong_components_are_registered_over_a_whole_graph(spark):
    sf = "/root/testdata/sf0.001"
    ids = {r.vid for r in queries._next(spark, sf).vertices.collect()}
    assert set(by_vid(queries.QUERIES["scc_next"](spark, sf), "component")) == ids


def test_strong_components_of_long_cycles(spark, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_EDGES", 20)
    edges = [(k, (k + 1) % 40, 1) for k in range(40)] + [(100 + k, 100 + (k * 7 + 7) % 91, 1) for k in range(91)]
    got = by_vid(components.strong(graph(spark, edges)), "component")
    assert {got[k] for k in range(40)} == {0}
    reach = {k: {k} for k in range(100, 191)}
    for _ in range(95):
        for a, b, _w in edges[40:]:
            reach[a] |= reach[b]
    assert all(got[k] == min(x for x in reach[k] if k in reach[x]) for k in reach)


def test_registered_strong_components_against_brute_force(spark):
    """Over all orders: the components of a closure walked in plain Python."""
    sf = "/root/testdata/sf0.001"
    g = queries._orders(spark, sf)
    after = {}
    for r in g.edges.collect():
        after.setdefault(r.src, set()).add(r.dst)

    def reached(v):
        seen, todo = {v}, [v]
        while todo:
            for x in after.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    near = {v: reached(v) for v in after}
    want = {r.vid: min([r.vid, *(x for x in near.get(r.vid, ()) if r.vid in near.get(x, ()))]) for r in g.vertices.collect()}
    assert by_vid(queries.QUERIES["scc"](spark, sf), "component") == want


def test_placed_and_spread_graphs_give_the_same(spark):
    rng = random.Random(3)
    edges = [(rng.choice([0, rng.randrange(30)]), rng.randrange(30), rng.randint(1, 9)) for _ in range(150)]
    g = graph(spark, edges, 30)
    assigned = g.edges.withColumn("part", F.pmod(F.xxhash64("src", "dst"), F.lit(3)).cast("int"))
    for other in (g.placed(assigned), g.spread_hubs(4, 20)):
        assert other.edges.count() == 150 and other.edges.select("part").distinct().count() > 1
        for way in Direction:
            assert by_vid(traversal.scatter_step(other, F.col("vid"), way), "value") == by_vid(traversal.scatter_step(g, F.col("vid"), way), "value")
        assert by_vid(paths.sssp(other, paths.roots(g, 0)).state, "dist", "pred") == by_vid(paths.sssp(g, paths.roots(g, 0)).state, "dist", "pred")
        assert by_vid(traversal.scatter_step(other.symmetrize(), F.lit(1), Direction.OUT), "value") == by_vid(traversal.scatter_step(g, F.lit(1), Direction.BOTH), "value")


def test_names_get_dense_numbers(spark):
    e = spark.createDataFrame([("b", "a", 1), ("c", "b", 2), ("ä", "c", 3), (None, "x", 4)], "src string, dst string, w bigint")
    g, names = Graph.from_names(e)
    assert {r.name: r.vid for r in names.collect()} == {"a": 0, "b": 1, "c": 2, "ä": 3}
    assert sorted(tuple(r) for r in g.edges.collect()) == [(1, 0, 1), (2, 1, 2), (3, 2, 3)] and g.vertices.count() == 4
    sparse, names = Graph.from_names(spark.createDataFrame([(10**15, -5), (7, 10**15)], "src bigint, dst bigint"))
    assert sorted((r.name, r.vid) for r in names.collect()) == [(-5, 0), (7, 1), (10**15, 2)]


def test_edges_of_vertex_zero_only(spark):
    g = graph(spark, [(0, 0, 1)])
    assert g.vertices.count() == 1 and by_vid(degree.degree(g, Direction.BOTH), "degree") == {0: 2}


def test_fractional_weights(spark):
    g = Graph.from_edges(spark.createDataFrame([(0, 1, 0.75), (0, 2, 0.25), (2, 1, 0.25)], "src bigint, dst bigint, w double"))
    assert by_vid(paths.sssp(g, paths.roots(g, 0)).state, "dist") == {0: 0.0, 1: 0.5, 2: 0.25}


def test_hooks_and_what_a_run_leaves(spark):
    g = graph(spark, PATH4)
    p = VertexProgram(
        state={"n": F.when(F.col("vid") == 0, 0)}, message={"m": F.col("n") + 1}, combine={"c": F.min("m")}, apply=lambda: {"n": F.coalesce("n", "c")}, activate=F.col("n").isNull(), active=F.col("vid") == 0,
        aggregate={"known": F.count("n")}, output_statistics=lambda df: {"largest": df.agg(F.max("n")).first()[0]},
    )
    out = run(p, g)
    assert out.converged and out.output == {"largest": 3}
    assert [(m["active"], m["known"], m["messages"], m["combined"]) for m in out.metrics] == [(1, 2, 1, 1), (1, 3, 1, 1), (1, 4, 1, 1), (0, 4, 0, 0)]
    short = run(p, g, max_supersteps=2)
    assert not short.converged and short.output == {"largest": 2}
    with pytest.raises(NotConverged):
        run(p, g, max_supersteps=2, must_converge=True)


def test_relabelling_permutes_and_partitions_do_not_matter(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(30), rng.randrange(30), rng.randint(1, 9)) for _ in range(60)]
    move = list(range(30))
    rng.shuffle(move)
    a, b = graph(spark, edges, 30), graph(spark, [(move[s], move[d], w) for s, d, w in edges], 30)
    da = by_vid(paths.sssp(a, paths.roots(a, 0)).state, "dist")
    db = by_vid(paths.sssp(b, paths.roots(b, move[0])).state, "dist")
    assert {move[k]: v for k, v in da.items()} == db
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        c = graph(spark, edges[::-1], 30)
        assert by_vid(paths.sssp(c, paths.roots(c, 0)).state, "dist") == da
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_program_rules(spark):
    g = graph(spark, PATH4)
    with pytest.raises(NotImplementedError):
        run(VertexProgram(), g)
    # vertices that do not halt send again each round; the cap ends it
    p = VertexProgram(state={"n": F.lit(0)}, message={"m": F.lit(1)}, combine={"c": F.sum("m")}, apply=lambda: {"n": (F.col("n") + F.col("c")).cast("int")}, halt=False)
    out = run(p, g, max_supersteps=3)
    assert out.supersteps == 3 and by_vid(out.state, "n") == {0: 0, 1: 3, 2: 3, 3: 3}
    # sources send whatever ``active`` says, and only they
    p.active, p.halt = F.lit(False), True
    seen = []
    p.on_superstep = lambda df: seen.append(df.count()) or {"rows": seen[-1]}
    out = run(p, g, vertex_sets.of(g, [1, 99]))
    assert by_vid(out.state, "n") == {0: 0, 1: 0, 2: 1, 3: 0} and out.metrics[0]["rows"] == 4
    assert run(p, g).supersteps == 1  # nobody is active


def test_empty_graph(spark):
    g = graph(spark, [], 3)
    assert by_vid(pagerank.pagerank_frozen(g), "pr") == {0: 0.15, 1: 0.15, 2: 0.15}
    assert by_vid(components.weak(g), "component") == {0: 0, 1: 1, 2: 2}
    assert Graph.from_edges(g.edges).vertices.count() == 0
