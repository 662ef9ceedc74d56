"""Weakly and strongly connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Direction, Graph
from ..plans.program import Run, VertexProgram, run
from ..storage import materialize


def _roots(batches):
    """node, root for every node of the edges of a partition whose smallest reachable node is another."""
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    own = [(x, find(x)) for x in parent if find(x) != x]
    yield pa.record_batch([pa.array([a for a, _ in own], pa.int64()), pa.array([b for _, b in own], pa.int64())], ["node", "root"])


def contract(edges: DataFrame) -> DataFrame:
    """``edges``: two long columns.  Returns node, root for every node of an edge whose smallest reachable node, root, is another.

    A round moves every node to its least neighbour, or leaves it where it is less itself, and
    keeps the distinct edges between where their ends are now.  Ids are compared in the first
    round, which empties stars around small ids, and hashes with another salt in each later
    one; by these a constant share of the nodes goes in a round, so that all rounds together
    move a few times the edges.  Rests of LOCAL_EDGES edges are finished in one task.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    u, v = F.col("u"), F.col("v")
    now, hops = materialize(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges"), []
    while now.count() > LOCAL_EDGES:
        rank = (lambda x, salt=len(hops): F.struct(F.xxhash64(x, F.lit(salt)).alias("h"), x.alias("x"))) if hops else (lambda x: F.struct(x.alias("x")))
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        hop = both.groupBy("u").agg(F.min(rank(v)).alias("best")).select(u.alias("node"), F.least("best", rank(u))["x"].alias("next"))
        hops.append(hop := materialize(hop, "hop"))
        ends = [hop.select(F.col("node").alias(c), F.col("next").alias(f"{c}_next")) for c in "uv"]
        moved = now.join(ends[0], "u").join(ends[1], "v").where("u_next != v_next")
        now = materialize(moved.select(F.greatest("u_next", "v_next").alias("u"), F.least("u_next", "v_next").alias("v")).distinct(), "edges")
    roots = materialize(now.coalesce(1).mapInArrow(_roots, "node bigint, root bigint"), "roots")
    if not hops:
        return roots
    for hop in reversed(hops):
        roots = hop.join(roots.select(F.col("node").alias("next"), "root"), "next", "left").select("node", F.coalesce("root", "next").alias("root"))
    roots = materialize(roots, "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return roots.join(least, "root").where("node != least").select("node", F.col("least").alias("root"))


def weak(graph: Graph) -> DataFrame:
    """vid, component: the smallest id of its weakly connected component; isolated vertices are their own."""
    roots = contract(graph.edges.select("src", "dst"))
    return graph.vertices.select("vid").join(roots, F.col("vid") == F.col("node"), "left").select("vid", F.coalesce("root", "vid").alias("component"))


def min_label(graph: Graph, direction: Direction = Direction.BOTH, max_supersteps: int | None = None) -> Run:
    """vid, component by passing on labels: along one direction the smallest id that reaches it, both ways its weak component."""
    program = VertexProgram(
        state={"component": F.col("vid")},
        message={"label": F.col("component")},
        combine={"least": F.min("label")},
        apply=lambda: {"component": F.least("component", "least")},
        activate=F.col("least") < F.col("component"),
        direction=direction,
    )
    return run(program, graph, max_supersteps=max_supersteps)


def sizes(labels: DataFrame) -> DataFrame:
    """component, vertices."""
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("vertices"))


def count(labels: DataFrame) -> DataFrame:
    """components: how many vertices are the smallest of their component."""
    return labels.agg(F.count_if(F.col("component") == F.col("vid")).alias("components"))


#: Edges of a rest that one task finishes by itself.
LOCAL_EDGES = 500_000


def _strong_here(batches):
    """node, root of all nodes of the edges of one partition: two depth-first passes, the second against the edges."""
    ends = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches), strict=True)] or [np.zeros(0, np.int64)] * 2
    ids, flat = np.unique(np.concatenate(ends), return_inverse=True)
    src, dst = flat[: len(ends[0])], flat[len(ends[0]) :]

    def lists(near, far):
        order = np.argsort(near, kind="stable")
        return np.searchsorted(near[order], np.arange(len(ids) + 1)).tolist(), far[order].tolist()

    start, after = lists(src, dst)
    at, seen, done = list(start[:-1]), bytearray(len(ids)), []
    for v in range(len(ids)):
        if seen[v]:
            continue
        seen[v], path = 1, [v]
        while path:
            x = path[-1]
            if at[x] < start[x + 1]:
                y = after[at[x]]
                at[x] += 1
                if not seen[y]:
                    seen[y] = 1
                    path.append(y)
            else:
                done.append(path.pop())
    start, before = lists(dst, src)
    root = [-1] * len(ids)
    for v in reversed(done):
        if root[v] < 0:
            root[v], todo, own = v, [v], [v]
            while todo:
                x = todo.pop()
                for y in before[start[x] : start[x + 1]]:
                    if root[y] < 0:
                        root[y] = v
                        todo.append(y)
                        own.append(y)
            least = min(own)
            for y in own:
                root[y] = least
    yield pa.record_batch([pa.array(ids), pa.array(ids[np.array(root, np.int64)] if len(ids) else ids)], ["vid", "component"])


def strong(graph: Graph) -> DataFrame:
    """vid, component: the smallest id of its strongly connected component, by forward and backward colouring.

    Each turn takes off vertices without an edge to or from others left, which are components
    of their own, layer by layer while that takes many; then it colours the rest with the
    smallest id that reaches each, and finds what in each colour reaches back to the vertex
    that gave it: one component of every colour.  What is left with LOCAL_EDGES edges or fewer
    is finished in one task.
    """
    left, found = graph.vertices.select("vid"), graph.vertices.sparkSession.createDataFrame([], "vid bigint, component bigint")
    edges = materialize(graph.edges.select("src", "dst").where("src != dst").distinct(), "scc-edges")
    while True:
        n = edges.count()
        while n > LOCAL_EDGES:
            both = edges.select(F.col("src").alias("vid")).intersect(edges.select(F.col("dst").alias("vid")))
            linked = materialize(both, "linked")
            fewer = materialize(_between(edges, linked), "scc-edges")
            found = found.unionByName(left.join(linked, "vid", "left_anti").select("vid", F.col("vid").alias("component")))
            left, edges, before, n = linked, fewer, n, fewer.count()
            if n > 0.9 * before:
                break
        if n <= LOCAL_EDGES:
            here = materialize(edges.coalesce(1).mapInArrow(_strong_here, "vid bigint, component bigint"), "strong")
            alone = left.join(here.select("vid"), "vid", "left_anti").select("vid", F.col("vid").alias("component"))
            return materialize(found.unionByName(here).unionByName(alone), "strong")
        now = Graph(left, edges)
        colours = materialize(min_label(now, Direction.OUT).state, "colours")
        a, b = colours.select(F.col("vid").alias("src"), F.col("component").alias("a")), colours.select(F.col("vid").alias("dst"), F.col("component").alias("b"))
        same = Graph(left, edges.join(a, "src").join(b, "dst").where("a = b").select("src", "dst"))
        reach = VertexProgram(
            state={"found": F.col("component") == F.col("vid")},
            message={"m": F.lit(1)},
            combine={"n": F.count("m")},
            apply=lambda: {"found": F.lit(True)},
            activate=~F.col("found"),
            active=F.col("component") == F.col("vid"),
            direction=Direction.IN,
        )
        done = run(reach, same, vertices=colours).state.where("found").select("vid", "component")
        found = materialize(found.unionByName(done), "found")
        now.unpersist(), same.unpersist()
        left = materialize(left.join(found, "vid", "left_anti"), "rest")
        edges = materialize(_between(edges, left), "scc-edges")


def _between(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The edges both of whose ends are among the vertices."""
    return edges.join(vertices.select(F.col("vid").alias("src")), "src", "left_semi").join(vertices.select(F.col("vid").alias("dst")), "dst", "left_semi").select("src", "dst")
