"""Betweenness dependencies of one source: path counts forward by level, dependencies backward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Direction, Graph
from ..plans.program import Run, VertexProgram, run
from ..plans.search import search


def forward(graph: Graph, sources: DataFrame, max_supersteps: int | None = None) -> Run:
    """vid, level, paths of reached vertices: how many shortest ways there are, parallel edges counted each."""
    new = F.col("level").isNull()
    program = VertexProgram(
        state={"level": F.when(F.col("_root"), 0).cast("bigint"), "paths": F.when(F.col("_root"), 1).cast("bigint")},
        message={"m_level": F.col("level") + 1, "m_paths": F.col("paths")},
        combine={"c_level": F.min("m_level"), "c_paths": F.sum("m_paths")},
        apply=lambda: {"level": F.when(new, F.col("c_level")).otherwise(F.col("level")), "paths": F.when(new, F.col("c_paths")).otherwise(F.col("paths"))},
        activate=new,
    )
    out = search(program, graph, sources, max_supersteps)
    return Run(out.state.where("level is not null").select("vid", "level", "paths"), out.metrics)


def backward(graph: Graph, reached: DataFrame) -> Run:
    """vid, level, paths, delta: each vertex's share in shortest ways from the source; the source's own included.

    One round for each level from the deepest: a vertex of level k gets from those of level k + 1.
    """
    deepest = reached.agg(F.max("level")).first()[0] or 0
    state, metrics = reached.withColumn("delta", F.lit(0.0)), []
    for level in range(deepest - 1, -1, -1):
        step = VertexProgram(
            message={"share": (1 + F.col("delta")) / F.col("paths")},
            combine={"mass": F.sum("share")},
            apply=lambda level=level: {"delta": F.when(F.col("level") == level, F.col("paths") * F.col("mass")).otherwise(F.col("delta"))},
            active=F.col("level") == level + 1,
            direction=Direction.IN,
        )
        done = run(step, graph, max_supersteps=1, vertices=state)
        state = done.state
        metrics += done.metrics
    return Run(state, metrics)


def dependency(graph: Graph, sources: DataFrame) -> Run:
    """vid, delta over all vertices; those not reached have zero."""
    ahead = forward(graph, sources)
    # only edges out of reached vertices are laid out a second time
    from_reached = graph.by("src").join(ahead.state.select(F.col("vid").alias("src")), "src", "left_semi").select(graph.edges.columns)
    back = backward(Graph(graph.vertices, from_reached, graph.placement), ahead.state)
    found = back.state.select(F.col("vid").alias("_v"), "delta")
    out = graph.vertices.select("vid").join(found, F.col("vid") == F.col("_v"), "left").select("vid", F.coalesce("delta", F.lit(0.0)).alias("delta"))
    return Run(out, ahead.metrics + back.metrics)
