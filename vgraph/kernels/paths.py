"""Breadth-first search and shortest paths; what is not reached is absent from results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Direction, Graph
from ..plans.program import Run, VertexProgram
from ..plans.search import search


def roots(graph: Graph, *ids: int) -> DataFrame:
    return graph.spark.createDataFrame([(i,) for i in ids], "vid bigint")


def bfs(graph: Graph, sources: DataFrame, direction: Direction = Direction.OUT, max_supersteps: int | None = None) -> Run:
    """vid, level, label (the smallest root that reaches it in as many steps), parent (the smallest neighbour one level nearer)."""
    program = VertexProgram(
        state={"level": F.when(F.col("_root"), 0).cast("bigint"), "label": F.when(F.col("_root"), F.col("vid")), "parent": F.lit(None).cast("bigint")},
        message={"m_level": F.col("level") + 1, "m_label": F.col("label"), "m_parent": F.col("vid")},
        combine={"c_level": F.min("m_level"), "c_label": F.min("m_label"), "c_parent": F.min("m_parent")},
        # messages of a round all have one level, so the first to come is final
        apply=lambda: {n: F.when(F.col("level").isNull(), F.col(f"c_{n}")).otherwise(F.col(n)) for n in ("level", "label", "parent")},
        activate=F.col("level").isNull(),
        direction=direction,
    )
    out = search(program, graph, sources, max_supersteps)
    return Run(out.state.where("level is not null").select("vid", "level", "label", "parent"), out.metrics, out.converged)


def sssp(graph: Graph, sources: DataFrame, weight: str | None = "w", direction: Direction = Direction.OUT, max_supersteps: int | None = None) -> Run:
    """vid, dist, pred: least sums of edge weights (of ones without a weight), and the smallest last vertex before it on such a way.

    Rounds go on until no vertex is active, unless ``max_supersteps`` caps them.  Weights must
    not be negative.  A source keeps distance zero and no predecessor.
    """
    kind = graph.edges.schema[weight].dataType.simpleString() if weight else "bigint"
    if kind in ("tinyint", "smallint", "int"):  # sums of whole numbers are longs, of others what the weights are
        kind = "bigint"
    elif kind == "float":
        kind = "double"
    step = F.col(weight).cast(kind) if weight else F.lit(1).cast(kind)
    better = F.col("dist").isNull() | (F.col("best.d") < F.col("dist"))
    equal = (F.col("best.d") == F.col("dist")) & (F.col("best.p") < F.col("pred"))
    program = VertexProgram(
        state={"dist": F.when(F.col("_root"), 0).cast(kind), "pred": F.lit(None).cast("bigint")},
        message={"offer": F.struct((F.col("dist") + step).cast(kind).alias("d"), F.col("vid").alias("p"))},
        combine={"best": F.min("offer")},  # the least distance, then the least sender
        apply=lambda: {"dist": F.when(better, F.col("best.d")).otherwise(F.col("dist")), "pred": F.when(better | equal, F.col("best.p")).otherwise(F.col("pred"))},
        activate=better,
        direction=direction,
    )
    out = search(program, graph, sources, max_supersteps)
    return Run(out.state.where("dist is not null").select("vid", "dist", "pred"), out.metrics, out.converged)
