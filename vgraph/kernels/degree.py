"""Degrees and edge totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Direction, Graph


def degree(graph: Graph, direction: Direction = Direction.OUT) -> DataFrame:
    """vid, degree of every vertex; both ways a self-loop counts twice."""
    ends = {Direction.OUT: ["src"], Direction.IN: ["dst"], Direction.BOTH: ["src", "dst"]}[direction]
    e = graph.edges.select(F.explode(F.array(*ends)).alias("to")) if len(ends) > 1 else graph.edges.select(F.col(ends[0]).alias("to"))
    n = e.groupBy("to").agg(F.count(F.lit(1)).alias("n"))
    return graph.vertices.select("vid").join(n, F.col("vid") == F.col("to"), "left").select("vid", F.coalesce("n", F.lit(0)).alias("degree"))


def edge_totals(graph: Graph) -> DataFrame:
    """out_edges, in_edges: the sums of both degrees, which agree."""
    out = degree(graph, Direction.OUT).agg(F.sum("degree").alias("out_edges"))
    return out.crossJoin(degree(graph, Direction.IN).agg(F.sum("degree").alias("in_edges")))
