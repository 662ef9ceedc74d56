"""Sets of vertices as DataFrames with a column vid."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def of(graph: Graph, ids: Iterable[int]) -> DataFrame:
    """The given ids that are vertices of the graph."""
    return graph.spark.createDataFrame([(i,) for i in ids], "vid bigint").join(graph.vertices.select("vid"), "vid", "left_semi")


def everything(graph: Graph) -> DataFrame:
    return graph.vertices.select("vid")


def nothing(graph: Graph) -> DataFrame:
    return graph.vertices.select("vid").where(F.lit(False))


def insert(a: DataFrame, b: DataFrame) -> DataFrame:
    """A bag: what both hold, repeated ids kept."""
    return a.select("vid").unionByName(b.select("vid"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return insert(a, b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("vid").intersect(b.select("vid"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("vid").distinct().join(b.select("vid"), "vid", "left_anti")


def local(vertices: DataFrame, part: int, parts: int) -> DataFrame:
    """The vertices that a part owns."""
    return vertices.where(F.pmod("vid", F.lit(parts)) == part)
