"""PageRank, un-normalised: scores sum to about the number of vertices; mass of vertices without out-edges is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Direction, Graph
from ..operators.traversal import combine, messages
from ..plans.program import Run, VertexProgram, run

# The teleport weight, and the delta at or below which a vertex stops sending.
TELEPORT, THRESHOLD = 0.15, 1e-5


def _with_degrees(graph: Graph) -> DataFrame:
    d = graph.by("src").groupBy("src").agg(F.count(F.lit(1)).alias("outdegree"))  # laid out for the rounds anyway
    return graph.vertices.join(d, F.col("vid") == d["src"], "left").drop("src")


def pagerank_frozen(graph: Graph) -> DataFrame:
    """vid, pr after rounds in which the sent values are never refreshed: one join and one aggregate."""
    sending = _with_degrees(graph).where("outdegree > 0").select("vid", (F.lit(TELEPORT) / F.col("outdegree")).alias("share"))
    got = combine(messages(sending, graph, {"share": F.col("share")}, Direction.OUT), {"mass": F.sum("share")})
    return graph.vertices.join(got, F.col("vid") == F.col("to"), "left").select("vid", (F.lit(TELEPORT) + (1 - TELEPORT) * F.coalesce("mass", F.lit(0.0))).alias("pr"))


def pagerank_power(graph: Graph, supersteps: int = 10) -> Run:
    """vid, pr after power iterations: every vertex with out-edges sends its current share each round."""
    program = VertexProgram(
        state={"pr": F.lit(TELEPORT)},
        message={"share": F.col("pr") / F.col("outdegree")},
        combine={"mass": F.sum("share")},
        apply=lambda: {"pr": F.lit(TELEPORT) + (1 - TELEPORT) * F.col("mass")},
        active=F.col("outdegree") > 0,
        halt=False,
    )
    out = run(program, graph, max_supersteps=supersteps, vertices=_with_degrees(graph))
    return Run(out.state.select("vid", "pr"), out.metrics)


def pagerank_delta(graph: Graph, supersteps: int = 10, threshold: float = THRESHOLD) -> Run:
    """vid, pr by passing on changes: a vertex adds what it gets and sends it on while it exceeds the threshold."""
    delta = (1 - TELEPORT) * F.col("mass")
    program = VertexProgram(
        state={"pr": F.lit(TELEPORT), "delta": F.lit(TELEPORT)},
        message={"share": F.col("delta") / F.col("outdegree")},
        combine={"mass": F.sum("share")},
        apply=lambda: {"pr": F.col("pr") + delta, "delta": delta},
        activate=(delta > threshold) & (F.col("outdegree") > 0),
        active=F.col("outdegree") > 0,
    )
    out = run(program, graph, max_supersteps=supersteps, vertices=_with_degrees(graph))
    return Run(out.state.select("vid", "pr"), out.metrics)


def total(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.sum("pr").alias("pr_sum"))


def top(ranks: DataFrame, k: int) -> DataFrame:
    """The k largest scores, ties by vid; scores are compared as rounded to nine places."""
    return ranks.select("vid", F.round("pr", 9).alias("pr")).orderBy(F.desc("pr"), "vid").limit(k)
