"""One scatter-combine step: messages along edges, combined per destination."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Direction, Graph

#: A traversal's message: named columns over the sender's state and the edge's columns.
Message = Callable[[], dict[str, Column]]


def ends(direction: Direction) -> list[tuple[str, str]]:
    """The near and the far end of edges that carry messages: once one way, twice both ways."""
    return {Direction.OUT: [("src", "dst")], Direction.IN: [("dst", "src")], Direction.BOTH: [("src", "dst"), ("dst", "src")]}[direction]


def messages(senders: DataFrame, graph: Graph, message: dict[str, Column], direction: Direction) -> DataFrame:
    """``to`` and the message columns, one row for every edge of a sender in the direction.

    Senders and edges are partitioned alike on the joined end, so neither moves; on a graph
    with a placement, senders go to the parts that hold edges of theirs.  Both ways is the
    union of the two: a self-loop delivers twice.
    """
    parts = []
    for near, far in ends(direction):
        e, sending = graph.by(near), senders
        met = senders["vid"] == e[near]
        if graph.placement:
            a = graph.agents(near).select(F.col("vid").alias("_agent"), F.col("part").alias("_part"))
            sending = senders.join(a, senders["vid"] == a["_agent"])
            met = (sending["_part"] == e["part"]) & met
        parts.append(sending.join(e, met).select(F.col(far).alias("to"), *[c.alias(n) for n, c in message.items()]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def combine(sent: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """``to`` and the combined columns: partial aggregates before the one shuffle, final ones after."""
    return sent.groupBy("to").agg(*[c.alias(n) for n, c in aggregates.items()])


def scatter_step(graph: Graph, value: Column, direction: Direction, combined: str = "sum") -> DataFrame:
    """vid, value: for every vertex the combined values of its neighbours; null where none sends."""
    senders = graph.vertices.select("vid", value.alias("sent"))
    got = combine(messages(senders, graph, {"sent": F.col("sent")}, direction), {"value": getattr(F, combined)("sent")})
    return graph.vertices.select("vid").join(got, F.col("vid") == F.col("to"), "left").select("vid", "value")
