"""Vertex programs: initialise, scatter, combine, apply, and halt, in bulk-synchronous rounds.

Hooks build Columns, not Python functions over rows, so a round is one Catalyst plan of
joins and aggregates, and one job.  State, edges and combined messages share one hash
partitioning by vertex; the only shuffle of a round carries partially combined messages.
Each round's state is a bucketed table in the shared folder: plans stay as small as one
round, sizes are true, and a lost executor costs its tasks of the current round only.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import NotConverged
from ..graph import Direction, Graph
from ..operators.traversal import combine, messages
from ..storage import bucketed, drop

#: Rounds run at most where vertices do not halt by themselves and no number is given.
MAX_SUPERSTEPS = 1024


def _missing(*_):
    raise NotImplementedError("a vertex program needs state, message, combine and apply")


@dataclass
class VertexProgram:
    """The hooks of a vertex program.

    ``state``: initial columns by name.  ``message``: columns sent along an edge, over the
    sender's state and the edge.  ``combine``: aggregates over message columns.  ``apply``: new
    state columns over old ones and combined ones, for vertices that got messages; names left
    out stay.  ``activate``: over old and combined columns, whether such a vertex sends next.
    ``active``: which vertices send first, where all are sources.  ``halt``: whether a sender
    rests after sending.  Combined columns are null where no message came.
    """

    state: dict[str, Column] = field(default_factory=dict)
    message: dict[str, Column] = field(default_factory=dict)
    combine: dict[str, Column] = field(default_factory=dict)
    apply: Callable[[], dict[str, Column]] = _missing
    activate: Column | None = None
    active: Column | None = None
    halt: bool = True
    direction: Direction = Direction.OUT
    #: Run on the state after each round; what it returns joins the round's metrics.
    on_superstep: Callable[[DataFrame], dict] | None = None
    #: Aggregates over all vertices after each round, found on the way without a pass of their own; they join the round's metrics.
    aggregate: dict[str, Column] = field(default_factory=dict)
    #: Run once on the final state; what it returns is the run's output.
    output_statistics: Callable[[DataFrame], dict] | None = None


@dataclass
class Run:
    """What a run leaves: the final state, a row of metrics for each round, whether no vertex was active any more, and what ``output_statistics`` gave.

    Metrics: superstep, active (vertices that send next), messages (sent along edges),
    combined (vertices that got any), seconds, and what the hooks add.
    """

    state: DataFrame
    metrics: list[dict]
    converged: bool = True
    output: dict = field(default_factory=dict)

    @property
    def supersteps(self) -> int:
        return len(self.metrics)


def run(program: VertexProgram, graph: Graph, sources: DataFrame | None = None, max_supersteps: int | None = None, vertices: DataFrame | None = None, must_converge: bool = False) -> Run:
    """Run rounds until no vertex is active or the cap is reached; the latter raises NotConverged if ``must_converge``.

    Without ``max_supersteps`` a program whose vertices halt has no cap.
    ``sources``: ids (vid) that are active first, whatever ``active`` says; None: all
    vertices for which ``active`` holds.  ``vertices``: the graph's with further columns for
    the hooks, which stay in the state; so the state of one run can start the next.  The next
    senders are those that ``activate`` names and those that sent and do not halt.
    """
    if not program.combine or not program.message:
        _missing()
    cap = max_supersteps if max_supersteps and max_supersteps > 0 else None if program.halt else MAX_SUPERSTEPS
    base = graph.vertices if vertices is None else vertices
    first = F.lit(True) if program.active is None else program.active
    state = base
    for name, value in program.state.items():
        state = state.withColumn(name, value)
    if sources is None:
        state = state.withColumn("active", F.coalesce(first, F.lit(False)))
    else:
        ids = sources.select(F.col("vid").alias("_source")).distinct()
        state = state.join(ids, F.col("vid") == F.col("_source"), "left").withColumn("active", F.col("_source").isNotNull()).drop("_source")
    names = [c for c in state.columns if c != "active"]
    n = graph.partitions
    state, metrics, left = bucketed(state.repartition(n, "vid"), "vid", n, "state"), [], 0
    for step in count() if cap is None else range(cap):
        began = time.perf_counter()
        sent = messages(state.where("active"), graph, program.message, program.direction)
        got = combine(sent, program.combine | {"_messages": F.count(F.lit(1))})
        joined = state.join(got, state["vid"] == got["to"], "left")
        new = program.apply()
        there = F.col("to").isNotNull()
        wakes = F.lit(False) if program.activate is None else there & program.activate
        columns = [(F.when(there, new[n]).otherwise(F.col(n)) if n in new else F.col(n)).alias(n) for n in names]
        active = wakes if program.halt else wakes | F.col("active")
        seen = Observation()
        volume = F.coalesce(F.sum("_messages"), F.lit(0)).alias("messages"), F.count("_messages").alias("combined")
        after = joined.select(*columns, F.coalesce(active, F.lit(False)).alias("active"), "_messages")
        after = after.observe(seen, F.count_if("active").alias("active"), *volume, *[c.alias(n) for n, c in program.aggregate.items()]).drop("_messages")
        before, state = state, bucketed(after, "vid", n, "state")
        drop(before)
        left = seen.get["active"]
        metrics.append({"superstep": step} | seen.get | {"seconds": time.perf_counter() - began} | (program.on_superstep(state) if program.on_superstep else {}))
        if not left:
            break
    if left and must_converge:
        raise NotConverged(f"{left} vertices are active after {len(metrics)} rounds")
    state = state.drop("active")
    return Run(state, metrics, not left, program.output_statistics(state) if program.output_statistics else {})
