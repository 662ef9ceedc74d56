"""Searches: vertex programs whose state is empty until a vertex is a source or gets a message.

Only such vertices have a row, so a round costs what its frontier does, not what the graph
does.  While no more than FRONTIER messages are sent, the driver fetches the edges of the
senders and keeps the rows that change; otherwise a round runs over a table as in
:mod:`.program`.  A search changes from one to the other as its frontier shrinks and grows.
"""

from __future__ import annotations

import time
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..graph import Graph
from ..operators.traversal import combine, ends, messages
from ..storage import bucketed, drop
from .program import Run, VertexProgram

#: Messages that may be sent in a round of the driver's.
FRONTIER = 10_000
#: Rows that the driver keeps before they join the table.
HELD = 100_000
#: Ids that are given to a filter one by one, by which blocks of edges without them are skipped.
NAMED = 10


class _Held:
    """Rows by vid that the driver keeps; of rows of one vid the last holds."""

    def __init__(self):
        self.rows: pa.Table | None = None
        self.at: dict[int, int] = {}

    def put(self, rows: pa.Table) -> None:
        start = self.rows.num_rows if self.rows else 0
        self.at |= {v: start + k for k, v in enumerate(rows["vid"].to_pylist())}
        self.rows = pa.concat_tables([self.rows, rows]).combine_chunks() if self.rows else rows

    def all(self) -> pa.Table:
        return self.rows.take(pa.array(list(self.at.values()), pa.int64()))


def _among(df: DataFrame, ids: pa.Array | pa.ChunkedArray, column: str) -> DataFrame:
    """The rows of ``df`` whose column is among the ids."""
    if len(ids) <= NAMED:
        return df.where(f"{column} in ({', '.join(f'{i}L' for i in ids.to_pylist())})")
    local = df.sparkSession.createDataFrame(pa.table({"_id": ids}), "_id bigint")
    return df.join(F.broadcast(local), F.col(column) == F.col("_id"), "left_semi")


def search(program: VertexProgram, graph: Graph, sources: DataFrame, max_supersteps: int | None = None) -> Run:
    """Rounds until no vertex is active, or at most ``max_supersteps``.

    As :func:`.program.run` with these sources for a program whose ``state`` is null for all
    other vertices, whose vertices halt, and which has no hooks on rounds; but the final state
    has rows of the sources and of vertices that got messages only.  ``state`` may use a column
    ``_root``, which is true.
    """
    spark, names, n = graph.spark, ["vid", *program.state], graph.partitions
    cap = max_supersteps if max_supersteps and max_supersteps > 0 else None
    first = graph.own(sources.select("vid").distinct(), "vid").withColumn("_root", F.lit(True))
    first = first.select("vid", *[c.alias(k) for k, c in program.state.items()])
    schema = first.schema
    wakes = F.lit(False) if program.activate is None else F.coalesce(program.activate, F.lit(False))
    # hooks and the edges to fetch are put together once, as building them takes longer than a small round
    new, before = program.apply(), [f"_old_{k}" for k in names[1:]]
    columns = [new[k].cast(schema[k].dataType).alias(k) if k in new else F.col(k) for k in names[1:]]
    told = ["to", *[c.alias(k) for k, c in program.message.items()], *before]
    combined = [*[c.alias(k) for k, c in program.combine.items()], F.count(F.lit(1)).alias("_messages"), *[F.first(k).alias(k) for k in before]]
    again = ["to", *program.combine, "_messages", *[F.col(at).alias(k) for k, at in zip(names[1:], before, strict=True)]]
    result = [F.col("to").alias("vid"), *columns, wakes.alias("active")]
    sides, degree = [], 0
    for near, far in ends(program.direction):
        e = graph.by(near)
        degree += e.groupBy(near).count().agg(F.max("count")).first()[0] or 0
        sides.append(graph.own(e.select(F.col(near).alias("_near"), F.col(far).alias("to"), *e.columns), "to"))

    def local(rows: pa.Table, kind=schema) -> DataFrame:
        return spark.createDataFrame(rows, kind)

    table: DataFrame | None = None  # rows that the driver does not keep, and whether they send next
    held, metrics = _Held(), []
    begun = first.limit(FRONTIER + 1).toArrow()
    small, left = begun.num_rows <= FRONTIER, begun.num_rows
    if small:
        held.put(begun)
        senders = begun
    else:
        table = bucketed(first.withColumn("active", F.lit(True)).repartition(n, "vid"), "vid", n, "state")

    def merged(active: pa.ChunkedArray | None) -> DataFrame:
        """The table with the driver's rows; those of ``active`` send next."""
        own = local(held.all()) if held.at else spark.createDataFrame([], schema)
        if active is None:
            own = own.withColumn("active", F.lit(False))
        else:
            sends = local(pa.table({"_id": active}), "_id bigint").withColumn("active", F.lit(True))
            own = own.join(F.broadcast(sends), F.col("vid") == F.col("_id"), "left").drop("_id").withColumn("active", F.coalesce("active", F.lit(False)))
        if table is None:
            return own
        kept = table.join(F.broadcast(own.select(F.col("vid").alias("_v"))), F.col("vid") == F.col("_v"), "left_anti")
        return kept.select(*names, F.lit(False).alias("active")).unionByName(own)

    def flush(active: pa.ChunkedArray | None) -> DataFrame:
        nonlocal held
        out = bucketed(merged(active).repartition(n, "vid"), "vid", n, "state")
        if table is not None:
            drop(table)
        held = _Held()
        return out

    def fetched(ids: pa.ChunkedArray) -> DataFrame:
        """The edges along which these vertices send, ``to`` their far end; one more than FRONTIER at most."""
        found = [_among(e, ids, "_near") for e in sides]
        found = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        return found if len(ids) * degree <= FRONTIER else found.limit(FRONTIER + 1)

    def passed(edges: pa.Table, kind) -> DataFrame:
        """The rows after their messages, in one task: those of senders, of edges and of receivers are put side by side."""
        near, to = edges["_near"].to_pylist(), edges["to"].to_pylist()
        side = held.rows.take(pa.array([held.at[v] for v in near], pa.int64()))
        old = held.rows.select(names[1:]).take(pa.array([held.at.get(v) for v in to], pa.int64()))
        given, fields = edges.drop_columns("_near"), {f.name: f.dataType for f in kind.fields}
        for k in names:
            given, fields[k] = given.append_column(k, side[k]), schema[k].dataType
        for k, at in zip(names[1:], before, strict=True):
            given, fields[at] = given.append_column(at, old[k]), schema[k].dataType
        rows = local(given, StructType([StructField(k, fields[k]) for k in given.column_names])).coalesce(1)
        return rows.select(told).groupBy("to").agg(*combined).select(again).select(result)

    for step in count() if cap is None else range(cap):
        began = time.perf_counter()
        if small:
            seen = {"active": 0, "messages": 0, "combined": 0}
            wanted = fetched(senders["vid"]) if left else None
            edges = wanted.toArrow() if left else None
            if left and edges.num_rows > FRONTIER:
                table, small = flush(senders["vid"]), False
            elif left and edges.num_rows:
                if table is not None:
                    unknown = pa.array(sorted({v for v in edges["to"].to_pylist()} - held.at.keys()), pa.int64())
                    if len(unknown):
                        held.put(_among(table, unknown, "vid").select(*names).toArrow())
                after = passed(edges, wanted.schema).toArrow()
                held.put(after.select(names))
                senders = after.filter(after["active"]).select(names)
                seen = {"active": senders.num_rows, "messages": edges.num_rows, "combined": after.num_rows}
        if small:
            left = seen["active"]
            if left and len(held.at) > HELD:
                table = flush(None)
                held.put(senders)
        else:
            got = combine(messages(table.where("active"), graph, program.message, program.direction), program.combine | {"_messages": F.count(F.lit(1))})
            got = graph.own(got, "to")
            joined = table.join(got, table["vid"] == got["to"], "full_outer")
            there, observed = F.col("to").isNotNull(), Observation()
            kept = [F.when(there, c).otherwise(F.col(k)).alias(k) for k, c in zip(names[1:], columns, strict=True)]
            after = joined.select(F.coalesce("vid", "to").alias("vid"), *kept, (there & wakes).alias("active"), "_messages")
            after = after.observe(observed, F.count_if("active").alias("active"), F.coalesce(F.sum("_messages"), F.lit(0)).alias("messages"), F.count("_messages").alias("combined"))
            last, table = table, bucketed(after.drop("_messages"), "vid", n, "state")
            drop(last)
            seen = observed.get
            left = seen["active"]
            if seen["messages"] <= FRONTIER and left <= FRONTIER:
                senders = table.where("active").select(*names).toArrow()
                held.put(senders)
                small = True
        metrics.append({"superstep": step} | seen | {"seconds": time.perf_counter() - began})
        if not left:
            break
    return Run((merged(None) if small else table).select(*names), metrics, not left)
