"""Assigning edges to parts, and what an assignment costs.

The greedy choosers are sequential by nature: each edge's part depends on those before it.
They run as independent loaders, each over the edges of some sources, with state of its own;
a loader is a stream within one task, and there may be as many as the cluster has cores.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: Scores this near the best count as equal; among equals (src + dst) picks in turn.
TIE = 1e-4


class Loader:
    """Edge counts of the parts, and on which parts each endpoint already is: a bit for each part."""

    def __init__(self, parts: int, score: Callable, shared: bool = False, shortcut: bool = False):
        self.parts, self.score, self.shared, self.shortcut = parts, score, shared, shortcut
        self.counts = [0] * parts
        self.sources: dict[int, int] = {}
        self.targets = self.sources if shared else {}

    def place(self, src: int, dst: int) -> int:
        if self.shortcut and src % self.parts == dst % self.parts:
            best = src % self.parts
        else:
            scores = self.score(self, src, dst)
            most = max(scores)
            equal = [i for i, s in enumerate(scores) if most - s < TIE]
            best = equal[(src + dst) % len(equal)]
        self.counts[best] += 1
        self.sources[src] = self.sources.get(src, 0) | 1 << best
        self.targets[dst] = self.targets.get(dst, 0) | 1 << best
        return best

    def leave(self, src: int) -> None:
        """Forget the source, which comes no more."""
        if not self.shared:
            self.sources.pop(src, None)


def _product(balance: Callable) -> Callable:
    """Affinity times balance.  A part that has the source counts one, target or not; others half
    for owning the source, plus one for having the target or else half for owning it."""

    def score(x: Loader, src: int, dst: int) -> list[float]:
        out, s, d, own_s, own_d = balance(x), x.sources.get(src, 0), x.targets.get(dst, 0), src % x.parts, dst % x.parts
        for i in range(x.parts):
            if not s >> i & 1:
                out[i] *= (1.0 if d >> i & 1 else 0.5 * (own_d == i)) + 0.5 * (own_s == i)
        return out

    return score


def _sum(home: float) -> Callable:
    def score(x: Loader, src: int, dst: int) -> list[float]:
        s, d, counts = x.sources.get(src, 0), x.targets.get(dst, 0), x.counts
        most = max(counts)
        base = 1 + most - min(counts)
        out = [(most - n) / base + (s >> i & 1) + (d >> i & 1) for i, n in enumerate(counts)]
        if home:
            out[src % x.parts] += home
            out[dst % x.parts] += home
        return out

    return score


def _spread(x: Loader) -> list[float]:
    most = max(x.counts)
    base = 1 + most - min(x.counts)
    return [1 + (most - n) / base for n in x.counts]


def chooser(kind: str, parts: int, capacity: int = 1) -> Loader:
    """A loader's state for one of the kinds.

    ``greedy``: affinity to endpoints times balance.  ``ldg``: affinity times the distance from
    ``capacity``, a whole number, as a share of it.  ``edge``: balance plus both endpoints and half for their owners.  ``edge1``: the
    same with one map for both endpoints.  ``plain``: balance plus endpoints.  ``parallel``: plain,
    but edges whose ends have one owner go there.
    """
    room = lambda x: [abs(1.0 - n / max(capacity, 1)) for n in x.counts]
    return {
        "greedy": lambda: Loader(parts, _product(_spread)), "ldg": lambda: Loader(parts, _product(room)),
        "edge": lambda: Loader(parts, _sum(0.5)), "edge1": lambda: Loader(parts, _sum(0.5), shared=True),
        "plain": lambda: Loader(parts, _sum(0.0)), "parallel": lambda: Loader(parts, _sum(0.0), shortcut=True),
    }[kind]()


KINDS = ("greedy", "ldg", "edge", "edge1", "plain", "parallel")


#: Edges for which a loader is laid out, as it keeps the parts of all endpoints it has met.
LOADER_EDGES = 5_000_000


def partition_edges(edges: DataFrame, kind: str, parts: int, loaders: int | None = None) -> DataFrame:
    """src, dst, part.  A loader takes the edges of sources with one remainder, in order of src and dst.

    By default there are as many loaders as parts, or as many times more as LOADER_EDGES asks for.
    Each has a task to itself, which keeps the parts of the targets it has met, and of sources
    too for ``edge1`` only, as edges come by source.  Places are found once and written.
    """
    n = edges.count()
    loaders = loaders or parts * max(1, -(-n // (parts * LOADER_EDGES)))
    capacity = max(1, n // parts // loaders)

    def run(batches):
        now, state, last = None, None, None
        for batch in batches:
            out = []
            for loader, src, dst in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if loader != now:
                    now, state = loader, chooser(kind, parts, capacity)
                elif src != last:
                    state.leave(last)
                last = src
                out.append(state.place(src, dst))
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(out, pa.int32())], ["src", "dst", "part"])

    e = edges.select(F.pmod("src", F.lit(loaders)).cast("int").alias("loader"), "src", "dst")
    # not by a hash of the loader, which would put several into one task
    placed = e.repartitionById(loaders, F.col("loader")).sortWithinPartitions("loader", "src", "dst").mapInArrow(run, "src bigint, dst bigint, part int")
    return materialize(placed, "placed")


def assign(edges: DataFrame, part: Column) -> DataFrame:
    """src, dst, part by a formula over the edge, such as a hash of its ends."""
    return edges.select("src", "dst", part.cast("int").alias("part"))


def replicas(assigned: DataFrame, parts: int, end: str) -> DataFrame:
    """part, vid: endpoints on parts that do not own them; for ``src`` scatter agents, for ``dst`` combiner agents."""
    return assigned.select("part", F.col(end).alias("vid")).where(F.pmod("vid", F.lit(parts)) != F.col("part")).distinct()


def metrics(assigned: DataFrame, parts: int) -> DataFrame:
    """One row: edges, scatters, combiners, both (agents that are either's), agents, cut (agents over edges), largest part."""
    sides = replicas(assigned, parts, "src").withColumn("s", F.lit(1)).withColumn("c", F.lit(0)).unionByName(replicas(assigned, parts, "dst").withColumn("s", F.lit(0)).withColumn("c", F.lit(1)))
    each = sides.groupBy("part", "vid").agg(F.max("s").alias("s"), F.max("c").alias("c"))
    agents = each.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("scatters"), F.coalesce(F.sum("c"), F.lit(0)).alias("combiners"), F.count_if((F.col("s") == 1) & (F.col("c") == 1)).alias("both"), F.count(F.lit(1)).alias("agents"))
    sizes = assigned.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.max("n").alias("largest"))
    return sizes.crossJoin(agents).withColumn("cut", F.round(F.col("agents") / F.col("edges"), 9))
