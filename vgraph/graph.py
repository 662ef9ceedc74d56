"""A graph is two DataFrames: vertices (vid) and directed multigraph edges (src, dst, properties)."""

from __future__ import annotations

from enum import Enum

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize


class Direction(Enum):
    """Which edges of a vertex carry its messages."""

    OUT = "out"
    IN = "in"
    BOTH = "both"


class Graph:
    """Vertices ``vid BIGINT`` and edges ``src BIGINT, dst BIGINT`` with any further columns.

    Edges are a bag: parallel edges and self-loops all count.  Vertices need not touch an edge.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, placement: bool = False):
        """``placement``: edges have a column ``part``, and traversals run on the parts (see :meth:`placed`)."""
        self.vertices, self.edges, self.placement = vertices, edges, placement
        #: Where vertices are all of 0 to n - 1, this n.
        self.dense: int | None = None
        self._laid_out: dict[str, DataFrame] = {}

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @classmethod
    def from_edges(cls, edges: DataFrame, n_vertices: int | None = None) -> Graph:
        """A graph over the ids 0 to n_vertices - 1; by default up to the largest id of an edge."""
        if n_vertices is None:
            largest = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
            n_vertices = 0 if largest is None else largest + 1
        out = cls(edges.sparkSession.range(n_vertices).withColumnRenamed("id", "vid"), edges)
        out.dense = n_vertices
        return out

    @classmethod
    def from_names(cls, edges: DataFrame) -> tuple[Graph, DataFrame]:
        """A graph over ids of any type, and name, vid: the dense number of each, in order of names.

        Names are sorted in ranges and counted per range, so no task numbers them all.  Edges
        with a null end are left out.
        """
        given = edges.where("src is not null and dst is not null")
        names = given.select(F.col("src").alias("name")).union(given.select("dst")).distinct()
        at = F.monotonically_increasing_id()
        ranged = materialize(names.repartitionByRange("name").sortWithinPartitions("name").select("name", F.shiftrightunsigned(at, 33).alias("range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("own")), "names")
        before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        starts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        names = materialize(ranged.join(F.broadcast(starts), "range").select("name", (F.col("start") + F.col("own")).alias("vid")), "names")
        others = [c for c in edges.columns if c not in ("src", "dst")]
        a, b = names.select(F.col("name").alias("src"), F.col("vid").alias("_src")), names.select(F.col("name").alias("dst"), F.col("vid").alias("_dst"))
        numbered = given.join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *others)
        return cls(names.select("vid"), numbered), names

    def placed(self, assigned: DataFrame) -> Graph:
        """The graph with its edges on parts: ``assigned`` has src, dst, part for each edge, as a partitioner gives them.

        Traversals then run part by part: a sender goes once to each part that holds edges of
        its own, edges meet it there, and messages are combined there before they go to their
        destinations.  So edges of a hub are met in as many tasks as there are parts holding them.
        """
        return Graph(self.vertices, assigned, True)

    def spread_hubs(self, parts: int, limit: int = 1_000_000) -> Graph:
        """The graph with edges of vertices that have over ``limit`` at one end split over ``parts``; all others stay with their source."""
        hubs = self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(F.col("src").alias("_hub"))
        part = F.when(F.col("_hub").isNotNull(), F.pmod(F.xxhash64("dst"), F.lit(parts))).otherwise(F.pmod(F.xxhash64("src"), F.lit(parts))).cast("int")
        return self.placed(self.edges.join(hubs, F.col("src") == F.col("_hub"), "left").withColumn("part", part).drop("_hub"))

    @property
    def partitions(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def own(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of ``df`` whose column is a vertex."""
        if self.dense is not None:
            return df.where((F.col(column) >= 0) & (F.col(column) < self.dense))
        return df.join(self.vertices.select(F.col("vid").alias("_own")), F.col(column) == F.col("_own"), "left_semi")

    def by(self, end: str) -> DataFrame:
        """The edges partitioned by ``src`` or ``dst``, sorted by it and kept so: later joins on that end neither move nor sort an edge again.

        Kept blocks that are lost with an executor are computed again from the edges.
        """
        if end not in self._laid_out:
            keys = ["part", end] if self.placement else [end]
            self._laid_out[end] = self.edges.repartition(self.partitions, *keys).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)
        return self._laid_out[end]

    def agents(self, end: str) -> DataFrame:
        """vid, part: on which parts each vertex has edges at that end. Only with a placement."""
        name = f"agents {end}"
        if name not in self._laid_out:
            self._laid_out[name] = self.edges.select(F.col(end).alias("vid"), "part").distinct().repartition(self.partitions, "vid").persist(StorageLevel.MEMORY_AND_DISK)
        return self._laid_out[name]

    def unpersist(self) -> None:
        for df in self._laid_out.values():
            df.unpersist()
        self._laid_out.clear()

    def reverse(self) -> Graph:
        others = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others), self.placement)

    def symmetrize(self) -> Graph:
        """Every edge and its reverse; a self-loop comes twice, as a traversal both ways meets it twice."""
        return Graph(self.vertices, self.edges.unionByName(self.reverse().edges), self.placement)

    def simple(self) -> Graph:
        """Distinct edges without self-loops and properties."""
        return Graph(self.vertices, self.edges.select("src", "dst").where("src != dst").distinct())

    def out_degrees(self) -> DataFrame:
        """src, outdegree of vertices that have out-edges."""
        return self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("outdegree"))
