"""Edges that keep arriving, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.components import contract
from ..storage import materialize


def read_edge_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """A stream of src, dst from a folder that Parquet files of edges are added to."""
    return spark.readStream.schema("src bigint, dst bigint").option("maxFilesPerTrigger", files_at_once).parquet(path)


def degree_stream(edges: DataFrame) -> DataFrame:
    """A stream of vid, degree: out-degrees so far; state is one row for each vertex."""
    return edges.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("degree"))


class Components:
    """Weak components of all edges so far; each batch is merged with the forest of those before."""

    def __init__(self, spark: SparkSession):
        self.forest = spark.createDataFrame([], "node bigint, root bigint")

    def update(self, batch: DataFrame, _: int = 0) -> None:
        """For ``foreachBatch``: the forest stands for all edges before, so only it and the batch are read. A batch run again changes nothing."""
        both = batch.select("src", "dst").unionByName(self.forest.select(F.col("node").alias("src"), F.col("root").alias("dst")))
        self.forest = materialize(contract(both), "forest")


class Latest:
    """The last state of a stream of aggregates, as a table in the shared folder; for ``follow`` in complete mode."""

    def __init__(self):
        self.table: DataFrame | None = None

    def update(self, batch: DataFrame, _: int = 0) -> None:
        self.table = materialize(batch, "latest")


def follow(edges: DataFrame, update: Callable, checkpoint: str, mode: str = "append"):
    """Start a query that hands each batch to ``update`` and ends when all that is there has been read."""
    return edges.writeStream.outputMode(mode).foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
