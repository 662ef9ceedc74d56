"""Sinks: edge lists, partitioned tables, and binary parts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


#: Files of a part at most.
PART_FILES = 16


def write_edge_list(edges: DataFrame, path: str) -> None:
    """Text lines "src dst", by Spark's writer, one file for each partition."""
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("overwrite").text(path)


def drop_first_line(spark: SparkSession, path: str, out: str) -> None:
    """A copy of a text file without its first line."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.slice(F.split(F.regexp_replace("value", r"\n$", ""), "\n"), 2, 1 << 30)).alias("value"))
    rows.write.mode("overwrite").text(out)


def write_parts_table(assigned: DataFrame, path: str) -> None:
    """A Parquet table of edges by ``part``, each written by several tasks; readers of one part read its files only."""
    assigned.repartition("part", F.pmod(F.xxhash64("src", "dst"), F.lit(PART_FILES))).write.mode("overwrite").partitionBy("part").parquet(path)


def save_graph(graph: Graph, path: str) -> None:
    graph.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))


def encoded_parts(assigned: DataFrame) -> DataFrame:
    """part, chunk, data: the edges of each part as little-endian pairs of unsigned 64-bit numbers, in chunks.

    A chunk is what one task holds of a part, so no part gathers in one task; the chunks of
    a part, one after another, are the part's file.
    """

    def encode(batches):
        for chunk, batch in enumerate(batches):
            part, src, dst = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for p in np.unique(part):
                own = part == p
                data = np.stack([src[own], dst[own]], axis=1).astype("<u8").tobytes()
                yield pa.record_batch([pa.array([int(p)], pa.int32()), pa.array([chunk], pa.int64()), pa.array([data], pa.binary())], ["part", "chunk", "data"])

    return assigned.select(F.col("part").cast("int"), "src", "dst").mapInArrow(encode, "part int, chunk bigint, data binary")


def narrowed(degrees: DataFrame) -> DataFrame:
    """Degrees as 32-bit numbers."""
    return degrees.withColumn("outdegree", F.col("outdegree").cast("int"))
