"""Graph files: counts, edge lists, roots, properties, adjacency lists and binary parts.

A graph's files share a prefix: ``<prefix>.meta``, ``<prefix>.edges.<i>``, ``<prefix>.roots``
and ``<prefix>.part.<P>.<i>`` with ``<prefix>.outdegree.<P>.<i>``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


@dataclass
class IngressParameters:
    """Where a graph is and how it is stored: format ``ascii`` or ``bin`` text, method ``edgelists`` or ``partitions``."""

    prefix: str
    format: str = "ascii"
    method: str = "edgelists"
    partitions: int | None = None


def read_meta(spark: SparkSession, prefix: str) -> tuple[int, int]:
    """The numbers of vertices and edges."""
    tokens = " ".join(r.value for r in spark.read.text(f"{prefix}.meta").limit(16).collect()).split()
    return int(tokens[0]), int(tokens[1])


def read_edge_lists(spark: SparkSession, prefix: str) -> DataFrame:
    """src, dst of text lines "src dst ..."; blank lines and lines that begin with # are skipped."""
    lines = spark.read.text(f"{prefix}.edges.*").select(F.trim("value").alias("value")).where("value != '' and not startswith(value, '#')")
    parts = F.split("value", r"\s+")
    return lines.select(parts[0].cast("bigint").alias("src"), parts[1].cast("bigint").alias("dst"))


def read_token_pairs(spark: SparkSession, prefix: str) -> DataFrame:
    """src, dst of files that are one stream of numbers in pairs, lines or not; there are no comments.

    Lines of an even number of tokens, the usual form, are paired where they are read; only
    files in which a pair spans lines are read whole.
    """
    lines = spark.read.text(f"{prefix}.edges.*").select(F.col("_metadata.file_path").alias("file"), F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "").alias("t"))
    spanning = lines.where(F.size("t") % 2 == 1).select("file").distinct()
    whole = spark.read.text(f"{prefix}.edges.*", wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "").alias("t"))
    rows = lines.join(spanning, "file", "left_anti").unionByName(whole.join(spanning, "file", "left_semi"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("t") / 2).cast("int") - 1), lambda k: F.struct(F.get("t", 2 * k).alias("src"), F.get("t", 2 * k + 1).alias("dst")))
    return rows.where(F.size("t") >= 2).select(F.explode(pairs).alias("e")).select(F.col("e.src").cast("bigint").alias("src"), F.col("e.dst").cast("bigint").alias("dst"))


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of lines "vid outdegree target target ..."."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where("trim(value) != '' and not startswith(trim(value), '#')").select(parts.alias("t"))
    return lines.select(F.col("t")[0].cast("bigint").alias("src"), F.explode(F.transform(F.slice("t", F.lit(3), F.col("t")[1].cast("int")), lambda t: t.cast("bigint"))).alias("dst"))


def read_tokens(spark: SparkSession, path: str, kind: str = "bigint", n: int = 0) -> DataFrame:
    """pos, value of the tokens of text files, in order; the first n of them where n > 0."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "")).alias("pos", "t"))
    out = lines.select(F.col("pos").cast("bigint"), F.col("t").cast(kind).alias("value"))
    return out.where(F.col("pos") < n) if n > 0 else out


def read_roots(spark: SparkSession, prefix: str, graph: Graph | None = None) -> DataFrame | None:
    """vid of the sources: a count, then so many ids. None, meaning all vertices, for a count of -1.

    With a graph, ids that are not its vertices are left out.
    """
    tokens = read_tokens(spark, f"{prefix}.roots")
    count = tokens.where("pos = 0").first().value
    if count < 0:
        return None
    ids = tokens.where((F.col("pos") > 0) & (F.col("pos") <= count)).select(F.col("value").alias("vid"))
    return ids if graph is None else ids.join(graph.vertices.select("vid"), "vid", "left_semi")


def read_vertex_property(spark: SparkSession, path: str, name: str, kind: str = "double") -> DataFrame:
    """vid and the property: the k-th token is that of vertex k."""
    return read_tokens(spark, path, kind).select(F.col("pos").alias("vid"), F.col("value").alias(name))


def read_edge_property(spark: SparkSession, edges_path: str, path: str, name: str, kind: str = "double") -> DataFrame:
    """src, dst and the property: the k-th token is that of the k-th edge of one edge file."""
    lines = spark.read.text(edges_path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#")))).alias("pos", "line"))
    parts = F.split(F.trim("line"), r"\s+")
    edges = lines.select(F.col("pos").cast("bigint"), parts[0].cast("bigint").alias("src"), parts[1].cast("bigint").alias("dst"))
    return edges.join(read_tokens(spark, path, kind).withColumnRenamed("value", name), "pos").drop("pos")


def made_up_property(df: DataFrame, name: str = "w", below: int = 65535, *keys: str) -> DataFrame:
    """A whole number below ``below`` for each row, by a hash of its keys: the same in every run."""
    keys = keys or ("src", "dst")
    return df.withColumn(name, F.pmod(F.xxhash64(*keys), F.lit(below)).cast("bigint"))


def read_parts(spark: SparkSession, prefix: str, parts: int) -> DataFrame:
    """part, src, dst of binary parts: pairs of little-endian unsigned 64-bit numbers."""

    def decode(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                pairs = np.frombuffer(data.as_buffer(), "<u8").astype(np.int64).reshape(-1, 2)
                part = int(path.rsplit(".", 1)[1])
                for k in range(0, len(pairs), 1 << 18):
                    own = pairs[k : k + (1 << 18)]
                    yield pa.record_batch([pa.array(np.full(len(own), part), pa.int32()), pa.array(own[:, 0]), pa.array(own[:, 1])], ["part", "src", "dst"])

    files = spark.read.format("binaryFile").load(f"{prefix}.part.{parts}.*").select("path", "content")
    return files.mapInArrow(decode, "part int, src bigint, dst bigint")


def read_out_degrees(spark: SparkSession, prefix: str, parts: int) -> DataFrame:
    """vid, outdegree of binary parts: 32-bit numbers, the j-th of part i that of vertex j * parts + i."""

    def decode(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                n = np.frombuffer(data.as_buffer(), "<i4").astype(np.int64)
                part = int(path.rsplit(".", 1)[1])
                yield pa.record_batch([pa.array(np.arange(len(n)) * parts + part), pa.array(n)], ["vid", "outdegree"])

    files = spark.read.format("binaryFile").load(f"{prefix}.outdegree.{parts}.*").select("path", "content")
    return files.mapInArrow(decode, "vid bigint, outdegree bigint")


def read_replica_maps(spark: SparkSession, prefix: str, parts: int) -> DataFrame:
    """part, other, vid: sources of ``part`` that part ``other`` holds replicas of, from files of bitmaps over the part's vertices."""

    def decode(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw, at, part = data.as_py(), 0, int(path.rsplit(".", 1)[1])
                for other in (p for p in range(parts) if p != part):
                    bits = int(np.frombuffer(raw, "<i8", 1, at)[0])
                    size = bits // 8 + 8
                    words = np.frombuffer(raw, np.uint8, size, at + 8)
                    on = np.flatnonzero(np.unpackbits(words, bitorder="little")[:bits])
                    at += 8 + size
                    yield pa.record_batch([pa.array(np.full(len(on), part), pa.int32()), pa.array(np.full(len(on), other), pa.int32()), pa.array(on * parts + part)], ["part", "other", "vid"])

    files = spark.read.format("binaryFile").load(f"{prefix}.scatterMap.{parts}.*").select("path", "content")
    return files.mapInArrow(decode, "part int, other int, vid bigint")


def load(spark: SparkSession, params: IngressParameters) -> Graph:
    """The graph that the parameters name, over as many vertices as its counts say."""
    n, _ = read_meta(spark, params.prefix)
    if params.method == "partitions":
        edges = read_parts(spark, params.prefix, params.partitions).select("src", "dst")
    else:
        edges = (read_token_pairs if params.format == "bin" else read_edge_lists)(spark, params.prefix)
    return Graph.from_edges(edges, n)
