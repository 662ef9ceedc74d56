"""Tables in the folder that driver and executors share; they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_cleaned: set[str] = set()


def _clean_at_end(spark: SparkSession) -> None:
    """Delete what is written when the program ends, as results may be read until then."""
    name = spark.sparkContext.applicationId
    if name not in _cleaned:
        _cleaned.add(name)
        atexit.register(_release_quietly, spark)


def _release_quietly(spark: SparkSession) -> None:
    try:
        release(spark)
    except (Py4JError, OSError):  # the JVM has gone first
        _written.clear()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session, whose one
    process sees one disk, may leave it unset; then a temporary folder is made once.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="vgraph-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = f"file://{folder}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage at files that outlive any executor, gives the planner true sizes,
    and fixes whatever the plan computes once (row numbers, Python results).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _clean_at_end(spark)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Write ``df``, which is hash-partitioned by ``key`` into ``n``, as a table of so many buckets and read it again.

    As :func:`materialize`, but joins and aggregates on the key need not move the rows.
    """
    spark = df.sparkSession
    table = f"vgraph_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{table}"
    _clean_at_end(spark)
    _written.append(path)
    df.write.format("parquet").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(table)
    out = spark.table(table)
    out._vgraph = table, path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of :func:`bucketed` that nothing reads any more."""
    table, path = df._vgraph
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.remove(path)


def release(spark: SparkSession) -> None:
    """Delete what :func:`materialize` and :func:`bucketed` wrote, once no result that reads it is needed; so does the end of the program."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
