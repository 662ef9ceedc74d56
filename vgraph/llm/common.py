"""What the operators share: tables in the shared folder, batches, and how words are read.

Every operator takes a DataFrame and returns a DataFrame.  Columns that an operator
adds replace input columns of the same name; columns used only on the way carry a
``_v_`` prefix and never reach a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import materialize, release, shared_dir

__all__ = ["BATCH_ROWS", "SPACES", "WORD", "fits", "materialize", "release", "shared_dir", "small_batches", "without"]

#: Fixed value: the ASCII white space that separates words in every contract.
SPACES = b" \t\n\x0b\x0c\r"
#: Java and RE2 spelling of a word.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch at most while texts go to Python, so that a batch stays small beside a task's memory; only a
#: text that is longer by itself makes a larger one.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def small_batches(df: DataFrame) -> SparkSession:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES`` where they are larger. Returns the session.

    The settings stay lowered, as what an operator returns is run later; they change no result.
    """
    spark = df.sparkSession
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))  # plain numbers, too
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
    return spark


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, in any spelling that Spark takes as equal."""
    taken = {n.lower() for n in names}
    return df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in taken])
