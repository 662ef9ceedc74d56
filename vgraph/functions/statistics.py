"""A nine-number summary of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

NAMES = ("min", "q1", "median", "q3", "max", "mean", "stddev", "harmonic_mean", "harmonic_stddev")


def summary(df: DataFrame, column: str) -> DataFrame:
    """One row with the nine numbers; needs seven values at least.

    Quartiles take the sorted values at places (n+1)/4, (n+1)/2 and 3(n+1)/4 counted from
    zero, between two places blended 3:1, 1:1 and 1:3.  Zeros add nothing to sums of inverses.
    Values are counted per distinct value and ranked within ranges of values, of which only
    the totals are summed up in one place.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    inverse = F.when(F.col("x") != 0, 1 / F.col("x")).otherwise(0.0)
    total = x.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("stddev"), F.sum(inverse).alias("inverses"), F.stddev_samp(inverse).alias("spread"))
    each = x.groupBy("x").agg(F.count(F.lit(1)).alias("k"))
    ranged = materialize(each.repartitionByRange("x").withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranged.groupBy("range").agg(F.sum("k").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.sum("k").over(Window.partitionBy("range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranged.withColumn("own", own).join(F.broadcast(starts), "range").withColumn("upto", F.col("start") + F.col("own"))
    n = total.first().n
    whole, quarter = divmod(n + 1, 4)
    half, third = (n + 1) // 2, 3 * (n + 1) // 4

    def at(place: int):
        return F.min(F.when(F.col("upto") > place, F.col("x")))

    def blend(place: int, exact: bool, low: float, high: float):
        return at(place) if exact else low * at(place) + high * at(place + 1)

    quartiles = ranked.agg(
        blend(whole, quarter == 0, 0.75, 0.25).alias("q1"), blend(half, (n + 1) % 2 == 0, 0.5, 0.5).alias("median"), blend(third, 3 * (n + 1) % 4 == 0, 0.25, 0.75).alias("q3"))
    harmonic = F.col("n") / F.col("inverses")
    both = total.crossJoin(quartiles).withColumn("harmonic_mean", harmonic).withColumn("harmonic_stddev", F.col("spread") / F.sqrt(F.col("n") - 1) * harmonic * harmonic)
    return both.select(*NAMES)


def extremes(df: DataFrame, *columns: str) -> DataFrame:
    """One row with the largest and the smallest value of each column: max_<column>, min_<column>."""
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("max", F.max), ("min", F.min))])
