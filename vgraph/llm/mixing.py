"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

A source's share grows with its weight until it reaches its cap, the size it would have at
the maximum number of epochs; what the cap turns away is shared again among the others by
weight, until no source is above.  Within a source every document repeats a whole number of
times, and a seeded order decides which are taken once more for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, without

#: Hexadecimal digits of the seeded order that cut a source into buckets: 3 give 4,096, so that a source with a third of all rows still sorts in small groups.
BUCKET_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def repeating_weights(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """source, weight: sources by code point, null last, weigh as ``cycle`` does, over and over.

    Ranks the distinct sources in one task: a mixture names a weight for each source, so their
    list is as short as a configuration.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (place % len(cycle) + 1).cast("int"))
    return sources.select("source", weight.alias("weight"))


def water_fill(sources: DataFrame, total: float, epochs: float) -> DataFrame:
    """``sources``: source, source_size, weight.  Adds target: min(epochs * source_size, weight * level).

    Each round recomputes the level from sums over the sources above it, so only three
    numbers come to the driver; a round that caps no further source is the last.
    """
    cap, level, before = F.col("source_size") * F.lit(float(epochs)), None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        capped, weight, n = sources.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if n == before or not weight:
            break
        level, before = (total - (capped or 0.0)) / weight, n
    filled = cap if not weight else F.least(cap, F.col("weight") * F.lit(level))
    return sources.withColumn("target", F.coalesce(filled, F.lit(0.0)).cast("double"))


def mix(docs: DataFrame, weights, share: float, epochs: float = 2.0, seed: int = 42, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target, copies, taken: how often the mix repeats a row, and the words that makes.

    ``weights``: a DataFrame source, weight, or a tuple of weights that sources in code-point
    order take in turn.  ``share``: words of the mix for each word of the input.  Sizes are
    words; a null text has none, and a null source is a source of its own.  A source's taken
    words differ from its target by about half of one document at most.  The order is by MD5 of
    seed and id, then id and size; rows equal in these are taken alike, those with a null id
    too.  An empty table gives no rows.  Reruns give the same mix.
    """
    rows = without(docs, "size", "source_size", "target", "copies", "taken").withColumn("size", words(F.col(f"`{text_col}`")))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("~"))))
    slim = materialize(rows.select(F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("id"), "size", order.alias("order")), "sizes")
    parts = materialize(slim.groupBy("source", F.substring("order", 1, BUCKET_DIGITS).alias("bucket")).agg(F.sum("size").alias("words")), "parts")
    sizes = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    if isinstance(weights, tuple):
        weights = repeating_weights(sizes.select("source"), weights)
    named = weights.select(F.col("source").alias("_v_source"), "weight")
    sizes = materialize(sizes.join(named, sizes["source"].eqNullSafe(named["_v_source"]), "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight")), "sources")
    total = float(share) * (sizes.agg(F.sum("source_size")).first()[0] or 0)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = materialize(water_fill(sizes, total, epochs).withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "plan")

    # the last row in seeded order that the rest takes: prefix sums over buckets, then within the bucket where the rest ends
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("words").over(running), F.lit(0)))
    goals = plan.select(F.col("source").alias("_v_source"), "rest")
    last = starts.join(goals, starts["source"].eqNullSafe(goals["_v_source"])).where("start < rest")
    last = materialize(last.groupBy("source").agg(F.max_by(F.struct("bucket", "start", "rest"), "bucket").alias("last")).select(F.col("source").alias("_v_source"), "last.*"), "last")
    edge = slim.join(last, slim["source"].eqNullSafe(last["_v_source"]) & (F.substring("order", 1, BUCKET_DIGITS) == last["bucket"]))
    within = Window.partitionBy("source").orderBy("order", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))).where(F.col("before") + F.col("size") / 2 < F.col("rest"))
    key = F.struct("order", F.col("id").isNull().alias("none"), "id", "size")
    cut = edge.groupBy("source").agg(F.max(key).alias("cut")).select(F.col("source").alias("_v_cut"), "cut")
    decided = plan.join(last.select(F.col("_v_source"), "bucket"), plan["source"].eqNullSafe(last["_v_source"]), "left").drop("_v_source")
    decided = decided.join(cut, decided["source"].eqNullSafe(cut["_v_cut"]), "left").select(F.col("source").alias("_v_source"), "source_size", "target", F.col("whole").alias("_v_whole"), F.col("bucket").alias("_v_bucket"), F.col("cut").alias("_v_cut"))
    decided = materialize(decided, "decided")
    found = rows.join(decided, rows[f"`{source_col}`"].eqNullSafe(decided["_v_source"]), "left")
    own = F.struct(order.alias("order"), F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col("size").alias("size"))
    more = F.coalesce((F.substring(order, 1, BUCKET_DIGITS) < F.col("_v_bucket")) | (own <= F.col("_v_cut")), F.lit(False))
    copies = F.col("_v_whole") + more.cast("long")
    return without(found.withColumn("copies", copies).withColumn("taken", copies * F.col("size")), "_v_source", "_v_whole", "_v_bucket", "_v_cut")


def mixed(docs: DataFrame, weights, share: float, epochs: float = 2.0, seed: int = 42, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` repeats it, its columns unchanged.

    Columns named as those that :func:`mix` adds keep their values.  Null, empty and repeated
    rows and empty tables: as there.
    """
    names = docs.columns
    own = {c: f"_v_{k}" for k, c in enumerate(names)}
    renamed = docs.toDF(*own.values())
    at = {c.lower(): n for c, n in own.items()}
    repeated = mix(renamed, weights, share, epochs, seed, at[text_col.lower()], at[id_col.lower()], at[source_col.lower()])
    repeated = repeated.withColumn("_v_again", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return repeated.select([F.col(n).alias(c) for c, n in own.items()])
