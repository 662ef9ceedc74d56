"""Exact duplicates by counting quotient filters and byte verification.

Each input partition builds one counting quotient filter over the 64-bit fingerprints
of its texts.  A filter is cut at quotient borders into ranges; filters of one range
meet in one task and merge by their sorted remainders without loss.  Fingerprints that
count once are settled there.  Rows of the others are verified on the bytes: equal
means equal normalised text, not equal hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, fits, materialize, small_batches, without

#: Repeated fingerprints up to this number (16 MB of longs) are broadcast to find their rows; beyond it a shuffle join does.
BROADCAST_FINGERPRINTS = 2_000_000
#: As many ids of rows to drop, likewise.
BROADCAST_IDS = 2_000_000
#: Distinct fingerprints that a merging task is laid out for.
RANGE_FINGERPRINTS = 1_000_000


class QuotientFilter:
    """A counting quotient filter over 64-bit fingerprints with linear probing.

    The top ``q`` bits of a fingerprint are its quotient, the home slot; the rest, its
    remainder, is stored.  Runs of equal quotient lie in quotient order, remainders
    sorted within a run.  A count above one sits in the slot after its remainder.
    Three bit vectors say which quotients occur, where runs end, and which slots hold
    counts.  Quotient and remainder give back the whole fingerprint, so nothing is lost.
    """

    def __init__(self, q: int, slots, occupied, run_ends, counters):
        self.q, self.slots, self.occupied, self.run_ends, self.counters = q, slots, occupied, run_ends, counters

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        """``keys``: sorted distinct uint64; ``counts``: how often each occurs."""
        q = max(1, int(np.ceil(np.log2(max(len(keys), 1) / 0.75 + 1))))
        r = np.uint64(64 - q)
        quotients = (keys >> r).astype(np.int64)
        width = 1 + (counts > 1)
        heads = np.flatnonzero(np.r_[True, quotients[1:] != quotients[:-1]]) if len(keys) else np.zeros(0, np.int64)
        run_width = np.add.reduceat(width, heads) if len(keys) else np.zeros(0, np.int64)
        before = np.cumsum(run_width) - run_width
        starts = np.maximum.accumulate(quotients[heads] - before) + before if len(keys) else before
        size = int(max(1 << q, starts[-1] + run_width[-1])) if len(keys) else 1 << q
        within = np.cumsum(width) - width
        at = within - np.repeat(before - starts, np.diff(np.r_[heads, len(keys)])) if len(keys) else within
        slots, occupied = np.zeros(size, np.uint64), np.zeros(1 << q, bool)
        run_ends, counters = np.zeros(size, bool), np.zeros(size, bool)
        slots[at] = keys & np.uint64((1 << (64 - q)) - 1)
        many = counts > 1
        slots[at[many] + 1] = counts[many].astype(np.uint64)
        counters[at[many] + 1] = True
        occupied[quotients] = True
        run_ends[starts + run_width - 1] = True
        return cls(q, slots, occupied, run_ends, counters)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and their counts."""
        quotients, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.run_ends)
        if not len(ends):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        starts = np.maximum(quotients, np.r_[0, ends[:-1] + 1])
        length = ends - starts + 1
        at = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())
        home = np.repeat(quotients, length).astype(np.uint64)
        first = ~self.counters[at]
        keys = (home[first] << np.uint64(64 - self.q)) | self.slots[at[first]]
        counts = np.ones(len(keys), np.int64)
        which = np.cumsum(first) - 1
        counts[which[~first]] = self.slots[at[~first]].astype(np.int64)
        return keys, counts

    def dump(self) -> bytes:
        used = np.flatnonzero(self._used())
        head = np.array([self.q, len(self.slots), len(used)], "<i8")
        bits = (np.packbits(x) for x in (self.occupied, self.run_ends, self.counters, self._used()))
        return b"".join([head.tobytes(), *(b.tobytes() for b in bits), self.slots[used].astype("<u8").tobytes()])

    def _used(self) -> np.ndarray:
        quotients, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.run_ends)
        edge = np.zeros(len(self.slots) + 1, np.int64)
        if len(ends):
            np.add.at(edge, np.maximum(quotients, np.r_[0, ends[:-1] + 1]), 1)
            np.add.at(edge, ends + 1, -1)
        return np.cumsum(edge[:-1]) > 0

    @classmethod
    def load(cls, data: bytes) -> QuotientFilter:
        q, size, n = (int(x) for x in np.frombuffer(data, "<i8", 3))
        at, parts = 24, []
        for bits in (1 << q, size, size, size):
            raw = np.frombuffer(data, np.uint8, (bits + 7) // 8, at)
            parts.append(np.unpackbits(raw, count=bits).astype(bool))
            at += len(raw)
        slots = np.zeros(size, np.uint64)
        slots[parts[3]] = np.frombuffer(data, "<u8", n, at)
        return cls(q, slots, *parts[:3])


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted (fingerprints, counts) as one, counts of equal fingerprints added."""
    keys, counts = np.r_[a[0], b[0]], np.r_[a[1], b[1]]
    order = np.argsort(keys, kind="stable")  # two sorted runs: one merging pass
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(keys) else counts


@F.arrow_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("points", T.LongType())]))
def _digest(texts: pa.Array) -> pa.Array:
    fp, sha, points = [], [], []
    for text in texts.to_pylist():
        text = text or ""
        norm = text.encode().translate(None, SPACES)
        fp.append(xxhash.xxh64_intdigest(norm) - (1 << 63))
        sha.append(hashlib.sha256(norm).hexdigest())
        points.append(len(text))
    return pa.StructArray.from_arrays([pa.array(fp, pa.int64()), pa.array(sha, pa.string()), pa.array(points, pa.int64())], ["fp", "sha", "points"])


# marked so that no filter on its result is moved below it: the filter would digest all texts again, in a second worker of the same task
_digest = _digest.asNondeterministic()


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """Of a DataFrame with one long column ``fp``, those found more than once: fp, n.

    ``rows`` is about how many there are; it only sets into how many ranges the filters are cut.
    """
    ranges = max(-(-rows // RANGE_FINGERPRINTS), int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def build(batches):
        mine = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
            mine = merge(mine, np.unique(keys, return_counts=True))
        keys, counts = mine
        part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        cuts = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[k], cuts[k + 1])
            yield pa.record_batch([pa.array([int(k)], pa.int32()), pa.array([QuotientFilter.of(keys[own], counts[own]).dump()], pa.binary())], ["range", "filter"])

    def meet(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = QuotientFilter.load(data).items()
                held[k] = merge(held[k], own) if k in held else own
        for keys, counts in held.values():
            many = counts > 1
            yield pa.record_batch([pa.array((keys[many] ^ np.uint64(1 << 63)).view(np.int64)), pa.array(counts[many])], ["fp", "n"])

    filters = fingerprints.select("fp").mapInArrow(build, "range int, filter binary")
    return filters.repartition(ranges, "range").mapInArrow(meet, "fp bigint, n bigint")


def exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256, n_points.

    Texts are equal when identical without ASCII white space; a null text counts as empty.
    The row of a group with the most code points stays, then that with the smallest id (null
    ids last), then the first of fully equal rows, so exactly one row of a group has ``kept``.
    An empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    small_batches(docs)
    slim = docs.select(F.col(f"`{id_col}`").alias("_v_id"), F.col(f"`{text_col}`").alias("_v_text"))
    digested = slim.withColumn("_v_d", _digest("_v_text"))
    rows = materialize(digested.select("_v_id", "_v_d.fp", "_v_d.sha", "_v_d.points", F.monotonically_increasing_id().alias("_v_row")), "digests")
    repeated = materialize(repeated_fingerprints(rows, rows.count()), "repeated").select("fp")
    small = fits(repeated, BROADCAST_FINGERPRINTS)
    suspects = digested.select(F.col("_v_d.fp").alias("fp"), "_v_text").join(F.broadcast(repeated) if small else repeated.hint("merge"), "fp", "left_semi")
    # whole bytes are the grouping key: partial aggregation keeps one text per task and group, and a group needs no single task
    norm = F.regexp_replace(F.coalesce("_v_text", F.lit("")), r"[\x20\x09-\x0D]+", "")
    verified = suspects.select("fp", norm.cast("binary").alias("norm")).groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("group_size"))
    groups = materialize(verified.where("group_size > 1").select(F.sha2("norm", 256).alias("sha"), "group_size"), "groups")
    first = rows.groupBy("sha").agg(F.min(F.struct((-F.col("points")).alias("p"), F.col("_v_id").isNull().alias("none"), F.col("_v_id").alias("id"), F.col("_v_row").alias("row"))).alias("first"))
    known = materialize(groups.join(first, "sha"), "known")
    return rows.join(known, "sha", "left").select(
        F.col("_v_id").alias(id_col),
        F.when(F.col("first").isNull(), F.col("_v_id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first").isNull() | (F.col("first.row") == F.col("_v_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("points").alias("n_points"),
    )


def drop_exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs``, its columns unchanged, with the one row of each group that stays.

    Nulls, ties and empty tables: as in :func:`exact_duplicates`.  Rows that repeat both id
    and text are told apart only by their place, so of these any one stays.
    """
    labels = materialize(exact_duplicates(docs, text_col, id_col), "exact")
    ids = labels.groupBy(id_col).agg(F.count(F.lit(1)).alias("_v_n"), F.count_if("kept").alias("_v_kept"))
    gone = materialize(ids.where("_v_kept = 0").select(F.col(id_col).alias("_v_gone")), "gone")
    mixed = materialize(ids.where("_v_kept > 0 and _v_n > _v_kept").select(F.col(id_col).alias("_v_gone")), "repeats")
    out = gone.unionByName(mixed)
    rest = docs.join(F.broadcast(out) if fits(out, BROADCAST_IDS) else out, docs[f"`{id_col}`"].eqNullSafe(F.col("_v_gone")), "left_anti")
    if mixed.isEmpty():
        return rest
    # ids on several rows of which some go: their rows are matched by text as well
    stay = labels.where("kept").select(F.col(id_col).alias("_v_id"), F.col("text_sha256").alias("_v_sha"), F.col("n_points").alias("_v_points"))
    again = docs.join(mixed, docs[f"`{id_col}`"].eqNullSafe(F.col("_v_gone")), "left_semi").withColumn("_v_d", _digest(F.col(f"`{text_col}`")))
    again = again.join(stay, again[f"`{id_col}`"].eqNullSafe(stay["_v_id"]) & (again["_v_d.sha"] == stay["_v_sha"]) & (again["_v_d.points"] == stay["_v_points"]), "left_semi")
    return rest.unionByName(without(again.withColumn("_v_key", F.col("_v_d.sha")).withColumn("_v_same", F.col(f"`{id_col}`")).dropDuplicates(["_v_same", "_v_key"]), "_v_d", "_v_key", "_v_same"))
