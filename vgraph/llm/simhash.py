"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes.  Two fingerprints that differ in at most two
bits differ in at most two bytes, so they share at least six positional bytes: the
guaranteed minimum.  The index posts each distinct fingerprint under joint keys of four
positional bytes, chosen so that any two spoiled positions leave one key whole; no pair
with the minimum is missed.  Pairs that meet are tallied over all eight positions, those
with the minimum kept and verified on their bits.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels.components import contract
from .common import fits, materialize, small_batches, without

#: Posting lists up to this length are paired; longer ones go the way that makes no pairs.
PAIRED_LIST = 64
#: Ids of documents to drop up to this number (16 MB) are broadcast; beyond it a shuffle join drops them.
BROADCAST_IDS = 2_000_000
_BLOCK = 1 << 20


def simhash(text: str | None, width: int = 3) -> int:
    """Bit b is set when over half of the shingle hashes (repeats count) have it; no words: zero."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, _BLOCK):
        h = np.array([hashed(line[a:b], 42) for a, b in zip(starts[k : k + _BLOCK], ends[k : k + _BLOCK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_udf(width: int):
    @F.arrow_udf(T.LongType())
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t.as_py(), width) for t in texts], np.uint64).view(np.int64))

    return fingerprint


def joint_keys(bits: int) -> list[tuple[int, ...]]:
    """Sets of four byte positions, fewer if fewer are shared for sure, such that any ``bits`` spoiled positions leave one set whole."""
    left, chosen = set(combinations(range(8), bits)), []
    blocks = list(combinations(range(8), min(4, 8 - bits)))
    while left:
        best = max(blocks, key=lambda b: sum(not set(b) & set(s) for s in left))
        chosen.append(best)
        left = {s for s in left if set(best) & set(s)}
    return chosen


def mask(positions) -> int:
    """The bits of these byte positions, as a signed long."""
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def links(fingerprints: DataFrame) -> DataFrame:
    """Of distinct longs in column ``fp``: pairs a, b whose connection equals that of all pairs at two bits or fewer.

    Pairs of lists up to ``PAIRED_LIST`` are made, tallied and verified.  In longer lists
    every member posts itself and its one-bit changes of the four bytes outside the key:
    two members are within two bits exactly when they post a common value, so linking each
    member to the least under each value links what all pairs would, in linear size.
    """
    bits = 2
    least = 8 - bits
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask(p))).alias("bytes")) for k, p in enumerate(joint_keys(bits))])
    postings = fingerprints.select("fp", F.explode(keys).alias("key")).select("fp", "key.k", "key.bytes")
    lists = materialize(postings.groupBy("k", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists")
    short = postings.join(lists.where(F.col("n") <= PAIRED_LIST).select("k", "bytes"), ["k", "bytes"], "left_semi")
    pairs = short.select("k", "bytes", F.col("fp").alias("a")).join(short.select("k", "bytes", F.col("fp").alias("b")), ["k", "bytes"]).where("a < b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    shared = reduce(lambda x, y: x + y, [(differ.bitwiseAND(F.lit(mask([p]))) == 0).cast("int") for p in range(8)])
    paired = pairs.select("a", "b", shared.alias("tally"), F.bit_count(differ).alias("bits")).where((F.col("tally") >= least) & (F.col("bits") <= bits)).select("a", "b")
    long = lists.where(F.col("n") > PAIRED_LIST).select("k", "bytes")
    if long.isEmpty():
        return paired.distinct()
    free = [[b for b in range(64) if b // 8 not in p] for p in joint_keys(bits)]
    change = [F.array(F.lit(0).cast("long"), *[F.lit(_signed(b)) for b in f]) for f in free]
    posted = postings.join(long, ["k", "bytes"], "left_semi").select("k", "fp", F.explode(F.element_at(F.array(*change), F.col("k") + 1)).alias("c")).select("k", "fp", F.col("fp").bitwiseXOR(F.col("c")).alias("value"))
    heads = posted.groupBy("k", "value").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a < most").drop("most")
    starred = posted.join(heads, ["k", "value"]).where("a < fp").select("a", F.col("fp").alias("b"))
    return paired.unionByName(starred).distinct()


def _signed(bit: int) -> int:
    return (1 << bit) - (1 << 64) if bit == 63 else 1 << bit


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """One row per row of ``docs``: its id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of two bits or fewer.  A null or
    wordless text has fingerprint zero and links like any other; rows with a null id get the
    smallest id of their component, null if it has none; equal rows stay as many; an empty
    table gives no rows.  Other columns of ``docs`` are not read.
    """
    small_batches(docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), fingerprint_udf(width)(F.col(f"`{text_col}`")).alias("fp"))
    rows = materialize(rows, "fingerprints")
    known = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = contract(links(known.select("fp")))
    named = known.join(roots, known["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    top = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(named.join(top, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """``docs``, its columns unchanged, with one document of each component: that with the smallest id.

    Rows with a null id stay; of rows repeating that smallest id all stay, as they are one document.
    """
    classes = near_duplicates(docs, text_col, id_col, width)
    gone = materialize(classes.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_v_gone")).distinct(), "gone")
    kept = docs.join(F.broadcast(gone) if fits(gone, BROADCAST_IDS) else gone, docs[f"`{id_col}`"] == gone["_v_gone"], "left_anti")
    return without(kept, "_v_gone")
