"""Best-fit packing of tokenised documents by bin completion.

Where a document goes depends on nothing but its length, so the packing problem is the
histogram of lengths: at most as many numbers as a sequence has tokens, however large the
corpus.  The driver solves it once for the whole corpus by branch-and-bound over bin
completions and gets a short list of patterns with how often each is used; every piece then
finds its sequence from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches, without

#: Buckets into which each length is cut to rank its pieces; a length that a third of all pieces share is ranked in so many groups.
RANK_BUCKETS = 1024
#: Steps of the quick search, which tries the few best fillings of a bin, and of the exhaustive one after it.  The first to
#: run out of steps ends with its incumbent: any packing it returns is whole and valid; more steps can only save sequences.
QUICK_STEPS, SEARCH_STEPS = 5_000, 100_000
#: Items of a filling at most that is tested for being dominated; more are kept as if they were not, which only costs steps.
DOMINATED = 6
#: Text with so long a run of white space goes through the tokenizers library, as the ranks' pattern would run out of stack on a longer one.
LONG_SPACE = re.compile(r"\s{2000}")

def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on in order."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ranks_of(path: str) -> tuple[dict[bytes, int] | None, list[str]]:
    """Of a tokenizer's file: the same encoding as merge ranks, several times faster, if it is plain byte-level BPE whose ids ascend with its merges, else None; and its special tokens.

    The file takes some 100 MB while it is read, so the driver reads it for all tasks.
    """
    tokenizer = _library(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    setup = json.loads(tokenizer.to_str())
    model, split = setup["model"], setup["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not model.get("dropout") and setup["normalizer"] is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if not plain:
        return None, special
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [model["vocab"][a + b] for a, b in pairs]
    if any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
        return None, special
    added, byte = {t["content"] for t in setup["added_tokens"]}, _byte_of()
    return {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if token not in added}, special


class Encoder:
    """Token ids of texts, as the tokenizers library gives them for a file, as little-endian unsigned 32-bit bytes.

    Texts without a special token's string and very long white space go through the equal
    merge ranks where there are such; tests hold the two against each other.  ``known``: what
    :func:`ranks_of` gives for the file.
    """

    def __init__(self, path: str, end_id: int, known: tuple[dict[bytes, int] | None, list[str]] | None = None):
        self.path, self.end, self._tokenizer, self.ranked = path, end_id, None, None
        ranks, self.special = known or ranks_of(path)
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def tokenizer(self):
        if self._tokenizer is None:  # some 50 MB that few texts need; read for the first of them
            self._tokenizer = _library(self.path)
        return self._tokenizer

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if self.ranked is None or any(s in text for s in self.special) or LONG_SPACE.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranked.encode_ordinary(text)
        ids.append(self.end)
        return np.array(ids, "<u4").tobytes()


_encoders: dict[tuple[str, int], Encoder] = {}


def pieces_of(text: Column, known, tokenizer: str, end_id: int, capacity: int, with_ids: bool) -> Column:
    """An array with piece, start, length, ids_crc32 (and ids) for each piece of the tokenised text. ``known``: a broadcast of :func:`ranks_of`."""
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())] + [("ids", T.BinaryType())] * with_ids
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids))

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(*f) for f in fields])))
    def cut(texts: pa.Array) -> pa.Array:
        encode = _encoders.get((tokenizer, end_id)) or _encoders.setdefault((tokenizer, end_id), Encoder(tokenizer, end_id, known.value))
        out = []
        for text in texts:
            ids = encode(text.as_py())
            n = len(ids) // 4
            many = -(-n // capacity)
            edges = [0, *range(n - capacity * (many - 1), n + 1, capacity)]
            own = []
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                part = ids[4 * a : 4 * b]
                own.append({"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(part)} | ({"ids": part} if with_ids else {}))
            out.append(own)
        return pa.array(out, kind)

    return cut(text)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best-fit decreasing over a histogram: (times, ((length, how many), ...)) for each pattern."""
    room: dict[int, list] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for space in sorted(r for r in room if r >= length):
            each = space // length
            for times, pattern in room.pop(space):
                full = min(times, left // each)
                rest = (left - full * each) if full < times else 0
                if full:
                    room.setdefault(space - each * length, []).append((full, (*pattern, (length, each))))
                if rest:
                    room.setdefault(space - rest * length, []).append((1, (*pattern, (length, rest))))
                if times - full - (rest > 0):
                    room.setdefault(space, []).append((times - full - (rest > 0), pattern))
                left -= full * each + rest
            if not left:
                break
        each = capacity // length
        for times, many in ((left // each, each), (1 if left % each else 0, left % each)):
            if times:
                room.setdefault(capacity - many * length, []).append((times, ((length, many),)))
    return [x for own in room.values() for x in own]


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of ``b`` can be put into those of ``a``: then filling with ``a`` loses nothing.

    Fillings of many items are not held against each other, as the test tries all ways to put them.
    """
    if sum(b) > sum(a) or len(a) > len(b) or len(b) > DOMINATED:
        return False
    free = list(a)

    def put(k: int) -> bool:
        if k == len(b):
            return True
        for i in range(len(free)):
            if free[i] >= b[k]:
                free[i] -= b[k]
                if put(k + 1):
                    return True
                free[i] += b[k]
        return False

    return put(0)


def fillings(space: int, lengths: list[int], counts: dict[int, int], waste: int, most: int = 6, effort: int = 400) -> list[tuple[int, ...]]:
    """The best undominated ways to fill ``space``, least waste first, each wasting at most ``waste``.

    ``lengths`` descend.  Only maximal fillings are made, longest items first; ``effort``
    bounds the tries and ``most`` what is kept.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    tries = 0
    smallest = lengths[-1] if lengths else space + 1

    perfect = 0

    def extend(at: int, left: int, chosen: tuple[int, ...]) -> None:
        nonlocal tries, perfect
        tries += 1
        if left < smallest:
            if left <= waste:
                found.append((left, chosen))
                perfect += not left
            return
        grew = False
        for k in range(bisect_left(lengths, -left, at, key=neg), len(lengths)):
            if tries > effort or perfect >= most:
                return
            if chosen.count(lengths[k]) < counts[lengths[k]]:
                grew = True
                extend(k, left - lengths[k], (*chosen, lengths[k]))
        if not grew and left <= waste:
            found.append((left, chosen))

    extend(0, space, ())
    kept: list[tuple[int, ...]] = []
    for _, f in sorted(found, key=lambda x: (x[0], len(x[1]))):
        if not any(_dominates(k, f) for k in kept):
            kept.append(f)
        if len(kept) == most:
            break
    return kept


def all_fillings(space: int, lengths: list[int], counts: dict[int, int], waste: int, budget: list[int]):
    """Every undominated way to fill ``space`` that wastes at most ``waste``, one by one, longest items first.

    Only fillings that take no further item are made; each try takes one from ``budget[0]``,
    and none comes after it is used up.  One that an earlier one dominates is left out.
    """
    kept: list[tuple[int, ...]] = []

    def extend(at: int, left: int, chosen: tuple[int, ...]):
        budget[0] -= 1
        if budget[0] < 0:
            return
        if left <= waste and not any(n <= left and chosen.count(n) < counts[n] for n in lengths[bisect_left(lengths, -left, key=neg) :]):
            if not any(_dominates(k, chosen) for k in kept):
                kept.append(chosen)
                yield chosen
        for k in range(bisect_left(lengths, -left, at, key=neg), len(lengths)):
            n = lengths[k]
            for many in range(min(counts[n], left // n), 0, -1):
                yield from extend(k + 1, left - many * n, (*chosen, *(n,) * many))

    yield from extend(0, space, ())


def complete(counts: dict[int, int], capacity: int, steps: int = SEARCH_STEPS) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns that pack a histogram of lengths below ``capacity`` into few bins.

    Best-fit decreasing is the first incumbent; a search over the best few fillings of each
    bin, each used as often as the items last, is quick to better it.  Unless the bins are then
    as few as the lengths need at least, an exhaustive search over all undominated fillings
    and all numbers of times follows; if it ends within ``steps``, the bins are the fewest.
    """
    best = best_fit(counts, capacity)
    best = _search(best, counts, capacity, [QUICK_STEPS], False)
    return _search(best, counts, capacity, [steps], True)


def _search(best: list, counts: dict[int, int], capacity: int, budget: list[int], exhaustive: bool) -> list:
    """Bin completion by branch-and-bound with ``best`` as the incumbent.

    The search takes the longest item left, branches over the fillings around it, and drops a
    branch once its waste rules out saving a bin over the incumbent.
    """
    bins, total = sum(t for t, _ in best), sum(n * c for n, c in counts.items())
    least = -(-total // capacity)
    left, taken, waste = dict(counts), [], 0
    stack: list = []

    def options():
        lengths = sorted(left, reverse=True)
        head = lengths[0]
        after = {n: c - (n == head) for n, c in left.items()}
        free = (bins - 1) * capacity - total - waste
        rest = [n for n in lengths if after[n] > 0]
        for fill in all_fillings(capacity - head, rest, after, free, budget) if exhaustive else fillings(capacity - head, rest, after, free):
            pattern = tuple((n, (head, *fill).count(n)) for n in sorted({head, *fill}, reverse=True))
            lost = capacity - head - sum(fill)
            most = min(left[n] // many for n, many in pattern)
            for times in range(most, 0, -1) if exhaustive else (min(most, free // lost) if lost else most,):
                yield times, pattern, times * lost

    def undo() -> int:
        times, pattern, lost = taken.pop()
        for n, many in pattern:
            left[n] = left.get(n, 0) + times * many
        return lost

    if bins > least and left:
        stack.append(options())
    while stack and budget[0] > 0 and bins > least:
        budget[0] -= 1
        option = next(stack[-1], None)
        if option is None:
            stack.pop()
            if taken:
                waste -= undo()
            continue
        times, pattern, lost = option
        # the incumbent may have got better since the options were laid out
        if not times or waste + lost > (bins - 1) * capacity - total:
            continue
        for n, many in pattern:
            left[n] -= times * many
            if not left[n]:
                del left[n]
        taken.append(option)
        waste += lost
        if left:
            stack.append(options())
            continue
        best, bins = [(t, p) for t, p, _ in taken], sum(t for t, _, _ in taken)
        waste -= undo()
    return best


def _places(patterns) -> tuple[np.ndarray, ...]:
    """Sorted intervals of (length, rank): where each starts, its first sequence, pieces a sequence, offset in it."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, pattern in patterns:
        offset = 0
        for length, many in pattern:
            rows.append((length << 48 | used.get(length, 0), length, base, many, offset))
            used[length] = used.get(length, 0) + times * many
            offset += length * many
        base += times
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece: its id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its token ids and ``end_id``; null and empty texts are that one id.  Only
    documents over ``capacity`` are cut, the first piece taking the odd length.  Every row of
    ``docs``, repeated ones and null ids included, is packed as a document of its own; an
    empty table gives no rows.  Texts of any length are read whole by one task, long runs of
    one character too.  Other columns of ``docs`` are not read.
    """
    spark = small_batches(docs)
    known = spark.sparkContext.broadcast(ranks_of(tokenizer))
    cut = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(pieces_of(F.col(f"`{text_col}`"), known, tokenizer, end_id, capacity, with_ids)).alias("p"))
    pieces = materialize(cut.select("id", "p.*", F.monotonically_increasing_id().alias("row")), "pieces")
    part = pieces.select("id", "piece", "start", "length", "ids_crc32", "row").where(F.col("length") < capacity).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(RANK_BUCKETS)))
    groups = materialize(part.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(_places(complete(counts, capacity)))

    @F.arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        keys, lengths, base, many, offset = table.value
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, (n << 48) | r, side="right") - 1
        r = r - (keys[at] & ((1 << 48) - 1))
        return pa.StructArray.from_arrays([pa.array(base[at] + r // many[at]), pa.array(offset[at] + r % many[at] * lengths[at])], ["sequence_id", "offset"])

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = part.withColumn("own", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1)
    ranked = ranked.join(groups.withColumn("before", before), ["length", "bucket"]).withColumn("at", place("length", F.col("before") + F.col("own")))
    shared = ranked.select("id", "piece", "start", "length", "ids_crc32", "row", "at.sequence_id", "at.offset")
    whole = pieces.where(F.col("length") == capacity).select("id", "piece", "start", "length", "ids_crc32", "row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = shared.unionByName(whole)
    if with_ids:
        placed = placed.join(pieces.select("row", "ids"), "row")
    return without(placed.withColumnRenamed("id", id_col), "row")
