"""Near-duplicate lines by a segment-partition edit join.

How many edits make two lines near grows with the shorter of them, up to a threshold.  A line
of length l is cut into threshold-plus-one segments; a line within the threshold keeps one of
them whole, near its place.  Segments are posted under (length, segment number, content); every
line probes the postings of each length it may match with the substrings that the multi-match
rule leaves.  Pairs that meet are verified by a banded bit-parallel edit distance.  Texts of
lines never move: postings carry hashes, and only lines of candidate pairs are read again for
their texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels.components import contract
from .common import fits, materialize, small_batches

#: Lines are near when at most so many code points are inserted, deleted or changed between them, and at most one for so many
#: code points of the shorter one: none under 10, one under 20, two from 20 on.
THRESHOLD, FOR_EACH = 2, 10
#: A posting list of more pairs is not paired: its lines are posted again by the segments of what the shared segment leaves.
PAIRED = 1 << 22
#: How often lists are divided so; what is left then is alike but for a few code points, and is paired by blocks of so many lines.
LEVELS, BLOCK_LINES = 6, 1 << 14
#: Candidate lines or keys up to this number (16 MB of sorted longs) are broadcast; beyond it a shuffle join finds them.
BROADCAST_HASHES = 2_000_000


def normal_lines(text: str | None) -> list[tuple[int, str]]:
    """Place and content of the lines that have words, white space trimmed and made single spaces."""
    return [(k, " ".join(own)) for k, line in enumerate((text or "").split("\n")) if (own := line.split())]


def digest(line: str) -> int:
    """128 bits that stand for a line."""
    return xxhash.xxh3_128_intdigest(line.encode())


def _halves(h: int, bits: int = 64) -> tuple[int, int]:
    """A name of so many bits from the front of a digest, and the last 64 bits to check it by."""
    return (h >> 128 - bits) - (1 << bits - 1), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def namer(clashes: dict[tuple[int, int], int], bits: int = 64) -> Callable[[str], int]:
    """Names of lines: the front of their digests, but for those that ``clashes`` names by front and check."""
    shared = {h for h, _ in clashes}

    def name(line: str) -> int:
        h, check = _halves(digest(line), bits)
        return clashes.get((h, check), h) if h in shared else h

    return name if clashes else lambda line: (digest(line) >> 128 - bits) - (1 << bits - 1)


def allowed(n: int, threshold: int = THRESHOLD) -> int:
    """Edits that make lines near of which the shorter has ``n`` code points."""
    return min(threshold, n // FOR_EACH)


def segments(n: int, threshold: int) -> list[tuple[int, int]]:
    """Start and length of the threshold-plus-one segments of a line of length n; the later ones take the odd code points."""
    k = threshold + 1
    short, long = n // k, n % k
    sizes = [short] * (k - long) + [short + 1] * long
    return [(sum(sizes[:i]), sizes[i]) for i in range(k)]


_BASE, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def keys_of(lines: list[str], threshold: int, above: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What lines post and probe, all at once: (line, key, whether it posts, start, end) of each.

    A line posts its segments.  It probes for segments of lines up to the threshold shorter
    and of its own length where they may have moved: segment i by at most i places from the
    left and threshold - i from the right.  Lines of one length that keep a segment in its
    place meet by their postings.  A key is a hash of length, segment number and content
    (from prefix sums of powers, so any substring costs the same), and of ``above``.
    """
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(code), _BASE, np.uint64)]) if len(code) else np.ones(1, np.uint64)
    inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(code), _INVERSE, np.uint64)]) if len(code) else np.ones(1, np.uint64)
    sums = np.r_[np.uint64(0), np.add.accumulate(code * power[:-1])]
    origin = np.cumsum(n) - n
    above = np.zeros(len(lines), np.uint64) if above is None else above
    k, out = threshold + 1, []

    def take(rows: np.ndarray, start: np.ndarray, size: np.ndarray, length: np.ndarray, i: int, posts: bool) -> None:
        a = origin[rows] + start
        content = (sums[a + size] - sums[a]) * inverse[a]
        name = (length * 16 + i).astype(np.uint64) * np.uint64(_BASE)
        out.append((rows, _mixed(_mixed(content + name) + above[rows]), np.full(len(rows), posts), start, start + size))

    for d in range(threshold + 1):
        length = n - d
        some = np.flatnonzero(length > threshold)
        base, more = length // k, length % k
        for i in range(k):
            start = i * base + np.maximum(0, i - (k - more))
            size = base + (i >= k - more)
            if not d:
                take(some, start[some], size[some], length[some], i, True)
            for o in range(-i, i + 1):
                if abs(o - d) <= threshold - i and (d or o):
                    p = start + o
                    rows = some[(p[some] >= 0) & (p[some] + size[some] <= n[some])]
                    take(rows, p[rows], size[rows], length[rows], i, False)
    # too short for segments: such lines meet each other, and the longer ones that may match probe for them
    for rows, posts in ((np.flatnonzero(n <= threshold), True), (np.flatnonzero((n > threshold) & (n <= 2 * threshold)), False)):
        out.append((rows, _mixed(above[rows] + np.uint64(_MIX[1])), np.full(len(rows), posts), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def postings(lines: list[str], threshold: int, level: int, hot: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, whether it posts) at a level, of lines that need so many edits to be near in turn, each band with keys of its own."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    out = []
    for edits in range(1, threshold + 1):
        # the shorter line of a pair allows just so many edits; the longer one may have as many code points more
        most = FOR_EACH * (edits + 1) - 1 + edits if edits < threshold else np.inf
        own = np.flatnonzero((n >= FOR_EACH * edits) & (n <= most))
        line, key, posts = _band([lines[k] for k in own.tolist()], edits, level, hot)
        out.append((own[line], key, posts))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _band(lines: list[str], threshold: int, level: int, hot: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, whether it posts) at a level; below level 0 only within keys whose lists were too long at each level above.

    ``hot``: sorted keys of each level above.  Two lines that share the segment that a key
    stands for are within the threshold only if the rests of them are, so the rests are cut
    and posted in turn.  A line that probed the segment meets those that posted it, not others
    that probed it.
    """
    which, above, role, rest = np.arange(len(lines)), np.full(len(lines), threshold, np.uint64), np.ones(len(lines), bool), lines
    for depth in range(level + 1):
        line, key, posts, start, end = keys_of(rest, threshold, above)
        posts = posts & role[line]
        if depth == level:
            return which[line], key, posts
        at = np.searchsorted(hot[depth], key)
        some = np.flatnonzero(hot[depth][np.minimum(at, len(hot[depth]) - 1)] == key) if len(hot[depth]) else np.zeros(0, np.int64)
        rest = [rest[k][:a] + rest[k][b:] for k, a, b in zip(line[some].tolist(), start[some].tolist(), end[some].tolist(), strict=True)]
        which, above, role = which[line[some]], key[some], posts[some]
    raise AssertionError


#: Kinds of characters that a sketch counts.
_KINDS = 8


def sketches(lines: list[str]) -> np.ndarray:
    """Of each line eight counts of kinds of characters, modulo 256. Within k edits, they differ by 2 k in all at most."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = ((code * np.uint32(0x9E3779B1)) >> np.uint32(29)).astype(np.int64)
    return np.bincount(np.repeat(np.arange(len(lines)) * _KINDS, n) + kind, minlength=len(lines) * _KINDS).astype(np.uint8).view("<i8")


def edit_distance(a: str, b: str, threshold: int) -> int:
    """Edit distance, or threshold + 1 if it is larger; bits of one band of width 2 * threshold + 1 advance in parallel."""
    if abs(len(a) - len(b)) > threshold:
        return threshold + 1
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return abs(len(a) - len(b))
    lo = _shared(a, b, n)
    a, b = a[lo:], b[lo:]
    n = min(len(a), len(b))
    hi = _shared(a[::-1], b[::-1], n)
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    if not a or not b:
        return min(max(len(a), len(b)), threshold + 1)
    if len(a) > len(b):
        a, b = b, a
    # bit r of a row is the cell on diagonal r - threshold; cells hold whether a distance up to k is reached there
    width = 2 * threshold + 1
    full = (1 << width) - 1
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    reached = [0] * (threshold + 1)
    for k in range(threshold + 1):  # before b starts, i deletions lead to diagonal i
        reached[k] = sum(1 << (threshold + i) for i in range(k + 1)) & full
    for j, c in enumerate(b):
        at = j - threshold
        match = places.get(c, 0) << -at if at < 0 else places.get(c, 0) >> at
        old = reached
        reached = [0] * (threshold + 1)
        for k in range(threshold + 1):
            cells = old[k] & match
            if k:
                cells |= old[k - 1] | old[k - 1] >> 1  # change; b's character inserted
                cells |= reached[k - 1] << 1  # a's character deleted
            reached[k] = cells & full
    end = len(a) - len(b) + threshold
    return next((k for k in range(threshold + 1) if reached[k] >> end & 1), threshold + 1)


def _shared(a: str, b: str, n: int) -> int:
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _signed(keys: np.ndarray) -> np.ndarray:
    return (keys ^ np.uint64(1 << 63)).view(np.int64)


def _post(texts: DataFrame, threshold: int, level: int, hot: list[np.ndarray], name_of: Callable[[], Callable]) -> DataFrame:
    """key, line, probe, sketch: the postings and probes of all lines that can be near others, each line once a batch."""
    held = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        name = name_of()
        for batch in batches:
            lines: dict[int, str] = {}
            size = 0

            def out():
                which, key, posts = postings(list(lines.values()), threshold, level, held.value)
                hashes = np.fromiter(lines, np.int64, len(lines))
                return pa.record_batch([pa.array(_signed(key)), pa.array(hashes[which]), pa.array(~posts), pa.array(sketches(list(lines.values()))[which])], ["key", "line", "probe", "sketch"])

            for text in batch.column(0):
                for _, line in normal_lines(text.as_py()):
                    if len(line) >= FOR_EACH and (h := name(line)) not in lines:
                        lines[h] = line
                        size += len(line)
                if size > 1 << 19:
                    yield out()
                    lines, size = {}, 0
            if lines:
                yield out()

    return texts.mapInArrow(run, "key bigint, line bigint, probe boolean, sketch bigint")


def _meet(posted: DataFrame, threshold: int, most: int | None) -> DataFrame:
    """a, b: pairs that meet under a key and whose sketches allow it; for lists of more than ``most`` pairs, a = the key and b = each of its lines, and ``long`` is true."""
    parts = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def batch_of(a, b, long):
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), long))], ["a", "b", "long"])

    def run(batches):
        held: list[tuple] = []
        size, skip = 0, None

        def pairs(key, line, probe, kinds):
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[heads[1:], len(key)]
            # postings come before probes; a list needs one, and lines that differ
            some = ~probe[heads] & (np.minimum.reduceat(line, heads) != np.maximum.reduceat(line, heads))
            found, n = [], 0
            for s, e in zip(heads[some].tolist(), ends[some].tolist(), strict=True):
                cut = s + int(np.searchsorted(probe[s:e], True))
                left, first = np.unique(line[s:cut], return_index=True)
                right, other = np.unique(line[s:e], return_index=True)
                if most is not None and len(left) * len(right) > most:
                    yield batch_of(np.full(len(right), key[s]), right, True)
                    continue
                x, y = (kinds[s:e][k].view(np.int8).reshape(-1, _KINDS) for k in (first, other))
                for k in range(len(left)):
                    near = right[(np.abs((x[k] - y).astype(np.int16)).sum(axis=1) <= 2 * threshold) & (right != left[k])]
                    if len(near):
                        found.append(np.stack([np.minimum(near, left[k]), np.maximum(near, left[k])], axis=1))
                        n += len(near)
                    if n > 1 << 20:
                        both = np.unique(np.concatenate(found), axis=0)
                        yield batch_of(both[:, 0], both[:, 1], False)
                        found, n = [], 0
            if found:
                both = np.unique(np.concatenate(found), axis=0)
                yield batch_of(both[:, 0], both[:, 1], False)

        for batch in batches:
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if skip is not None:  # the rest of a list too long to hold
                at = int(np.searchsorted(own[0], skip, side="right"))
                if at:
                    yield batch_of(own[0][:at], own[1][:at], True)
                own = [x[at:] for x in own]
                if not len(own[0]):
                    continue
                skip = None
            at = int(np.searchsorted(own[0], own[0][-1])) if len(own[0]) else 0
            if at:
                yield from pairs(*(np.concatenate([h[i] for h in held] + [x[:at]]) for i, x in enumerate(own)))
                held, size = [], 0
            held.append(tuple(x[at:] for x in own))
            size += len(own[0]) - at
            if most is not None and size > most:
                skip = own[0][-1]
                for h in held:
                    yield batch_of(h[0], h[1], True)
                held, size = [], 0
        if held and size:
            yield from pairs(*(np.concatenate([h[i] for h in held]) for i in range(4)))

    return posted.repartition(parts, "key").sortWithinPartitions("key", "probe").mapInArrow(run, "a bigint, b bigint, long boolean")


def _blocks(posted: DataFrame, keys: DataFrame, threshold: int) -> DataFrame:
    """a, b: pairs that meet under ``keys``, each list cut into blocks, so that a task holds two blocks and not a list."""
    sized = posted.join(keys, posted["key"] == keys["a"], "left_semi")
    sized = sized.join(sized.groupBy(F.col("key").alias("_k")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_LINES).cast("int").alias("blocks")), F.col("key") == F.col("_k"))
    own, other = F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = sized.where("not probe").select("key", own.alias("i"), other.alias("j"), "line", F.lit(False).alias("probe"), "sketch")
    right = sized.select("key", other.alias("i"), own.alias("j"), "line", F.lit(True).alias("probe"), "sketch")
    return _meet(left.unionByName(right).select(F.xxhash64("key", "i", "j").alias("key"), "line", "probe", "sketch"), threshold, None).select("a", "b")


def _longs(df: DataFrame) -> np.ndarray:
    """The sorted values of a DataFrame of one long column."""
    return np.sort(df.toArrow().column(0).to_numpy().astype(np.int64))


def _within(texts: DataFrame, hashes: DataFrame, name_of: Callable[[], Callable]) -> DataFrame:
    """line, content of the lines of ``texts`` whose names are in ``hashes`` (column line)."""

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("content", T.StringType())])))
    def cut(column: pa.Array) -> pa.Array:
        kind, name = pa.list_(pa.struct([("line", pa.int64()), ("content", pa.string())])), name_of()
        own = ({name(x): x for _, x in normal_lines(t.as_py()) if len(x) >= FOR_EACH} for t in column)
        return pa.array([[{"line": h, "content": x} for h, x in o.items()] for o in own], kind)

    if fits(hashes, BROADCAST_HASHES):
        wanted = texts.sparkSession.sparkContext.broadcast(_longs(hashes.select("line")))

        def pick(batches):
            name, sought = name_of(), wanted.value
            for batch in batches:
                lines = {name(x): x for text in batch.column(0) for _, x in normal_lines(text.as_py()) if len(x) >= FOR_EACH}
                names = np.fromiter(lines, np.int64, len(lines))
                at = np.searchsorted(sought, names)
                found = names[sought[np.minimum(at, len(sought) - 1)] == names].tolist() if len(sought) else []
                yield pa.record_batch([pa.array(found, pa.int64()), pa.array([lines[h] for h in found], pa.string())], ["line", "content"])

        lines = texts.mapInArrow(pick, "line bigint, content string")
    else:
        lines = texts.select(F.explode(cut(texts.columns[0])).alias("l")).select("l.*").join(hashes, "line", "left_semi")
    return lines.groupBy("line").agg(F.first("content").alias("content"))


def _candidates(texts: DataFrame, threshold: int, level: int, hot: list[np.ndarray], name_of: Callable[[], Callable]) -> DataFrame:
    """a, b of pairs that meet at a level or, for lists too long there, below it."""
    posted = _post(texts, threshold, level, hot, name_of)
    met = materialize(_meet(posted, threshold, PAIRED), "met")
    found = met.where("not long").select("a", "b")
    long = met.where("long")
    keys = materialize(long.select("a").distinct(), "keys")
    n = keys.count()
    if not n:
        return found
    if level == LEVELS:
        return found.unionByName(_blocks(posted, keys, threshold))
    # below, only the lines of such lists are read, and keys go by in slices that a task can hold
    lines = materialize(_within(texts, materialize(long.select(F.col("b").alias("line")).distinct(), "long"), name_of).select("content"), "long-lines")
    slices = -(-n // BROADCAST_HASHES)
    for k in range(slices):
        own = np.sort(_longs(keys.where(F.pmod(F.xxhash64("a"), F.lit(slices)) == k)).view(np.uint64) ^ np.uint64(1 << 63))
        found = found.unionByName(_candidates(lines, threshold, level + 1, [*hot, own], name_of))
    return found


def edit_links(texts: DataFrame, threshold: int = THRESHOLD, name_of: Callable[[], Callable] = lambda: namer({})) -> DataFrame:
    """a < b: names of all pairs of different near lines, over a one-column DataFrame of texts.

    Null and empty texts have no lines, repeated ones add none; an empty table gives no rows.
    ``name_of`` makes the function that names lines.
    """
    found = _candidates(texts, threshold, 0, [], name_of)
    found = materialize(found.distinct(), "candidates")
    ends = found.select(F.col("a").alias("line")).union(found.select("b")).distinct()
    contents = materialize(_within(texts, materialize(ends, "ends"), name_of), "contents")
    first = contents.select(F.col("line").alias("a"), F.col("content").alias("x"))
    second = contents.select(F.col("line").alias("b"), F.col("content").alias("y"))

    @F.arrow_udf(T.BooleanType())
    def near(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([edit_distance(p, q, k) <= k for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True) for k in (allowed(min(len(p), len(q)), threshold),)], pa.bool_())

    return found.join(first, "a").join(second, "b").where(near("x", "y")).select("a", "b")


def _lines(text: Column, bits: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("line", T.LongType()), T.StructField("check", T.LongType()), T.StructField("length", T.IntegerType())])))
    def cut(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("at", pa.int32()), ("line", pa.int64()), ("check", pa.int64()), ("length", pa.int32())]))
        return pa.array([[{"at": k, "line": h, "check": c, "length": len(x)} for k, x in normal_lines(t.as_py()) for h, c in (_halves(digest(x), bits),)] for t in texts], kind)

    return cut(text)


def _firsts(rows: DataFrame) -> DataFrame:
    """line, its first place, and the least and greatest of the other halves of its digests."""
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "at")
    return rows.groupBy("line").agg(F.min(place).alias("place"), F.min("check").alias("least"), F.max("check").alias("most"))


def line_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", name_bits: int = 64) -> DataFrame:
    """One row per line with words: row (of ``docs``), its id, at, line, length, class_id, n_links, kept.

    class_id is the smallest name among lines that chains of near lines connect, n_links the
    number of different lines near it.  Of a class the first line stays, by id (null last),
    row and place.  Lines under FOR_EACH code points are duplicates only when equal.  A line's
    name is ``name_bits`` of its digest; lines that share these, but not the 64 others, get names
    of their own.  Null and empty texts and an empty table give no rows; repeated rows are duplicates
    line by line; lines of any length are read whole.  Other columns of ``docs`` are not read.
    """
    small_batches(docs)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = source.select(F.monotonically_increasing_id().alias("row"), "id", F.explode(_lines(F.col("text"), name_bits)).alias("l")).select("row", "id", "l.*")
    rows = materialize(rows, "lines")
    # first places are known per line before lines meet in classes, so a line of a third of all documents is small here
    firsts = materialize(_firsts(rows), "firsts")
    shared = firsts.where("least != most").select("line")
    clashes: dict[tuple[int, int], int] = {}
    if not shared.isEmpty():  # some three such lines come in 10 billion
        others = rows.join(F.broadcast(shared), "line").select("line", "check").distinct().orderBy("line", "check").collect()
        for k, r in enumerate(others):
            if k and others[k - 1].line == r.line:
                h, check = r.line, r.check
                while (h, check) in clashes or h == r.line or h in clashes.values():
                    h, check = _halves(xxhash.xxh3_128_intdigest(f"{h} {check}".encode()))
                clashes[r.line, r.check] = h
        named = docs.sparkSession.createDataFrame([(h, c, n) for (h, c), n in clashes.items()], "line bigint, check bigint, name bigint")
        rows = materialize(rows.join(F.broadcast(named), ["line", "check"], "left").withColumn("line", F.coalesce("name", "line")), "lines")
        firsts = materialize(_firsts(rows), "firsts")
    links = materialize(edit_links(source.select("text"), name_of=lambda: namer(clashes, name_bits)), "links")
    degree = links.select(F.col("a").alias("line")).union(links.select("b")).groupBy("line").agg(F.count(F.lit(1)).alias("n_links"))
    roots = contract(links)
    near = degree.join(roots, degree["line"] == roots["node"], "left").select("line", "n_links", F.coalesce("root", "line").alias("class_id"))
    known = firsts.join(near, "line", "left").select("line", "place", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_id", "line").alias("class_id"))
    heads = known.groupBy("class_id").agg(F.min("place").alias("first"))
    known = materialize(known.join(heads, "class_id").select("line", "class_id", "n_links", "first.row", "first.at").withColumnsRenamed({"row": "first_row", "at": "first_at"}), "classes")
    out = rows.join(known, "line")
    return out.select("row", F.col("id").alias(id_col), "at", "line", "length", "class_id", "n_links", ((F.col("row") == F.col("first_row")) & (F.col("at") == F.col("first_at"))).alias("kept"))


def documents_summary(lines: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per different id of ``docs``, null too: n_lines, n_removed, n_near (lines with a near different line), n_links, n_chars_kept.

    Rows that repeat an id count together; ids without lines have zeros; an empty table gives no rows.
    """
    own = lines.groupBy(F.col(id_col).alias("_v_id")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(~F.col("kept")).alias("n_removed"), F.count_if(F.col("n_links") > 0).alias("n_near"),
        F.sum("n_links").alias("n_links"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("length"))), F.lit(0)).cast("long").alias("n_chars_kept"),
    )
    ids = docs.select(F.col(f"`{id_col}`").alias(id_col)).distinct()
    joined = ids.join(own, ids[id_col].eqNullSafe(own["_v_id"]), "left")
    return joined.select(id_col, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_lines", "n_removed", "n_near", "n_links", "n_chars_kept")])


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs``, its columns unchanged, each text without the lines that repeat an earlier near line.

    Rows of equal id and text, null ids too, change alike: what one of them keeps, all keep.
    Null and empty texts stay as they are; an empty table gives no rows.
    """
    key = F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("~")), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    keyed = docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text"))
    places = line_duplicates(keyed, "text", "key").groupBy("key", "at").agg(F.max("kept").alias("kept")).where("not kept")
    gone = places.groupBy(F.col("key").alias("_v_key")).agg(F.collect_list("at").alias("_v_gone"))
    joined = docs.withColumn("_v_of", key).join(gone, F.col("_v_of") == F.col("_v_key"), "left")
    rest = F.filter(F.split(F.col(f"`{text_col}`"), "\n", -1), lambda x, i: ~F.array_contains("_v_gone", i))
    text = F.when(F.col("_v_gone").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(rest, "\n"))
    return joined.withColumn("_v_text", text).withColumn(text_col, F.col("_v_text")).select([F.col(f"`{c}`") for c in docs.columns])
