"""Quality rules: lines that recur across documents of a host, and documents they deplete.

A line's frequency is the number of distinct documents of its host that hold it; documents
of equal lines count once, so copies of one document do not condemn it.  Lines at or above
the limit are removed; a document whose rest is too short, or too small a part, is depleted.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, materialize, small_batches, without

#: A line goes when so many distinct documents of its host hold it, and so large a share of them.
MIN_DOCUMENTS, MIN_SHARE = 10, 0.01
#: A document is depleted when lines went and fewer words, or a smaller share of its words, are left.
MIN_WORDS, MIN_REST = 50, 0.3
#: Fixed value: characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_DIGIT = re.compile(rb"[0-9]")
_LINE = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("line", T.LongType()), T.StructField("words", T.IntegerType())])
_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    at = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    _, pairs = np.unique(at[:-2] * len(known) + at[1:-1], return_inverse=True)
    _, window, n = np.unique(pairs * len(known) + at[2:], return_inverse=True, return_counts=True)
    again = n[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= again
    return int(covered.sum())


def measure(text: str | None) -> dict:
    """Base counts of a text, and its lines that have words: place, hash of the normalised line, words.

    A line is normalised to ASCII lower case, single spaces, and zeros for digits.
    """
    raw = (text or "").encode()
    words, lines, seen, dup, content = raw.split(), [], set(), 0, xxhash.xxh64()
    for at, line in enumerate(raw.split(b"\n")):
        own = line.split()
        if own:
            dup += line in seen
            seen.add(line)
            norm = _DIGIT.sub(b"0", b" ".join(own).lower())
            content.update(norm + b"\n")
            lines.append({"at": at, "line": xxhash.xxh64_intdigest(norm) - (1 << 63), "words": len(own)})
    spaces = len(raw) - len(raw.translate(None, SPACES))
    return {
        "n_words": len(words), "word_chars": len(text or "") - spaces, "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": dup, "n_repeat_words": repeated_words(words), "content": content.intdigest() - (1 << 63), "lines": lines,
    }


@F.arrow_udf(T.StructType([*(T.StructField(n, T.LongType()) for n in _LONGS), T.StructField("lines", T.ArrayType(_LINE))]))
def _measured(texts: pa.Array) -> pa.Array:
    line = pa.struct([("at", pa.int32()), ("line", pa.int64()), ("words", pa.int32())])
    return pa.array([measure(t.as_py()) for t in texts], pa.struct([*((n, pa.int64()) for n in _LONGS), ("lines", pa.list_(line))]))


def quality(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: its id, the base counts, base_failed, removed, n_left, kept.

    ``removed`` holds the places of the lines that go, ``n_left`` the words left without them.
    base_failed: under 50 words, or over half of them in repeated three-word windows.  A null
    text has no words; rows with a null host form one host; equal rows get equal verdicts; an
    empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    small_batches(docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{host_col}`").alias("host"), _measured(F.col(f"`{text_col}`")).alias("m"))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "id", F.coalesce(F.concat(F.lit("h"), "host"), F.lit("")).alias("host"), "m.*"), "measured")
    lines = rows.select("row", "host", "content", F.explode("lines").alias("l")).select("row", "host", "content", "l.*")
    # distinct first on all three, so that a line of a hot host is counted in many tasks
    counts = lines.select("host", "line", "content").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"))
    hosts = rows.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    often = materialize(counts.where(F.col("documents") >= MIN_DOCUMENTS).join(hosts, "host").where(F.col("documents") >= MIN_SHARE * F.col("of")).select("host", "line"), "often")
    gone = lines.join(often, ["host", "line"], "left_semi").groupBy("row").agg(F.sum("words").alias("lost"), F.sort_array(F.collect_list("at")).alias("removed"))
    judged = rows.drop("lines").join(gone, "row", "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    left = F.col("n_words") - F.col("lost")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("lost") > 0) & ((left < MIN_WORDS) | (left < MIN_REST * F.col("n_words")))
    return judged.select(F.col("id").alias(id_col), *_LONGS[:-1], failed.alias("base_failed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), left.alias("n_left"), (~failed & ~depleted).alias("kept"))


def clean(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source") -> DataFrame:
    """``docs``, its columns unchanged, of kept documents, without the lines that go.

    Equal ids are told apart by host and text, which decide the verdict.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{host_col}`").alias(host_col), F.col(f"`{text_col}`").alias(text_col))
    key = F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("~")), F.coalesce(F.col(f"`{host_col}`"), F.lit("~")), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    keyed = slim.withColumn("_v_key", key)
    verdicts = quality(keyed, text_col, "_v_key", host_col).where("kept").groupBy("_v_key").agg(F.first("removed").alias("_v_removed"))
    found = docs.withColumn("_v_key", key).join(verdicts, "_v_key")
    rest = F.filter(F.split(F.col(f"`{text_col}`"), "\n", -1), lambda x, i: ~F.array_contains("_v_removed", i))
    return without(found.withColumn(text_col, F.array_join(rest, "\n")).select([F.col(f"`{c}`") for c in docs.columns]), "_v_key")
