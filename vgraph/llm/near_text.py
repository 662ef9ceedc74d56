"""Near-duplicate texts: the byte-position inverted index of SimHash fingerprints, verified on word shingles.

Fingerprints of shingles lie far apart even for close texts, as one changed word spoils
every shingle that holds it.  So candidates come from fingerprints of single words, each
distinct word weighing the root of its count times its length less two, which one changed
word hardly moves; two prints of 64 bits are taken, from the halves of a 128-bit hash.
Texts are candidates when either print differs in at most ``BITS`` bits.  Such prints
differ in at most so many of their eight positional bytes and share the rest, the
guaranteed minimum: the index posts them under every joint key of that many positions.
Candidates are verified: they are linked when the sets of their word shingles have a
Jaccard similarity of at least the wanted one.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels.components import contract
from ..storage import bucketed
from .common import fits, materialize, small_batches, without
from .simhash import PAIRED_LIST, joint_keys

#: Differing bits of one of the two prints up to which texts are candidates.
BITS = 5
#: Rows of 40 bytes up to this number (some 60 MB in a hash relation) are broadcast; beyond it a shuffle join is taken.
BROADCAST_TEXTS = 500_000
_BLOCK = 1 << 16


def word_prints(text: str | None) -> tuple[int, int]:
    """Bit b is set when the words whose hash has it weigh over half of all; no words: zeros."""
    counts = Counter((text or "").encode().lower().split())  # bytes: A-Z and ASCII white space only
    words, times = list(counts), np.fromiter(counts.values(), np.float64, len(counts))
    weights = np.rint(16 * np.sqrt(times)).astype(np.int64) * np.fromiter((max(1, len(w) - 2) for w in words), np.int64, len(words))
    ones = np.zeros(128, np.int64)
    for k in range(0, len(words), _BLOCK):
        h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in words[k : k + _BLOCK]), np.uint8).reshape(-1, 16)
        ones += (np.unpackbits(h, axis=1) * weights[k : k + _BLOCK, None]).sum(axis=0)
    a, b = np.packbits(ones * 2 > weights.sum()).view(">i8").tolist()
    return a, b


@F.arrow_udf(T.ArrayType(T.LongType()))
def _prints(texts: pa.Array) -> pa.Array:
    return pa.array([word_prints(t.as_py()) for t in texts], pa.list_(pa.int64()))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; fewer words: of all of them together; none: empty."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[k : k + width])) for k in range(n)), np.uint64, n))


def _shingles(width: int):
    @F.arrow_udf(T.BinaryType())
    def shingles(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_hashes(t.as_py(), width).tobytes() for t in texts], pa.binary())

    return shingles


@F.arrow_udf(T.DoubleType())
def _jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    def one(x, y):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0

    return pa.array([one(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.float64())


def _near(x: str, y: str):
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= BITS


def _pairs(left: DataFrame, right: DataFrame, cond) -> DataFrame:
    """a < b: nodes of rows of both sides that share a list, for which ``cond`` holds and whose prints are near."""
    l, r = (d.select("list", *[F.col(c).alias(c + s) for c in d.columns if c != "list"]) for d, s in ((left, "1"), (right, "2")))
    met = l.join(r, "list").where(cond & _near("fp1", "fp2"))
    return met.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def _text_key(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))


def _verified(pairs: DataFrame, known: DataFrame, docs: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """Those of the pairs whose texts have the similarity. Only texts of candidates are read into shingles, each once."""
    pairs = materialize(pairs, "candidates")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialize(known.join(nodes, "node").select("node", "key"), "wanted")
    texts = docs.select(_text_key(text_col).alias("key"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.join(F.broadcast(wanted) if fits(wanted, BROADCAST_TEXTS) else wanted, "key").groupBy("node").agg(F.any_value("text").alias("text"))
    sets = materialize(texts.select("node", _shingles(width)("text").alias("s")), "shingles")
    a, b = (sets.select(F.col("node").alias(c), F.col("s").alias("s" + c)) for c in "ab")
    size = [F.octet_length("sa"), F.octet_length("sb")]
    both = pairs.join(a, "a").join(b, "b").where(F.least(*size) >= F.greatest(*size) * similarity)
    return materialize(both.where(_jaccard("sa", "sb") >= similarity).select("a", "b"), "near")


def near_text_links(known: DataFrame, docs: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """Pairs a, b of nodes of ``known`` (node, key, prints) whose connection equals that of all linked pairs.

    Lists of up to ``PAIRED_LIST`` texts are paired.  In a longer one all are held against its
    first text; then texts outside its largest component so far are held against those of
    other components.  Two texts of one component need no link of their own, so a list of
    copies costs what it has texts; only one of many texts that are unlike but have near
    prints makes more pairs, which are dropped by their prints inside the join.
    """
    keys = joint_keys(BITS)
    shifts = F.array(*[F.array(*[F.lit(8 * b) for b in p]) for p in keys])
    posted = known.select("node", F.posexplode("prints").alias("p", "fp")).select("node", "fp", "p", F.posexplode(shifts).alias("q", "at"))
    name = reduce(lambda x, k: x * 256 + F.expr(f"shiftright(fp, at[{k}]) & 255"), range(len(keys[0])), F.col("p").cast("long") * len(keys) + F.col("q"))
    n = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = posted.select("node", "fp", name.alias("list")).repartition(n, "list")
    lists = posted.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("list"))).where("n > 1")
    lists = bucketed(lists, "list", n, "lists")  # the joins of lists move nothing
    short, long = lists.where(F.col("n") <= PAIRED_LIST).drop("n"), lists.where(F.col("n") > PAIRED_LIST).drop("n")
    heads = long.groupBy("list").agg(F.min(F.struct("node", "fp")).alias("h")).select("list", "h.node", "h.fp")
    later = F.col("node1") < F.col("node2")
    found = _verified(_pairs(short, short, later).unionByName(_pairs(heads, long, later)).distinct(), known, docs, text_col, width, similarity)
    if long.isEmpty():
        return found
    roots = contract(found)
    rooted = long.join(roots, "node", "left").select("list", "node", "fp", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted")
    most = rooted.groupBy("list", "root").count().groupBy("list").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count(F.lit(1)).alias("c"))
    rest = rooted.join(most.where("c > 1"), "list").where("root != most").drop("most", "c")
    crossing = _pairs(rest, rooted, F.col("root1") != F.col("root2"))
    return found.unionByName(_verified(crossing, known, docs, text_col, width, similarity))


def near_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """key (SHA-256 of the text), component_id, n_texts, n_rows of every distinct text of ``docs``.

    component_id is the smallest id reachable over links, null if none has an id; n_texts and
    n_rows count its component.  Texts are compared by their words, A-Z lower-cased, however
    long; those of fewer words than ``width`` are linked when all words are equal, null and wordless
    texts with each other.  Equal rows count as often as they are; an empty table gives no
    rows.  Other columns of ``docs`` are not read.
    """
    small_batches(docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _text_key(text_col).alias("key"), _prints(F.col(f"`{text_col}`")).alias("prints"))
    known = rows.groupBy("key").agg(F.any_value("prints").alias("prints"), F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    known = materialize(known.withColumn("node", F.monotonically_increasing_id()), "texts")
    roots = contract(near_text_links(known.select("node", "key", "prints"), docs, text_col, width, similarity))
    named = known.join(roots, "node", "left").select("key", "least", "rows", F.coalesce("root", "node").alias("root"))
    top = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_texts"), F.sum("rows").alias("n_rows"))
    return materialize(named.join(top, "root").select("key", "component_id", "n_texts", "n_rows"), "classes")


def drop_near_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs``, its columns unchanged, with one document of each component: that with the smallest id.

    Rows with a null id stay; of rows of one component that repeat its smallest id all stay,
    as they are one document.
    """
    classes = near_texts(docs, text_col, id_col, width, similarity).where("n_rows > 1")
    classes = classes.select(F.col("key").alias("_v_key"), F.col("component_id").alias("_v_class"), F.lit(True).alias("_v_met"))
    keyed = docs.join(F.broadcast(classes) if fits(classes, BROADCAST_TEXTS) else classes, _text_key(text_col) == F.col("_v_key"), "left")
    own = docs[f"`{id_col}`"]
    return without(keyed.where(F.col("_v_met").isNull() | own.isNull() | (own == F.col("_v_class"))), "_v_key", "_v_class", "_v_met")
