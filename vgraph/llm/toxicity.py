"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Every word of the labelled sample spans the vector space.  A word weighs its inverse document
frequency, times one plus its log-likelihood ratio for the toxic class where it is commoner
there (supervised TF-IDF: without it the few words that mark a text drown in its ordinary
ones), and counts within a text on a logarithmic scale.  An index over a bounded number of
labelled examples answers each text with its exactly nearest ones; votes weighted by
closeness, calibrated on the examples themselves (each left out of its own vote), give the
score, and the voters are the evidence.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import fits, materialize, small_batches, without

#: Labelled texts that the model is fitted on at most: those with the smallest hashes of their ids.
EXAMPLES = 2_000
#: Labels up to this number are broadcast to find their texts (a hash relation of 2,000,000 takes some 150 MB); beyond it a shuffle join does.
BROADCAST_LABELS = 500_000
NEIGHBOURS, BLOCK, PRIOR_WEIGHT = 16, 64, 0.5

_WORD = re.compile(r"\w+")


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


class BlockMaxIndex:
    """Postings of unit vectors, with each term's largest impact in every block of examples that it occurs in."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        lead = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        self.order = np.argsort(lead, kind="stable")  # like examples share blocks, so bounds are tight
        at = np.concatenate([np.full(len(vectors[d][0]), k) for k, d in enumerate(self.order)] + [np.zeros(0)]).astype(np.int64)
        term = np.concatenate([vectors[d][0] for d in self.order] + [np.zeros(0)]).astype(np.int64)
        impact = np.concatenate([vectors[d][1] for d in self.order] + [np.zeros(0)])
        by_term = np.lexsort((at, term))
        self.docs, self.impacts, term = at[by_term].astype(np.int32), impact[by_term], term[by_term]
        self.blocks = max(1, -(-len(vectors) // BLOCK))
        # a chunk is a term's postings within a block
        name = term * self.blocks + self.docs // BLOCK
        heads = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else np.zeros(0, np.int64)
        self.start = np.r_[heads, len(name)].astype(np.int32)
        self.block = self.docs[heads] // BLOCK
        most = np.maximum.reduceat(self.impacts, heads) if len(heads) else np.zeros(0)
        self.most = np.nextafter(most.astype(np.float32), np.float32(2))  # rounded up, as it is a bound
        self.chunks = np.searchsorted(term[heads], np.arange(n_terms + 1)).astype(np.int32)

    def nearest(self, query: tuple[np.ndarray, np.ndarray], k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of largest cosine above zero, ties by place, and their cosines.

        Blocks are scored from the largest bound down until no bound reaches the k-th best.
        """
        term, weight = query
        chunk, n = _ranges(self.chunks[term], self.chunks[term + 1])
        weight = np.repeat(weight, n)
        bounds = np.bincount(self.block[chunk], weight * self.most[chunk], self.blocks)
        todo = np.argsort(-bounds, kind="stable")
        todo = todo[bounds[todo] > 0]
        best, score = np.zeros(0, np.int64), np.zeros(0)
        first, step = 0, 8
        while first < len(todo) and not (len(score) >= k and bounds[todo[first]] < score[k - 1] - 1e-12):
            now = np.zeros(self.blocks, bool)
            now[todo[first : first + step]] = True
            own = np.flatnonzero(now[self.block[chunk]])
            rows, n = _ranges(self.start[chunk[own]], self.start[chunk[own] + 1])
            sums = np.bincount(self.docs[rows], np.repeat(weight[own], n) * self.impacts[rows], self.blocks * BLOCK)
            hit = np.flatnonzero(sums)
            docs, scores = np.concatenate([best, hit]), np.concatenate([score, sums[hit]])
            if but >= 0:
                keep = self.order[docs] != but
                docs, scores = docs[keep], scores[keep]
            if len(docs) > 4 * k:  # all that can be among the best, ties included
                keep = scores >= np.partition(scores, -k)[-k]
                docs, scores = docs[keep], scores[keep]
            top = np.lexsort((docs, -scores))[:k]
            best, score = docs[top], scores[top]
            first, step = first + step, step * 4
        return self.order[best], score


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, and how many each has."""
    n = (end - start).astype(np.int64)
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


class Model:
    """What scoring needs; its size is bounded by the texts of EXAMPLES examples."""

    def __init__(self, ids: list, counts: list[Counter], labels: np.ndarray, id_type: T.DataType | None = None):
        self.ids, self.labels, self.id_type = ids, np.asarray(labels, float), id_type or T.LongType()
        p_all = int(self.labels.sum())
        n_all = len(self.labels) - p_all
        everywhere, toxic = Counter(), Counter()
        for own, y in zip(counts, self.labels, strict=True):
            everywhere.update(own.keys())
            if y:
                toxic.update(own.keys())
        self.place = {w: k for k, w in enumerate(sorted(everywhere))}
        self.weight = np.array([np.log(1 + len(counts) / everywhere[w]) * (1 + _ratio(toxic[w], everywhere[w] - toxic[w], p_all, n_all)) for w in self.place])
        vectors = [self.weigh(c) for c in counts]
        self.index = BlockMaxIndex(vectors, len(self.place))
        self.prior = (p_all + 0.5) / (len(self.labels) + 1.0) if counts else 0.0
        bare = np.array([not c for c in counts], bool)
        self.bare = float((self.labels[bare].sum() + 0.5) / (bare.sum() + 1.0)) if bare.any() else float(self.prior)
        self.slope, self.shift = 1.0, 0.0
        votes = [(self.vote(v, k)[0], y) for k, (v, y) in enumerate(zip(vectors, self.labels, strict=True)) if len(v[0])]
        if votes:
            self.calibrate(*(np.array(x) for x in zip(*votes, strict=True)))

    def weigh(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a unit vector; words that no example has are no terms."""
        own = [(k, n) for w, n in counts.items() if (k := self.place.get(w)) is not None]
        if not own:
            return np.zeros(0, np.int64), np.zeros(0)
        t, n = np.array(own, np.int64).T
        w = self.weight[t] * (1 + np.log(n))
        return t, w / np.linalg.norm(w)

    def vote(self, query: tuple[np.ndarray, np.ndarray], but: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        near, cosine = self.index.nearest(query, NEIGHBOURS, but)
        w = cosine**2
        return (w @ self.labels[near] + PRIOR_WEIGHT * self.prior) / (w.sum() + PRIOR_WEIGHT), near, cosine

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Logistic curve over the votes' log-odds, by Newton steps on smoothed targets."""
        x = np.log(votes / (1 - votes))
        goal = np.where(labels > 0, 1 - 1 / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
        a = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a[0] * x + a[1])))
            g = np.array([(p - goal) @ x, (p - goal).sum()]) + 1e-2 * (a - [1, 0])
            v = p * (1 - p)
            h = np.array([[v @ (x * x), v @ x], [v @ x, v.sum()]]) + 1e-2 * np.eye(2)
            step = np.linalg.solve(h, g)
            a -= np.clip(step, -1, 1)
            if abs(step).max() < 1e-9:
                break
        if a[0] > 0:
            self.slope, self.shift = a

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        found = self.weigh(word_counts(text))
        if not len(found[0]):
            return self.bare, []
        vote, near, cosine = self.vote(found)
        p = 1 / (1 + np.exp(-(self.slope * np.log(vote / (1 - vote)) + self.shift)))
        return float(p), [{"id": self.ids[d], "similarity": float(c), "label": int(self.labels[d])} for d, c in zip(near, cosine, strict=True)]


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", examples: int = EXAMPLES) -> Model:
    """A model from at most ``examples`` texts of ``docs`` that ``labels`` marks; equal texts count once, by majority.

    Null ids and null labels are ignored; null texts are empty; without any label every text
    scores zero.  Of rows that share an id and differ in text, each is an example.
    """
    small_batches(docs)
    own = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    small = fits(own, BROADCAST_LABELS)
    hashed = texts.select("id", "h").join(F.broadcast(own) if small else own, "id")
    train = hashed.groupBy("h").agg(F.min("id").alias("id"), (F.avg("y") >= 0.5).cast("int").alias("y"))
    sample = materialize(train.orderBy(F.xxhash64("id"), "id", "h").limit(examples), "examples")
    words = T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])

    @F.arrow_udf(words)
    def count(column: pa.Array) -> pa.Array:
        found = [word_counts(t.as_py()) for t in column]
        return pa.StructArray.from_arrays([pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["words", "counts"])

    found = texts.join(F.broadcast(sample), ["id", "h"]).select("id", "h", "y", count("text").alias("c")).select("id", "h", "y", "c.*").toArrow()
    at = {(i, h): k for k, (i, h) in enumerate(zip(found.column("id").to_pylist(), found.column("h").to_pylist(), strict=True))}
    order = [at[key] for key in sorted(at)]
    ids, labelled = ([found.column(n)[k].as_py() for k in order] for n in ("id", "y"))
    counts = [Counter(dict(zip(found.column("words")[k].as_py(), found.column("counts")[k].as_py(), strict=True))) for k in order]
    del found
    return Model(ids, counts, np.array(labelled, float), docs.schema[id_col].dataType)


def _ratio(p: int, n: int, p_all: int, n_all: int) -> float:
    """Log-likelihood ratio of a term with p of p_all toxic and n of n_all other texts; zero if not commoner among toxic ones."""
    if p * n_all <= n * p_all:
        return 0.0
    share = (p + n) / (p_all + n_all)
    cells = ((p, p_all * share), (n, n_all * share), (p_all - p, p_all * (1 - share)), (n_all - n, n_all * (1 - share)))
    return 2 * sum(o * np.log(o / e) for o, e in cells if o)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from one half on) and evidence (the nearest examples: id, similarity, label).

    Null, empty and wordless texts score the share of toxic ones among such examples, and so
    do texts without any word of an example; they have no evidence.  Every row is scored from
    its whole text alone, so ties, repeated rows and other columns do not matter; an empty
    table gives no rows.
    """
    held = small_batches(docs).sparkContext.broadcast(model)
    evidence = T.ArrayType(T.StructType([T.StructField("id", model.id_type), T.StructField("similarity", T.DoubleType()), T.StructField("label", T.IntegerType())]))
    kind = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.struct([("id", to_arrow_type(model.id_type)), ("similarity", pa.float64()), ("label", pa.int32())])))])

    @F.arrow_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", evidence)]))
    def judge(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("score", "evidence"), held.value.score(t.as_py()), strict=True)) for t in texts], kind)

    judged = without(docs, "score", "predicted", "evidence").withColumn("_v_j", judge(F.col(f"`{text_col}`")))
    return without(judged.withColumn("score", F.col("_v_j.score")).withColumn("predicted", (F.col("_v_j.score") >= 0.5).cast("int")).withColumn("evidence", F.col("_v_j.evidence")), "_v_j")


def fold(id_col: str = "doc_id", of: int = 5):
    """The id's place among ``of`` folds."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % of
