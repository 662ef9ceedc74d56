"""Scores by a class-based n-gram language model (Brown classes found by exchange clustering).

Exchange goes over the whole vocabulary in two levels.  The most frequent words, and symbols
for the endings of all others, are exchanged one after another until class bigrams tell most.
Then every other word is exchanged on its own: it leaves the class of its ending for the one
in which its contexts gain most.  The number of classes grows with the vocabulary.  A token's
probability is that of its class after the class before, times that of the word in its class:
    P(w | before) = P(class(w) | class(before)) * P(w | class(w)).
Each class keeps some mass for unseen words.  An unseen word has that mass, whatever the class,
times its probability under a model of spelling, so probabilities sum to at most one.
Counts come from every training document.  Tables of bounded size (the most frequent words,
class counts of symbols) go by broadcast; words beyond them meet their counts in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches

#: Words that are exchanged one after another, and symbols of endings.
HEAD, ENDINGS = 8192, 1024
#: Most frequent words at most whose counts and classes are broadcast (about 8 MB); all others are joined.
KNOWN = 262_144
#: Classes at most, as a class is written in one byte; a vocabulary of 270 million words has so many.
CLASSES = 256
#: Rounds of exchange; in each, half of the symbols may move.
ROUNDS = 6
#: Weight of the class distribution behind each row of transitions.
SMOOTHING = 5.0
#: Tokens that a task of the word exchange is laid out for.
RANGE_TOKENS = 4_000_000
SYMBOLS, _BLOCK = 1 + HEAD + ENDINGS, 2048


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def n_classes(words: int) -> int:
    """Classes for a vocabulary of so many words: twice its fourth root, 16 at least."""
    return int(min(CLASSES, max(16, round(2 * words**0.25))))


def _vocabulary(texts: DataFrame) -> DataFrame:
    """word (bytes, A-Z in lower case), ending, n over all ``texts``."""

    def count(batches):
        seen: Counter = Counter()

        def out():
            yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array([ending(w) for w in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "ending", "n"])
            seen.clear()

        for batch in batches:
            for text in batch.column(0):
                seen.update((text.as_py() or "").encode().lower().split())
                if len(seen) > 200_000:
                    yield from out()
        yield from out()

    return texts.mapInArrow(count, "word binary, ending int, n bigint").groupBy("word", "ending").agg(F.sum("n").alias("n"))


def _added(parts: DataFrame, blocks: int, spread: int) -> dict[int, np.ndarray]:
    """Sums of ``counts`` (binary of ``kind``) by ``block``, in two levels, so that no task adds up what every task sent."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, kind, data in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "counts")), strict=True):
                part = np.frombuffer(data, kind).astype(np.int64)
                held[b] = held[b] + part if b in held else part
        for b, part in held.items():
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array(["<i8"]), pa.array([part.astype("<i8").tobytes()], pa.binary())], ["block", "kind", "counts"])

    kind = "block int, kind string, counts binary"
    first = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(spread))).repartition(blocks * spread, "block", "part").mapInArrow(add, kind)
    return {r.block: np.frombuffer(r.counts, "<i8") for r in first.repartition(blocks, "block").mapInArrow(add, kind).collect()}


def _packed(block: int, counts: np.ndarray) -> pa.RecordBatch:
    kind = next(k for k, bits in (("<u1", 8), ("<u2", 16), ("<u4", 32), ("<u8", 64)) if int(counts.max(initial=0)) < 1 << bits)
    return pa.record_batch([pa.array([block], pa.int32()), pa.array([kind]), pa.array([counts.astype(kind).tobytes()], pa.binary())], ["block", "kind", "counts"])


def _letters() -> np.ndarray:
    """Symbols of bytes in spelling, by rule: letters, digits, the rest of ASCII, UTF-8 beginnings and continuations; 0 ends a word."""
    out = np.full(256, 28)
    out[32] = 0
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[ord("0") : ord("9") + 1] = 27
    out[0x80:0xC0] = 32 + np.arange(64) // 4
    out[0xC0:] = 31
    out[0xC2], out[0xC3] = 29, 30
    return out


_LETTER, _LETTERS, _WINDOW = _letters(), 48, 4
#: log10 of the probability of a byte among those of its symbol.
_WITHIN = -np.log10(np.bincount(_LETTER, minlength=_LETTERS)[_LETTER])


class Spelling:
    """Probabilities of words by windows of byte symbols, each length mixed with the next shorter one; all words together have one at most."""

    def __init__(self, counts: np.ndarray):
        """``counts``: of windows, by code."""

        def mixed(c: np.ndarray, p: np.ndarray) -> np.ndarray:
            other = np.maximum((c > 0).sum(axis=-1, keepdims=True), 1.0)  # as many as there are symbols that follow
            return (c + other * p) / (c.sum(axis=-1, keepdims=True) + other)

        p = np.full(_LETTERS, 1 / _LETTERS)
        for n in range(1, _WINDOW):
            p = mixed(counts.reshape(-1, *(_LETTERS,) * n).sum(axis=0, dtype=np.float64), p)
        # the longest windows by their first symbols, as the whole table takes much of a driver
        self.logs = np.empty(_LETTERS**_WINDOW, np.float32)
        for logs, c in zip(self.logs.reshape(_LETTERS, *p.shape), counts.reshape(_LETTERS, *p.shape), strict=True):
            logs[:] = np.log10(mixed(c, p))

    @staticmethod
    def windows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words one after another: the code of each window, the byte at its end, and where each word begins; codes between words are -1."""
        gap = b" " * (_WINDOW - 1)
        raw = np.frombuffer(gap + gap.join(words) + b" ", np.uint8)
        s = _LETTER[raw]
        n = np.fromiter(map(len, words), np.int64, len(words)) + _WINDOW - 1
        starts = np.cumsum(n) - n
        code = np.zeros(len(raw) - _WINDOW + 1, np.int64)
        for k in range(_WINDOW):
            code = code * _LETTERS + s[k : k + len(code)]
        for k in range(1, _WINDOW - 1):  # a word's end is spelled once; further spaces only move the window on
            code[starts[1:] - k] = -1
        return code, raw[_WINDOW - 1 :], starts

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word."""
        if not words:
            return np.zeros(0)
        code, last, starts = self.windows(words)
        return np.add.reduceat(np.where(code >= 0, self.logs[code] + _WITHIN[last], 0.0), starts)


def _spelling(words: DataFrame) -> Spelling:
    """A model of the spelling of ``words`` (a column of bytes), each counted once; it has a number for each window at most."""

    def count(batches):
        total = np.zeros(_LETTERS**_WINDOW, np.int64)
        for batch in batches:
            code = Spelling.windows(batch.column(0).to_pylist())[0] if batch.num_rows else np.zeros(0, np.int64)
            total += np.bincount(code[code >= 0], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["code", "n"])

    found = words.mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_LETTERS**_WINDOW, np.int64)
    counts[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return Spelling(counts)


class Lexicon:
    """Codes of tokens: 0 the end of a text, then the most frequent words, then endings of all others. Bounded by KNOWN."""

    def __init__(self, words: list[bytes], counts: np.ndarray, documents: int, discount: float, spelling: Spelling):
        self.text, self.head, self.known, self.spelling = b" ".join(words), min(HEAD, len(words)), len(words), spelling
        rank = np.arange(len(words))
        own = np.where(rank < HEAD, 1 + rank, 1 + HEAD + np.array([ending(w) for w in words], np.int64))
        self.symbol = np.concatenate([[0], own, 1 + HEAD + np.arange(ENDINGS)]).astype(np.int64)
        self.hash = np.array([0, *map(word_hash, words), *[0] * ENDINGS], np.uint64)
        self.base = np.log10(np.r_[documents, counts] + 1.0)
        self.own = np.log10(np.r_[max(documents, 1), np.where(rank < HEAD, counts, counts - discount)])
        self.seen_end = int(documents > 0)
        self.place: dict[bytes, int] | None = None

    def encode(self, texts: list[str | None]) -> pa.StructArray:
        """Of each text: tokens, those known here, their log counts, codes in order, and the words not known here with their places."""
        if self.place is None:
            self.place = {w: k for k, w in enumerate(self.text.split(), 1)}
        get, tokens, known, base, own, codes, places, unknown, many = self.place.get, [], [], [], [], [], [], [], []
        for text in texts:
            words = (text or "").encode().lower().split()
            at = np.array([*map(get, words), 0], float)  # None becomes nan
            rest = np.flatnonzero(np.isnan(at))
            here = at[~np.isnan(at)].astype(np.int64)
            if len(rest):
                mine = [words[k] for k in rest.tolist()]
                at[rest] = [1 + self.known + ending(w) for w in mine]
                unknown += mine
                places.append(rest)
            many.append(len(rest))
            tokens.append(len(words) + 1)
            known.append(len(here) - 1 + self.seen_end)
            base.append(self.base[here].sum())
            own.append(self.own[here].sum())
            codes.append(at.astype("<u4").tobytes())
        offsets = pa.array(np.r_[0, np.cumsum(many)].astype(np.int32))
        tail = pa.StructArray.from_arrays([pa.array(unknown, pa.binary()), pa.array(np.concatenate([np.zeros(0, np.int64), *places]).astype(np.int32)), pa.array(self.spelling(unknown), pa.float64())], ["word", "at", "spelled"])
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64()), pa.array(codes, pa.binary()), pa.ListArray.from_arrays(offsets, tail)], _ENCODED.fieldNames())


_TAIL = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("at", T.IntegerType()), T.StructField("spelled", T.DoubleType())])
_ENCODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("own", T.DoubleType()), T.StructField("codes", T.BinaryType()), T.StructField("tail", T.ArrayType(_TAIL))])


def _running(batch: pa.RecordBatch, some: int = 256):
    """The codes of a batch of texts, some texts at a time: each text follows an end (0) and closes with one; and which texts."""
    parts = [np.frombuffer(s, "<u4") for s in batch.column(0).to_pylist()]
    for at in range(0, len(parts), some):
        yield at, parts[at : at + some], np.concatenate([np.zeros(1, np.uint32), *parts[at : at + some]]).astype(np.int64)


def context_counts(codes: DataFrame, symbol: np.ndarray, classes: np.ndarray, k: int, spread: int) -> np.ndarray:
    """How often each symbol has each class before it [0] and after it [1], over a column of code strings.

    A task adds up one matrix of fixed size; matrices are cut into blocks of symbols, which
    are added in many tasks, each holding its blocks only.
    """
    held = codes.sparkSession.sparkContext.broadcast((symbol, classes.astype(np.int64)))

    def count(batches):
        names, of = held.value
        total = np.zeros((2, len(of) * k), np.int64)
        for batch in batches:
            for _, _, codes in _running(batch):
                s = names[codes]
                c = of[s]
                total[0] += np.bincount(s[1:] * k + c[:-1], minlength=len(of) * k)
                total[1] += np.bincount(s[:-1] * k + c[1:], minlength=len(of) * k)
        cube = total.reshape(2, len(of), k)
        for b in range(0, len(of), _BLOCK):
            part = cube[:, b : b + _BLOCK]
            if part.any():
                yield _packed(b, part)

    out = np.zeros((2, len(classes), k), np.int64)
    for b, counts in _added(codes.mapInArrow(count, "block int, kind string, counts binary"), -(-len(classes) // _BLOCK), spread).items():
        part = counts.reshape(2, -1, k)
        out[:, b : b + part.shape[1]] = part
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(counts: np.ndarray, classes: np.ndarray, movable: np.ndarray) -> np.ndarray:
    """One round: each movable symbol goes, most frequent first, to the class that gains the likelihood most.

    The likelihood of class bigrams is the sum of n log n over pairs of classes less that
    over classes, twice.  Contexts are those counted under ``classes``.
    """
    before, after = counts[0].astype(float), counts[1].astype(float)
    classes, k = classes.copy(), counts.shape[2]
    size = before.sum(axis=1)
    pairs, totals = np.zeros((k, k)), np.bincount(classes, size, k)
    np.add.at(pairs.T, classes, before)
    logs = _xlogx(totals)
    for s in np.argsort(-size, kind="stable"):
        if not movable[s] or not size[s]:
            continue
        own, left, right, n = classes[s], before[s], after[s], size[s]
        pairs[:, own] = np.maximum(pairs[:, own] - left, 0)
        pairs[own, :] = np.maximum(pairs[own, :] - right, 0)
        totals[own] -= n
        logs[own] = _xlogx(totals[own])
        where_l, where_r = np.flatnonzero(left), np.flatnonzero(right)
        p, q = pairs[where_l], pairs[:, where_r]
        gain = (_xlogx(p + left[where_l, None]) - _xlogx(p)).sum(axis=0) + (_xlogx(q + right[where_r]) - _xlogx(q)).sum(axis=1)
        gain -= 2 * (_xlogx(totals + n) - logs)
        best = int(np.argmax(gain))
        best = int(own) if gain[own] >= gain[best] - 1e-9 else best
        classes[s] = best
        pairs[:, best] += left
        pairs[best, :] += right
        totals[best] += n
        logs[best] = _xlogx(totals[best])
    return classes


def likelihood(counts: np.ndarray, classes: np.ndarray) -> float:
    pairs = np.zeros((counts.shape[2],) * 2)
    np.add.at(pairs.T, classes, counts[0].astype(float))
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(axis=0)).sum() - _xlogx(pairs.sum(axis=1)).sum())


def cluster(codes: DataFrame, symbol: np.ndarray, k: int, spread: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all symbols, and the counts of class pairs under them, the best that the rounds reach."""
    n = int(symbol.max()) + 1
    classes = np.minimum(np.arange(n), k - 1)  # the most frequent words first have classes of their own
    best, kept, pairs = -np.inf, classes, np.zeros((k, k))
    for turn in range(rounds + 1):
        counts = context_counts(codes, symbol, classes, k, spread)
        now = likelihood(counts, classes)
        if now > best:
            best, kept, pairs = now, classes, np.zeros((k, k))
            np.add.at(pairs.T, classes, counts[0].astype(float))
        if turn < rounds:
            classes = exchange(counts, classes, np.arange(n) % 2 == turn % 2)
    return kept, pairs


def better_classes(entries: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of words, and the class to which exchange moves each.

    An entry holds, from its highest bits on, 40 bits that name a word, and a byte each for the
    word's class, the class before it and the class after it; entries ascend, ``counts`` says
    how often each occurs.  Every word is weighed against the same ``pairs`` of classes, of
    which its own counts are taken where it is.
    """
    k, totals = len(pairs), pairs.sum(axis=0)
    name = entries >> np.uint64(16)
    heads = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    word = np.cumsum(np.r_[True, name[1:] != name[:-1]]) - 1
    own = (name[heads] & np.uint64(255)).astype(np.int64)
    before, after = ((entries >> np.uint64(b) & np.uint64(255)).astype(np.int64) for b in (8, 0))
    gain = np.zeros((len(heads), k))
    for side, table in ((before, pairs), (after, pairs.T)):
        key, at = np.unique(word * 256 + side, return_inverse=True)
        n, w, x = np.bincount(at, counts), key // 256, key % 256
        rows, mine = table[x], own[w]
        more = _xlogx(rows + n[:, None]) - _xlogx(rows)
        here = rows[np.arange(len(key)), mine]
        more[np.arange(len(key)), mine] = _xlogx(here) - _xlogx(np.maximum(here - n, 0))
        gain += np.add.reduceat(more, np.searchsorted(w, np.arange(len(heads))), axis=0)
    size = np.bincount(word, counts)
    loss = _xlogx(totals + size[:, None]) - _xlogx(totals)
    loss[np.arange(len(own)), own] = _xlogx(totals[own]) - _xlogx(np.maximum(totals[own] - size, 0))
    gain -= 2 * loss
    best = np.argmax(gain, axis=1)
    stays = gain[np.arange(len(own)), own] >= gain[np.arange(len(own)), best] - 1e-9
    return name[heads], np.where(stays, own, best)


#: Entries that are weighed at once.
_CHUNK = 20_000


def word_classes(encoded: DataFrame, lexicon, classes: np.ndarray, pairs: np.ndarray, tokens: int) -> DataFrame:
    """name, class: the class of every word that is no symbol of its own, by its contexts in all texts of ``encoded`` (codes, tail)."""
    ranges = max(-(-tokens // RANGE_TOKENS), int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = encoded.sparkSession.sparkContext.broadcast((classes.astype(np.int64), pairs))

    def entries_of(batch: pa.RecordBatch):
        lex, (of, _) = lexicon.value, held.value
        tail = batch.column(1)
        words, at = tail.flatten().field("word").to_pylist(), tail.flatten().field("at").to_numpy(zero_copy_only=False)
        bounds = np.r_[0, np.cumsum(tail.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        for first, parts, codes in _running(batch):
            c = of[lex.symbol[codes]].astype(np.uint64)
            mid = np.flatnonzero((codes > lex.head) & (codes <= lex.known))
            lo, hi = bounds[first], bounds[first + len(parts)]
            starts = np.cumsum([1, *map(len, parts)])[:-1]
            far = np.repeat(starts, np.diff(bounds[first : first + len(parts) + 1])) + at[lo:hi]
            place = np.concatenate([mid, far])
            hashed = np.concatenate([lex.hash[codes[mid]], np.fromiter(map(word_hash, words[lo:hi]), np.uint64, hi - lo)])
            yield (hashed >> np.uint64(24) << np.uint64(24)) | c[place] << np.uint64(16) | c[place - 1] << np.uint64(8) | c[place + 1]

    def send(batches):
        waiting: list[np.ndarray] = []
        n = 0

        def out():
            e = np.sort(np.concatenate(waiting))
            part = ((e >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(cuts))
            waiting.clear()
            return pa.record_batch([pa.array(some, pa.int32()), pa.array([e[cuts[r] : cuts[r + 1]].tobytes() for r in some], pa.binary())], ["range", "entries"])

        for batch in batches:
            for e in entries_of(batch):
                waiting.append(e)
                n += len(e)
                if n > 1 << 21:
                    yield out()
                    n = 0
        if n:
            yield out()

    def decide(batches):
        table = held.value[1]
        kept: dict[int, list] = {}  # by range: entries and counts added up, then blobs that wait to be

        def add_up(own: list) -> list:
            e, n = np.concatenate([own[0], *own[2:]]), np.concatenate([own[1], *(np.ones(len(x), np.int64) for x in own[2:])])
            order = np.argsort(e, kind="stable")
            e, n = e[order], n[order]
            heads = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
            return [e[heads], np.add.reduceat(n, heads)]

        for batch in batches:
            for r, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = kept.setdefault(r, [np.zeros(0, np.uint64), np.zeros(0, np.int64)])
                own.append(np.frombuffer(data, np.uint64))
                if sum(map(len, own[2:])) > max(RANGE_TOKENS, len(own[0])):
                    kept[r] = add_up(own)
        for own in kept.values():
            e, n = add_up(own)
            names = e >> np.uint64(16)
            at = 0
            while at < len(e):
                end = len(e) if at + _CHUNK >= len(e) else int(np.searchsorted(names, names[at + _CHUNK]))
                end = end if end > at else int(np.searchsorted(names, names[at], side="right"))
                name, new = better_classes(e[at:end], n[at:end], table)
                yield pa.record_batch([pa.array(name.view(np.int64)), pa.array(new, pa.int32())], ["name", "class"])
                at = end

    return encoded.select("codes", "tail").mapInArrow(send, "range int, entries binary").repartition(ranges, "range").mapInArrow(decide, "name bigint, class int")


class Model:
    """Classes by code and the logarithms of a class-based model; ``unseen`` is by the class before."""

    def __init__(self, classes: np.ndarray, pairs: np.ndarray, mass: np.ndarray, types: np.ndarray, discount: float):
        """``mass``: tokens by class; ``types``: words by class that are discounted."""
        rows, self.classes = pairs.sum(axis=1, keepdims=True), classes
        prior = (mass + 1.0) / (mass + 1.0).sum()
        step = (pairs + SMOOTHING * prior) / (rows + SMOOTHING)
        spare = discount * types + 1.0
        self.steps, self.inside = np.log10(step), np.log10(mass + 1.0)
        self.unseen = np.log10(step @ (spare / (mass + 1.0)))


#: Added to the class of an unseen word's ending, which only words after it meet.
_UNSEEN = 256


def _learn(source: DataFrame) -> tuple[DataFrame, DataFrame, Model | None, dict]:
    """From id, held_out, text: the classed texts, the vocabulary beyond KNOWN (word, n, class), the model, and what else scores need."""
    spark = source.sparkSession
    vocabulary = materialize(_vocabulary(source.where(~F.col("held_out")).select("text")), "vocabulary")
    documents = source.where(~F.col("held_out")).count()
    n, v, once, twice = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    spread = max(1, int(np.ceil(np.sqrt(n / RANGE_TOKENS))))
    # the words found more often than a cut, of which there are KNOWN at most, so that no task sorts what every task has
    often = np.array(sorted(((r.n, r.words) for r in vocabulary.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True), np.int64).reshape(-1, 2)
    fit = int(np.searchsorted(np.cumsum(often[:, 1]), KNOWN, side="right"))
    cut = int(often[fit, 0]) if fit < len(often) else 0
    order = (F.desc("n"), "word")
    top = vocabulary.where(F.col("n") > cut).orderBy(*order).toArrow()
    words, counts = top.column("word").to_pylist(), top.column("n").to_numpy().astype(float)
    del top
    head, rest = min(HEAD, len(words)), vocabulary.where(F.lit(False))
    if not head:
        rest = vocabulary
    elif v > head:  # words behind the last symbol of its own in the same order
        word, most = F.lit(bytearray(words[head - 1])), F.lit(int(counts[head - 1]))
        rest = vocabulary.where((F.col("n") < most) | ((F.col("n") == most) & (F.col("word") > word)))
    spelling = _spelling((rest if v > head else vocabulary).select("word"))
    lexicon = spark.sparkContext.broadcast(Lexicon(words, counts, documents, discount, spelling))
    lex = lexicon.value

    @F.arrow_udf(_ENCODED)
    def encode(texts: pa.Array) -> pa.Array:
        return lexicon.value.encode(texts.to_pylist())

    encoded = source.select("id", "held_out", encode("text").alias("e")).select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "e.*")
    encoded = materialize(encoded, "encoded")
    training = encoded.where(~F.col("held_out"))
    k = n_classes(v)
    symbols, pairs = cluster(training.select("codes"), lex.symbol, k, spread)
    at_ending = symbols[1 + HEAD :]
    of_code = symbols[lex.symbol].copy()
    mass, types = np.zeros(k), np.zeros(k)
    np.add.at(mass, symbols[: 1 + head], np.r_[documents, counts[:head]])
    far = rest.select("word", "n", F.lit(0).alias("class"))
    if v > head:
        found = word_classes(training, lexicon, symbols, pairs, int(n))
        own = F.element_at(F.array(*[F.lit(int(c)) for c in at_ending]), F.col("ending") + 1)
        name = F.shiftleft(F.shiftrightunsigned(F.xxhash64("word"), 24), 8).bitwiseOR(own.cast("long"))
        far = materialize(rest.withColumn("name", name).join(found, "name", "left").select("word", "n", F.coalesce("class", own).alias("class")), "far")
        for r in far.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():
            mass[r["class"]] += r.n
            types[r["class"]] += r.types
        if len(words) > head:
            of_code[1 + head : 1 + len(words)] = far.where(F.col("n") > cut).orderBy(*order).toArrow().column("class").to_numpy()
    # texts as classes: those of codes, and for words beyond the lexicon those that the join finds
    tail = encoded.select("row", F.explode("tail").alias("t")).select("row", "t.*").join(far.withColumnRenamed("n", "c"), "word", "left")
    there = F.col("c").isNotNull()
    tail = tail.groupBy("row").agg(
        F.count_if(there).alias("t_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("t_base"),
        F.sum(F.when(there, F.log10(F.col("c") - F.lit(discount))).otherwise(F.col("spelled"))).alias("t_own"),
        F.collect_list(F.struct("at", F.coalesce("class", F.lit(-1)).alias("class"))).alias("patch"),
    )
    held = spark.sparkContext.broadcast(of_code.astype(np.uint16))

    @F.arrow_udf(T.BinaryType())
    def classed(codes: pa.Array, patches: pa.Array) -> pa.Array:
        out = []
        for s, p in zip(codes.to_pylist(), patches, strict=True):
            c = held.value[np.frombuffer(s, "<u4")]
            if p.is_valid:
                at, new = (p.values.field(f).to_numpy(zero_copy_only=False) for f in ("at", "class"))
                c[at] = np.where(new < 0, c[at] + _UNSEEN, new)
            out.append(c.astype("<u2").tobytes())
        return pa.array(out, pa.binary())

    none = F.lit(0.0)
    out = encoded.drop("tail").join(tail, "row", "left").select(
        "id", "held_out", "n_tokens", (F.col("known") + F.coalesce("t_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("t_base", none)).alias("base"), (F.col("own") + F.coalesce("t_own", none)).alias("own"), classed("codes", "patch").alias("classes"),
    )
    out = materialize(out, "classed")

    def count(batches):
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                c = np.frombuffer(s, "<u2").astype(np.int64) % _UNSEEN
                total += np.bincount(np.r_[of_code[0], c[:-1]] * k + c, minlength=k * k)
        if total.any():
            yield _packed(0, total)

    pairs = _added(out.where(~F.col("held_out")).select("classes").mapInArrow(count, "block int, kind string, counts binary"), 1, spread).get(0, np.zeros(k * k)).reshape(k, k).astype(float)
    model = Model(of_code, pairs, mass, types, discount) if documents else None
    return out, far, model, {"tokens": int(n + documents), "words": int(v + (documents > 0)), "discount": discount, "lexicon": lex}


def brown_scores(docs: DataFrame, held_out: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from rows where ``held_out`` is false or null.  Tokens are words with A-Z
    in lower case and one end for each text; a null or empty text is its end alone, a long one
    is read whole.  base_score is the add-one unigram's log10 probability, score the class
    model's.  Without training rows both are zero.  Equal rows get equal scores; an empty table
    gives no rows.  Other columns of ``docs`` are not read.
    """
    spark = small_batches(docs)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    texts, _, model, known = _learn(source)
    table = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def walk(classes: pa.Array) -> pa.Array:
        m = table.value
        out = []
        for s in classes.to_pylist():
            c = np.frombuffer(s, "<u2").astype(np.int64)
            new, c = c >= _UNSEEN, c % _UNSEEN
            before = np.r_[m.classes[0], c[:-1]]
            out.append(float(np.where(new, m.unseen[before], m.steps[before, c] - m.inside[c]).sum()))
        return pa.array(out, pa.float64())

    found = texts.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(known["tokens"]).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(known["tokens"] + known["words"] + 1.0)))).alias("base_score"),
        (F.col("own") + walk("classes") if model else F.lit(0.0)).alias("score"),
    )
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
