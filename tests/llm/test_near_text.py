"""Near-duplicate texts against brute force over all pairs, with a second spelling of prints and shingles."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from vgraph.llm import near_text
from vgraph.llm.common import WORD


def words_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(WORD, text or "")]


def prints_of(text):
    counts = Counter(words_of(text))
    weight = {w: round(16 * n**0.5) * max(1, len(w.encode()) - 2) for w, n in counts.items()}
    total, out = sum(weight.values()), []
    hashes = {w: xxhash.xxh3_128_intdigest(w.encode()) for w in weight}
    for half in (64, 0):
        out.append(sum(1 << b for b in range(64) if 2 * sum(x for w, x in weight.items() if hashes[w] >> (half + b) & 1) > total))
    return out


def shingles_of(text, width=5):
    words = words_of(text)
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def near_classes(texts, prints=prints_of):
    """The least place of each text's component over links: a print within five bits and a similarity of 0.8."""
    near, sets, parent = [prints(t) for t in texts], [shingles_of(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if any((a ^ b).bit_count() <= 5 for a, b in zip(near[i], near[j], strict=True)) and jaccard(sets[i], sets[j]) >= 0.8:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(texts))]


def library(rng):
    vocabulary = [f"{rng.choice(['la', 'Ré', 'mon', 'ti', 'Wor'])}{rng.randrange(900)}" for _ in range(500)]
    texts = [None, "", " \t", "one", "ONE", "one two", "x " * 60_000, "x " * 60_001]
    for size in (8, 40, 60, 90, 200, 400):
        base = [rng.choice(vocabulary) for _ in range(size)]
        texts.append(" ".join(base))
        for changed in (1, 1, 2, 3, 6, size // 8):
            other = list(base)
            for _ in range(changed):
                other[rng.randrange(size)] = rng.choice(vocabulary)
            texts.append("\n".join(other))
        texts.append(" ".join(rng.sample(base, size)))  # equal words in another order: equal prints, another text
    return texts


def test_word_prints():
    for text in library(random.Random(2)):
        assert [p & ((1 << 64) - 1) for p in near_text.word_prints(text)] == prints_of(text)


@pytest.mark.parametrize("cap", [64, 2])
def test_near_texts_against_brute_force(spark, monkeypatch, cap):
    monkeypatch.setattr(near_text, "PAIRED_LIST", cap)
    texts = library(random.Random(3)) * 2
    df = spark.createDataFrame([(k, t, f"key{k}", "v") for k, t in enumerate(texts)], "doc_id bigint, text string, key string, node string")
    want = near_classes(texts)
    assert 10 < len(set(want)) < len(texts) // 2 - 8
    kept = near_text.drop_near_texts(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.key, r.node) for r in kept.collect()) == sorted((k, f"key{k}", "v") for k in set(want))
    got = near_text.near_texts(df).join(df.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("k")), F.col("key") == F.col("k")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))
    sizes = Counter(want)
    assert all(r.n_rows == sizes[r.component_id] for r in got)


def test_wide_list_of_unlike_texts_with_equal_prints(spark, monkeypatch):
    """A list whose texts fall into several components: copies of six orders of the same words."""
    monkeypatch.setattr(near_text, "PAIRED_LIST", 3)
    rng, base = random.Random(4), [f"word{k}" for k in range(60)]
    texts = []
    for _ in range(6):
        order = rng.sample(base, 60)
        for k in range(5):
            texts.append(" ".join(order[:59] + [f"end{k}"]))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = near_classes(texts)
    assert len(set(want)) == 6
    assert sorted(r.doc_id for r in near_text.drop_near_texts(df).collect()) == sorted(set(want))


def test_null_and_repeated_ids(spark):
    a, b = "the quick brown fox jumps over the lazy dog near a river bank", "an entirely other text that nobody has ever linked to any other one"
    rows = [(3, a), (None, a), (5, a.upper()), (3, b), (3, a), (7, b + "\n"), (None, None), (9, ""), (9, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = Counter((r.doc_id, r.text) for r in near_text.drop_near_texts(df).collect())
    assert kept == Counter([(3, a), (None, a), (3, b), (3, a), (None, None), (9, ""), (9, "")])
    assert near_text.drop_near_texts(df.where("false")).count() == 0 and near_text.near_texts(df.where("false")).count() == 0
