"""Mixing, packing, language-model scores, registered queries and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_text import near_classes
from vgraph.llm import brown, exact_dedup, mixing, packing, toxicity
from vgraph.llm import queries as registered

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def documents(spark):
    rng = random.Random(11)
    rows = []
    for k in range(300):
        source = rng.choice(["a", "a", "a", "b", "c", None])
        rows.append((k, " ".join("w" + str(rng.randrange(50)) for _ in range(rng.randint(0, 40))), source, "clash"))
    rows += [(301, None, "a", None), (302, "", "d", None), (303, "x " * 20_000, "b", None), (5, rows[5][1], rows[5][2], None), (None, "no id here", "c", None), (None, "no id here", "c", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")


def test_mix(spark):
    df = documents(spark)
    out = mixing.mix(df, (3, 1, 2), 1.5, 2.0)
    rows = out.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(r.size == size(r.text) and r.taken == r.copies * r.size <= 2 * r.size for r in rows) and len(rows) == df.count()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    total = {s: sum(r.size for r in g) for s, g in by.items()}
    names = sorted([s for s in by if s is not None]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while open_:  # water-filling by hand
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * total[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else weight[s] * level
        left -= sum(2.0 * total[s] for s in full)
        open_ = open_ - full if full else set()
    for s, g in by.items():
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == total[s] for r in g)
        assert abs(sum(r.taken for r in g) - target[s]) <= max(r.size for r in g) * (2 if any(r.doc_id in (5, None) for r in g) else 0.5) + 1e-6
    again = sorted(map(str, mixing.mix(df.repartition(7), (3, 1, 2), 1.5, 2.0).select("doc_id", "source", "taken").collect()))
    assert again == sorted(map(str, out.select("doc_id", "source", "taken").collect()))
    copies = mixing.mixed(df, (3, 1, 2), 1.5, 2.0)
    assert copies.columns == df.columns and copies.count() == sum(r.copies for r in rows)
    assert mixing.mix(df.where("false"), (3, 1, 2), 1.5).count() == 0


def test_mixed_keeps_values_of_clashing_columns(spark):
    df = documents(spark)
    clash = df
    for name in ("size", "source_size", "target", "copies", "taken"):
        clash = clash.withColumn(name, F.concat(F.lit(f"own {name} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    out = mixing.mixed(clash, (3, 1, 2), 1.5, 2.0)
    assert out.columns == clash.columns and out.schema["size"].dataType.simpleString() == "string"
    times = Counter()
    for r in mixing.mix(df, (3, 1, 2), 1.5, 2.0).collect():
        times[r.doc_id, r.text, r.source] += r.copies
    got = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    assert got == Counter({k: n for k, n in times.items() if n})
    assert all(r[c] == f"own {c} {'-' if r.doc_id is None else r.doc_id}" for r in out.collect() for c in ("size", "source_size", "target", "copies", "taken"))
    assert mixing.mixed(clash.where("false"), (3, 1, 2), 1.5).count() == 0


def test_mix_plans_stay_in_the_jvm(spark):
    plan = mixing.mix(documents(spark), (3, 1, 2), 1.5)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder(TOKENIZER, 2)
    assert e.ranked is not None
    texts = ["", None, "Hello  world\n\n x's 12ab", "a<|endoftext|>b", "日本語🙂 naïve x\u0085y", " " * 500, "a" * 3000, "\r\n\t mixed \x1c end "]
    if Path(SF).exists():
        import pyarrow.parquet as pq

        texts += pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()
    for t in texts:
        assert e(t) == np.array(e.tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=25))
def test_bin_completion(counts):
    for pack in (lambda: packing.best_fit(counts, 64), lambda: packing.complete(counts, 64, 500)):
        patterns, used = pack(), Counter()
        for times, pattern in patterns:
            assert times > 0 and sum(n * many for n, many in pattern) <= 64
            for n, many in pattern:
                used[n] += times * many
        assert used == Counter(counts)
    best = sum(t for t, _ in packing.complete(counts, 64, 500))
    assert -(-sum(n * c for n, c in counts.items()) // 64) <= best <= sum(t for t, _ in packing.best_fit(counts, 64))


def test_bin_completion_beats_best_fit():
    # best-fit decreasing leaves gaps that a search over fillings closes
    counts = {6: 2, 4: 2, 3: 2, 2: 2}
    assert sum(t for t, _ in packing.complete(counts, 10)) == 3
    gaps = {44: 1, 24: 3, 22: 1, 21: 1, 17: 2, 8: 1, 6: 2}
    assert sum(t for t, _ in packing.complete(gaps, 61)) == 4


def fewest(items, capacity):
    """The least number of bins, by trying every place for every item."""
    best = len(items)
    bins = []

    def put(k):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] >= items[k]:
                bins[b] -= items[k]
                put(k + 1)
                bins[b] += items[k]
        bins.append(capacity - items[k])
        put(k + 1)
        bins.pop()

    put(0)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 29), max_size=9), st.integers(0, 1))
def test_bin_completion_finds_the_minimum(items, double):
    """Against all placements, also when neither the quick search nor the lower bound settles it."""
    items = sorted(items, reverse=True)
    packing_of = lambda: sum(t for t, _ in packing._search(packing.best_fit(Counter(items), 30), Counter(items), 30, [1_000_000], True))
    assert packing_of() == sum(t for t, _ in packing.complete(Counter(items), 30)) == fewest(items, 30)


def test_all_fillings_are_all():
    counts = {7: 1, 5: 2, 3: 3}
    got = list(packing.all_fillings(10, [7, 5, 3], counts, 10, [1000]))
    assert got == [(7, 3), (5, 5)]
    assert list(packing.all_fillings(10, [7, 5, 3], counts, 10, [0])) == []


@pytest.mark.parametrize("text", [" ", "\n", "a", "1", "!", "\u3000", "é ", " \n"])
def test_encoder_of_a_million_characters(text):
    e = packing.Encoder(TOKENIZER, 2)
    whole = text * (1_000_000 // len(text))
    assert e(whole) == np.array(e.tokenizer.encode(whole, add_special_tokens=False).ids + [2], "<u4").tobytes()


def test_packing_a_long_run_of_white_space(spark):
    rows = [(1, " " * 1_000_000), (2, "a\n" * 10 + "\n" * 500_000 + "b"), (3, "plain"), (4, None)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), TOKENIZER).collect()
    check_packing(out, rows)


def test_undominated():
    assert packing.fillings(10, [7, 5, 3], {7: 1, 5: 2, 3: 3}, 10)[:2] == [(7, 3), (5, 5)]
    assert packing._dominates((7, 3), (5, 3, 2)) and not packing._dominates((5, 5), (7,))


def check_packing(rows, texts, capacity=1024):
    """A packing of texts, given as (id, text) rows in any order: whole, gapless, within capacity."""
    e = packing.Encoder(TOKENIZER, 2)
    want = Counter()
    for i, t in texts:
        ids = e(t)
        n = len(ids) // 4
        first = n - capacity * (-(-n // capacity) - 1)
        at = 0
        for k, end in enumerate(range(first, n + 1, capacity)):
            want[i, k, at, end - at, zlib.crc32(ids[4 * at : 4 * end])] += 1
            at = end
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_packing_round_trip(spark):
    df = documents(spark).withColumn("offset", F.lit("clash"))
    texts = [(r.doc_id, r.text) for r in df.collect()]
    rows = packing.pack(df, TOKENIZER).collect()
    used, least = check_packing(rows, texts)
    assert used <= 1.01 * least + 2
    ids = packing.pack(df, TOKENIZER, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in ids) and len(ids) == len(rows)
    assert packing.pack(df.where("false"), TOKENIZER).count() == 0


def brown_fixture(spark):
    rng = random.Random(12)
    tongues = [[f"{t}{k}" for k in range(60)] for t in "xyz"]
    rows = [(k, " ".join(rng.choice(tongues[k % 3]).title() for _ in range(rng.randint(0, 60)))) for k in range(240)]
    return [*rows, (500, None), (501, ""), (502, "unseen words only zq"), (503, "x1 " * 50_000), (7, rows[7][1]), (None, "x1 x2")]


def test_brown_base_against_brute_force_and_held_out(spark):
    rows = brown_fixture(spark)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("clash")).withColumn("n", F.lit(1))
    got = brown.brown_scores(df, toxicity.fold(of=7) == 2).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = Counter((i, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    out = [r for r in got if r.held_out and r.doc_id < 500]
    assert len(out) > 20 and sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) <= 1e-6 * r.perplexity for r in got)
    again = {str((r.doc_id, r.n_tokens)): r.score for r in brown.brown_scores(df.repartition(3), toxicity.fold(of=7) == 2).collect()}
    assert all(abs(again[str((r.doc_id, r.n_tokens))] - r.score) < 1e-6 for r in got)


def test_brown_words_beyond_the_broadcast_table(spark, monkeypatch):
    df = spark.createDataFrame(brown_fixture(spark), "doc_id bigint, text string")
    want = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in brown.brown_scores(df, toxicity.fold(of=7) == 2).collect()}
    for head, known in ((8192, 50), (20, 50), (20, 200), (20, 20)):
        monkeypatch.setattr(brown, "HEAD", head)
        monkeypatch.setattr(brown, "KNOWN", known)
        got = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in brown.brown_scores(df, toxicity.fold(of=7) == 2).collect()}
        assert got == want


@pytest.mark.parametrize("known", [20, 60, 1000])
def test_brown_scores_against_brute_force(spark, monkeypatch, known):
    """Scores from the classes alone, by plain loops; and all probabilities after any class sum to one."""
    monkeypatch.setattr(brown, "HEAD", 20)
    monkeypatch.setattr(brown, "KNOWN", known)
    rows = brown_fixture(spark)
    rows += [(600 + k, f"x1 rare{k} y2 rare{k % 7}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    got = brown.brown_scores(df, toxicity.fold(of=7) == 2).collect()
    texts, far, model, seen = brown._learn(df.select(F.col("doc_id").alias("id"), F.coalesce(toxicity.fold(of=7) == 2, F.lit(False)).alias("held_out"), "text"))
    lex, d = seen["lexicon"], seen["discount"]
    tokens = lambda t: [None, *(t or "").encode().lower().split(), None]
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t)[1:])
    names = lex.text.split()
    head = set(names[:20])  # fewer where ties would exceed the known words
    assert len(names) >= 10 and names == sorted((w for w in count if w), key=lambda w: (-count[w], w))[: len(names)]
    of = {w: int(model.classes[1 + k]) for k, w in enumerate(names)} | {bytes(r.word): r["class"] for r in far.collect()} | {None: int(model.classes[0])}
    assert set(of) == set(count)
    cls = lambda w: of[w] if w in of else int(model.classes[1 + lex.known + brown.ending(w)])
    pairs, mass, spare = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            pairs.update((cls(a), cls(b)) for a, b in zip(tokens(t), tokens(t)[1:], strict=False))
    for w, n in count.items():
        mass[of[w]] += n
        spare[of[w]] += d * (w is not None and w not in head)
    k = len(model.steps)
    total = sum(mass[c] + 1 for c in range(k))
    step = lambda a, b: (pairs[a, b] + brown.SMOOTHING * (mass[b] + 1) / total) / (sum(pairs[a, x] for x in range(k)) + brown.SMOOTHING)
    weight = lambda w: count[w] - (d if w is not None and w not in head else 0)
    unseen = lambda a: sum(step(a, c) * (spare[c] + 1) / (mass[c] + 1) for c in range(k))
    for a in range(k):
        assert abs(sum(step(a, of[w]) * weight(w) / (mass[of[w]] + 1) for w in count) + unseen(a) - 1) < 1e-9
    spell = {w: float(lex.spelling([w])[0]) for i, t in rows for w in tokens(t) if w and w not in of}
    sums = {}
    for i, t in rows:
        if (t or "") not in sums and len(t or "") < 1000:
            sums[t or ""] = sum(math.log10(step(cls(a), of[b]) * weight(b) / (mass[of[b]] + 1)) if b in of else math.log10(unseen(cls(a))) + spell[b] for a, b in zip(tokens(t), tokens(t)[1:], strict=False))
    by = {i: t or "" for i, t in rows}
    assert spell and all(abs(r.score - sums[by[r.doc_id]]) < 1e-6 for r in got if by[r.doc_id] in sums)


def test_spelling_sums_to_one_at_most():
    words = [b"an", b"ana", b"na", "né".encode(), b"a1", b"b"]
    code, _, _ = brown.Spelling.windows(words)
    assert (code >= 0).sum() == sum(map(len, words)) + len(words)
    model = brown.Spelling(np.bincount(code[code >= 0], minlength=brown._LETTERS**brown._WINDOW))
    one = [bytes([b]) for b in range(256) if b not in b" \t\n\x0b\x0c\r"]
    two = [a + b for a in one for b in one]
    assert np.allclose(model(one + two)[: len(one)], [model([w])[0] for w in one])
    total = (10.0 ** model(one)).sum() + (10.0 ** model(two)).sum()
    assert 0.3 < total < 1 and model([b"an"]) > model([b"zq"])


def test_word_exchange_against_one_by_one():
    """Each word's class maximises the class bigram likelihood, its own counts moved with it."""
    rng = np.random.default_rng(5)
    k, pairs = 5, rng.integers(1, 50, (5, 5)).astype(float)
    words = {}
    for w in range(40):
        own = int(rng.integers(0, k))
        words[w << 8 | own] = Counter((int(rng.integers(0, k)), int(rng.integers(0, k))) for _ in range(rng.integers(1, 6)))
    entries = sorted((name << 16 | b << 8 | a, n) for name, c in words.items() for (b, a), n in c.items())
    for name, c in words.items():  # the table holds what the words bring
        for (b, a), n in c.items():
            pairs[b, name & 255] += n
            pairs[name & 255, a] += n
    names, new = brown.better_classes(np.array([e for e, _ in entries], np.uint64), np.array([n for _, n in entries]), pairs)
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    for name, got in zip(names.tolist(), new.tolist(), strict=True):
        before, after = Counter(), Counter()
        for (b, a), n in words[name].items():
            before[b] += n
            after[a] += n
        size, gains = sum(before.values()), []
        for c in range(k):
            off = name & 255 == c  # its counts are in the table there already
            gain = sum(f(pairs[b, c] + (0 if off else n)) - f(pairs[b, c] - (n if off else 0)) for b, n in before.items())
            gain += sum(f(pairs[c, a] + (0 if off else n)) - f(pairs[c, a] - (n if off else 0)) for a, n in after.items())
            total = pairs[:, c].sum()
            gains.append(gain - 2 * (f(total + (0 if off else size)) - f(total - (size if off else 0))))
        assert gains[got] >= max(gains) - 1e-6


def test_brown_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    assert [(r.score, r.base_score, r.train_tokens) for r in brown.brown_scores(df, F.lit(True)).collect()] == [(0.0, 0.0, 0)] * 2
    assert brown.brown_scores(df.where("false"), F.lit(False)).count() == 0


def test_exchange_separates_what_never_mixes():
    rng = np.random.default_rng(3)
    k = 4
    classes = np.minimum(np.arange(brown.SYMBOLS), k - 1)
    counts = np.zeros((2, brown.SYMBOLS, k), np.int64)
    text = np.concatenate([rng.integers(1, 20, 400) + 20 * (j % 2) for j in range(40)])
    for turn in range(4):
        counts[:] = 0
        np.add.at(counts[0], (text[1:], classes[text[:-1]]), 1)
        np.add.at(counts[1], (text[:-1], classes[text[1:]]), 1)
        before = brown.likelihood(counts, classes)
        classes = brown.exchange(counts, classes, np.arange(brown.SYMBOLS) % 2 == turn % 2)
    assert before > -1e9 and not set(classes[1:20]) & set(classes[21:40])


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_query_against_sql(spark, name):
    from tests.graph.test_oracles import same

    same(spark, name, registered.QUERIES, registered.SQL)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the generated tables")
def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == docs.columns
        before, rows = now.collect(), after.collect()
        if name == "toxicity":
            scored = toxicity.score(now, toxicity.fit(now, spark.read.parquet(f"{SF}/labels.parquet").where(toxicity.fold() != 0)))
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in scored.collect() if not r.predicted)
        elif name == "exact dedup":
            best = {}
            for r in before:
                key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
                best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
            assert sorted(r.doc_id for r in rows) == sorted(i for _, i in best.values())
        elif name == "SimHash near-dedup":
            texts = sorted((r.doc_id, r.text) for r in before)
            parent = near_classes([t for _, t in texts])
            assert sorted(r.doc_id for r in rows) == [texts[k][0] for k in range(len(texts)) if parent[k] == k]
        else:
            times = {r.doc_id: r.copies for r in mixing.mix(now, (3, 1, 2), 1.5).collect()}
            assert Counter(r.doc_id for r in rows) == Counter({k: n for k, n in times.items() if n})
        now = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.packing(spark, now, SF).collect()
    check_packing(packed, [(r.doc_id, r.text) for r in now.collect()])
    assert exact_dedup.exact_duplicates(now.where("false")).count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert Counter(r.doc_id for r in whole.collect()) == Counter(r.doc_id for r in packed)
