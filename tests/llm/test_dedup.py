"""Exact and near duplicates of documents and lines against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vgraph.llm import exact_dedup, line_dedup, simhash

SCHEMA = "doc_id bigint, text string, source string, kept boolean, sha string, fp string"
MESSY = [
    (5, "Hello  World", "a", None, "x", None), (3, "HelloWorld", "a", True, "x", None), (9, "Hello World\n ", None, None, None, "z"),
    (1, None, "b", None, None, None), (2, "", "b", None, None, None), (4, " \t\n", "b", None, None, None),
    (7, "same row", "c", None, None, None), (7, "same row", "c", None, None, None), (7, "other text", "c", None, None, None),
    (None, "no id", "d", None, None, None), (None, "no id", "d", None, None, None), (8, "no id", "d", None, None, None),
    (10, "größe x", "e", None, None, None), (11, "größe x", "e", None, None, None), (12, "w " * 150_000, "f", None, None, None), (13, "w" * 150_000, "f", None, None, None),
]


def messy(spark):
    return spark.createDataFrame(MESSY, SCHEMA)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1) | st.integers(0, 50), max_size=300), st.lists(st.integers(0, 50) | st.integers((1 << 64) - 9, (1 << 64) - 1), max_size=200))
def test_quotient_filter_is_lossless(a, b):
    filters = []
    for x in (a, b):
        keys, counts = np.unique(np.array(x, np.uint64), return_counts=True)
        f = exact_dedup.QuotientFilter.load(exact_dedup.QuotientFilter.of(keys, counts).dump())
        got = f.items()
        assert (got[0] == keys).all() and (got[1] == counts).all()
        filters.append(got)
    keys, counts = np.unique(np.array(a + b, np.uint64), return_counts=True)
    got = exact_dedup.merge(*filters)
    assert (got[0] == keys).all() and (got[1] == counts).all()


def test_exact_duplicates(spark):
    rows = exact_dedup.exact_duplicates(messy(spark)).collect()
    groups = {}
    for r in MESSY:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    want = []
    for norm, g in groups.items():
        best = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        want += [(r[0], best[0], len(g), hashlib.sha256(norm.encode()).hexdigest()) for r in g]
    key = str
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=key) == sorted(want, key=key)
    assert sum(r.kept for r in rows) == len(groups)  # of equal rows only one is kept
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_drop_exact_duplicates_keeps_columns_and_one_row_a_group(spark):
    out = exact_dedup.drop_exact_duplicates(messy(spark))
    assert out.columns == ["doc_id", "text", "source", "kept", "sha", "fp"]
    got = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in out.collect()]
    assert len(got) == len(set(got)) == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in MESSY})
    none = messy(spark).where("false")
    assert exact_dedup.exact_duplicates(none).count() == exact_dedup.drop_exact_duplicates(none).count() == 0


def test_no_task_digests_its_texts_twice(spark, monkeypatch):
    """A second evaluation takes a second Python worker beside each task, which stays for the rest of the program."""
    ran = []
    evaluations = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    monkeypatch.setattr(exact_dedup, "materialize", lambda df, name, f=exact_dedup.materialize: (ran.append((name, evaluations(df))), f(df, name))[1])
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (2, "ab"), (2, "d"), (3, None), (4, "")], "doc_id bigint, text string")
    kept = exact_dedup.drop_exact_duplicates(df)
    assert {n: k for n, k in ran if k} == {"digests": 1, "groups": 1} and evaluations(kept) == 1
    assert sorted(r.text or "" for r in kept.collect()) == ["", "a b", "c", "d"]


def test_verification_beyond_the_broadcast_bound(spark, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_duplicates(messy(spark)).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_FINGERPRINTS", 0)
    assert sorted(map(str, exact_dedup.exact_duplicates(messy(spark)).collect())) == want


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(prints):
    """Smallest index reachable over pairs of at most two differing bits."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "Delta", "épsilon", "zeta", "ETA"]
    texts = [None, "", "  ", "one", "one two", "ONE two", "x " * 60_000]
    for _ in range(12):
        base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(base))
        for _ in range(4):
            other = list(base)
            other[rng.randrange(len(other))] = "changed"
            texts.append("\t".join(other))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    prints = [fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    want = classes(prints)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert len(set(want)) < len(want) - 5
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_links_of_long_lists_lose_no_connection(spark, monkeypatch):
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)], "k bigint, fp bigint")
    want = classes(prints)
    for cap in (1 << 20, 3):
        monkeypatch.setattr(simhash, "PAIRED_LIST", cap)
        pairs = [tuple(r) for r in simhash.links(df.select("fp")).collect()]
        assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in pairs)
        at = {(p - (1 << 64) if p >> 63 else p): k for k, p in enumerate(prints)}
        parent = list(range(len(prints)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            x, y = find(at[a]), find(at[b])
            parent[max(x, y)] = min(x, y)
        assert [find(k) for k in range(len(prints))] == want


def test_joint_keys_cover():
    from itertools import combinations

    keys = simhash.joint_keys(2)
    assert all(any(not set(k) & set(spoiled) for k in keys) for spoiled in combinations(range(8), 2))


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=1, max_size=12), st.text("ab", min_size=1, max_size=12), st.integers(1, 3))
def test_edit_distance_and_segments(a, b, threshold):
    d = distance(a, b)
    assert line_dedup.edit_distance(a, b, threshold) == min(d, threshold + 1)

    if d <= threshold:
        x, y = line_dedup.sketches([a, b]).view(np.int8).reshape(2, 8).astype(int)
        assert abs((x - y + 128) % 256 - 128).sum() <= 2 * threshold
        every = []  # all keys of either line, as if every list were too long
        for level in (0, 1):
            line, key, posts = line_dedup._band([a, b], threshold, level, every)
            assert any({*key[(line == k) & posts]} & {*key[line != k]} for k in (0, 1))
            every.append(np.unique(key))


def lines_fixture():
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefg hij") for _ in range(rng.randint(20, 60))) for _ in range(40)]

    def changed(s, k):
        b = list(s)
        for _ in range(k):
            p = rng.randrange(len(b))
            b[p : p + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
        return "".join(b)

    docs = [(i, "\n".join(changed(rng.choice(base), rng.randint(0, 3)) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    docs += [(900 + i, "same text of one id") for i in (0, 0)]
    docs += [(100 + i, f"the same beginning of every line here and then {rng.randrange(10**5)} end") for i in range(50)]
    return [*docs, (400, None), (401, ""), (402, "short\nshort\n\n  short "), (3, docs[3][1]), (None, docs[4][1])]


def near_lines(docs, name):
    """Names of all pairs of near lines: one edit from ten code points of the shorter line on, two from twenty on."""
    lines = sorted({" ".join(x.split()) for _, t in docs for x in (t or "").split("\n") if x.split()})
    out = set()
    for i, a in enumerate(lines):
        for b in lines[:i]:
            most = min(2, min(len(a), len(b)) // 10)
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                out.add(tuple(sorted((name(a), name(b)))))
    return out


def test_lines_of_all_lengths_against_brute_force(spark):
    rng = random.Random(16)
    docs = []
    for k in range(150):
        base = "".join(rng.choice("ab cd") for _ in range(rng.choice([1, 2, 5, 8, 9, 10, 11, 12, 18, 19, 20, 21, 22, 30])))
        p = rng.randrange(len(base))
        docs.append((k, f"{base}\n{base[:p]}{rng.choice(['', 'x', 'yz'])}{base[p + rng.randrange(2):]}\n{base}a"))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    near = near_lines(docs, line_dedup.namer({}))
    assert len(near) > 50 and {tuple(r) for r in line_dedup.edit_links(df.select("text")).collect()} == near


def test_lines_whose_names_clash(spark):
    """With only eight names to share, lines stay apart by the rest of their digests."""
    df = spark.createDataFrame(lines_fixture(), "doc_id bigint, text string")
    want = {(r.doc_id, r.row, r.at): (r.n_links, r.kept) for r in line_dedup.line_duplicates(df).collect()}
    rows = line_dedup.line_duplicates(df, name_bits=3).collect()
    assert {(r.doc_id, r.row, r.at): (r.n_links, r.kept) for r in rows} == want
    assert sum(-4 <= r.line < 4 for r in rows) and len({r.line for r in rows}) > 100
    assert sum(r.kept for r in rows) == len({r.class_id for r in rows})


def test_line_duplicates_against_brute_force(spark, monkeypatch):
    docs = lines_fixture()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("kept", F.lit("clash"))
    near = near_lines(docs, line_dedup.namer({}))
    for most, levels, block in ((4096, 4, 100), (20, 4, 100), (2, 4, 100), (2, 1, 3), (2, 0, 5)):
        monkeypatch.setattr(line_dedup, "PAIRED", most)
        monkeypatch.setattr(line_dedup, "LEVELS", levels)
        monkeypatch.setattr(line_dedup, "BLOCK_LINES", block)
        assert {tuple(r) for r in line_dedup.edit_links(df.select("text")).collect()} == near
    rows = line_dedup.line_duplicates(df).collect()
    assert len(rows) == sum(len(line_dedup.normal_lines(t)) for _, t in docs)
    assert sum(r.kept for r in rows) == len({r.class_id for r in rows})
    degree = {}
    for a, b in near:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    assert all(r.n_links == degree.get(r.line, 0) for r in rows)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[400] is None and texts[401] == "" and texts[402] == "short\n"
    assert [r.text for r in out.where("doc_id = 900").collect()] == ["same text of one id"] * 2
    assert line_dedup.line_duplicates(df.where("false")).count() == 0
    summary = {r.doc_id: r for r in line_dedup.documents_summary(line_dedup.line_duplicates(df.where("doc_id = 402")), df.where("doc_id = 402")).collect()}
    assert (summary[402].n_lines, summary[402].n_removed, summary[402].n_chars_kept) == (3, 2, 5)


def test_registered_line_dedup_names_classes_and_removed_lines(spark, tmp_path):
    from vgraph.llm.queries import QUERIES

    near = "a line of text that is long enough to be near"
    docs = [(1, f"{near}\nalone\n{near}s"), (2, f"other\n\n{near}"), (3, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op7_line_dedup"](spark, str(tmp_path))
    got = {(r.doc_id, r.at): r for r in out.collect()}
    assert {k: (r.n_links, r.kept) for k, r in got.items()} == {(1, 0): (1, True), (1, 1): (0, True), (1, 2): (1, False), (2, 0): (0, True), (2, 2): (1, False)}
    assert got[1, 0].class_id == got[1, 2].class_id == got[2, 2].class_id
    assert len({r.class_id for r in got.values()}) == 3 and got[1, 0].line == got[2, 2].line != got[1, 2].line
