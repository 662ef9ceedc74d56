"""Readers, writers, partitioners, statistics, bits and streams."""

import random

import numpy as np
from pyspark.sql import functions as F

from vgraph.functions import bits, statistics
from vgraph.graph import Graph
from vgraph.operators import partitioners as P
from vgraph.operators import vertex_sets
from vgraph.sources import readers, writers
from vgraph.streaming import edges as streams


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_text_files(spark, tmp_path):
    (tmp_path / "g.meta").write_text("5 4\n")
    (tmp_path / "g.edges.0").write_text("# a comment\n0 1 extra\n\n1\t2\n")
    (tmp_path / "g.edges.1").write_text("3 4\n  2 3\n")
    prefix = str(tmp_path / "g")
    assert readers.read_meta(spark, prefix) == (5, 4)
    assert rows(readers.read_edge_lists(spark, prefix)) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    g = readers.load(spark, readers.IngressParameters(prefix))
    assert g.vertices.count() == 5 and g.edges.count() == 4
    (tmp_path / "h.edges.0").write_text("0 1 1 2\n2\n3\n")
    assert rows(readers.read_token_pairs(spark, str(tmp_path / "h"))) == [(0, 1), (1, 2), (2, 3)]
    (tmp_path / "adj").write_text("0 2 1 2\n1 0\n# x\n2 1 0\n")
    assert rows(readers.read_adjacency(spark, str(tmp_path / "adj"))) == [(0, 1), (0, 2), (2, 0)]
    (tmp_path / "g.roots").write_text("2\n1 9\n")
    assert rows(readers.read_roots(spark, prefix)) == [(1,), (9,)]
    assert rows(readers.read_roots(spark, prefix, g)) == [(1,)]
    (tmp_path / "a.roots").write_text("-1\n")
    assert readers.read_roots(spark, str(tmp_path / "a")) is None
    (tmp_path / "vp").write_text("0.5 1.5\n2.5\n")
    assert rows(readers.read_vertex_property(spark, str(tmp_path / "vp"), "x")) == [(0, 0.5), (1, 1.5), (2, 2.5)]
    assert readers.read_tokens(spark, str(tmp_path / "vp"), "double", 2).count() == 2
    (tmp_path / "ep").write_text("7\n8\n")
    assert rows(readers.read_edge_property(spark, f"{prefix}.edges.0", str(tmp_path / "ep"), "w", "bigint")) == [(0, 1, 7), (1, 2, 8)]
    assert rows(readers.made_up_property(g.edges)) == rows(readers.made_up_property(g.edges.orderBy("dst")))


def test_binary_parts(spark, tmp_path):
    edges = [[(0, 1), (2, 3)], [(1, 2)]]
    for k, part in enumerate(edges):
        np.array(part, "<u8").tofile(tmp_path / f"g.part.2.{k}")
    np.array([3, 1], "<i4").tofile(tmp_path / "g.outdegree.2.0")
    np.array([5], "<i4").tofile(tmp_path / "g.outdegree.2.1")
    prefix = str(tmp_path / "g")
    assert rows(readers.read_parts(spark, prefix, 2)) == [(0, 0, 1), (0, 2, 3), (1, 1, 2)]
    assert rows(readers.read_out_degrees(spark, prefix, 2)) == [(0, 3), (1, 5), (2, 1)]
    for k, on in enumerate(([1], [0])):  # bitmaps of 64 bits and one word more
        word = sum(1 << b for b in on)
        (tmp_path / f"g.scatterMap.2.{k}").write_bytes(np.array([64], "<i8").tobytes() + np.array([word, 0], "<u8").tobytes())
    assert rows(readers.read_replica_maps(spark, prefix, 2)) == [(0, 1, 2), (1, 0, 1)]
    back = writers.encoded_parts(readers.read_parts(spark, prefix, 2))
    data = {}
    for r in back.orderBy("part", "chunk").collect():
        data[r.part] = data.get(r.part, b"") + bytes(r.data)
    assert {k: sorted(map(tuple, np.frombuffer(v, "<u8").reshape(-1, 2).tolist())) for k, v in data.items()} == {0: [(0, 1), (2, 3)], 1: [(1, 2)]}


def test_writers(spark, tmp_path):
    e = spark.createDataFrame([(0, 1), (1, 2)], "src bigint, dst bigint")
    writers.write_edge_list(e, str(tmp_path / "x.edges.0"))
    assert rows(readers.read_edge_lists(spark, str(tmp_path / "x"))) == [(0, 1), (1, 2)]
    (tmp_path / "in").write_text("5 4\n0 1\n1 2\n")
    writers.drop_first_line(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["0 1", "1 2"]
    writers.save_graph(Graph.from_edges(e), str(tmp_path / "saved"))
    assert writers.load_graph(spark, str(tmp_path / "saved")).vertices.count() == 3
    assert dict(writers.narrowed(spark.range(1).withColumnRenamed("id", "outdegree")).dtypes)["outdegree"] == "int"


def test_partitioners_replay(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(300)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    for kind in P.KINDS:
        got = rows(P.partition_edges(df, kind, 4, 3))
        want = []
        for loader in range(3):
            state = P.chooser(kind, 4, len(edges) // 4 // 3)
            want += [(s, d, state.place(s, d)) for s, d in sorted(e for e in edges if e[0] % 3 == loader)]
        assert got == sorted(want), kind


def formula(kind, n, cap, counts, known, src, dst):
    """The score of each part, written out as it is described."""
    has_s, has_d = known[0].get(src, set()), known[1].get(dst, set())
    most, base = max(counts), 1 + max(counts) - min(counts)
    out = []
    for i in range(n):
        s, d, own_s, own_d = i in has_s, i in has_d, src % n == i, dst % n == i
        if kind in ("greedy", "ldg"):
            affinity = 1.0 if s else (0.5 if own_s else 0.0) + (1.0 if d else 0.5 if own_d else 0.0)
            out.append(affinity * (1 + (most - counts[i]) / base if kind == "greedy" else abs(1 - counts[i] / cap)))
        else:
            home = 0.5 if kind in ("edge", "edge1") else 0.0
            out.append((most - counts[i]) / base + s + d + home * own_s + home * own_d)
    return out


def test_partitioners_against_formulas(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(400)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    n, loaders = 4, 2
    for kind in P.KINDS:
        want = []
        for loader in range(loaders):
            counts, sources = [0] * n, {}
            known = (sources, sources if kind == "edge1" else {})
            for s, d in sorted(e for e in edges if e[0] % loaders == loader):
                scores = formula(kind, n, len(edges) // n // loaders, counts, known, s, d)
                equal = [i for i, x in enumerate(scores) if max(scores) - x < 1e-4]
                best = s % n if kind == "parallel" and s % n == d % n else equal[(s + d) % len(equal)]
                counts[best] += 1
                known[0].setdefault(s, set()).add(best)
                known[1].setdefault(d, set()).add(best)
                want.append((s, d, best))
        assert rows(P.partition_edges(df, kind, n, loaders)) == sorted(want), kind


def test_partition_rules():
    # an edge's first part is that of both owners; a known source draws later edges
    x = P.chooser("greedy", 4)
    assert x.place(1, 5) == 1
    assert x.place(1, 9) == 1
    y = P.chooser("parallel", 4)
    assert y.place(2, 6) == 2
    z = P.chooser("plain", 2)
    assert {z.place(a, b) for a, b in ((0, 1), (2, 3))} == {0, 1}  # balance alone decides


def test_loaders_have_tasks_of_their_own_and_place_once(spark):
    seen = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(k, k % 7) for k in range(160)], "src bigint, dst bigint")
    counted = df.mapInArrow(lambda bs: ((seen.add(b.num_rows), b)[1] for b in bs), df.schema)
    placed = P.partition_edges(counted, "ldg", 16)
    before = seen.value
    assert P.metrics(placed, 16).first().edges == 160 and seen.value == before
    per_task = placed.groupBy(F.input_file_name(), F.pmod("src", F.lit(16))).count().groupBy("input_file_name()").count()
    assert [r["count"] for r in per_task.collect()] == [1] * 16
    # what a loader keeps does not grow with the sources it is done with
    x = P.chooser("plain", 4)
    for k in range(100):
        x.place(k, 1)
        x.leave(k)
    assert not x.sources and len(x.targets) == 1


def test_partition_metrics(spark):
    a = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (2, 1, 0)], "src bigint, dst bigint, part int")
    m = P.metrics(a, 2).first()
    assert (m.edges, m.scatters, m.combiners, m.both, m.agents, m.largest) == (3, 1, 1, 0, 2, 2)


def test_statistics(spark):
    for n in (7, 8, 9, 10):
        x = [float(v * v % 11) for v in range(n)]
        got = statistics.summary(spark.createDataFrame([(v,) for v in x], "x double"), "x").first()
        s, inv = sorted(x), [1 / v if v else 0 for v in x]
        t = (n + 1) / 4
        k = int(t)
        assert abs(got.q1 - (s[k] if t == k else 0.75 * s[k] + 0.25 * s[k + 1])) < 1e-9
        t, k = (n + 1) / 2, int((n + 1) / 2)
        assert abs(got.median - (s[k] if t == k else (s[k] + s[k + 1]) / 2)) < 1e-9
        assert abs(got.mean - np.mean(x)) < 1e-9 and abs(got.stddev - np.std(x, ddof=1)) < 1e-9
        h = n / sum(inv)
        assert abs(got.harmonic_mean - h) < 1e-9
        assert abs(got.harmonic_stddev - np.sqrt(sum((i - np.mean(inv)) ** 2 for i in inv)) / (n - 1) * h * h) < 1e-9


def test_extremes_and_text(spark):
    df = spark.createDataFrame([(3, 2.5), (None, -1.0), (7, None)], "a bigint, b double")
    assert statistics.extremes(df, "a", "b").first().asDict() == {"max_a": 7, "min_a": 3, "max_b": 2.5, "min_b": -1.0}
    assert rows(df.select(bits.to_string(F.col("b")).alias("t")).where("t is not null")) == [("-1.0",), ("2.5",)]


def test_bits_and_sets(spark):
    ids = spark.createDataFrame([(0,), (63,), (64,), (200,)], "vid bigint")
    words = bits.set_to_bitmap(ids)
    assert rows(bits.bitmap_to_set(words)) == [(0,), (63,), (64,), (200,)]
    assert words.agg(F.sum(bits.count_ones(F.col("word")))).first()[0] == 4
    r = spark.range(1).select(bits.align_up(F.lit(65)).alias("u"), bits.align_down(F.lit(127)).alias("d"), *[c.alias(n) for n, c in zip("kmi", bits.unpack_id(bits.pack_id(F.lit(3), F.lit(7), F.lit(9))), strict=True)]).first()
    assert tuple(r) == (128, 64, 3, 7, 9)
    g = Graph.from_edges(spark.createDataFrame([(0, 3)], "src bigint, dst bigint"))
    a, b = vertex_sets.of(g, [0, 1, 9]), vertex_sets.of(g, [1, 2])
    assert rows(vertex_sets.union(a, b)) == [(0,), (1,), (2,)] and rows(vertex_sets.insert(a, b)) == [(0,), (1,), (1,), (2,)]
    assert rows(vertex_sets.intersect(a, b)) == [(1,)] and rows(vertex_sets.difference(a, b)) == [(0,)]
    assert vertex_sets.nothing(g).count() == 0 and vertex_sets.everything(g).count() == 4


def test_streams(spark, tmp_path):
    for k, e in enumerate(([(0, 1), (0, 2)], [(2, 3)], [(7, 8)])):
        spark.createDataFrame(e, "src bigint, dst bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    c = streams.Components(spark)
    streams.follow(streams.read_edge_stream(spark, str(tmp_path / "in"), 1), c.update, str(tmp_path / "at")).awaitTermination()
    assert rows(c.forest) == [(1, 0), (2, 0), (3, 0), (8, 7)]
    found = streams.Latest()
    streams.follow(streams.degree_stream(streams.read_edge_stream(spark, str(tmp_path / "in"), 1)), found.update, str(tmp_path / "at3"), "complete").awaitTermination()
    assert rows(found.table) == [(0, 2), (2, 1), (7, 1)]
    streams.degree_stream(streams.read_edge_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("deg").option("checkpointLocation", str(tmp_path / "at2")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("deg")) == [(0, 2), (2, 1), (7, 1)]
