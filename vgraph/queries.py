"""Registered queries of the graph engine, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import bits, statistics
from .graph import Direction, Graph
from .kernels import betweenness, components, degree, pagerank, paths
from .operators import partitioners, traversal, vertex_sets
from .plans.program import VertexProgram, run
from .sources import readers, writers
from .storage import materialize, shared_dir
from .streaming import edges as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

OUT, IN, BOTH = Direction.OUT, Direction.IN, Direction.BOTH

# The graphs that the queries run on, in SQL.
_OC = "SELECT o_orderkey AS src, o_custkey AS dst, 1 + o_orderkey % 7 AS w FROM orders"
_PS = "SELECT l_partkey AS src, l_suppkey AS dst, CAST(l_linenumber AS BIGINT) AS w FROM lineitem"
_NEXT = """SELECT src, dst, w FROM (SELECT l_partkey AS src,
  lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst,
  CAST(l_linenumber AS BIGINT) AS w FROM lineitem) WHERE dst IS NOT NULL"""


def _orders(spark: SparkSession, sf: str) -> Graph:
    t = spark.read.parquet(f"{sf}/orders.parquet")
    return Graph.from_edges(t.select(F.col("o_orderkey").cast("bigint").alias("src"), F.col("o_custkey").cast("bigint").alias("dst"), (1 + F.col("o_orderkey") % 7).cast("bigint").alias("w")))


def _parts(spark: SparkSession, sf: str) -> Graph:
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    return Graph.from_edges(t.select(F.col("l_partkey").cast("bigint").alias("src"), F.col("l_suppkey").cast("bigint").alias("dst"), F.col("l_linenumber").cast("bigint").alias("w")))


def _next(spark: SparkSession, sf: str) -> Graph:
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    lead = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    e = t.select(F.col("l_partkey").cast("bigint").alias("src"), lead.cast("bigint").alias("dst"), F.col("l_linenumber").cast("bigint").alias("w"))
    # written, as vertices, degrees and layouts would each sort the orders again
    return Graph.from_edges(materialize(e.where("dst is not null"), "next"))


def _sql(edges: str, tail: str, recursive: bool = False, more: str = "") -> str:
    """A query over e (the edges), v (all vertices) and d (out-degrees)."""
    return f"""WITH {"RECURSIVE " if recursive else ""}e AS ({edges}),
v AS (SELECT range AS vid FROM range((SELECT max(greatest(src, dst)) + 1 FROM e))),
d AS (SELECT src, count(*) AS deg FROM e GROUP BY src){"," if more else ""}
{more}
{tail}"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- degrees, traversals, graph views -------------------------------------------------


def _degree_sql(ends: str) -> str:
    return _sql(_PS, f"SELECT vid, count(x.t)::BIGINT AS degree FROM v LEFT JOIN ({ends}) x ON x.t = vid GROUP BY vid")


@query(_degree_sql("SELECT src AS t FROM e"))
def out_degree(spark, sf):
    return degree.degree(_parts(spark, sf), OUT)


@query(_degree_sql("SELECT dst AS t FROM e"))
def in_degree(spark, sf):
    return degree.degree(_parts(spark, sf), IN)


@query(_degree_sql("SELECT src AS t FROM e UNION ALL SELECT dst FROM e"))
def total_degree(spark, sf):
    return degree.degree(_parts(spark, sf), BOTH)


@query("SELECT count(*)::BIGINT AS out_edges, count(*)::BIGINT AS in_edges FROM lineitem")
def edge_totals(spark, sf):
    return degree.edge_totals(_parts(spark, sf))


def _scatter_sql(ends: str) -> str:
    return _sql(_PS, f"SELECT vid, sum(x.f)::BIGINT AS value FROM v LEFT JOIN ({ends}) x ON x.t = vid GROUP BY vid")


@query(_scatter_sql("SELECT src AS f, dst AS t FROM e"))
def scatter_step_out(spark, sf):
    return traversal.scatter_step(_parts(spark, sf), F.col("vid"), OUT)


@query(_scatter_sql("SELECT dst AS f, src AS t FROM e"))
def scatter_step_in(spark, sf):
    return traversal.scatter_step(_parts(spark, sf), F.col("vid"), IN)


@query(_scatter_sql("SELECT src AS f, dst AS t FROM e UNION ALL SELECT dst, src FROM e"))
def scatter_step_both(spark, sf):
    return traversal.scatter_step(_parts(spark, sf), F.col("vid"), BOTH)


@query(_sql(_PS, "SELECT vid, min(e.src) AS value FROM v LEFT JOIN e ON e.dst = vid GROUP BY vid"))
def scatter_step_min(spark, sf):
    return traversal.scatter_step(_parts(spark, sf), F.col("vid"), OUT, "min")


@query(_sql(_PS, "SELECT src, dst, count(*)::BIGINT AS n FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) GROUP BY src, dst"))
def symmetrize(spark, sf):
    return _parts(spark, sf).symmetrize().edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(_sql(_PS, "SELECT DISTINCT src, dst FROM e WHERE src != dst"))
def simple_graph(spark, sf):
    return _parts(spark, sf).simple().edges


@query(_sql(_PS, "SELECT dst AS src, src AS dst, sum(w)::BIGINT AS w FROM e GROUP BY ALL"))
def reverse(spark, sf):
    return _parts(spark, sf).reverse().edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


# --- PageRank ---------------------------------------------------------------------------

_DELTA = """r AS (SELECT 0 AS it, vid, 0.15::DOUBLE AS delta FROM v UNION ALL
  SELECT r.it + 1, e.dst, 0.85 * sum(r.delta / d.deg) FROM r JOIN e ON e.src = r.vid JOIN d ON d.src = r.vid
  WHERE r.it < 10 AND (r.it = 0 OR r.delta > 1e-5) GROUP BY r.it + 1, e.dst),
p AS (SELECT vid, sum(delta) AS pr FROM r GROUP BY vid)"""


@query(_sql(_NEXT, "SELECT vid, round(0.15 + 0.85 * coalesce(sum(0.15 / d.deg), 0), 6) AS pr FROM v LEFT JOIN e ON e.dst = vid LEFT JOIN d ON d.src = e.src GROUP BY vid"))
def pagerank_frozen(spark, sf):
    return pagerank.pagerank_frozen(_next(spark, sf)).select("vid", F.round("pr", 6).alias("pr"))


@query(_sql(_PS, "SELECT vid, round(0.15 + 0.85 * coalesce(sum(0.15 / d.deg), 0), 6) AS pr FROM v LEFT JOIN e ON e.dst = vid LEFT JOIN d ON d.src = e.src GROUP BY vid"))
def pagerank_frozen_sinks(spark, sf):
    return pagerank.pagerank_frozen(_parts(spark, sf)).select("vid", F.round("pr", 6).alias("pr"))


@query(_sql(_NEXT, "SELECT vid, round(pr, 6) AS pr FROM r WHERE it = 10", True, """r AS (SELECT 0 AS it, vid, 0.15::DOUBLE AS pr FROM v UNION ALL
  SELECT it + 1, vid, 0.15 + 0.85 * sum(m) FROM (
    SELECT it, vid, 0.0::DOUBLE AS m FROM r UNION ALL
    SELECT r.it, e.dst, r.pr / d.deg FROM r JOIN e ON e.src = r.vid JOIN d ON d.src = r.vid) WHERE it < 10 GROUP BY it + 1, vid)"""))
def pagerank_power10(spark, sf):
    return pagerank.pagerank_power(_next(spark, sf), 10).state.select("vid", F.round("pr", 6).alias("pr"))


@query(_sql(_NEXT, "SELECT vid, round(pr, 6) AS pr FROM p", True, _DELTA))
def pagerank_delta10(spark, sf):
    return pagerank.pagerank_delta(_next(spark, sf), 10).state.select("vid", F.round("pr", 6).alias("pr"))


@query(_sql(_PS, "SELECT round(sum(pr), 4) AS pr_sum FROM p", True, _DELTA))
def pagerank_sum(spark, sf):
    return pagerank.total(pagerank.pagerank_delta(_parts(spark, sf), 10).state).select(F.round("pr_sum", 4).alias("pr_sum"))


@query(_sql(_NEXT, "SELECT vid, round(pr, 6) AS pr FROM p ORDER BY round(pr, 9) DESC, vid LIMIT 20", True, _DELTA))
def top_pagerank(spark, sf):
    return pagerank.top(pagerank.pagerank_delta(_next(spark, sf), 10).state, 20).select("vid", F.round("pr", 6).alias("pr"))


# --- paths --------------------------------------------------------------------------------


def _bfs_sql(edges: str, roots: str, near: str = "src", far: str = "dst") -> str:
    return f"""b(vid, lvl) USING KEY (vid) AS (SELECT vid, 0::BIGINT FROM ({roots}) UNION
  (SELECT e.{far}, min(b.lvl + 1) FROM b JOIN e ON e.{near} = b.vid LEFT JOIN recurring.b r ON r.vid = e.{far} WHERE r.vid IS NULL GROUP BY e.{far}))"""


_ROOT = "SELECT 0::BIGINT AS vid"


@query(_sql(_OC, "SELECT vid, lvl AS level FROM b", True, _bfs_sql(_OC, _ROOT)))
def bfs_levels(spark, sf):
    g = _orders(spark, sf)
    return paths.bfs(g, paths.roots(g, 0)).state.select("vid", "level")


@query(_sql(_NEXT, "SELECT vid, lvl AS level FROM b", True, _bfs_sql(_NEXT, _ROOT, "dst", "src")))
def bfs_levels_in(spark, sf):
    g = _next(spark, sf)
    return paths.bfs(g, paths.roots(g, 0), IN).state.select("vid", "level")


@query(_sql(_NEXT, "SELECT vid, 0::BIGINT AS label FROM b", True, _bfs_sql(_NEXT, _ROOT)))
def bfs_label_out(spark, sf):
    g = _next(spark, sf)
    return paths.bfs(g, paths.roots(g, 0)).state.select("vid", "label")


@query(_sql(_PS, "SELECT vid, 0::BIGINT AS label FROM b", True, _bfs_sql(_PS, _ROOT, "dst", "src")))
def bfs_label_in(spark, sf):
    g = _parts(spark, sf)
    return paths.bfs(g, paths.roots(g, 0), IN).state.select("vid", "label")


@query(_sql(_NEXT, "SELECT b.vid, min(p.vid) AS parent FROM b LEFT JOIN e ON e.dst = b.vid LEFT JOIN b p ON p.vid = e.src AND p.lvl = b.lvl - 1 GROUP BY b.vid", True, _bfs_sql(_NEXT, _ROOT)))
def bfs_parent(spark, sf):
    g = _next(spark, sf)
    return paths.bfs(g, paths.roots(g, 0)).state.select("vid", "parent")


@query(_sql(_OC, "SELECT vid, lvl AS level FROM b", True, _bfs_sql(_OC, "SELECT unnest([5::BIGINT, 77, 500]) AS vid")))
def bfs_multi_root(spark, sf):
    g = _orders(spark, sf)
    return paths.bfs(g, vertex_sets.of(g, [5, 77, 500])).state.select("vid", "level")


@query(_sql(_NEXT, "SELECT lvl AS superstep, count(*)::BIGINT AS active FROM b WHERE lvl > 0 GROUP BY lvl UNION ALL SELECT max(lvl) + 1, 0 FROM b", True, _bfs_sql(_NEXT, _ROOT)))
def superstep_activity(spark, sf):
    g = _next(spark, sf)
    rows = [(m["superstep"] + 1, m["active"]) for m in paths.bfs(g, paths.roots(g, 0)).metrics]
    return spark.createDataFrame(rows, "superstep bigint, active bigint")


def _sssp_sql(w: str) -> str:
    return f"""b(vid, dist) USING KEY (vid) AS (SELECT 0::BIGINT, 0::BIGINT UNION
  (SELECT e.dst, min(b.dist + {w})::BIGINT FROM b JOIN e ON e.src = b.vid LEFT JOIN recurring.b r ON r.vid = e.dst
   WHERE r.vid IS NULL OR b.dist + {w} < r.dist GROUP BY e.dst))"""


@query(_sql(_NEXT, "SELECT vid, dist FROM b", True, _sssp_sql("e.w")))
def sssp(spark, sf):
    g = _next(spark, sf)
    return paths.sssp(g, paths.roots(g, 0)).state.select("vid", "dist")


@query(_sql(_OC, "SELECT vid, dist FROM b", True, _sssp_sql("e.w")))
def sssp_long(spark, sf):
    g = _orders(spark, sf)
    return paths.sssp(g, paths.roots(g, 0)).state.select("vid", "dist")


@query(_sql(_NEXT, "SELECT b.vid, b.dist, min(p.vid) FILTER (WHERE b.vid != 0) AS pred FROM b LEFT JOIN e ON e.dst = b.vid LEFT JOIN b p ON p.vid = e.src AND p.dist + e.w = b.dist GROUP BY b.vid, b.dist", True, _sssp_sql("e.w")))
def sssp_pred(spark, sf):
    g = _next(spark, sf)
    return paths.sssp(g, paths.roots(g, 0)).state


@query(_sql(_NEXT, "SELECT vid, dist FROM b", True, _sssp_sql("1")))
def sssp_hops(spark, sf):
    g = _next(spark, sf)
    return paths.sssp(g, paths.roots(g, 0), None).state.select("vid", "dist")


@query(_sql(_NEXT, "SELECT vid, min(dist)::BIGINT AS dist FROM k GROUP BY vid", True, """k AS (SELECT 0 AS it, 0::BIGINT AS vid, 0::BIGINT AS dist UNION ALL
  SELECT k.it + 1, e.dst, min(k.dist + e.w) FROM k JOIN e ON e.src = k.vid WHERE k.it < 2 GROUP BY k.it + 1, e.dst)"""))
def sssp_capped(spark, sf):
    g = _next(spark, sf)
    return paths.sssp(g, paths.roots(g, 0), max_supersteps=2).state.select("vid", "dist")


# --- components -----------------------------------------------------------------------------

_WCC = """u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
c(vid, component) USING KEY (vid) AS (SELECT vid, vid FROM v UNION
  (SELECT u.dst, min(c.component) FROM c JOIN u ON u.src = c.vid JOIN recurring.c r ON r.vid = u.dst WHERE c.component < r.component GROUP BY u.dst))"""
_LABEL = """c(vid, component) USING KEY (vid) AS (SELECT vid, vid FROM v UNION
  (SELECT e.dst, min(c.component) FROM c JOIN e ON e.src = c.vid JOIN recurring.c r ON r.vid = e.dst WHERE c.component < r.component GROUP BY e.dst))"""


@query(_sql(_OC, "SELECT vid, component FROM c", True, _WCC))
def wcc(spark, sf):
    return components.weak(_orders(spark, sf))


@query(_sql(_OC, "SELECT count(DISTINCT component)::BIGINT AS components FROM c", True, _WCC))
def wcc_count(spark, sf):
    return components.count(components.weak(_orders(spark, sf)))


@query(_sql(_OC, "SELECT component, count(*)::BIGINT AS vertices FROM c GROUP BY component", True, _WCC))
def wcc_sizes(spark, sf):
    return components.sizes(components.weak(_orders(spark, sf)))


@query(_sql(_NEXT, "SELECT vid, component FROM c", True, _WCC))
def wcc_labels(spark, sf):
    return components.min_label(_next(spark, sf), BOTH).state


@query(_sql(_NEXT, "SELECT vid, component FROM c", True, _LABEL))
def min_label_out(spark, sf):
    return components.min_label(_next(spark, sf), OUT).state


@query()
def scc(spark, sf):
    """Strong components of the whole graph of orders; the closure that SQL would need is too large, so a test holds them against brute force."""
    return components.strong(_orders(spark, sf))


@query(_sql(_NEXT, "SELECT a.x AS vid, least(a.x, coalesce(min(a.y), a.x)) AS component FROM (SELECT v.vid AS x, NULL AS y FROM v UNION ALL SELECT f.x, f.y FROM t f JOIN t g ON f.x = g.y AND f.y = g.x) a GROUP BY a.x", True, """t(x, y) AS (SELECT src, dst FROM e UNION SELECT t.x, e.dst FROM t JOIN e ON e.src = t.y)"""))
def scc_next(spark, sf):
    """Strong components of the whole graph of parts."""
    return components.strong(_next(spark, sf))


# --- betweenness ------------------------------------------------------------------------------

_FORWARD = """f AS (SELECT 0::BIGINT AS lvl, 0::BIGINT AS vid, 1::HUGEINT AS paths UNION ALL
  SELECT f.lvl + 1, e.dst, sum(f.paths) FROM f JOIN e ON e.src = f.vid JOIN b ON b.vid = e.dst AND b.lvl = f.lvl + 1 GROUP BY f.lvl + 1, e.dst)"""


@query(_sql(_NEXT, "SELECT vid, lvl AS level, paths::BIGINT AS paths FROM f", True, _bfs_sql(_NEXT, _ROOT) + ",\n" + _FORWARD))
def bc_forward(spark, sf):
    g = _next(spark, sf)
    return betweenness.forward(g, paths.roots(g, 0)).state


# Backward: rows of a level carry their dependencies; those of the level before them join along edges, and are there even without successors.
_BACKWARD = """m AS (SELECT max(lvl) AS deepest FROM f),
y AS (SELECT f.lvl, f.vid, f.paths::DOUBLE AS paths, 0::DOUBLE AS delta FROM f, m WHERE f.lvl = m.deepest UNION ALL
  SELECT g.lvl, g.vid, g.paths, coalesce(sum(g.share), 0) FROM (
    SELECT f.lvl, f.vid, f.paths::DOUBLE AS paths, f.paths::DOUBLE / y.paths * (1 + y.delta) AS share
    FROM y JOIN e ON e.dst = y.vid JOIN f ON f.vid = e.src AND f.lvl = y.lvl - 1
    UNION ALL SELECT f.lvl, f.vid, f.paths::DOUBLE, NULL FROM (SELECT DISTINCT lvl FROM y) k JOIN f ON f.lvl = k.lvl - 1) g
  GROUP BY g.lvl, g.vid, g.paths)"""


@query(_sql(_NEXT, "SELECT v.vid, round(coalesce(y.delta, 0), 6) AS delta FROM v LEFT JOIN y ON y.vid = v.vid", True, _bfs_sql(_NEXT, _ROOT) + ",\n" + _FORWARD + ",\n" + _BACKWARD))
def bc_dependency(spark, sf):
    g = _next(spark, sf)
    return betweenness.dependency(g, paths.roots(g, 0)).state.select("vid", F.round("delta", 6).alias("delta"))


# --- partitions -----------------------------------------------------------------------------


@query(_sql(_PS, """SELECT (SELECT count(*) FROM a)::BIGINT AS edges, (SELECT max(n) FROM (SELECT count(*) AS n FROM a GROUP BY part))::BIGINT AS largest,
  sum(s)::BIGINT AS scatters, sum(c)::BIGINT AS combiners, count_if(s = 1 AND c = 1)::BIGINT AS both, count(*)::BIGINT AS agents, round(count(*) / (SELECT count(*) FROM a), 9) AS cut
FROM (SELECT part, vid, max(s) AS s, max(c) AS c FROM (SELECT part, src AS vid, 1 AS s, 0 AS c FROM a WHERE src % 8 != part UNION ALL SELECT part, dst, 0, 1 FROM a WHERE dst % 8 != part) GROUP BY part, vid)""", more="a AS (SELECT src, dst, (src + dst) % 8 AS part FROM e)"))
def hash_partition_metrics(spark, sf):
    return partitioners.metrics(partitioners.assign(_parts(spark, sf).edges, F.pmod(F.col("src") + F.col("dst"), F.lit(8))), 8)


def _greedy(kind: str):
    def run(spark, sf):
        return partitioners.metrics(partitioners.partition_edges(_parts(spark, sf).edges, kind, 8), 8)

    run.__name__ = f"greedy_partition_{kind}"
    return run


for _kind in partitioners.KINDS:
    query()(_greedy(_kind))


@query(_sql(_PS, "SELECT v.vid, coalesce(min(e.src), NULL) AS value FROM v LEFT JOIN e ON e.dst = vid GROUP BY vid"))
def scatter_on_parts(spark, sf):
    """A traversal on edges that a partitioner has placed."""
    g = _parts(spark, sf)
    return traversal.scatter_step(g.placed(partitioners.partition_edges(g.edges, "ldg", 8)), F.col("vid"), OUT, "min")


@query(_sql(_NEXT, "SELECT vid, lvl AS level FROM b", True, _bfs_sql(_NEXT, _ROOT)))
def bfs_on_spread_hubs(spark, sf):
    """A search on a graph whose hubs are split over parts."""
    g = _next(spark, sf).spread_hubs(8, 40)
    return paths.bfs(g, paths.roots(g, 0)).state.select("vid", "level")


@query("""WITH e AS (SELECT c_name AS src, n_name AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey), n AS (SELECT src AS name FROM e UNION SELECT dst FROM e),
k AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS vid FROM n) SELECT a.vid AS src, b.vid AS dst FROM e JOIN k a ON a.name = e.src JOIN k b ON b.name = e.dst""")
def named_vertices(spark, sf):
    """Edges between names, numbered through a dictionary."""
    c, n = spark.read.parquet(f"{sf}/customer.parquet"), spark.read.parquet(f"{sf}/nation.parquet")
    return Graph.from_names(c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_name").alias("src"), F.col("n_name").alias("dst")))[0].edges


@query(_sql(_PS, "SELECT max(g)::BIGINT AS max_degree, min(g)::BIGINT AS min_degree, max(g)::BIGINT::VARCHAR AS text FROM (SELECT vid, count(e.src) AS g FROM v LEFT JOIN e ON e.src = vid GROUP BY vid)"))
def degree_extremes(spark, sf):
    return statistics.extremes(degree.degree(_parts(spark, sf), OUT), "degree").withColumn("text", bits.to_string(F.col("max_degree")))


@query(_sql(_NEXT, "SELECT lvl + 1 AS superstep, (SELECT count(*) FROM b x WHERE x.lvl <= k.lvl + 1)::BIGINT AS reached, (SELECT count(*) FROM b x JOIN e ON e.src = x.vid WHERE x.lvl = k.lvl)::BIGINT AS messages FROM (SELECT DISTINCT lvl FROM b) k", True, _bfs_sql(_NEXT, _ROOT)))
def superstep_statistics(spark, sf):
    """What the aggregate hook and the volume metrics of each round say of a search."""
    g = _next(spark, sf)
    program = VertexProgram(
        state={"level": F.when(F.col("vid") == 0, 0).cast("bigint")}, message={"m": F.col("level") + 1}, combine={"c": F.min("m")}, apply=lambda: {"level": F.coalesce("level", "c")},
        activate=F.col("level").isNull(), aggregate={"reached": F.count("level")},
    )
    rows = [(m["superstep"] + 1, m["reached"], m["messages"]) for m in run(program, g, paths.roots(g, 0)).metrics]
    return spark.createDataFrame(rows, "superstep bigint, reached bigint, messages bigint")


@query(_sql(_PS, "SELECT (src + dst) % 4 AS part, src, dst, count(*)::BIGINT AS n FROM e GROUP BY ALL"))
def part_files(spark, sf):
    """Edges written as a table by part and read again."""
    path = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    writers.write_parts_table(partitioners.assign(_parts(spark, sf).edges, F.pmod(F.col("src") + F.col("dst"), F.lit(4))), path)
    return spark.read.parquet(path).groupBy(F.col("part").cast("bigint").alias("part"), "src", "dst").agg(F.count(F.lit(1)).alias("n"))


# --- sets, bits, statistics, sources ------------------------------------------------------------


def _sets(spark, sf):
    v = vertex_sets.everything(_parts(spark, sf))
    return v.where("vid % 2 = 0"), v.where("vid % 3 = 0")


@query(_sql(_PS, "SELECT vid FROM v WHERE vid % 2 = 0 OR vid % 3 = 0"))
def set_union(spark, sf):
    return vertex_sets.union(*_sets(spark, sf))


@query(_sql(_PS, "SELECT vid FROM v WHERE vid % 2 = 0 UNION ALL SELECT vid FROM v WHERE vid % 3 = 0"))
def set_insert(spark, sf):
    return vertex_sets.insert(*_sets(spark, sf))


@query(_sql(_PS, "SELECT vid FROM v WHERE vid % 6 = 0"))
def set_intersect(spark, sf):
    return vertex_sets.intersect(*_sets(spark, sf))


@query(_sql(_PS, "SELECT vid FROM v WHERE vid % 2 = 0 AND vid % 3 != 0"))
def set_difference(spark, sf):
    return vertex_sets.difference(*_sets(spark, sf))


@query(_sql(_PS, "SELECT vid FROM v WHERE vid % 8 = 3"))
def local_vertices(spark, sf):
    return vertex_sets.local(vertex_sets.everything(_parts(spark, sf)), 3, 8)


@query(_sql(_PS, "SELECT vid FROM v WHERE vid % 3 = 0"))
def bitmap_round_trip(spark, sf):
    return bits.bitmap_to_set(bits.set_to_bitmap(_sets(spark, sf)[1]))


@query(_sql(_PS, "SELECT vid // 64 AS word_index, count(*)::BIGINT AS ones FROM v WHERE vid % 3 = 0 GROUP BY 1"))
def bitmap_ones(spark, sf):
    return bits.set_to_bitmap(_sets(spark, sf)[1]).select("word_index", bits.count_ones(F.col("word")).cast("bigint").alias("ones"))


@query(_sql(_PS, "SELECT vid, vid // 64 * 64 AS down, (vid + 63) // 64 * 64 AS up, vid % 8 AS owner, 2::BIGINT AS kind, vid % 1000 AS machine, vid AS index FROM v"))
def packed_ids(spark, sf):
    v = vertex_sets.everything(_parts(spark, sf))
    packed = v.withColumn("packed", bits.pack_id(F.lit(2), F.col("vid") % 1000, F.col("vid")))
    kind, machine, index = bits.unpack_id(F.col("packed"))
    return packed.select("vid", bits.align_down(F.col("vid")).alias("down"), bits.align_up(F.col("vid")).alias("up"), bits.owner(F.col("vid"), 8).alias("owner"), kind.alias("kind"), machine.alias("machine"), index.alias("index"))


@query(_sql(_PS, """SELECT round(min(x), 6) AS min,
  round(CASE WHEN (n + 1) % 4 = 0 THEN a[(n + 1) // 4 + 1] ELSE 0.75 * a[(n + 1) // 4 + 1] + 0.25 * a[(n + 1) // 4 + 2] END, 6) AS q1,
  round(CASE WHEN (n + 1) % 2 = 0 THEN a[(n + 1) // 2 + 1] ELSE 0.5 * a[(n + 1) // 2 + 1] + 0.5 * a[(n + 1) // 2 + 2] END, 6) AS median,
  round(CASE WHEN 3 * (n + 1) % 4 = 0 THEN a[3 * (n + 1) // 4 + 1] ELSE 0.25 * a[3 * (n + 1) // 4 + 1] + 0.75 * a[3 * (n + 1) // 4 + 2] END, 6) AS q3,
  round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS stddev, round(n / sum(i), 6) AS harmonic_mean,
  round(stddev_samp(i) / sqrt(n - 1) * (n / sum(i)) * (n / sum(i)), 6) AS harmonic_stddev
FROM (SELECT *, CASE WHEN x != 0 THEN 1 / x ELSE 0 END AS i, count(*) OVER () AS n, list(x) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a FROM s) GROUP BY n, a""", more="s AS (SELECT vid, count(e.src)::DOUBLE AS x FROM v LEFT JOIN e ON e.src = vid GROUP BY vid)"))
def degree_summary(spark, sf):
    found = statistics.summary(degree.degree(_parts(spark, sf), OUT), "degree")
    return found.select([F.round(c, 6).alias(c) for c in found.columns])


@query(_sql(_OC, "SELECT src, dst FROM e"))
def edge_list_round_trip(spark, sf):
    """Edges written as text lines and read as a graph's edge files."""
    path = f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}"
    writers.write_edge_list(_orders(spark, sf).edges, f"{path}/g.edges.0")
    return readers.read_edge_lists(spark, f"{path}/g")


@query(_sql(_OC, "SELECT src AS vid, count(*)::BIGINT AS degree FROM e GROUP BY src"))
def degree_stream(spark, sf):
    """Out-degrees of edges that arrive as files, by Structured Streaming."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    _orders(spark, sf).edges.select("src", "dst").repartition(4).write.parquet(f"{path}/in")
    found = streams.Latest()
    streams.follow(streams.degree_stream(streams.read_edge_stream(spark, f"{path}/in", 2)), found.update, f"{path}/at", "complete").awaitTermination()
    return found.table


@query(_sql(_OC, "SELECT vid, component FROM c WHERE component != vid", True, _WCC))
def component_stream(spark, sf):
    """Weak components of edges that arrive in batches."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    _orders(spark, sf).edges.select("src", "dst").repartition(3).write.parquet(f"{path}/in")
    found = streams.Components(spark)
    streams.follow(streams.read_edge_stream(spark, f"{path}/in", 2), found.update, f"{path}/at").awaitTermination()
    return found.forest.select(F.col("node").alias("vid"), F.col("root").alias("component"))
