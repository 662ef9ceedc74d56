"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

if not Path(SF).exists():
    pytest.skip("needs the generated tables", allow_module_level=True)

from vgraph import queries as graph  # noqa: E402


def same(spark, name, registered, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registered[name](spark, SF)
    cur = con.execute(sql[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = sorted(names)
    got = sorted((tuple(r[c] for c in key) for r in df.collect()), key=str)
    want = sorted((tuple(r[names.index(c)] for c in key) for r in cur.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(graph.SQL))
def test_graph_query(spark, name):
    same(spark, name, graph.QUERIES, graph.SQL)


def test_every_query_has_sql_but_the_greedy_partitioners_and_strong_components():
    assert {n for n in graph.QUERIES if n not in graph.SQL} == {n for n in graph.QUERIES if n.startswith("greedy_partition_")} | {"scc"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(graph.QUERIES) <= set(e.queries())
