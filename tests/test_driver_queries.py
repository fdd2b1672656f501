"""Every driver query with SQL against DuckDB on the smallest tables; the rest by invariants."""

import math
import os

import duckdb
import pytest

from spindrel import queries as own

DATA = "/root/testdata/sf0.001"
TABLES = sorted(own.KEYS)
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool) or hasattr(value, "dtype") and value.dtype == bool:
        return str(bool(value))
    if isinstance(value, int | float) or hasattr(value, "dtype"):
        return f"{float(value) + 0.0:.9g}"
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(n for n, q in own.Q.items() if q.sql is not None))
def test_against_sql(spark, duck, name):
    df = own.Q[name].run(spark, DATA)
    want = duck.sql(own.Q[name].sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def result(spark, name):
    return [r.asDict() for r in own.Q[name].run(spark, DATA).collect()]


def test_spanning_forest_weighs_no_more_than_the_tree(spark):
    forest, tree = result(spark, "graph_mst_kruskal")[0]["total"], result(spark, "graph_mst_prim")[0]["total"]
    assert forest >= tree - 1e-6


def test_pagerank_sums_to_one(spark):
    assert sum(r["rank"] for r in result(spark, "graph_pagerank")) == pytest.approx(1, abs=1e-3)


def test_communities_lie_in_components(spark):
    component = {r["n"]: r["r"] for r in result(spark, "graph_components")}
    for call in ("CommunityDetectionLouvain(e[], undirected: true)", "LabelPropagation(e[], undirected: true)"):
        script = f"{own.SUPPLY} ?[] <~ {call}"
        seen = {}
        for r in own.session_for(spark, DATA, script).run(script).collect():
            label, node = (tuple(r[0]), r[1]) if isinstance(r[0], list) else (r[0], r[1])
            assert seen.setdefault(label, component[node]) == component[node]


def test_yen_paths_are_ordered_and_loopless(spark):
    found = result(spark, "graph_yen")
    assert len(found) <= 3
    for r in found:
        nodes = r["path"].split(",")
        assert len(set(nodes)) == len(nodes) and nodes[0] == "0" and nodes[-1] == "7"


def test_near_duplicates_find_each_document_itself(spark):
    found = {(r["a"], r["i"]) for r in result(spark, "lsh_near_dup")}
    assert all((a, a) in found for a, _ in found)
