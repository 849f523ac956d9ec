"""Queries on all links and all seeds against their SQL on DuckDB."""

from __future__ import annotations

import duckdb
import pytest
from test_oracle import rows

import __spark_entry__ as entry
from arcweft.sources.tables import TABLES, graph


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["boruvka_mst", "prim_mst", "greedy_coloring", "dsatur_coloring", "find_bridges", "find_articulation_points", "pagerank_layer", "all_pairs_cost_of_tenths"])
def test_whole_graphs(spark, sf_dir, con, name):
    assert rows(entry.queries()[name](spark, sf_dir).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize(("name", "sign"), [("whole_trade", "<>"), ("whole_dag", "<")])
def test_no_link_is_left_out(spark, sf_dir, con, name, sign):
    want = con.execute(f"SELECT DISTINCT c_nationkey, s_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey {sign} s_nationkey").fetchall()
    assert sorted((r.src, r.dst) for r in graph(spark, sf_dir, name).edges.collect()) == sorted(want)


@pytest.mark.parametrize("name", ["failure_probabilities", "bipartite_colors", "compute_path_latency", "min_cut_edges", "has_fallback_path", "all_pairs_path", "floyd_warshall"])
def test_all_seeds(spark, sf_dir, con, name):
    assert rows(entry.queries()[name](spark, sf_dir).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())
