"""Queries against their SQL on DuckDB."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

NAMES = ["graph_counts", "reverse_graph", "bfs", "multi_source_bfs", "dijkstra", "toposort_levels", "scc_labels", "boruvka_mst", "edmonds_karp", "yen_k_shortest_paths", "bfs_with_callback", "can_reach", "find_all_cycles_directed", "compute_blast_radius", "run_parallel_analysis"]


def rows(frame):
    plain = lambda v: None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v.item() if hasattr(v, "item") else v
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = rows(entry.queries()[name](spark, sf_dir).toPandas())
    want = rows(con.execute(entry.oracle_sql()[name]).df())
    assert got == want
    assert not any(isinstance(v, float) and math.isinf(v) for r in got[1] for v in r)


def test_every_query_has_an_oracle():
    from arcweft.queries import ORACLE, QUERIES

    # The one without lists paths, which SQL would do exponentially: see test_edges.
    assert set(QUERIES) - set(ORACLE) == {"yen_k_shortest_paths_whole"} and set(ORACLE) <= set(QUERIES)
