"""Empty graphs, loops, parallel edges, cycles, and files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from arcweft.model import from_rows
from arcweft.operators import measures, paths, structure, traversal
from arcweft.sources.tables import demo, read_graph, write_graph


def make(spark, n, edges):
    return from_rows(spark, [(i,) for i in range(n)], edges)


def test_empty(spark):
    g = from_rows(spark, [], [])
    assert structure.kahn_toposort(g).count() == 0
    assert structure.chromatic_number_estimate(g) == 1
    assert measures.project_duration(g) == 0
    assert structure.boruvka_mst(g).count() == 0


def test_loop_and_parallel_edges(spark):
    g = make(spark, 2, [(0, 0), (0, 1)])
    assert structure.has_cycle_directed(g)
    assert not structure.is_bipartite(g)[0]
    assert [r.cycle for r in structure.find_all_cycles_directed(g).collect()] == [[0]]
    par = make(spark, 3, [(0, 1), (0, 1), (1, 2)])
    assert structure.has_cycle_undirected(par)
    assert sorted((r.u, r.v) for r in structure.find_bridges(par).collect()) == [(0, 1), (1, 2)]


def test_negative_weights(spark):
    g = make(spark, 3, [(0, 1, 4), (0, 2, 2), (2, 1, -3)])
    assert {r.node: r.dist for r in paths.bellman_ford(g, [0])[0].collect()} == {0: 0, 1: -1, 2: 2}
    with pytest.raises(ValueError):
        paths.dijkstra(g, [0])
    bad = make(spark, 2, [(0, 1, 1), (1, 0, -2)])
    assert paths.bellman_ford(bad, [0])[1]
    assert paths.floyd_warshall(bad)[1]


def test_validation(spark):
    with pytest.raises(ValueError):
        make(spark, 2, [(0, 5)]).validate()
    with pytest.raises(ValueError):
        traversal.can_reach(make(spark, 2, []), 0, 9)
    with pytest.raises(structure.CycleError):
        structure.kahn_toposort(make(spark, 2, [(0, 1), (1, 0)]))


def test_files(spark, tmp_path):
    g = demo(spark)
    for kind in ("parquet", "csv", "json"):
        a, b = str(tmp_path / f"n{kind}"), str(tmp_path / f"e{kind}")
        write_graph(g, a, b, kind)
        back = read_graph(spark, a, b, kind)
        assert back.edges.exceptAll(g.edges).count() == 0
        assert back.nodes.exceptAll(g.nodes).count() == 0


def test_weights_that_are_no_whole_numbers(spark):
    """0.1 + 0.2 + 0.3 depends on the order of addition: no path may be lost by it."""
    g = make(spark, 4, [(0, 1, 0.1), (1, 2, 0.2), (2, 3, 0.3), (3, 0, 0.7)])
    for table in (paths.johnsons(g)[0], paths.floyd_warshall(g)[0]):
        rows = {(r.src, r.dst): r for r in table.collect()}
        assert len(rows) == 16 and all(r.next is not None for r in rows.values())
        assert rows[0, 3].next == 1 and rows[0, 3].dist == pytest.approx(0.6)
    found = {(r.src, r.dst): r.path for r in paths.pair_paths(table.select("src", "dst"), table).collect()}
    assert len(found) == 16 and found[0, 3] == [0, 1, 2, 3] and found[3, 2] == [3, 0, 1, 2]


def test_cheapest_paths_equal_a_full_listing():
    import random

    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(2, 8)
        edges: dict[int, dict[int, float]] = {}
        for u in range(n):
            for v in range(n):
                if u != v and rng.random() < 0.6:
                    edges.setdefault(u, {})[v] = float(rng.randrange(1, 5))

        def every(path, edges=edges, n=n):
            if path[-1] == n - 1:
                yield sum(edges[u][v] for u, v in zip(path, path[1:], strict=False)), tuple(path)
                return
            for v in edges.get(path[-1], {}):
                if v not in path:
                    yield from every([*path, v])

        for k in (1, 3, 50):
            assert paths.cheapest(edges, 0, n - 1, k) == sorted(every([0]))[:k]
    banned = paths.dijkstra_path({0: {1: 1.0, 2: 5.0}, 1: {2: 1.0}}, 0, 2, frozenset([1]))
    assert banned == (5.0, [0, 2]) and paths.dijkstra_path({0: {1: 1.0}}, 0, 1, banned_edges=frozenset([(0, 1)])) is None


def test_a_ladder_of_near_equal_paths_ends():
    """2 ** 60 paths of nearly one cost."""
    edges: dict[int, dict[int, float]] = {}
    for i in range(60):
        edges[3 * i] = {3 * i + 1: 1.0, 3 * i + 2: 1.0 + i * 1e-3}
        edges[3 * i + 1] = edges[3 * i + 2] = {3 * i + 3: 1.0}
    found = paths.cheapest(edges, 0, 180, 5)
    assert len(found) == 5 and [round(c, 6) for c, _ in found] == [120.0, 120.0, 120.001, 120.001, 120.002]


def test_searches_stop_early(spark):
    g = make(spark, 6, [(i, i + 1) for i in range(5)])
    assert traversal.can_reach(g, 0, 2) and not traversal.can_reach(g, 3, 0)
    order = traversal.bfs(g, [0], F.col("node") < 2).collect()
    assert sorted(r.node for r in order) == [0, 1, 2]
    assert [r.node for r in traversal.bfs_with_callback(g, [3], F.lit(False)).collect()] == [3]
