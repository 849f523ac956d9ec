"""The example graph's answers, calculated by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from arcweft.operators import failure, measures, paths, structure, traversal
from arcweft.sources.tables import demo


@pytest.fixture(scope="module")
def g(spark):
    return demo(spark).validate()


def column(df, order, name):
    return [r[name] for r in df.orderBy(order).collect()]


def test_traversal(g):
    assert column(traversal.bfs(g, [0]), "pos", "node") == [0, 1, 11, 13, 2, 3, 9, 12, 6, 4, 5, 14, 10, 7, 8]
    assert column(traversal.dfs(g, [0]), "pos", "node") == [0, 1, 2, 3, 4, 5, 13, 6, 7, 8, 14, 9, 10, 11, 12]
    assert {r.node: r.dist for r in traversal.multi_source_bfs(g, [3, 11]).collect()} == {3: 0, 11: 0, 4: 1, 5: 1, 6: 1, 12: 1, 13: 1, 14: 1, 7: 2, 8: 2}
    assert traversal.transitive_closure(g).count() == 74


def test_shortest_paths(g):
    rows = paths.dijkstra(g, [0]).orderBy("node").collect()
    assert [r.dist for r in rows] == [0, 3, 7, 9, 17, 19, 8, 13, 16, 8, 14, 5, 10, 1, 24]
    assert [r.prev for r in rows] == [None, 0, 1, 1, 3, 3, 11, 6, 6, 1, 9, 0, 11, 0, 3]


def test_order_and_critical_path(g):
    assert column(structure.kahn_toposort(g), "pos", "node") == [0, 1, 2, 9, 10, 11, 12, 3, 5, 6, 14, 13, 7, 4, 8]
    plan = measures.compute_critical_path(g).orderBy("pos").collect()
    assert max(r.eft for r in plan) == 113
    assert [r.node for r in plan if r.critical] == [0, 1, 9, 11, 3, 14, 4]
    assert [r.slack for r in sorted(plan)] == [0, 0, 91, 0, 0, 27, 14, 14, 14, 0, 77, 0, 68, 27, 0]


def test_forests(g):
    assert structure.boruvka_mst(g).agg(F.sum("weight"), F.count("*")).first() == (60, 14)
    assert structure.prim_mst(g, [0]).agg(F.sum("weight"), F.count("*")).first() == (79, 14)


def test_flow(g, spark):
    flow = measures.max_flow(g, spark.createDataFrame([(0, 13)], "src int, sink int"))
    assert flow.first().max_flow == 16000
    side = measures.min_cut(g, flow)
    assert column(side, "node", "node") == [0, 1, 2, 9, 10]
    assert sorted((r.u, r.v) for r in measures.min_cut_edges(g, side).collect()) == [(0, 11), (0, 13), (1, 3), (9, 11)]
    with pytest.raises(ValueError):
        measures.max_flow(g, spark.createDataFrame([(3, 3)], "src int, sink int"))


def test_connectivity(g):
    found = structure.find_bridges_and_aps(g).collect()
    assert sorted((r.u, r.v) for r in found if r.kind == "bridge") == [(1, 2), (9, 10), (11, 12)]
    assert sorted(r.u for r in found if r.kind == "point") == [1, 3, 6, 9, 11]


def test_centrality(g):
    score = lambda df: [round(x, 6) for x in column(df, "node", "score")]
    assert score(measures.degree_centrality(g))[:4] == [0.107143, 0.142857, 0.035714, 0.25]
    assert score(measures.betweenness_centrality(g)) == [0, 0.027473, 0, 0.087912, 0, 0, 0.054945, 0, 0, 0.021978, 0, 0.087912, 0, 0, 0]
    assert score(measures.closeness_centrality(g))[:2] == [0.451613, 0.464286]


def test_pagerank(g):
    top = measures.pagerank(g).orderBy(F.desc("score")).limit(5).collect()
    assert [(r.node, round(r.score, 6)) for r in top] == [(8, 0.121058), (13, 0.11725), (4, 0.091416), (11, 0.070857), (3, 0.066924)]


def test_colors(g):
    want = [0, 1, 0, 0, 1, 1, 2, 0, 1, 0, 1, 1, 0, 2, 2]
    assert column(structure.greedy_coloring(g), "node", "color") == want
    assert column(structure.dsatur_coloring(g), "node", "color") == want


def test_failure(g):
    row = failure.simulate_failure(g, [3], 0.05).first()
    assert (row.cascade_depth, round(row.total_impact_score, 9), row.affected) == (2, 1.3, [5, 6, 14])
    joint = failure.simulate_multi_failure(g, [3, 5], 0.05).first()
    assert (joint.affected, round(joint.total_impact_score, 5)) == ([6, 14], 2.29585)
    blast = failure.compute_blast_radius(g, [3], 0.05).first()
    assert (blast.affected, blast.severity, round(blast.revenue_at_risk, 6)) == (3, "HIGH", 12400)


def test_latency_and_resilience(g, spark):
    pairs = spark.createDataFrame([(0, 13), (3, 4)], "src int, dst int")
    costs = [r.cost for r in paths.yen_k_shortest_paths(g, pairs, 5).where("src = 0").orderBy("rank").collect()]
    assert costs == [1, 7, 11, 14, 14]
    assert {(r.src, r.dst): round(r.score, 4) for r in paths.resilience_score(g, pairs).collect()} == {(0, 13): 0.5286, (3, 4): 0.4185}
    p99 = measures.p99_latency_estimate(g, spark.createDataFrame([(0, 13)], "src int, sink int")).first().p99
    assert 104 < p99 < 110
