"""Flows of many pairs at once: the edges on walks in each order of joins, and cuts without the whole source side."""

from __future__ import annotations

import random

import pytest
from test_edges import make

import __spark_entry__ as entry
from arcweft.operators import measures, paths


def graph(spark):
    rng = random.Random(3)
    ends = sorted((a, b) for a in range(9) for b in range(9) if a != b and rng.random() < 0.3)
    return make(spark, 9, [(a, b, 1, rng.randrange(4)) for a, b in [*ends, *ends[:4]]]), ends


@pytest.mark.parametrize("kind", ["all", "one source", "one sink", "few"])
def test_edges_on_walks(spark, kind):
    g, ends = graph(spark)
    reach = {v: {v} for v in range(9)}
    for _ in range(9):
        for a, b in ends:
            for v in range(9):
                if a in reach[v]:
                    reach[v].add(b)
    pairs = {"all": [(a, b) for a in range(9) for b in range(9)], "one source": [(0, b) for b in range(1, 9)], "one sink": [(a, 8) for a in range(8)], "few": [(0, 8), (1, 5), (4, 2)]}[kind]
    got = paths.between(g, spark.createDataFrame(pairs, "a int, b int")).select("a", "b", "src", "dst").distinct().collect()
    assert sorted(map(tuple, got)) == sorted((a, b, u, v) for a, b in pairs for u, v in ends if u in reach[a] and b in reach[v])


def test_cheapest_cut(spark):
    """The edges with capacity of the cut by the whole source side; their sum is the flow."""
    g, _ = graph(spark)
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(4, 9)], "src int, sink int")
    flows = measures.max_flow(g, pairs)
    cuts = measures.min_cut_edges(g, measures.min_cut(g, flows)).join(g.edges.selectExpr("src AS u", "dst AS v", "adj_idx", "capacity"), ["u", "v", "adj_idx"])
    key = lambda df: sorted((r.src, r.sink, r.u, r.v, r.adj_idx) for r in df.where("capacity > 0").collect())
    found = measures.cheapest_cut(g, pairs)
    assert key(found) == key(cuts)
    sums = {(r.src, r.sink): r.s for r in found.groupBy("src", "sink").agg({"capacity": "sum"}).toDF("src", "sink", "s").collect()}
    assert {(r.src, r.sink): r.max_flow for r in flows.collect() if r.max_flow} == sums


def shapes(kind):
    """Trees above sinks of many edges; with mixed, edges across the trees, a cycle and edges of next to no capacity as well."""
    rng = random.Random(11)
    ends = [(rng.randrange(v), v) for v in range(2, 12)] + [(rng.randrange(12), s) for s in range(12, 18) for _ in range(5)]
    caps = [float(rng.randrange(5)) for _ in ends]
    if kind == "mixed":
        ends += [(3, 7), (12, 14), (15, 4), (1, 2), (18, 19), (19, 18), (19, 16)]
        caps += [2.0, 1.0, 3.0, 2.0, 4.0, 4.0, 1e-10]
    return [(a, b, 1, c) for (a, b), c in zip(ends, caps, strict=True)]


def solved(edges, a, b):
    """The value, and the edges of some capacity that leave the least source side, by the solver on the whole graph."""
    cap = {}
    for u, v, _, c in edges:
        cap.setdefault(u, {})[v] = cap.get(u, {}).get(v, 0.0) + c
        cap.setdefault(v, {}).setdefault(u, 0.0)
    value, side = measures._max_flow(cap, a, b)
    return value, {(u, v) for u, v, _, c in edges if c > 1e-9 and u in side and v not in side}


@pytest.mark.parametrize("kind", ["trees", "mixed"])
def test_shrunk_networks(spark, kind):
    """Flows and cuts of networks that shrink, all or some, are those of the solver, for sources at all depths."""
    edges = shapes(kind)
    g = make(spark, 20, edges)
    ab = [(a, b) for a in range(20) for b in range(2, 20) if a != b and (a * b) % 7]
    pairs = spark.createDataFrame(ab, "src int, sink int")
    want = {p: solved(edges, *p) for p in ab}
    got = {(r.src, r.sink): r.max_flow for r in measures.max_flow(g, pairs, sides=False).collect()}
    assert got == pytest.approx({p: x for p, (x, _) in want.items()}, abs=1e-8) and any(got.values())
    cuts = {}
    for r in measures.cheapest_cut(g, pairs).where("capacity > 1e-9").collect():
        cuts.setdefault((r.src, r.sink), set()).add((r.u, r.v))
    assert {p: x for p, x in cuts.items() if got[p] > 1e-8} == {p: x for p, (f, x) in want.items() if f > 1e-8}


@pytest.mark.parametrize("name", ["edmonds_karp", "dinic", "min_cut_edges"])
def test_layers_need_no_gathered_networks(spark, sf_dir, monkeypatch, name):
    def gathered(*_):
        raise AssertionError("edges of each pair gathered")

    monkeypatch.setattr(measures, "between", gathered)
    assert not entry.queries()[name](spark, sf_dir).isEmpty()
