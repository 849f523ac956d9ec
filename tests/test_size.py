"""What queries on all seeds write on the way, for each pair of their result; and the same rows on graphs of any shape."""

from __future__ import annotations

import os
import random

import pytest
from test_edges import make

import __spark_entry__ as entry
from arcweft.operators import failure
from arcweft.plans.loops import ensure_checkpoint_dir

#: Pairs of a node of the layered graph with one that it reaches, and bytes for each of them: a row of a checkpoint takes 40 or more.
DATA, PAIRS, BYTES = "/root/testdata/sf0.01", 96_164, 24


def written(spark, run) -> float:
    """MB that run leaves in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    top = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names)
    before = size()
    run()
    return (size() - before) / 1e6


@pytest.mark.parametrize("name", ["compute_blast_radius", "run_parallel_analysis", "transitive_closure", "reachable_set", "failure_probabilities", "simulate_failure", "parallel_totals"])
def test_little_is_written_for_each_pair(spark, name):
    run = lambda: entry.queries()[name](spark, DATA).write.format("noop").mode("overwrite").save()
    assert written(spark, run) < PAIRS * BYTES / 1e6


@pytest.mark.parametrize("shape", ["layers", "back", "any"])
def test_depth_by_depth_equals_the_order(spark, shape):
    """Edges down only, with edges back up as well, and within a depth too; parallel edges and loops among them."""
    rng = random.Random(7)
    n = 14
    ends = [(rng.randrange(n), rng.randrange(n)) for _ in range(34)]
    if shape != "any":
        ends = [(a, b) for a, b in ends if b // 4 == a // 4 + 1 or shape == "back" and b // 4 == a // 4 - 2]
    g = make(spark, n, ends + ends[:3])
    g = type(g)(g.nodes.withColumn("health", (g.nodes["id"] % 7 + 2) / 10), g.edges)
    rows = lambda df: sorted((r.seed, r.node, r.depth, round(r.prob, 9)) for r in df.collect())
    got = rows(failure.probabilities(g, g.nodes))
    assert got == rows(failure._in_order(g, g.nodes.selectExpr("id AS seed")))
    assert any(0 < p < 1 for *_, p in got)
