"""Traversal and reachability; seeds are a column, so one seed and many are one plan."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweft.model import PropertyGraph
from arcweft.plans.loops import PIECES, cut, expand, ranked, seeds_of

Seeds = DataFrame | Iterable[int]


def bfs(g: PropertyGraph, seeds: Seeds, proceed: Column | None = None) -> DataFrame:
    """(seed, node, pos, depth): breadth-first discovery order, neighbours in the order of edges.

    proceed: a seed for which this (over node, pos, depth) is false somewhere goes no further than that depth.
    """
    edges = cut(g.edges.select("src", "dst", "adj_idx"))
    frontier = cut(seeds_of(g.nodes.sparkSession, seeds).withColumn("pos", F.lit(0)).withColumn("depth", F.lit(0)))
    state, depth, pieces = frontier, 0, 1
    if proceed is not None:
        frontier = frontier.where(proceed)
    while True:
        depth += 1
        found = frontier.join(edges, frontier["node"] == edges["src"]).groupBy("seed", F.col("dst").alias("node")).agg(F.min(F.struct("pos", "adj_idx")).alias("k"))
        found = found.join(state.select("seed", "node"), ["seed", "node"], "left_anti")
        offset = frontier.groupBy("seed").agg((F.max("pos") + 1).alias("o"))
        new = ranked(found, ["seed"], [F.col("k")], F.floor(F.col("k.pos") / F.lit(65536))).join(offset, "seed")
        frontier = cut(new.select("seed", "node", (F.col("n") + F.col("o")).cast("int").alias("pos"), F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            return state
        state, pieces = state.union(frontier), pieces + 1
        if pieces >= PIECES:
            state, pieces = cut(state), 1
        if proceed is not None:
            frontier = frontier.join(frontier.where(~proceed).select("seed").distinct(), "seed", "left_anti")


def bfs_with_callback(g: PropertyGraph, seeds: Seeds, proceed: Column) -> DataFrame:
    """bfs() up to and with the first node of each seed for which proceed (over node, pos, depth) is false."""
    order = bfs(g, seeds, proceed)
    stop = order.where(~proceed).groupBy("seed").agg(F.min("pos").alias("stop"))
    return order.join(stop, "seed", "left").where(F.col("stop").isNull() | (F.col("pos") <= F.col("stop"))).drop("stop")


def multi_source_bfs(g: PropertyGraph, sources: Seeds) -> DataFrame:
    """(node, dist): hops to the nearest source."""
    start = seeds_of(g.nodes.sparkSession, sources).select(F.lit(0).alias("seed"), "node")
    return expand(start, g.edges).select("node", F.col("depth").alias("dist"))


def reach(g: PropertyGraph, seeds: Seeds | None = None) -> DataFrame:
    """(seed, node, depth) of all nodes reachable from each seed, itself included; of every node without seeds."""
    return expand(seeds_of(g.nodes.sparkSession, g.nodes if seeds is None else seeds), g.edges)


def transitive_closure(g: PropertyGraph) -> DataFrame:
    """(src, dst) of all reachable pairs; each node reaches itself."""
    return reach(g).select(F.col("seed").alias("src"), F.col("node").alias("dst"))


def can_reach(g: PropertyGraph, u: int, v: int) -> bool:
    """Whether v is reachable from u."""
    g.require(u, v)
    found = F.col("node") == v
    return u == v or not expand(seeds_of(g.nodes.sparkSession, [u]), g.edges, until=found).where(found).isEmpty()


def reachable_set(g: PropertyGraph, seeds: Seeds) -> DataFrame:
    """(seed, node) without the seed itself, even on a cycle."""
    return reach(g, seeds).where("seed <> node").select("seed", "node")


def within_reach(g: PropertyGraph, seeds: Seeds) -> DataFrame:
    """(seed, src, dst, adj_idx, weight, capacity, is_fallback): the edges that each seed can come to."""
    r = reach(g, seeds).select("seed", "node")
    return r.join(g.edges, r["node"] == g.edges["src"]).drop("node")


def dfs(g: PropertyGraph, seeds: Seeds) -> DataFrame:
    """(seed, node, pos): depth-first preorder, neighbours in the order of edges.

    Depth-first order is sequential; each seed's reachable edges are one group, all seeds in parallel.
    """
    start = seeds_of(g.nodes.sparkSession, seeds)
    loops = start.select("seed", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(-1).alias("adj_idx"))
    edges = within_reach(g, start.select("seed")).select("seed", "src", "dst", "adj_idx").union(loops)

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["src", "adj_idx"])
        near = {u: list(v) for u, v in part.groupby("src")["dst"]}
        seed = int(part["seed"].iloc[0])
        stack, seen, order = [seed], set(), []
        while stack:
            u = stack.pop()
            if u not in seen:
                seen.add(u)
                order.append(u)
                stack += [v for v in reversed(near.get(u, [])) if v not in seen]
        return pd.DataFrame({"seed": seed, "node": order, "pos": range(len(order))})

    return edges.groupBy("seed").applyInPandas(walk, "seed int, node int, pos int")


def has_fallback_path(g: PropertyGraph, pairs: DataFrame) -> DataFrame:
    """(src, dst, has_fallback): whether a walk from src to dst uses a fallback edge; true if src = dst.

    A node stands twice, as 2 id before and 2 id + 1 after a fallback edge.
    """
    e = g.edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "is_fallback").distinct()
    before = e.select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + F.col("is_fallback").cast("int")).alias("dst"))
    after = e.select((F.col("src") * 2 + 1).alias("src"), (F.col("dst") * 2 + 1).alias("dst"))
    start = pairs.select(F.col("src").alias("seed"), (F.col("src").cast("long") * 2).alias("node")).distinct()
    r = expand(start, before.union(after)).where("node % 2 = 1").select(F.col("seed").alias("src"), F.floor(F.col("node") / 2).cast("int").alias("dst")).distinct().withColumn("hit", F.lit(True))
    return pairs.join(r, ["src", "dst"], "left").select("src", "dst", (F.coalesce("hit", F.lit(False)) | (F.col("src") == F.col("dst"))).alias("has_fallback"))
