"""Shortest paths, all pairs, and k cheapest paths."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweft.model import PropertyGraph
from arcweft.operators.traversal import Seeds, reach, seeds_of
from arcweft.plans.loops import MOST_ROUNDS, cut, expand, relax, stored


def _weights(g: PropertyGraph) -> DataFrame:
    return g.edges.select("src", "dst", F.col("weight").alias("w"))


def _before(dist: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, node, prev): of the edges on a shortest path into a node the one that is settled first."""
    a = dist.select("seed", F.col("node").alias("src"), F.col("value").alias("du"))
    tight = a.join(edges, "src").join(dist.withColumnRenamed("node", "dst"), ["seed", "dst"]).where("du + w = value and src <> dst and dst <> seed")
    return tight.groupBy("seed", F.col("dst").alias("node")).agg(F.min(F.struct("du", "src"))["src"].alias("prev"))


def bellman_ford(g: PropertyGraph, seeds: Seeds) -> tuple[DataFrame, bool]:
    """((src, node, dist, prev), has_negative_cycle); no distances are given with a reachable negative cycle."""
    start = seeds_of(g.nodes.sparkSession, seeds).withColumn("value", F.lit(0.0))
    dist, settled = relax(start, _weights(g), "min", g.num_nodes())
    if not settled:
        return dist.limit(0).select(F.col("seed").alias("src"), "node", F.col("value").alias("dist"), F.lit(None).cast("int").alias("prev")), True
    out = dist.join(_before(dist, _weights(g)), ["seed", "node"], "left")
    return out.select(F.col("seed").alias("src"), "node", F.col("value").alias("dist"), "prev"), False


def dijkstra(g: PropertyGraph, seeds: Seeds) -> DataFrame:
    """(src, node, dist, prev) of reachable nodes; ValueError if a weight is negative."""
    if not g.edges.where("weight < 0").isEmpty():
        raise ValueError("negative weight: use bellman_ford")
    return bellman_ford(g, seeds)[0]


def johnsons(g: PropertyGraph) -> tuple[DataFrame, bool]:
    """((src, dst, dist, next), has_negative_cycle) for all pairs, from all sources in one loop; weights may be negative.

    next is the first node after src on a shortest path, of several the one of smallest id.  It is carried with the
    value that it leads to, never found again by comparing sums, so that weights of any kind lose no path.
    """
    steps = cut(_weights(g).groupBy("src", "dst").agg(F.min("w").alias("w")))
    state = cut(g.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"), F.lit(None).cast("int").alias("next"), F.lit(True).alias("moved")))
    for _ in range(max(1, g.num_nodes())):
        delta = state.where("moved").select(F.col("src").alias("a"), F.col("dst").alias("b"), "dist", "next")
        offer = F.min(F.struct((F.col("dist") + F.col("w")).alias("dist"), F.coalesce("next", "dst").alias("next")))
        offered = delta.join(steps, delta["b"] == steps["src"]).groupBy(F.col("a").alias("src"), "dst").agg(offer.alias("offer"))
        state = cut(_improved(state, offered))
        if not state.where("src = dst and dist < 0").isEmpty():
            break
        if state.where("moved").isEmpty():
            return _own_next(state), False
    return _own_next(state.limit(0)), True


def _improved(state: DataFrame, offered: DataFrame) -> DataFrame:
    """The state with what offered (src, dst, offer) betters: a smaller value, or an equal one by a smaller next."""
    held = state.select("src", "dst", F.struct("dist", "next").alias("old"))
    # A pair of a node with itself has no next: nulls come first, so that only a smaller value betters it.
    moved = F.col("offer").isNotNull() & (F.col("old").isNull() | (F.col("offer") < F.col("old")))
    both = held.join(offered, ["src", "dst"], "full").withColumn("moved", moved).withColumn("k", F.when(F.col("moved"), F.col("offer")).otherwise(F.col("old")))
    return both.select("src", "dst", "k.dist", "k.next", "moved")


def _own_next(state: DataFrame) -> DataFrame:
    return state.select("src", "dst", "dist", F.when(F.col("src") == F.col("dst"), F.col("src")).otherwise(F.col("next")).alias("next"))


def floyd_warshall(g: PropertyGraph) -> tuple[DataFrame, bool]:
    """As johnsons(), by path doubling: about log2 of the longest path's edges in rounds."""
    one = _weights(g).select("src", "dst", F.col("w").alias("dist"), F.col("dst").alias("next"))
    own = g.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"), F.lit(None).cast("int").alias("next"))
    state = cut(one.union(own).groupBy("src", "dst").agg(F.min(F.struct("dist", "next")).alias("k")).select("src", "dst", "k.dist", "k.next"))
    for _ in range(max(1, g.num_nodes()).bit_length() + 1):
        if not state.where("src = dst and dist < 0").isEmpty():
            return _own_next(state.limit(0)), True
        second = state.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("dist").alias("more"), F.col("next").alias("then"))
        longer = F.min(F.struct((F.col("dist") + F.col("more")).alias("dist"), F.coalesce("next", "then").alias("next")))
        offered = state.join(second, state["dst"] == second["mid"]).groupBy("src", F.col("to").alias("dst")).agg(longer.alias("offer"))
        state = cut(_improved(state, offered))
        if state.where("moved").isEmpty():
            break
    return _own_next(state), False


def path_to(tree: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(src, node, path) for every row of (src, node, prev): the way from src along prev."""
    step = cut(tree.select("src", "node", "prev"))
    back = step.select("src", F.col("node").alias("head"), F.col("prev").alias("up"))
    state = cut(step.select("src", "node", F.col("node").alias("head"), F.array("node").alias("path")))
    done = None
    for _ in range(most_rounds):
        ended = state.where("head = src").select("src", "node", "path")
        done = ended if done is None else done.union(ended)
        state = cut(state.where("head <> src").join(back, ["src", "head"]).where("up is not null").select("src", "node", F.col("up").alias("head"), F.concat(F.array("up"), "path").alias("path")))
        if state.isEmpty():
            return done
    raise RuntimeError("a path did not end")


def pair_paths(pairs: DataFrame, all_pairs: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(src, dst, path) for pairs (src, dst), along next of all_pairs; pairs without a path are absent."""
    hop = cut(all_pairs.select(F.col("src").alias("at"), "dst", "next"))
    state = cut(pairs.select("src", "dst", F.col("src").alias("at"), F.array("src").alias("path")))
    done = None
    for _ in range(most_rounds):
        ended = state.where("at = dst").select("src", "dst", "path")
        done = ended if done is None else done.union(ended)
        state = cut(state.where("at <> dst").join(hop, ["at", "dst"]).where("next is not null").select("src", "dst", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path")))
        if state.isEmpty():
            return done
    raise RuntimeError("a path did not end")


def between(g: PropertyGraph, pairs: DataFrame) -> DataFrame:
    """(a, b, src, dst, adj_idx, weight, capacity, is_fallback): for each pair (a, b) the edges on walks from a to b.

    An edge is on one if a reaches its source and its end reaches b.  Three orders of joins find the same edges: by what
    meets at an edge, which pairs then sift, or from the pairs by all edges that a or b can come to.  The one with
    the fewest rows on the way is taken.
    """
    ab = pairs.select("a", "b").distinct()
    ahead = reach(g, ab.select(F.col("a").alias("seed"))).select(F.col("seed").alias("a"), F.col("node").alias("src"))
    edges = stored(g.edges)
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    back = expand(ab.select(F.col("b").alias("seed"), F.col("b").alias("node")).distinct(), turned).select(F.col("seed").alias("b"), F.col("node").alias("dst"))
    ends = edges.select("src", "dst")
    counted = lambda df, key, name: df.groupBy(key).agg(F.count("*").alias(name))
    total = lambda df, x: df.agg(F.sum(F.expr(x).cast("double"))).first()[0] or 0.0
    to_src, from_dst = counted(ahead, "src", "p"), counted(back, "dst", "q")
    by_edge = total(ends.join(to_src, "src").join(from_dst, "dst"), "p * q + p")
    by_a = total(ab.join(ahead.join(counted(ends, "src", "o"), "src").groupBy("a").agg(F.sum("o").alias("n")), "a"), "n")
    by_b = total(ab.join(back.join(counted(ends, "dst", "o"), "dst").groupBy("b").agg(F.sum("o").alias("n")), "b"), "n")
    ab.sparkSession.sparkContext._jvm.System.gc()  # the counts' shuffle files
    if by_edge <= min(by_a, by_b):
        found = edges.join(ahead, "src").join(back, "dst")
        n, m, k = ab.agg(F.count("*"), F.count_distinct("a"), F.count_distinct("b")).first()
        if n < m * k:  # else every a goes with every b
            found = found.join(ab, ["a", "b"], "left_semi")
    elif by_a <= by_b:
        found = ab.join(edges.join(ahead, "src"), "a").join(back, ["b", "dst"], "left_semi")
    else:
        found = ab.join(edges.join(back, "dst"), "b").join(ahead, ["a", "src"], "left_semi")
    return found.select("a", "b", "src", "dst", "adj_idx", "weight", "capacity", "is_fallback")


def dijkstra_path(edges: dict[int, dict[int, float]], a: int, b: int, banned_nodes: frozenset[int] = frozenset(), banned_edges: frozenset[tuple[int, int]] = frozenset()) -> tuple[float, list[int]] | None:
    """Cost and nodes of the cheapest way from a to b without banned nodes and edges; of equal ones the least by nodes."""
    for out in edges.values():
        if any(w < 0 for w in out.values()):
            raise ValueError("negative weight")
    back: dict[int, list[tuple[int, float]]] = {}
    for u, out in edges.items():
        for v, w in out.items():
            if u not in banned_nodes and v not in banned_nodes and (u, v) not in banned_edges:
                back.setdefault(v, []).append((u, w))
    rest: dict[int, float] = {}
    turn: dict[int, int] = {}  # when a node's way to b was settled
    heap = [(0.0, b)]
    while heap:
        d, v = heapq.heappop(heap)
        if v in rest:
            continue
        rest[v], turn[v] = d, len(turn)
        for u, w in back.get(v, ()):
            if u not in rest:
                heapq.heappush(heap, (d + w, u))
    if a not in rest or a in banned_nodes:
        return None
    path, cost = [a], 0.0
    while path[-1] != b:
        u = path[-1]
        tight = [(v, w) for v, w in edges[u].items() if v in rest and (u, v) not in banned_edges and turn[v] < turn[u] and w + rest[v] <= rest[u] + 1e-9]
        v, w = min(tight)
        path.append(v)
        cost += w
    return cost, path


def cheapest(edges: dict[int, dict[int, float]], a: int, b: int, k: int) -> list[tuple[float, tuple[int, ...]]]:
    """The k cheapest simple paths by (cost, path): each leaves one found before at some node, by an edge none has taken."""
    first = dijkstra_path(edges, a, b)
    if first is None:
        return []
    found, waiting, known = [(first[0], tuple(first[1]))], [], {tuple(first[1])}
    while len(found) < k:
        last = found[-1][1]
        for i in range(len(last) - 1):
            root = last[: i + 1]
            taken = frozenset((p[i], p[i + 1]) for _, p in found if p[: i + 1] == root)
            spur = dijkstra_path(edges, last[i], b, frozenset(root[:-1]), taken)
            if spur is None:
                continue
            path = (*root, *spur[1][1:])
            if path not in known:
                known.add(path)
                cost = 0.0
                for u, v in zip(path, path[1:], strict=False):
                    cost += edges[u][v]
                heapq.heappush(waiting, (cost, path))
        if not waiting:
            break
        found.append(heapq.heappop(waiting))
    return found


def yen_k_shortest_paths(g: PropertyGraph, pairs: DataFrame, k: int) -> DataFrame:
    """(src, dst, rank, path, cost): the k cheapest simple paths of each pair (src, dst); ties by the path.

    Parallel edges count by their least weight; k = 0 gives one path.  A pair takes k times the path's nodes searches,
    over the edges on its walks only; pairs run in parallel.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    ab = pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    parts = between(g, ab.where("a <> b")).groupBy("a", "b", "src", "dst").agg(F.min("weight").alias("w"))

    def search(part: pd.DataFrame) -> pd.DataFrame:
        a, b = int(part["a"].iloc[0]), int(part["b"].iloc[0])
        edges: dict[int, dict[int, float]] = {}
        for u, v, w in zip(part["src"].tolist(), part["dst"].tolist(), part["w"].tolist(), strict=True):
            edges.setdefault(u, {})[v] = w
        rows = [(a, b, i + 1, list(p), c) for i, (c, p) in enumerate(cheapest(edges, a, b, max(k, 1)))]
        return pd.DataFrame(rows, columns=["src", "dst", "rank", "path", "cost"])

    same = ab.where("a = b").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("rank"), F.array("a").alias("path"), F.lit(0.0).alias("cost"))
    return parts.groupBy("a", "b").applyInPandas(search, "src int, dst int, rank int, path array<int>, cost double").union(same)


def path_edges(paths: DataFrame, *keys: str) -> DataFrame:
    """(keys, i, u, v): the hops of each row's path."""
    hops = F.arrays_zip(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))).alias("u"), F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))).alias("v"))
    return paths.select(*keys, F.posexplode(hops).alias("i", "h")).select(*keys, "i", F.col("h.u").alias("u"), F.col("h.v").alias("v"))


def resilience_score(g: PropertyGraph, pairs: DataFrame, k: int = 5) -> DataFrame:
    """(src, dst, score): from the number of paths, the spread of their costs and whether one uses a fallback edge."""
    paths = cut(yen_k_shortest_paths(g, pairs, k))
    spare = g.edges.where("is_fallback").select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    uses = path_edges(paths, "src", "dst").join(spare, ["u", "v"], "left_semi").select("src", "dst").distinct().withColumn("fb", F.lit(0.1))
    per = paths.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("cost").alias("lo"), F.max("cost").alias("hi"))
    spread = F.when(F.col("hi") > 0, F.col("lo") / F.col("hi")).otherwise(1.0)
    full = F.least(F.lit(1.0), 0.5 * F.least(F.lit(1.0), F.col("n") / F.lit(float(max(k, 1)))) + 0.4 * spread + F.coalesce("fb", F.lit(0.0)))
    score = F.when(F.col("n").isNull(), 0.0).when(F.col("n") == 1, 0.1).otherwise(full)
    return pairs.select("src", "dst").distinct().join(per, ["src", "dst"], "left").join(uses, ["src", "dst"], "left").select("src", "dst", score.alias("score"))


__all__ = ["bellman_ford", "between", "cheapest", "dijkstra", "dijkstra_path", "floyd_warshall", "johnsons", "pair_paths", "path_edges", "path_to", "resilience_score", "yen_k_shortest_paths"]
