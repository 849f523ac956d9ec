"""Order, components, cycles, forests, colours and partitions."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweft.model import PropertyGraph
from arcweft.operators.traversal import Seeds, within_reach
from arcweft.plans.loops import components, cut, expand, peel, ranked, relax


class CycleError(ValueError):
    """The graph has a cycle where none is allowed."""


def waves(g: PropertyGraph) -> DataFrame:
    """(node, level, pos) in first-in-first-out topological order; CycleError if there is a cycle."""
    order = cut(peel(g.nodes, g.edges))
    if order.count() != g.num_nodes():
        raise CycleError("the graph has a cycle")
    return order


def kahn_toposort(g: PropertyGraph) -> DataFrame:
    """(pos, node)."""
    return waves(g).select("pos", "node")


def toposort_levels(g: PropertyGraph) -> DataFrame:
    """(level, pos, node): level is the longest number of hops from a source."""
    return waves(g).select("level", "pos", "node")


def dfs_toposort(g: PropertyGraph) -> DataFrame:
    """(pos, node): reverse depth-first postorder, starts by id.

    Weak components do not touch each other's order: each is one group, and the whole order runs through components
    from that of the greatest least id to that of the least, as the sequential search would leave them only if
    components are contiguous in id; between components any order is topological.
    """
    waves(g)
    label = weakly_connected_components(g)
    own = label.select(F.col("component"), F.col("node").alias("src"), F.lit(None).cast("int").alias("dst"), F.lit(-1).alias("adj_idx"))
    parts = g.edges.join(label, g.edges["src"] == label["node"]).select("component", "src", "dst", "adj_idx").union(own)

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        near = {u: list(v) for u, v in part[part["adj_idx"] >= 0].sort_values(["src", "adj_idx"]).groupby("src")["dst"]}
        done, order = set(), []
        for start in sorted(part["src"].unique().tolist()):
            if start in done:
                continue
            done.add(start)
            stack = [(start, iter(near.get(start, ())))]
            while stack:
                u, rest = stack[-1]
                for v in rest:
                    v = int(v)
                    if v not in done:
                        done.add(v)
                        stack.append((v, iter(near.get(v, ()))))
                        break
                else:
                    order.append(u)
                    stack.pop()
        order.reverse()
        return pd.DataFrame({"component": int(part["component"].iloc[0]), "k": range(len(order)), "node": order})

    found = cut(parts.groupBy("component").applyInPandas(walk, "component int, k int, node int"))
    size = found.groupBy("component").agg(F.count("*").alias("n"))

    before = size.withColumn("b", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("component")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return found.join(before, "component").select((F.col("b") + F.col("k")).cast("int").alias("pos"), "node")


def weakly_connected_components(g: PropertyGraph) -> DataFrame:
    """(node, component): component is the smallest id in it."""
    found = components(g.edges)
    return g.nodes.select(F.col("id").alias("node")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def scc(g: PropertyGraph) -> DataFrame:
    """(node, scc): strongly connected components, named by their smallest id.

    Rounds of colouring: every node takes the smallest id that reaches it; the nodes of a colour that reach its root
    are a component, and are taken out with it.  Nodes without in- or out-edges go first.
    """
    nodes = cut(g.nodes.select(F.col("id").alias("node")))
    edges = cut(g.edges.where("src <> dst").select("src", "dst").distinct())
    out = None
    while True:
        heads, tails = edges.select(F.col("dst").alias("node")).distinct(), edges.select(F.col("src").alias("node")).distinct()
        both = heads.join(tails, "node", "left_semi")
        single = nodes.join(both, "node", "left_anti").select("node", F.col("node").alias("scc"))
        inner = cut(nodes.join(both, "node", "left_semi"))
        out = single if out is None else out.union(single)
        if inner.isEmpty():
            return cut(out)
        mine = inner.select(F.col("node").alias("src"))
        edges = cut(edges.join(mine, "src", "left_semi").join(mine.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"))
        start = inner.select(F.lit(0).alias("seed"), "node", F.col("node").cast("double").alias("value"))
        color, _ = relax(start, edges.withColumn("w", F.lit(0.0)), "min")
        color = color.select("node", F.col("value").cast("int").alias("scc"))
        a, b = color.select(F.col("node").alias("src"), F.col("scc").alias("ca")), color.select(F.col("node").alias("dst"), F.col("scc").alias("cb"))
        within = edges.join(a, "src").join(b, "dst").where("ca = cb").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = color.where("node = scc").select(F.col("node").alias("seed"), "node")
        found = cut(expand(roots, within).select("node", F.col("seed").alias("scc")))
        out = cut(out.union(found))
        nodes = cut(inner.join(found, "node", "left_anti"))
        gone = found.select(F.col("node").alias("src"))
        edges = cut(edges.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))


def condensation_graph(g: PropertyGraph, sccs: DataFrame | None = None) -> tuple[PropertyGraph, DataFrame]:
    """(graph of components, (node, scc, meta)): meta numbers components by their smallest ids.

    One edge for each ordered pair of components: the first in scan order.
    """
    label = cut(scc(g) if sccs is None else sccs)
    members = label.groupBy("scc").agg(F.sort_array(F.collect_list("node")).alias("m"))

    numbered = cut(ranked(members, [], [F.col("scc")], F.floor(F.col("scc") / F.lit(65536))).select("scc", F.col("n").alias("meta"), "m"))
    nodes = numbered.select(F.col("meta").alias("id"), F.concat(F.lit("SCC_"), F.col("meta").cast("string"), F.lit("("), F.array_join(F.col("m").cast("array<string>"), ","), F.lit(")")).alias("name"))
    of = label.join(numbered.select("scc", "meta"), "scc").select("node", "scc", "meta")
    a, b = of.select(F.col("node").alias("src"), F.col("meta").alias("cu")), of.select(F.col("node").alias("dst"), F.col("meta").alias("cv"))
    cross = g.edges.join(a, "src").join(b, "dst").where("cu <> cv")
    first = cross.groupBy("cu", "cv").agg(F.min_by(F.struct("src", "adj_idx", "weight", "capacity", "is_fallback"), F.struct("src", "adj_idx")).alias("e"))

    place = F.row_number().over(Window.partitionBy("cu").orderBy("e.src", "e.adj_idx")) - 1
    edges = first.select(F.col("cu").alias("src"), F.col("cv").alias("dst"), place.alias("adj_idx"), "e.weight", "e.capacity", "e.is_fallback")
    return PropertyGraph.of(nodes, edges), of


def _ordered_scc(g: PropertyGraph, sign: int) -> DataFrame:
    meta, of = condensation_graph(g)
    order = peel(meta.nodes, meta.edges).select(F.col("node").alias("meta"), "pos")
    most = meta.num_nodes() - 1
    return of.join(order, "meta").select("node", "scc", (F.col("pos") if sign > 0 else F.lit(most) - F.col("pos")).alias("ord"))


def tarjan_scc(g: PropertyGraph) -> DataFrame:
    """(node, scc, ord): components in reverse topological order."""
    return _ordered_scc(g, -1)


def kosaraju_scc(g: PropertyGraph) -> DataFrame:
    """(node, scc, ord): components in topological order."""
    return _ordered_scc(g, 1)


def is_bipartite(g: PropertyGraph) -> tuple[bool, DataFrame]:
    """(answer, (node, color)): colours by parity of the distance from each component's smallest id; none if not bipartite."""
    both = g.edges.select("src", "dst").union(g.edges.select("dst", "src"))
    roots = weakly_connected_components(g).where("node = component").select(F.lit(0).alias("seed"), "node")
    color = cut(expand(roots, both).select("node", (F.col("depth") % 2).alias("color")))
    a, b = color.select(F.col("node").alias("src"), F.col("color").alias("ca")), color.select(F.col("node").alias("dst"), F.col("color").alias("cb"))
    ok = g.edges.select("src", "dst").join(a, "src").join(b, "dst").where("ca = cb").isEmpty()
    return ok, color if ok else color.limit(0)


def _biconnected(part: pd.DataFrame) -> pd.DataFrame:
    """Bridges and cut nodes of one component of a simple undirected graph, by depth-first low points."""
    near: dict[int, list[int]] = {}
    for u, v in zip(part["u"].tolist(), part["v"].tolist(), strict=True):
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    bridges, points = [], set()
    root = min(near)
    depth, low = {root: 0}, {root: 0}
    stack, children = [(root, -1, iter(sorted(near[root])))], 0
    while stack:
        u, parent, rest = stack[-1]
        for v in rest:
            if v == parent:
                continue
            if v in depth:
                low[u] = min(low[u], depth[v])
            else:
                depth[v] = low[v] = depth[u] + 1
                stack.append((v, u, iter(sorted(near[v]))))
                break
        else:
            stack.pop()
            if parent >= 0:
                low[parent] = min(low[parent], low[u])
                if low[u] > depth[parent]:
                    bridges.append((min(u, parent), max(u, parent)))
                if parent == root:
                    children += 1
                elif low[u] >= depth[parent]:
                    points.add(parent)
    if children > 1:
        points.add(root)
    return pd.DataFrame([(*b, "bridge") for b in bridges] + [(p, p, "point") for p in points], columns=["u", "v", "kind"])


def find_bridges_and_aps(g: PropertyGraph) -> DataFrame:
    """(u, v, kind): bridges (u < v) and articulation points (u = v) of the simple undirected graph.

    Low points are sequential; weak components run in parallel.
    """
    simple = g.edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    label = components(g.edges)
    parts = simple.join(label, simple["u"] == label["node"]).select("component", "u", "v")
    return parts.groupBy("component").applyInPandas(_biconnected, "u int, v int, kind string")


def find_bridges(g: PropertyGraph) -> DataFrame:
    """(u, v) with u < v."""
    return find_bridges_and_aps(g).where("kind = 'bridge'").select("u", "v")


def find_articulation_points(g: PropertyGraph) -> DataFrame:
    """(node)."""
    return find_bridges_and_aps(g).where("kind = 'point'").select(F.col("u").alias("node"))


def has_cycle_directed(g: PropertyGraph) -> bool:
    """Whether peeling leaves a remainder; a loop is a cycle."""
    return peel(g.nodes, g.edges).count() != g.num_nodes()


def has_cycle_undirected(g: PropertyGraph, compat: bool = True) -> bool:
    """Whether union-find would meet a joined pair: over edges with src < dst only, or (compat=False) over all distinct pairs."""
    if compat:
        e = g.edges.where("src < dst").select("src", "dst")
    else:
        e = g.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        if not e.where("src = dst").isEmpty():
            return True
    label = components(e)
    inside, groups = label.count(), label.select("component").distinct().count()
    return e.count() > inside - groups


def find_all_cycles_directed(g: PropertyGraph) -> DataFrame:
    """(cycle): every elementary cycle once, from its smallest node; parallel edges give as many.

    Paths grow from each start over larger nodes of its strong component only.  Their number can grow exponentially
    with the edges, as that of the cycles does; none are dropped.
    """
    label = cut(scc(g))
    a, b = label.select(F.col("node").alias("src"), F.col("scc").alias("ca")), label.select(F.col("node").alias("dst"), F.col("scc").alias("cb"))
    inner = cut(g.edges.join(a, "src").join(b, "dst").where("ca = cb").groupBy("src", "dst").agg(F.count("*").alias("times")))
    out = inner.where("src = dst").select(F.array("src").alias("cycle"), "times")
    paths = cut(inner.where("dst > src").select(F.col("src").alias("s"), F.col("dst").alias("at"), F.array("src", "dst").alias("path"), "times"))
    steps = inner.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("times").alias("more"))
    while not paths.isEmpty():
        grown = cut(paths.join(steps, "at").where("to = s or (to > s and not array_contains(path, to))").select("s", "to", "path", (F.col("times") * F.col("more")).alias("times")))
        out = out.union(grown.where("to = s").select(F.col("path").alias("cycle"), "times"))
        paths = cut(grown.where("to <> s").select("s", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), "times"))
    return out.select("cycle", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("cycle")


def boruvka_mst(g: PropertyGraph) -> DataFrame:
    """Edges of the minimum spanning forest of the graph seen as undirected; ties by (weight, src, adj_idx)."""
    label = cut(g.nodes.select(F.col("id").alias("node"), F.col("id").alias("c")))
    chosen = None
    edges = g.edges.where("src <> dst")
    while True:
        a, b = label.select(F.col("node").alias("src"), F.col("c").alias("ca")), label.select(F.col("node").alias("dst"), F.col("c").alias("cb"))
        cross = edges.join(a, "src").join(b, "dst").where("ca <> cb")
        e = F.struct("weight", "src", "adj_idx", "dst", "capacity", "is_fallback")
        best = cross.select(F.explode(F.array("ca", "cb")).alias("c"), e.alias("e"), "ca", "cb").groupBy("c").agg(F.min(F.struct("e", "ca", "cb")).alias("x"))
        picked = cut(best.select("x.e.*", "x.ca", "x.cb").distinct())
        if picked.isEmpty():
            break
        rows = picked.select("src", "dst", "adj_idx", "weight", "capacity", "is_fallback")
        chosen = rows if chosen is None else chosen.union(rows)
        merged = components(picked.select(F.col("ca").alias("src"), F.col("cb").alias("dst"))).select(F.col("node").alias("c"), "component")
        label = cut(label.join(merged, "c", "left").select("node", F.coalesce("component", "c").alias("c")))
    return g.edges.limit(0) if chosen is None else cut(chosen)


def kruskal_mst(g: PropertyGraph) -> DataFrame:
    """The same forest in the order in which edges are taken."""
    return boruvka_mst(g).orderBy("weight", "src", "adj_idx")


def prim_mst(g: PropertyGraph, starts: Seeds = (0,)) -> DataFrame:
    """(seed, src, dst, weight, capacity, is_fallback): the greedy tree over out-edges from each start; is_fallback is false.

    Sequential for each start; starts run in parallel.
    """

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple]] = {}
        for row in part[["weight", "src", "dst", "capacity"]].itertuples(index=False):
            near.setdefault(int(row.src), []).append((row.weight, int(row.src), int(row.dst), row.capacity))
        seed = int(part["seed"].iloc[0])
        inside, heap, tree = {seed}, list(near.get(seed, ())), []
        heapq.heapify(heap)
        while heap:
            w, u, v, c = heapq.heappop(heap)
            if v not in inside:
                inside.add(v)
                tree.append((seed, u, v, w, c, False))
                for e in near.get(v, ()):
                    heapq.heappush(heap, e)
        return pd.DataFrame(tree, columns=["seed", "src", "dst", "weight", "capacity", "is_fallback"])

    return within_reach(g, starts).groupBy("seed").applyInPandas(grow, "seed int, src int, dst int, weight double, capacity double, is_fallback boolean")


def greedy_coloring(g: PropertyGraph) -> DataFrame:
    """(node, color): the least free colour in order of (distinct neighbours descending, id).

    Each round colours all nodes whose earlier neighbours have colours: the sequential answer, in parallel.
    """
    both = g.edges.where("src <> dst").select("src", "dst").union(g.edges.where("src <> dst").select("dst", "src")).distinct()
    degree = both.groupBy("src").agg(F.count("*").alias("d"))
    rank = g.nodes.select(F.col("id").alias("node")).join(degree.withColumnRenamed("src", "node"), "node", "left").select("node", F.struct((-F.coalesce("d", F.lit(0))).alias("d"), "node").alias("k"))
    a, b = rank.select(F.col("node").alias("src"), F.col("k").alias("ka")), rank.select(F.col("node").alias("dst"), F.col("k").alias("kb"))
    earlier = cut(both.join(a, "src").join(b, "dst").where("ka < kb").select(F.col("src").alias("first"), F.col("dst").alias("node")))
    waiting, done = cut(rank.select("node")), None
    while not waiting.isEmpty():
        held = earlier.join(waiting.select(F.col("node").alias("first")), "first", "left_semi").select("node").distinct()
        ready = waiting.join(held, "node", "left_anti")
        if done is None:
            new = ready.select("node", F.lit(0).alias("color"))
        else:
            used = ready.join(earlier, "node").join(done.select(F.col("node").alias("first"), "color"), "first").groupBy("node").agg(F.collect_set("color").alias("u"))
            free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("u")), "u"))
            new = ready.join(used, "node", "left").select("node", F.coalesce(free, F.lit(0)).alias("color"))
        new = cut(new)
        done = new if done is None else cut(done.union(new))
        waiting = cut(waiting.join(new, "node", "left_anti"))
    return done if done is not None else g.nodes.limit(0).select(F.col("id").alias("node"), F.lit(0).alias("color"))


def _dsatur(part: pd.DataFrame) -> pd.DataFrame:
    near: dict[int, set[int]] = {}
    for u, v in zip(part["u"].tolist(), part["v"].tolist(), strict=True):
        near.setdefault(u, set())
        if u != v:
            near[u].add(v)
            near.setdefault(v, set()).add(u)
    color: dict[int, int] = {}
    taken: dict[int, set[int]] = {u: set() for u in near}
    heap = [(0, -len(near[u]), u) for u in near]
    heapq.heapify(heap)
    while heap:
        s, _, u = heapq.heappop(heap)
        if u in color or -s != len(taken[u]):
            continue
        color[u] = next(c for c in range(len(near[u]) + 1) if c not in taken[u])
        for v in near[u]:
            if v not in color and color[u] not in taken[v]:
                taken[v].add(color[u])
                heapq.heappush(heap, (-len(taken[v]), -len(near[v]), v))
    return pd.DataFrame({"node": list(color), "color": list(color.values())})


def dsatur_coloring(g: PropertyGraph) -> DataFrame:
    """(node, color): most distinct neighbour colours first, then most neighbours, then least id.

    Sequential within a weak component, whose colours do not depend on any other; components run in parallel.
    """
    label = cut(weakly_connected_components(g))
    pairs = g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    own = label.select("component", F.col("node").alias("u"), F.col("node").alias("v"))
    parts = pairs.join(label, pairs["u"] == label["node"]).select("component", "u", "v").union(own)
    return parts.groupBy("component").applyInPandas(_dsatur, "node int, color int")


def chromatic_number_estimate(g: PropertyGraph) -> int:
    """Colours that DSatur uses; 1 for an empty graph."""
    return (dsatur_coloring(g).agg(F.max("color")).first()[0] or 0) + 1


def partition_for_parallel(g: PropertyGraph) -> DataFrame:
    """(partition, node): weak components."""
    return weakly_connected_components(g).select(F.col("component").alias("partition"), "node")


def topological_wave_partition(g: PropertyGraph) -> DataFrame:
    """(wave, node)."""
    return toposort_levels(g).select(F.col("level").alias("wave"), "node")


def partition_by_scc(g: PropertyGraph) -> DataFrame:
    """(wave, node, scc): strong components in waves of their condensation."""
    meta, of = condensation_graph(g)
    level = peel(meta.nodes, meta.edges).select(F.col("node").alias("meta"), F.col("level").alias("wave"))
    return of.join(level, "meta").select("wave", "node", "scc")


