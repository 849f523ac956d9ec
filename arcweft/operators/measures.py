"""Centrality, critical path, flow, latency."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweft.model import PropertyGraph
from arcweft.operators.paths import between, path_edges, path_to
from arcweft.operators.structure import CycleError, waves
from arcweft.operators.traversal import reach
from arcweft.plans.loops import FEW, PIECES, cut, few, peel, relax, stored

EPSILON = 1e-9
SAMPLES, JITTER = 10_000, 0.20


def degree_centrality(g: PropertyGraph) -> DataFrame:
    """(node, score): in- and out-edges over 2 (N - 1)."""
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    n = g.num_nodes()
    return g.nodes.select("id").join(ends, "id", "left").select(F.col("id").alias("node"), (F.coalesce("d", F.lit(0)) / F.lit(2.0 * (n - 1) if n > 1 else 1.0)).alias("score"))


def closeness_centrality(g: PropertyGraph) -> DataFrame:
    """(node, score): r^2 / ((N - 1) sum of distances) over the r nodes that the node reaches; 0 if none."""
    n = g.num_nodes()
    per = reach(g).where("depth > 0").groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("r"), F.sum("depth").alias("d"))
    score = F.col("r") * F.col("r") / (F.lit(float(max(n - 1, 1))) * F.col("d"))
    return g.nodes.select("id").join(per, "id", "left").select(F.col("id").alias("node"), F.coalesce(score, F.lit(0.0)).alias("score"))


def betweenness_centrality(g: PropertyGraph) -> DataFrame:
    """(node, score): Brandes over hops, all sources in one loop; parallel edges count as paths of their own."""
    n = g.num_nodes()
    edges = cut(g.edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("m")))
    level = cut(g.nodes.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(1.0).alias("sigma")))
    levels, seen = [level], level.select("seed", "node")
    while True:
        nxt = level.join(edges, level["node"] == edges["src"]).groupBy("seed", F.col("dst").alias("node")).agg(F.sum(F.col("sigma") * F.col("m")).alias("sigma"))
        level = cut(nxt.join(seen, ["seed", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = cut(seen.union(level.select("seed", "node")))
    below = cut(levels[-1].withColumn("delta", F.lit(0.0)))
    total = None
    for up in reversed(levels[:-1]):
        w = below.select("seed", F.col("node").alias("dst"), F.col("sigma").alias("sw"), "delta")
        part = up.join(edges, up["node"] == edges["src"]).join(w, ["seed", "dst"]).groupBy("seed", "node").agg(F.sum(F.col("m") * F.col("sigma") / F.col("sw") * (1 + F.col("delta"))).alias("delta"))
        rows = below.where("node <> seed").select("node", "delta")
        total = rows if total is None else total.union(rows)
        below = cut(up.join(part, ["seed", "node"], "left").select("seed", "node", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")))
    norm = float((n - 1) * (n - 2)) if n > 2 else 1.0
    none = g.nodes.select(F.col("id").alias("node"), F.lit(0.0).alias("delta"))
    every = none if total is None else none.union(total)
    return every.groupBy("node").agg((F.sum("delta") / F.lit(norm)).alias("score"))


def pagerank(g: PropertyGraph, damping: float = 0.85, iterations: int = 100) -> DataFrame:
    """(node, score): the mass of nodes without out-edges goes to all; ends when the sum of changes is below 1e-9."""
    n = g.num_nodes()
    out = g.edges.groupBy("src").agg(F.count("*").alias("o"))
    links = cut(g.edges.groupBy("src", "dst").agg(F.count("*").alias("m")).join(out, "src").select("src", "dst", (F.col("m") / F.col("o")).alias("p")))
    ends = g.nodes.select(F.col("id").alias("node")).join(out.select(F.col("src").alias("node"), F.lit(False).alias("dangling")), "node", "left")
    rank = cut(ends.select("node", F.coalesce("dangling", F.lit(True)).alias("dangling"), F.lit(1.0 / max(n, 1)).alias("score")))
    lost = rank.where("dangling").agg(F.sum("score")).first()[0] or 0.0
    for _ in range(iterations):
        got = links.join(rank, links["src"] == rank["node"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("score")).alias("s"))
        base = (1 - damping) / n + damping * lost / n if n else 0.0
        new = cut(rank.join(got, rank["node"] == got["dst"], "left").select("node", "dangling", (F.lit(base) + F.lit(damping) * F.coalesce("s", F.lit(0.0))).alias("score"), F.col("score").alias("old")))
        # The change of this round and the mass that the next one has to deal out, at once.
        change, lost = new.agg(F.sum(F.abs(F.col("score") - F.col("old"))), F.sum(F.when(F.col("dangling"), F.col("score")))).first()
        lost, rank = lost or 0.0, new.select("node", "dangling", "score")
        if (change or 0.0) < 1e-9:
            break
    return rank.select("node", "score")


def compute_critical_path(g: PropertyGraph) -> DataFrame:
    """(node, est, eft, lst, lft, slack, critical, pos): earliest and latest times; pos is the topological place.

    CycleError on a cycle; an empty graph gives no rows.
    """
    order = waves(g).select("node", "pos")
    lat = g.nodes.select(F.col("id").alias("node"), F.col("base_latency_ms").alias("lat"))
    start = lat.select(F.lit(0).alias("seed"), "node", F.lit(0.0).alias("value"))
    steps = g.edges.join(lat, g.edges["src"] == lat["node"]).select("src", "dst", (F.col("lat") + F.col("weight")).alias("w"))
    est, _ = relax(start, steps, "max")
    early = cut(est.join(lat, "node").select("node", F.col("value").alias("est"), (F.col("value") + F.col("lat")).alias("eft"), "lat"))
    duration = max(0.0, early.agg(F.max("eft")).first()[0] or 0.0)
    back = g.edges.join(lat, g.edges["dst"] == lat["node"]).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("lat") - F.col("weight")).alias("w"))
    lft, _ = relax(start.withColumn("value", F.lit(duration)), back, "min")
    both = early.join(lft.select("node", F.col("value").alias("lft")), "node").join(order, "node")
    slack = F.col("lft") - F.col("eft")
    return both.select("node", "est", "eft", (F.col("lft") - F.col("lat")).alias("lst"), "lft", slack.alias("slack"), (slack <= EPSILON).alias("critical"), "pos")


def project_duration(g: PropertyGraph) -> float:
    """The greatest earliest finish; 0 for an empty graph."""
    return max(0.0, compute_critical_path(g).agg(F.max("eft")).first()[0] or 0.0)


def build_flow_network(g: PropertyGraph, use_capacity_field: bool = True) -> DataFrame:
    """(u, v, residual): capacities (or weights) with parallel edges added, and a zero edge back where there is none."""
    e = g.edges.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("capacity" if use_capacity_field else "weight").alias("c"))
    both = e.union(e.select("v", "u", F.lit(0.0)))
    return both.groupBy("u", "v").agg(F.sum("c").alias("residual"))


def _max_flow(cap: dict[int, dict[int, float]], s: int, t: int) -> tuple[float, set[int]]:
    """Value and residual source side, by levels and blocking flows; changes cap to the residual network."""
    flow = 0.0
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for v, c in cap.get(u, {}).items():
                if c > EPSILON and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if t not in level:
            return flow, set(level)
        rest = {u: list(cap.get(u, {})) for u in level}
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                hops = list(zip(path, path[1:], strict=False))
                least = min(cap[a][b] for a, b in hops)
                flow += least
                for a, b in hops:
                    cap[a][b] -= least
                    cap[b][a] = cap[b].get(a, 0.0) + least
                cutoff = next(i for i, (a, b) in enumerate(hops) if cap[a][b] <= EPSILON)
                path = path[: cutoff + 1]
                continue
            while rest[u]:
                v = rest[u][-1]
                if cap[u][v] > EPSILON and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
                rest[u].pop()
            else:
                path.pop()
                if path:
                    rest[path[-1]].pop()


def max_flow(g: PropertyGraph, pairs: DataFrame, use_capacity_field: bool = True, sides: bool = True) -> DataFrame:
    """(src, sink, max_flow, source_side array): for each pair; ValueError if src = sink.

    Only edges on walks from src to sink can carry flow, and only they are gathered; pairs run in parallel.  The
    source side holds the nodes of those walks that the residual network reaches from src.  Without sides that column is
    left out, and networks shrink before they are gathered.
    """
    if not pairs.where("src = sink").isEmpty():
        raise ValueError("src and sink must differ")
    if not sides:
        solved = pairs.select("src", "sink").distinct().join(_flows(g, pairs, use_capacity_field).select("src", "sink", "max_flow"), ["src", "sink"], "left")
        return solved.select("src", "sink", F.coalesce("max_flow", F.lit(0.0)).alias("max_flow"))
    solved = _solved(g, pairs, use_capacity_field)
    return solved.select("src", "sink", F.coalesce("max_flow", F.lit(0.0)).alias("max_flow"), F.coalesce("source_side", F.array("src")).alias("source_side"))


def _flows(g: PropertyGraph, pairs: DataFrame, use_capacity_field: bool = True, cuts: bool = False) -> DataFrame:
    """(src, sink, max_flow, cut array of (u, v), which is null without cuts): the pairs with a flow, maybe more."""
    shrunk, rest = _shrunk(g, pairs, use_capacity_field, cuts)
    if rest is None:
        return shrunk
    found = _solved(g, rest, use_capacity_field).where("max_flow is not null")
    crossing = F.arrays_zip(F.col("cut_from").alias("u"), F.col("cut_to").alias("v"))
    found = found.select("src", "sink", "max_flow", (crossing if cuts else F.lit(None)).cast("array<struct<u:int,v:int>>").alias("cut"))
    return found if shrunk is None else shrunk.union(found)


def _shrunk(g: PropertyGraph, pairs: DataFrame, use_capacity_field: bool, cuts: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """(the flows of the pairs whose networks shrink to one edge, the other pairs); either may be None.

    Where each node before a sink has one edge into it at most, a node passes on to the sink what it can send there, but
    no more than that edge brings: from the deepest nodes up, each is taken out and its edge to the sink added to that
    of the node above it.  A sink's edges lie in one task meanwhile.  The least source side ends at the first full edge.
    """
    every = stored(g.edges.where("src <> dst").select("src", "dst", F.coalesce("capacity" if use_capacity_field else "weight", F.lit(0.0)).alias("c")))
    if not every.where("c < 0 or isnan(c)").isEmpty():
        return None, pairs
    e = every.where("c > 0")
    live = stored(e.select(F.col("src").alias("v")).distinct())
    nodes = live.count()
    into = e.select(F.col("dst").alias("v"), "src", "c").join(few(live, nodes), "v").groupBy("v").agg(F.min("src").alias("up"), F.max("src").alias("most"), F.sum("c").alias("cap"))
    into = stored(into)
    alone = into.where("up = most").drop("most")
    parts = [stored(live.join(into, "v", "left_anti").select("v", F.lit(None).cast("int").alias("up"), F.lit(None).cast("double").alias("cap"), F.lit(0).alias("depth")))]
    rows, deepest, reached = parts[0].count(), 0, 0
    while rows:
        reached += rows
        parts.append(stored(few(parts[-1].select(F.col("v").alias("up")), rows).join(alone, "up").select("v", "up", "cap", F.lit(deepest + 1).alias("depth"))))
        rows = parts[-1].count()
        deepest += bool(rows)
        if len(parts) > PIECES:
            parts = [stored(reduce(DataFrame.union, parts[:-1])), parts[-1]]
    tree = stored(reduce(DataFrame.union, parts))
    ab = pairs.select(F.col("src").alias("v"), F.col("sink").alias("b")).distinct()
    ways, rest = e.select(F.col("dst").alias("b"), F.col("src").alias("v"), F.col("c").alias("f")), None
    if reached < nodes:
        other = stored(ways.join(few(tree.select("v"), reached), "v", "left_anti").select("b").distinct())
        rest = stored(pairs.join(few(other.withColumnRenamed("b", "sink")), "sink", "left_semi").select("src", "sink").distinct())
        ways = ways.join(few(other), "b", "left_anti")
    ends, begins = ab.select("b").distinct(), stored(ab.select("v").distinct().withColumn("own", F.lit(True)))
    if (sinks := ends.count()) <= FEW:
        ways = ways.join(F.broadcast(ends), "b", "left_semi")
    at = {r["depth"] for r in tree.join(few(begins), "v").select("depth").distinct().collect()}
    edge = lambda u, v: F.array(F.struct(F.col(u).alias("u"), F.col(v).alias("v")))
    total = [F.sum("f").alias("f"), *([F.flatten(F.collect_list("cut")).alias("cut")] if cuts else [])]
    state = ways.repartition("b").groupBy("b", "v").agg(F.sum("f").alias("f")).withColumn("done", F.lit(False))
    if cuts:
        state = state.withColumn("cut", edge("v", "b"))
    for depth in range(deepest, min(at, default=deepest), -1):
        state = state.join(few(tree.where(f"depth = {depth}").select("v", "up", "cap")), "v", "left")
        goes = ~F.col("done") & F.col("up").isNotNull()
        on = [F.when(goes, F.col("up")).otherwise(F.col("v")).alias("v"), F.when(goes, F.least("f", "cap")).otherwise(F.col("f")).alias("f"), F.col("done")]
        stay = ["v", "f", F.lit(True).alias("done")]
        if cuts:
            on.append(F.when(goes & (F.col("cap") - F.col("f") <= EPSILON), edge("up", "v")).otherwise(F.col("cut")).alias("cut"))
            stay.append("cut")
        if depth in at:  # what a source of pairs can send is kept before it is passed on
            state = state.join(few(begins), "v", "left")
            both = F.when(goes & F.col("own"), F.array(F.struct(*stay), F.struct(*on))).otherwise(F.array(F.struct(*on)))
            state = state.select("b", F.explode(both).alias("x")).select("b", "x.*")
        else:
            state = state.select("b", *on)
        state = state.groupBy("b", "v", "done").agg(*total)
        if (deepest - depth) % PIECES == PIECES - 1:
            state = stored(state).repartition("b")
    state = state.join(few(begins.select("v")), "v", "left_semi")
    across = (F.col("cut") if cuts else F.lit(None)).cast("array<struct<u:int,v:int>>")
    return state.select(F.col("v").alias("src"), F.col("b").alias("sink"), F.col("f").alias("max_flow"), across.alias("cut")), rest


def _solved(g: PropertyGraph, pairs: DataFrame, use_capacity_field: bool = True) -> DataFrame:
    """(src, sink, max_flow, source_side, cut_from, cut_to) of each pair, null where no walk leads.

    The edges of a pair follow each other in one task, which takes many pairs one after the other: a call of Python for
    each pair would take longer than the flow.
    """
    ab = pairs.select(F.col("src").alias("a"), F.col("sink").alias("b")).distinct()
    ways = between(g, ab).where("src <> dst").select("a", "b", "src", "dst", F.col("capacity" if use_capacity_field else "weight").alias("c"))
    parts = ways.repartition("a", "b").sortWithinPartitions("a", "b")
    schema = "src int, sink int, max_flow double, source_side array<int>, cut_from array<int>, cut_to array<int>"
    names = [x.split()[0] for x in schema.split(", ")]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("src", pa.int32()), ("sink", pa.int32()), ("max_flow", pa.float64()), *((x, pa.list_(pa.int32())) for x in names[3:])])
        own, cap, rows = None, {}, []

        def settle() -> None:
            ends = [(u, v) for u, out in cap.items() for v, c in out.items() if c > 0]
            value, side = _max_flow(cap, *own)
            across = [(u, v) for u, v in ends if u in side and v not in side]
            rows.append((*own, value, sorted(side), [u for u, _ in across], [v for _, v in across]))

        for batch in batches:
            for a, b, u, v, c in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if own != (a, b):
                    if own:
                        settle()
                    own, cap = (a, b), {}
                out = cap.setdefault(u, {})
                out[v] = out.get(v, 0.0) + (c or 0.0)
                cap.setdefault(v, {}).setdefault(u, 0.0)
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                rows.clear()
        if own:
            settle()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    found = parts.mapInArrow(solve, schema)
    return pairs.select("src", "sink").distinct().join(found, ["src", "sink"], "left")


dinic = edmonds_karp = max_flow  # the value and the least source side do not depend on how paths are chosen


def min_cut(g: PropertyGraph, flows: DataFrame) -> DataFrame:
    """(src, sink, node): the whole source side of max_flow() results, with nodes that lie on no walk to the sink.

    A node off all walks is on the source side if an edge leads to it from there: such edges carry no flow.
    """
    inside = cut(flows.select("src", "sink", F.explode("source_side").alias("node")))
    walks = between(g, flows.select(F.col("src").alias("a"), F.col("sink").alias("b"))).select(F.col("a").alias("src"), F.col("b").alias("sink"), F.explode(F.array("src", "dst")).alias("node")).distinct()
    out = inside
    frontier = inside
    edges = cut(g.edges.where(F.col("capacity") > EPSILON).select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct())
    walks = cut(walks)
    while True:
        step = frontier.join(edges, frontier["node"] == edges["u"]).select("src", "sink", F.col("v").alias("node")).distinct()
        frontier = cut(step.join(walks, ["src", "sink", "node"], "left_anti").join(out, ["src", "sink", "node"], "left_anti"))
        if frontier.isEmpty():
            return out
        out = cut(out.union(frontier))


def min_cut_edges(g: PropertyGraph, side: DataFrame) -> DataFrame:
    """(src, sink, u, v, adj_idx): all edges from the source side (src, sink, node) to the rest, parallel ones each."""
    e = g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "adj_idx")
    leave = side.join(e, side["node"] == e["u"]).select("src", "sink", "u", "v", "adj_idx")
    return leave.join(side.select("src", "sink", F.col("node").alias("v")), ["src", "sink", "v"], "left_anti").select("src", "sink", "u", "v", "adj_idx")


def cheapest_cut(g: PropertyGraph, pairs: DataFrame) -> DataFrame:
    """(src, sink, u, v, adj_idx, capacity): the edges with capacity that min_cut_edges() finds for min_cut() of max_flow().

    They lie on walks from src to sink, all of them: off these, an edge with capacity that leaves the source side leads to
    a node that belongs to it.  So the rest of the source side, which may be most of the graph for each pair, is not listed.
    """
    if not pairs.where("src = sink").isEmpty():
        raise ValueError("src and sink must differ")
    asked = _flows(g, pairs, cuts=True).join(pairs.select("src", "sink").distinct(), ["src", "sink"], "left_semi")
    across = stored(asked.where("max_flow > 0").select("src", "sink", F.explode("cut").alias("x")).select("src", "sink", "x.u", "x.v"))
    e = g.edges.where("capacity > 0").select(F.col("src").alias("u"), F.col("dst").alias("v"), "adj_idx", "capacity")
    return across.join(e, ["u", "v"]).select("src", "sink", "u", "v", "adj_idx", "capacity")


def compute_path_latency(g: PropertyGraph, paths: DataFrame) -> DataFrame:
    """(path_id, latency) of (path_id, path): the first node's latency, then the cheapest edge and the next node's.

    An empty path has latency 0; ValueError if two neighbours have no edge.
    """
    hops = path_edges(paths, "path_id")
    least = g.edges.groupBy(F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.min("weight").alias("w"))
    lat = g.nodes.select(F.col("id").alias("v"), F.col("base_latency_ms").alias("lat"))
    costs = hops.join(least, ["u", "v"], "left").join(lat, "v", "left")
    if not costs.where("w is null").isEmpty():
        raise ValueError("a path uses an edge that does not exist")
    tail = costs.groupBy("path_id").agg(F.sum(F.col("w") + F.col("lat")).alias("s"))
    first = paths.where(F.size("path") > 0).select("path_id", F.element_at("path", 1).alias("v")).join(lat, "v").select("path_id", F.col("lat").alias("f"))
    return paths.select("path_id").join(first, "path_id", "left").join(tail, "path_id", "left").select("path_id", (F.coalesce("f", F.lit(0.0)) + F.coalesce("s", F.lit(0.0))).alias("latency"))


def critical_path_latency(g: PropertyGraph, pairs: DataFrame) -> DataFrame:
    """(src, sink, path, latency): the longest way with node latencies; path empty and 0 if there is none.

    CycleError if a cycle lies on walks of a pair.  Among equal ways the predecessor first in topological order counts.
    """
    ab = pairs.select(F.col("src").alias("a"), F.col("sink").alias("b")).distinct()
    ways = cut(between(g, ab))
    joint = ways.select("src", "dst", "adj_idx", "weight").distinct()
    inner = joint.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    order = cut(peel(inner, joint).select("node", "pos"))
    if order.count() != inner.count():
        raise CycleError("a cycle lies between src and sink")
    lat = g.nodes.select(F.col("id").alias("node"), F.col("base_latency_ms").alias("lat"))
    steps = joint.join(lat, joint["dst"] == lat["node"]).groupBy("src", "dst").agg(F.max(F.col("weight") + F.col("lat")).alias("w"))
    start = ab.select(F.col("a").alias("seed")).distinct().join(lat, F.col("seed") == F.col("node")).select("seed", F.col("seed").alias("node"), F.col("lat").alias("value"))
    dist, _ = relax(start, steps, "max")
    a = dist.select("seed", F.col("node").alias("src"), F.col("value").alias("du")).join(order.withColumnRenamed("node", "src"), "src")
    tight = a.join(steps, "src").join(dist.withColumnRenamed("node", "dst"), ["seed", "dst"]).where("abs(du + w - value) <= 1e-9 and dst <> seed")
    prev = tight.groupBy("seed", F.col("dst").alias("node")).agg(F.min(F.struct("pos", "src"))["src"].alias("prev"))
    tree = dist.join(prev, ["seed", "node"], "left").select(F.col("seed").alias("src"), "node", "prev")
    path = path_to(tree).join(dist.select(F.col("seed").alias("src"), "node", "value"), ["src", "node"]).select("src", F.col("node").alias("sink"), "path", F.col("value").alias("latency"))
    out = pairs.select("src", "sink").distinct().join(path, ["src", "sink"], "left")
    return out.select("src", "sink", F.coalesce("path", F.array().cast("array<int>")).alias("path"), F.coalesce("latency", F.lit(0.0)).alias("latency"))


def p99_latency_estimate(g: PropertyGraph, pairs: DataFrame, seed: int = 42, samples: int = SAMPLES) -> DataFrame:
    """(src, sink, p99): the order statistic at 0.99 of sums of log-normal hops along the critical path; 0 without one.

    Draws come from a hash of sample and hop by Box-Muller, so they do not depend on partitions.
    """
    ways = cut(critical_path_latency(g, pairs))
    lat = g.nodes.select(F.col("id").alias("v"), F.col("base_latency_ms").alias("lat"))
    most = g.edges.groupBy(F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.max("weight").alias("w"))
    hops = path_edges(ways, "src", "sink").join(most, ["u", "v"]).join(lat, "v").select("src", "sink", (F.col("i") + 1).alias("hop"), (F.col("w") + F.col("lat")).alias("mean"))
    first = ways.where(F.size("path") > 0).join(lat, F.col("src") == F.col("v")).select("src", "sink", F.lit(0).alias("hop"), F.col("lat").alias("mean"))
    means = hops.union(first)
    sigma = F.sqrt(F.log(F.lit(1.0 + JITTER * JITTER)))
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "sample", "hop", "src", "sink"), F.lit(1 << 50)).cast("double") + 0.5) / F.lit(float(1 << 50))
    normal = F.sqrt(-2 * F.log(unit(1))) * F.cos(F.lit(6.283185307179586) * unit(2))
    drawn = means.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    total = drawn.groupBy("src", "sink", "sample").agg(F.sum(F.when(F.col("mean") > 0, F.exp(F.log("mean") - sigma * sigma / 2 + sigma * normal)).otherwise(0.0)).alias("t"))
    ordered = total.withColumn("r", F.row_number().over(Window.partitionBy("src", "sink").orderBy("t")) - 1)
    found = ordered.where(F.col("r") == int(0.99 * samples)).select("src", "sink", F.col("t").alias("p99"))
    return pairs.select("src", "sink").distinct().join(found, ["src", "sink"], "left").select("src", "sink", F.coalesce("p99", F.lit(0.0)).alias("p99"))
