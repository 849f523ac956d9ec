"""A property graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = "id int, name string, type string, health double, base_latency_ms double, has_fallback boolean"
EDGES = "src int, dst int, adj_idx int, weight double, capacity double, is_fallback boolean"
#: Kinds of node, in order of their numbers.
TYPES = ("INTERNAL", "EXTERNAL", "GATEWAY", "DATABASE")
DEFAULTS = {"type": "INTERNAL", "health": 1.0, "base_latency_ms": 5.0, "has_fallback": False, "weight": 1.0, "capacity": 1000.0, "is_fallback": False}


@dataclass(frozen=True)
class PropertyGraph:
    """nodes: id (dense from 0), name, type, health, base_latency_ms, has_fallback.
    edges: src, dst, adj_idx (place among the source's edges), weight, capacity, is_fallback.  A multigraph."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        """Fill in defaults, give edges their place where it is missing, and fix types."""
        names = lambda schema: [x.split()[0] for x in schema.split(", ")]
        for what, needed, have in (("nodes", ("id", "name"), nodes.columns), ("edges", ("src", "dst"), edges.columns)):
            if missing := [c for c in needed if c not in have]:
                raise ValueError(f"{what} lack {missing}")
        nodes = nodes.withColumns({c: F.lit(DEFAULTS[c]) for c in names(NODES) if c not in nodes.columns})
        edges = edges.withColumns({c: F.lit(DEFAULTS[c]) for c in names(EDGES) if c not in edges.columns and c != "adj_idx"})
        if "adj_idx" not in edges.columns:
            order = Window.partitionBy("src").orderBy("dst", "weight", "capacity", "is_fallback")
            edges = edges.withColumn("adj_idx", F.row_number().over(order) - 1)
        cast = lambda df, schema: df.select(*[F.col(n).cast(t).alias(n) for n, t in (x.split() for x in schema.split(", "))])
        return PropertyGraph(cast(nodes, NODES), cast(edges, EDGES))

    @staticmethod
    def densify(nodes: DataFrame, edges: DataFrame, key: str) -> PropertyGraph:
        """A graph from tables that name nodes by a natural key: ids follow the order of the keys.

        The numbering counts over ranges of the sorted keys, so no task sorts them all.
        """
        sorted_keys = nodes.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("__m", F.monotonically_increasing_id())
        from arcweft.plans.loops import cut

        keyed = cut(sorted_keys.withColumn("__p", F.shiftright("__m", 33)))
        sizes = keyed.groupBy("__p").agg(F.count("*").alias("k"))
        offsets = sizes.withColumn("b", F.coalesce(F.sum("k").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        ids = keyed.join(offsets, "__p").select(key, (F.col("b") + F.col("__m").bitwiseAND((1 << 33) - 1)).cast("int").alias("__id"))
        n = nodes.join(ids, key).withColumn("id", F.col("__id")).drop("__id", key)
        e = edges.join(ids.select(F.col(key).alias("src"), F.col("__id").alias("__s")), "src").join(ids.select(F.col(key).alias("dst"), F.col("__id").alias("__d")), "dst")
        return PropertyGraph.of(n, e.withColumn("src", F.col("__s")).withColumn("dst", F.col("__d")).drop("__s", "__d"))

    def validate(self) -> PropertyGraph:
        """Raise ValueError unless ids are dense, types known and edges end at nodes."""
        n, most, distinct, odd = self.nodes.agg(F.count("*"), F.max("id"), F.count_distinct("id"), F.count_if(~F.col("type").isin(*TYPES))).first()
        if n and (most != n - 1 or distinct != n or self.nodes.where("id < 0").limit(1).count()):
            raise ValueError("node ids must be 0..N-1")
        if odd:
            raise ValueError("unknown node type")
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        if not ends.join(self.nodes, "id", "left_anti").isEmpty():
            raise ValueError("an edge ends outside the graph")
        return self

    def require(self, *ids: int) -> None:
        """Raise ValueError for ids that are not nodes."""
        wanted = set(ids)
        if wanted and self.nodes.where(F.col("id").isin(*wanted)).select("id").distinct().count() != len(wanted):
            raise ValueError(f"not all nodes exist: {sorted(wanted)}")

    def add_nodes(self, more: DataFrame) -> PropertyGraph:
        """Append nodes; their ids must go on from the greatest."""
        return PropertyGraph.of(self.nodes.unionByName(PropertyGraph.of(more, self.edges).nodes), self.edges)

    def add_edges(self, more: DataFrame) -> PropertyGraph:
        """Append edges behind those that their sources have; several of one source in the order of adj_idx or dst."""
        new = PropertyGraph.of(self.nodes, more).edges
        have = self.edges.groupBy("src").agg((F.max("adj_idx") + 1).alias("k"))
        new = new.join(have, "src", "left").withColumn("adj_idx", F.col("adj_idx") + F.coalesce("k", F.lit(0))).drop("k")
        return PropertyGraph.of(self.nodes, self.edges.unionByName(new))

    def counts(self) -> DataFrame:
        """(num_nodes, num_edges)."""
        both = self.nodes.agg(F.count("*").alias("n"), F.lit(0).alias("e")).union(self.edges.agg(F.lit(0), F.count("*")))
        return both.agg(F.sum("n").alias("num_nodes"), F.sum("e").alias("num_edges"))

    def num_nodes(self) -> int:
        return self.nodes.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def get_node(self, node: int) -> DataFrame:
        self.require(node)
        return self.nodes.where(F.col("id") == node)

    def neighbors(self, node: int) -> DataFrame:
        self.require(node)
        return self.edges.where(F.col("src") == node).orderBy("adj_idx")

    def all_edges(self) -> DataFrame:
        return self.edges.orderBy("src", "adj_idx")

    def reverse(self) -> PropertyGraph:
        """All edges turned; a node's new edges are in the order of the old scan."""
        place = F.row_number().over(Window.partitionBy("dst").orderBy("src", "adj_idx")) - 1
        e = self.edges.withColumn("__p", place)
        return PropertyGraph(self.nodes, e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("__p").cast("int").alias("adj_idx"), "weight", "capacity", "is_fallback"))

    def to_undirected(self) -> PropertyGraph:
        """Each edge both ways: a loop twice.  Places follow the old scan, an edge before its turned copy."""
        e = self.edges
        a = e.select("src", "dst", F.col("src").alias("__s"), F.col("adj_idx").alias("__i"), F.lit(0).alias("__t"), "weight", "capacity", "is_fallback")
        b = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("src").alias("__s"), F.col("adj_idx").alias("__i"), F.lit(1).alias("__t"), "weight", "capacity", "is_fallback")
        place = F.row_number().over(Window.partitionBy("src").orderBy("__s", "__i", "__t")) - 1
        return PropertyGraph(self.nodes, a.union(b).withColumn("adj_idx", place.cast("int")).select("src", "dst", "adj_idx", "weight", "capacity", "is_fallback"))


def from_rows(spark: SparkSession, nodes: list[tuple], edges: list[tuple]) -> PropertyGraph:
    """A small graph from node tuples (id, name, type, health, latency, fallback) and edges (src, dst, weight, capacity, fallback) in order."""
    seen: dict[int, int] = {}
    rows = []
    for s, d, *rest in edges:
        w, c, f = (*rest, *(1.0, 1000.0, False)[len(rest) :])
        rows.append((s, d, seen.get(s, 0), float(w), float(c), f))
        seen[s] = seen.get(s, 0) + 1
    filled = [(n[0], *n[1:], *(None, "INTERNAL", 1.0, 5.0, False)[len(n) - 1 :]) for n in nodes]
    filled = [(n[0], n[1] or f"n{n[0]}", n[2], float(n[3]), float(n[4]), n[5]) for n in filled]
    return PropertyGraph(spark.createDataFrame(filled, NODES), spark.createDataFrame(rows, EDGES))
