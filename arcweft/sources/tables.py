"""Graphs from tables: parquet in and out, and graphs over the star-schema tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from arcweft.model import PropertyGraph, from_rows
from arcweft.plans.loops import cut

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

LAYER_NODES = """
SELECT CAST(r_regionkey AS INT) AS id, r_name AS name, 'GATEWAY' AS type, CAST(60 + r_regionkey % 40 AS DOUBLE) / 100 AS health, CAST(1 + r_regionkey % 5 AS DOUBLE) AS base_latency_ms, r_regionkey % 2 = 0 AS has_fallback FROM region
UNION ALL
SELECT CAST(5 + n_nationkey AS INT), n_name, 'INTERNAL', CAST(60 + n_nationkey % 40 AS DOUBLE) / 100, CAST(1 + n_nationkey % 9 AS DOUBLE), n_nationkey % 3 = 0 FROM nation
UNION ALL
SELECT CAST(30 + s_suppkey AS INT), s_name, 'EXTERNAL', CAST(60 + s_suppkey % 40 AS DOUBLE) / 100, CAST(1 + s_suppkey % 13 AS DOUBLE), s_suppkey % 5 = 0 FROM supplier
UNION ALL
SELECT CAST(30 + (SELECT count(*) FROM supplier) + p_partkey AS INT), p_name, 'DATABASE', CAST(60 + p_partkey % 40 AS DOUBLE) / 100, CAST(1 + p_size % 20 AS DOUBLE), FALSE FROM part
"""
LAYER_EDGES = """
SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS INT) AS adj_idx, weight, capacity, is_fallback FROM (
  SELECT CAST(n_regionkey AS INT) AS src, CAST(5 + n_nationkey AS INT) AS dst, CAST(1 + n_nationkey % 7 AS DOUBLE) AS weight, CAST(1000 + 100 * n_nationkey AS DOUBLE) AS capacity, FALSE AS is_fallback FROM nation
  UNION ALL
  SELECT CAST(5 + s_nationkey AS INT), CAST(30 + s_suppkey AS INT), CAST(1 + s_suppkey % 7 AS DOUBLE), CAST(500 + s_suppkey AS DOUBLE), s_suppkey % 5 = 0 FROM supplier
  UNION ALL
  SELECT CAST(30 + l_suppkey AS INT), CAST(30 + (SELECT count(*) FROM supplier) + l_partkey AS INT), CAST(1 + (l_suppkey + l_partkey) % 9 AS DOUBLE), sum(l_quantity), max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 FROM lineitem GROUP BY l_suppkey, l_partkey
) t
"""
NATION_NODES = """
SELECT CAST(n_nationkey AS INT) AS id, n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'INTERNAL' WHEN 1 THEN 'EXTERNAL' WHEN 2 THEN 'GATEWAY' ELSE 'DATABASE' END AS type, CAST(70 + n_nationkey AS DOUBLE) / 100 AS health, CAST(1 + n_nationkey % 9 AS DOUBLE) AS base_latency_ms, n_nationkey % 3 = 0 AS has_fallback FROM nation
"""


def _nation_edges(condition: str, most: int, whole: bool = False) -> str:
    """Links to the largest partners, of which the last is a fallback; or to all, with fallbacks from that rank on."""
    fallback, limit = (f"rk >= {most}", "") if whole else (f"rk = {most}", f" WHERE rk <= {most}")
    return f"""
SELECT src, dst, CAST(rk - 1 AS INT) AS adj_idx, CAST(1 + (src * 7 + dst * 3) % 11 AS DOUBLE) AS weight, vol AS capacity, {fallback} AS is_fallback FROM (
  SELECT src, dst, vol, row_number() OVER (PARTITION BY src ORDER BY vol DESC, dst) AS rk FROM (
    SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity) AS vol
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE c_nationkey {condition} s_nationkey GROUP BY c_nationkey, s_nationkey) v) r{limit}
"""


TRADE_EDGES = _nation_edges("<>", 2)
DAG_EDGES = _nation_edges("<", 3)
MARKET_NODES = NATION_NODES + """
UNION ALL
SELECT CAST(25 + s_suppkey AS INT), s_name, 'EXTERNAL', CAST(60 + s_suppkey % 40 AS DOUBLE) / 100, CAST(1 + s_suppkey % 13 AS DOUBLE), s_suppkey % 5 = 0 FROM supplier
"""
MARKET_EDGES = f"""
SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS INT) AS adj_idx, weight, capacity, is_fallback FROM (
  SELECT src, dst, weight, capacity, is_fallback FROM ({_nation_edges("<>", 2, whole=True)}) w
  UNION ALL
  SELECT CAST(s_nationkey AS INT), CAST(25 + s_suppkey AS INT), CAST(1 + s_suppkey % 7 AS DOUBLE), CAST(500 + s_suppkey AS DOUBLE), s_suppkey % 5 = 0 FROM supplier
) t
"""
#: name -> (nodes, edges): a layered DAG, a cyclic graph and a DAG of the links between nations (whole), and the cyclic one
#: with each nation's suppliers.  Trade and dag are those between nations with the two or three largest partners of each.
GRAPHS = {
    "layer": (LAYER_NODES, LAYER_EDGES),
    "trade": (NATION_NODES, TRADE_EDGES),
    "dag": (NATION_NODES, DAG_EDGES),
    "whole_trade": (NATION_NODES, _nation_edges("<>", 2, whole=True)),
    "whole_dag": (NATION_NODES, _nation_edges("<", 3, whole=True)),
    "market": (MARKET_NODES, MARKET_EDGES),
}


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the tables of a folder, which take no names in the session."""
    used = {t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)}
    named = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", sql)
    return spark.sql(named, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def graph(spark: SparkSession, sf_dir: str, name: str) -> PropertyGraph:
    """One of GRAPHS.  The few edges between nations are written once: loops would join the fact tables in each round."""
    nodes, edges = GRAPHS[name]
    e = query(spark, sf_dir, edges)
    return PropertyGraph.of(query(spark, sf_dir, nodes), e if name == "layer" else cut(e))


def read_graph(spark: SparkSession, nodes_path: str, edges_path: str, kind: str = "parquet") -> PropertyGraph:
    """A graph from two files or folders of any kind that Spark reads."""
    options = {"header": True, "inferSchema": True} if kind == "csv" else {}
    return PropertyGraph.of(spark.read.format(kind).options(**options).load(nodes_path), spark.read.format(kind).options(**options).load(edges_path))


def write_graph(g: PropertyGraph, nodes_path: str, edges_path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Write both tables; edges sorted by source within files, so that reads of one source skip most row groups."""
    options = {"header": True} if kind == "csv" else {}
    g.nodes.write.format(kind).options(**options).mode(mode).save(nodes_path)
    g.edges.repartitionByRange("src").sortWithinPartitions("src", "adj_idx").write.format(kind).options(**options).mode(mode).save(edges_path)


# The example graph of a payment platform.
#: id, name, type, health, base latency, whether it has a fallback.
DEMO_NODES = [
    (0, "API_GATEWAY", "GATEWAY", 0.99, 2.0, False),
    (1, "AUTH_SERVICE", "INTERNAL", 0.98, 5.0, False),
    (2, "USER_DB", "DATABASE", 0.97, 8.0, False),
    (3, "PAYMENT_SERVICE", "INTERNAL", 0.95, 12.0, True),
    (4, "PAYMENT_DB", "DATABASE", 0.96, 10.0, False),
    (5, "FRAUD_DETECTOR", "INTERNAL", 0.9, 20.0, False),
    (6, "NOTIFICATION_SERVICE", "INTERNAL", 0.92, 4.0, False),
    (7, "EMAIL_GATEWAY", "EXTERNAL", 0.85, 15.0, True),
    (8, "SMS_GATEWAY", "EXTERNAL", 0.8, 18.0, True),
    (9, "INVENTORY_SERVICE", "INTERNAL", 0.94, 6.0, False),
    (10, "INVENTORY_DB", "DATABASE", 0.96, 9.0, False),
    (11, "ORDER_SERVICE", "INTERNAL", 0.97, 7.0, False),
    (12, "ORDER_DB", "DATABASE", 0.98, 8.0, False),
    (13, "AUDIT_SERVICE", "INTERNAL", 0.99, 3.0, False),
    (14, "PAYMENT_GATEWAY_SECONDARY", "EXTERNAL", 0.88, 25.0, True),
]
#: src, dst, weight, capacity, whether it is a fallback.
DEMO_EDGES = [
    (0, 1, 3.0, 5000.0, False),
    (0, 11, 5.0, 3000.0, False),
    (0, 13, 1.0, 10000.0, False),
    (1, 2, 4.0, 2000.0, False),
    (1, 3, 6.0, 1500.0, False),
    (1, 9, 5.0, 2500.0, False),
    (3, 4, 8.0, 1000.0, False),
    (3, 5, 10.0, 800.0, False),
    (3, 6, 3.0, 1200.0, False),
    (3, 13, 2.0, 5000.0, False),
    (3, 14, 15.0, 500.0, True),
    (14, 4, 12.0, 500.0, True),
    (5, 13, 2.0, 3000.0, False),
    (6, 7, 5.0, 2000.0, False),
    (6, 8, 8.0, 1500.0, False),
    (7, 8, 3.0, 500.0, True),
    (9, 10, 6.0, 2000.0, False),
    (9, 11, 4.0, 1500.0, False),
    (11, 12, 5.0, 1500.0, False),
    (11, 3, 7.0, 800.0, False),
    (11, 13, 2.0, 4000.0, False),
    (11, 6, 3.0, 1000.0, False),
]


def demo(spark: SparkSession) -> PropertyGraph:
    """The example graph: 15 nodes, 22 edges."""
    return from_rows(spark, DEMO_NODES, DEMO_EDGES)
