"""The star-schema tables as a typed property graph.

Ids are a label's offset plus the table's own key; keys are 'customer:1' and the like.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .graph import EdgeTable, Graph, NodeTable

OFFSET = 10**12
#: label: (table, key column, place of its ids)
LABELS = {
    "Region": ("region", "r_regionkey", 1),
    "Nation": ("nation", "n_nationkey", 2),
    "Customer": ("customer", "c_custkey", 3),
    "Supplier": ("supplier", "s_suppkey", 4),
    "Part": ("part", "p_partkey", 5),
    "Order": ("orders", "o_orderkey", 6),
    "Doc": ("documents", "doc_id", 7),
    "Item": ("embeddings", "vec_id", 8),
}


def node_id(label: str, column: str):
    return F.lit(LABELS[label][2] * OFFSET) + F.col(column).cast("bigint")


def load(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] = tuple(LABELS)) -> Graph:
    """The graph of the tables under sf_dir; edges have ids by table and row key."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nodes = []
    for label in labels:
        table, key, _ = LABELS[label]
        df = read(table)
        props = {c: c for c in df.columns}
        nodes.append(NodeTable(df, (label,), node_id(label, key), F.concat(F.lit(f"{label.lower()}:"), F.col(key).cast("string")), props))
    edges = []

    def edge(kind: str, table: str, src: tuple[str, str], dst: tuple[str, str], number, **props: str):
        if src[0] in labels and dst[0] in labels:
            edges.append(EdgeTable(read(table), kind, number, node_id(*src), node_id(*dst), (src[0],), (dst[0],), props))

    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    edge("IN_REGION", "nation", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), node_id("Nation", "n_nationkey"))
    edge("IN_NATION", "customer", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), node_id("Customer", "c_custkey"))
    edge("IN_NATION", "supplier", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), node_id("Supplier", "s_suppkey"))
    edge("PLACED", "orders", ("Customer", "o_custkey"), ("Order", "o_orderkey"), node_id("Order", "o_orderkey"), price="o_totalprice")
    edge("CONTAINS", "lineitem", ("Order", "l_orderkey"), ("Part", "l_partkey"), F.lit(9 * OFFSET) + line, quantity="l_quantity", extendedprice="l_extendedprice", linenumber="l_linenumber")
    edge("SUPPLIED_BY", "lineitem", ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), F.lit(10 * OFFSET) + line, quantity="l_quantity")
    return Graph(spark, nodes, edges)
