"""The catalogue that a graph's data describes: labels, properties with the kinds seen, edge types with what they join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import RANK
from ..sources.graph import Graph

NAMES = {k.capitalize(): r for k, r in RANK.items()}


def labels(graph: Graph) -> DataFrame:
    """label and count; a node counts for each of its labels."""
    return graph.nodes(with_labels=True).select(F.explode("__labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def properties(graph: Graph) -> DataFrame:
    """label, property, kind, count, described: how often each kind of value is seen under a label. Nulls that are
    stored count as kind Null; a property that a node lacks does not count. Columns of typed tables are read once, in one aggregate a table."""
    parts = []
    for t in graph.node_tables:
        if t.labels is None:
            rows = t.df.select(F.explode("labels").alias("label"), F.explode(F.map_entries("props")).alias("e"))
            kind = F.element_at(F.create_map(*(F.lit(x) for k, r in NAMES.items() for x in (r, k))), F.coalesce(F.col("e.value.t"), F.lit(0)).cast("int"))
            rows = rows.select("label", F.col("e.key").alias("property"), kind.alias("kind"), F.col("e.value.d").alias("d"))
            parts.append(rows.groupBy("label", "property", "kind").agg(F.count(F.lit(1)).alias("count"), F.count("d").alias("described")))
            continue
        # one pass: a count a column, then a row a column
        counts = t.df.agg(*(F.count(c).alias(f"c{i}") for i, c in enumerate(t.props.values())))
        rows = F.array(*(F.struct(F.lit(p).alias("property"), F.lit(t.kind(p)[0].capitalize()).alias("kind"), F.col(f"c{i}").alias("count")) for i, p in enumerate(t.props)))
        for label in t.labels:
            out = counts.select(F.explode(rows).alias("r")).select(F.lit(label).alias("label"), "r.property", "r.kind", "r.count", F.lit(0).cast("bigint").alias("described"))
            parts.append(out.filter("count > 0"))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("label", "property", "kind").agg(F.sum("count").alias("count"), F.sum("described").alias("described"))


def connections(graph: Graph) -> DataFrame:
    """type, src_label, dst_label, count: every combination of the labels of an edge's ends. Tables whose ends have
    known single labels need no join."""
    parts, open_tables = [], []
    for t in graph.edge_tables:
        if t.type is not None and t.src_labels and t.dst_labels and len(t.src_labels) == len(t.dst_labels) == 1:
            parts.append(Graph(graph.spark, (), [t]).edges().groupBy("type").agg(F.count(F.lit(1)).alias("count")).select("type", F.lit(t.src_labels[0]).alias("src_label"), F.lit(t.dst_labels[0]).alias("dst_label"), "count"))
        else:
            open_tables.append(t)
    if open_tables:
        # two narrow joins by id; AQE deals with a node that holds many edges
        ends = graph.nodes(with_labels=True)
        e = Graph(graph.spark, (), open_tables).edges().select("type", "src", "dst")
        e = e.join(ends.select(F.col("id").alias("src"), F.col("__labels").alias("a")), "src").join(ends.select(F.col("id").alias("dst"), F.col("__labels").alias("b")), "dst")
        e = e.select("type", F.explode("a").alias("src_label"), "b").select("type", "src_label", F.explode("b").alias("dst_label"))
        parts.append(e.groupBy("type", "src_label", "dst_label").agg(F.count(F.lit(1)).alias("count")))
    if not parts:
        return graph.spark.createDataFrame([], "type string, src_label string, dst_label string, count long")
    return reduce(DataFrame.unionByName, parts).groupBy("type", "src_label", "dst_label").agg(F.sum("count").alias("count"))


def edge_types(graph: Graph) -> DataFrame:
    """type and count."""
    return graph.edges().groupBy("type").agg(F.count(F.lit(1)).alias("count"))


def merge(parts: list[DataFrame]) -> DataFrame:
    """One catalogue of several planes: counts of equal rows are added."""
    every = reduce(DataFrame.unionByName, parts)
    names = [c for c in every.columns if c not in ("count", "described")]
    return every.groupBy(*names).agg(*(F.sum(c).alias(c) for c in ("count", "described") if c in every.columns))


def counts(graph: Graph) -> tuple[int, int]:
    """Nodes and edges."""
    return graph.nodes().count(), graph.edges().count()


def summary(graph: Graph, hidden: str = "_") -> str:
    """Labels with the leading kind of each property, and edge types with what they join; names that begin with
    `hidden` are left out. The catalogue has a row a label, property and kind, so it fits the driver."""
    lines = []
    kinds: dict[str, dict[str, tuple[int, str]]] = {}
    for r in properties(graph).collect():
        if not r["property"].startswith(hidden):
            own = kinds.setdefault(r["label"], {})
            own[r["property"]] = max(own.get(r["property"], (0, "")), (r["count"], r["kind"]))
    for r in sorted(labels(graph).collect(), key=lambda r: r["label"]):
        props = ", ".join(f"{p}: {k}" for p, (_, k) in sorted(kinds.get(r["label"], {}).items()))
        lines.append(f"(:{r['label']}) x{r['count']} {{{props}}}")
    for r in sorted(connections(graph).collect(), key=lambda r: (r["type"], r["src_label"], r["dst_label"])):
        lines.append(f"(:{r['src_label']})-[:{r['type']}]->(:{r['dst_label']}) x{r['count']}")
    return "\n".join(lines)
