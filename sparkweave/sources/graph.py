"""A property graph over DataFrames: tables of nodes and tables of edges.

A node table has fixed labels and typed columns (a Parquet table seen as nodes), or a labels column and a map of tagged
values (soft schema, as store.py keeps it). Reading nodes takes the labels and properties that a plan needs, so only
those tables and columns are scanned, and filters on a property reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import RANK, VALUE, Value, kind_of_type, native, tagged

#: Map of a soft table's properties.
PROPS = T.MapType(T.StringType(), VALUE)
SOFT_NODES = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("props", PROPS)])
SOFT_EDGES = T.StructType([T.StructField("id", T.LongType()), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("type", T.StringType()), T.StructField("props", PROPS)])


@dataclass
class NodeTable:
    """labels is None for a soft table, whose df has the columns of SOFT_NODES."""

    df: DataFrame
    labels: tuple[str, ...] | None = None
    id: Column | str = "id"
    key: Column | str | None = None
    props: dict[str, str] = field(default_factory=dict)

    def kind(self, name: str) -> tuple[str, str]:
        """Kind of a property; "null" if the table has none of that name."""
        if self.labels is None:
            return "any", ""
        return kind_of_type(self.df.schema[self.props[name]].dataType) if name in self.props else ("null", "")

    def column(self, name: str) -> Column:
        if self.labels is None:
            return F.col("props")[name]
        c = self.props[name]
        return native(F.col(c), self.df.schema[c].dataType)


@dataclass
class EdgeTable:
    """type is None for a soft table, whose df has the columns of SOFT_EDGES. src_labels and dst_labels, if known,
    spare a join when labels of the far node are asked for."""

    df: DataFrame
    type: str | None = None
    id: Column | str = "id"
    src: Column | str = "src"
    dst: Column | str = "dst"
    src_labels: tuple[str, ...] | None = None
    dst_labels: tuple[str, ...] | None = None
    props: dict[str, str] = field(default_factory=dict)

    def type_column(self) -> Column:
        return F.col("type") if self.type is None else F.lit(self.type)

    def strings(self, names: Iterable[str]) -> list[Column]:
        """The named properties where their values are strings, NULL where they are not."""
        if self.type is None:
            values = [F.col("props")[n] for n in names]
            return [F.when(v["t"] == RANK["str"], v["s"]) for v in values]
        return [F.col(self.props[n]) for n in names if n in self.props and self.df.schema[self.props[n]].dataType == T.StringType()]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prop_column(i: int) -> str:
    return f"__p{i}"


class Graph:
    """Node and edge tables of one plane, with the indexes declared on it.

    `type_order` ranks edge types as adjacency lists do: in the order in which types were first seen.
    """

    def __init__(self, spark: SparkSession, nodes: Iterable[NodeTable], edges: Iterable[EdgeTable], type_order: Iterable[str] | None = None):
        self.spark, self.node_tables, self.edge_tables = spark, list(nodes), list(edges)
        order = list(type_order) if type_order is not None else list(dict.fromkeys(t.type for t in self.edge_tables if t.type))
        self.type_order = {t: i for i, t in enumerate(order)}
        self.keyword_indexes: dict[tuple[str, str], object] = {}
        #: Approximate: a search by the index's own metric goes through it, any other scans.
        self.vector_indexes: dict[tuple[str, str], object] = {}

    # labels

    def known_labels(self) -> set[str] | None:
        """All labels if every table has fixed ones."""
        if any(t.labels is None for t in self.node_tables):
            return None
        return {x for t in self.node_tables for x in t.labels}

    def tables(self, labels: frozenset[str] | None) -> list[NodeTable]:
        """Tables that may hold nodes with one of the labels (any table if None)."""
        return [t for t in self.node_tables if labels is None or t.labels is None or set(t.labels) & labels]

    # nodes

    def property_kind(self, labels: frozenset[str] | None, name: str) -> tuple[str, str]:
        kinds = {t.kind(name) for t in self.tables(labels)} - {("null", "")}
        return kinds.pop() if len(kinds) == 1 else ("any", "") if kinds else ("null", "")

    def nodes(self, labels: frozenset[str] | None = None, props: Iterable[str] = (), key: bool = False, with_labels: bool = False) -> DataFrame:
        """id, and on demand __key, __labels and __p0, __p1, ... (the properties in order). With labels, only nodes
        that carry one of them."""
        props = list(props)
        kinds = [self.property_kind(labels, p) for p in props]
        parts = []
        for t in self.tables(labels):
            df = t.df
            if t.labels is None and labels is not None:
                df = df.filter(reduce(lambda a, b: a | b, (F.array_contains("labels", x) for x in sorted(labels))))
            out = [_col(t.id).cast("bigint").alias("id")]
            if key:
                out.append((F.lit(None) if t.labels is not None and t.key is None else _col(t.key if t.key is not None else "key")).cast("string").alias("__key"))
            if with_labels:
                out.append((F.col("labels") if t.labels is None else F.array(*map(F.lit, t.labels)).cast("array<string>")).alias("__labels"))
            for i, (p, (kind, _)) in enumerate(zip(props, kinds, strict=True)):
                own = t.kind(p)
                if own[0] == "null":
                    c = F.lit(None).cast(VALUE) if kind == "any" else F.lit(None)
                elif kind == "any":
                    c = tagged(Value(*own[:1], t.column(p), own[1]))
                else:
                    c = t.column(p)
                out.append(c.alias(prop_column(i)))
            parts.append(df.select(*out))
        if not parts:
            kind = T.StructType([T.StructField("id", T.LongType())])
            empty = self.spark.createDataFrame([], kind)
            more = [F.lit(None).cast("string").alias("__key")] * key + [F.lit(None).cast("array<string>").alias("__labels")] * with_labels
            return empty.select("id", *more, *(F.lit(None).cast("string").alias(prop_column(i)) for i in range(len(props))))
        return reduce(DataFrame.unionByName, parts)

    def values(self, labels: frozenset[str] | None, props: Iterable[str], prefix: str = "") -> dict[str, Value]:
        """Values over the columns that nodes() makes of the properties."""
        out = {}
        for i, p in enumerate(props):
            kind, items = self.property_kind(labels, p)
            out[p] = Value(kind, F.col(prefix + prop_column(i)), items)
        return out

    # edges

    def edges(self, edge_type: str | None = None, weight: str | None = None, far: str = "") -> DataFrame:
        """id, src, dst, type and its rank; with weight, that property as a number."""
        parts = []
        for t in self.edge_tables:
            if edge_type is not None and t.type not in (None, edge_type):
                continue
            df = t.df
            if t.type is None and edge_type is not None:
                df = df.filter(F.col("type") == edge_type)
            out = [_col(t.id).cast("bigint").alias("id"), _col(t.src).cast("bigint").alias("src"), _col(t.dst).cast("bigint").alias("dst"), (F.col("type") if t.type is None else F.lit(t.type)).alias("type")]
            if weight is not None:
                if t.type is None:
                    p = F.col("props")[weight]
                    w = F.coalesce(p["f"], p["i"].cast("double"))
                else:
                    kind = kind_of_type(df.schema[t.props[weight]].dataType)[0] if weight in t.props else "null"
                    w = F.col(t.props[weight]).cast("double") if kind in ("int", "float") else F.lit(None).cast("double")
                # missing or not a number: 1; negative or not finite: 0
                out.append(F.when(w.isNull(), 1.0).when((w >= 0) & (w < float("inf")) & ~F.isnan(w), w).otherwise(0.0).alias("weight"))
            parts.append(df.select(*out))
        if not parts:
            return self.spark.createDataFrame([], "id long, src long, dst long, type string" + (", weight double" if weight is not None else ""))
        return reduce(DataFrame.unionByName, parts)

    def type_rank(self, c: Column) -> Column:
        """Rank of an edge's type; types that were not declared follow in alphabetical order after all others."""
        if not self.type_order:
            return F.lit(0)
        return F.coalesce(F.create_map(*(F.lit(x) for kv in self.type_order.items() for x in kv))[c], F.lit(len(self.type_order)))

    def far_labels(self, near: frozenset[str] | None, direction: str, edge_type: str | None) -> frozenset[str] | None:
        """Labels that a neighbour may have, None if any."""
        out: set[str] = set()
        for t in self.edge_tables:
            if edge_type is not None and t.type not in (None, edge_type):
                continue
            for d, near_labels, far_labels in (("Out", t.src_labels, t.dst_labels), ("In", t.dst_labels, t.src_labels)):
                if direction not in (d, "Both"):
                    continue
                if near is not None and near_labels is not None and not near & set(near_labels):
                    continue
                if far_labels is None:
                    return None
                out |= set(far_labels)
        return frozenset(out)

    def adjacency(self, direction: str, edge_type: str | None, near: frozenset[str] | None = None) -> DataFrame:
        """near, far, edge, dir (0 out, 1 in), type: a row for each end of an edge in the direction. A self-loop has
        two rows under Both. Edge tables that no node with a label of `near` can be an end of are not read."""
        parts = []
        for d, (a, b) in enumerate((("src", "dst"), ("dst", "src"))):
            if direction not in (("Out", "In")[d], "Both"):
                continue
            tables = [t for t in self.edge_tables if near is None or (t.src_labels, t.dst_labels)[d] is None or near & set((t.src_labels, t.dst_labels)[d])]
            e = Graph(self.spark, (), tables).edges(edge_type)
            parts.append(e.select(F.col(a).alias("near"), F.col(b).alias("far"), F.col("id").alias("edge"), F.lit(d).alias("dir"), "type"))
        return reduce(DataFrame.unionByName, parts)

    def declare_keyword_index(self, label: str, prop: str, index: object) -> None:
        held = self.keyword_indexes.get((label, prop))
        if held is not None and getattr(held, "language", None) != getattr(index, "language", None):
            raise ValueError(f"a keyword index on ({label}, {prop}) has another language")
        self.keyword_indexes[label, prop] = index


def soft_graph(spark: SparkSession, nodes: DataFrame, edges: DataFrame, type_order: Iterable[str] | None = None) -> Graph:
    """A graph of soft tables (columns of SOFT_NODES and SOFT_EDGES)."""
    return Graph(spark, [NodeTable(nodes)], [EdgeTable(edges)], type_order or ())
