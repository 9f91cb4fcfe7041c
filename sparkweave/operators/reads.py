"""Read operators above the plan: finding, seeding, expanding, tracing and describing nodes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import Value, as_text, untag
from ..plans import model as M
from ..sources.graph import Graph
from ..storage import cut
from . import algorithms
from .lowering import Query, vector_top_k

# Caps and the edge types that carry an impact.
FIND_LIMIT = 50
NEIGHBOURS = 100
LISTED = 100
SECTION_CAP = 20
CONTEXT_CHARS = 24_000
VALUE_BYTES = 500
IMPACT_TYPES = ("CALLS", "REFERENCES", "INSTANTIATES", "IMPORTS", "EXTENDS", "IMPLEMENTS")
IMPACT_DEPTH = 6


def induced(graph: Graph, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids (id)."""
    edges = graph.edges()
    for end in ("src", "dst"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return edges.select("id", "src", "dst", "type")


def query_subgraph(query: Query) -> tuple[DataFrame, DataFrame]:
    """Rows of a query, and the edges among its distinct nodes."""
    rows = cut(query.rows(), "rows")
    return rows, induced(query.graph, rows.select("id").distinct())


def neighbours(graph: Graph, node: int, direction: str = "Both", edge_type: str | None = None) -> DataFrame:
    """id, edge, type and dir of a node's neighbours."""
    return graph.adjacency(direction, edge_type).filter(F.col("near") == node).select(F.col("far").alias("id"), "edge", "type", "dir")


def expand(graph: Graph, node: int, limit: int = NEIGHBOURS) -> tuple[DataFrame, int]:
    """Up to `limit` neighbours in the order of adjacency, and how many there are."""
    found = cut(neighbours(graph, node), "neighbours")
    return found.orderBy("dir", graph.type_rank(F.col("type")), "type", "id", "edge").limit(limit), found.count()


def traverse(graph: Graph, ids: Iterable[int], direction: str = "Out", edge_type: str | None = None, low: int = 1, high: int = 1) -> DataFrame:
    """Distinct nodes within low..high hops."""
    return Query(graph).seek_ids(ids).expand_var(direction, edge_type, low, high).distinct().rows().select("id", "hops")


def seed(graph: Graph, how: str = "degree", n: int = 50, labels: frozenset[str] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The first n nodes by id, degree or PageRank; the edges among them; the number of nodes."""
    if how == "first":
        top = graph.nodes(labels).select("id", F.lit(0.0).alias("value")).orderBy("id").limit(n)
    elif how == "degree":
        top = algorithms.degrees(graph, labels).select("id", F.col("degree").cast("double").alias("value")).orderBy(F.desc("value"), "id").limit(n)
    elif how == "pagerank":
        top = algorithms.pagerank(graph, labels).select("id", F.col("rank").alias("value")).orderBy(F.desc("value"), "id").limit(n)
    else:
        raise ValueError("seed by first, degree or pagerank")
    top = cut(top, "seed")
    return top, induced(graph, top), graph.nodes(labels).count()


def texts(graph: Graph, labels: frozenset[str] | None, props: list[str]) -> DataFrame:
    """id, __key, __labels and the string form of properties, NULL where a value is no string."""
    values = graph.values(labels, props)
    nodes = graph.nodes(labels, props, True, True)
    own = [(v.col if v.kind == "str" else F.when(v.col["t"] == 4, v.col["s"]) if v.kind == "any" else F.lit(None).cast("string")).alias(p) for p, v in values.items()]
    return nodes.select("id", "__key", "__labels", *own)


def find_nodes(graph: Graph, text: str, props: list[str], limit: int = FIND_LIMIT) -> DataFrame:
    """id, field and match of nodes that hold the text in any case: in the key, else a label, else the first of the
    string properties."""
    want = text.lower()
    has = lambda c: F.lower(c).contains(want)
    rows = texts(graph, None, props)
    label = F.get(F.filter("__labels", has), F.lit(0))
    hits = [F.when(has(F.col("__key")), F.struct(F.lit("key").alias("field"), F.col("__key").alias("match"))), F.when(label.isNotNull(), F.struct(F.lit("label").alias("field"), label.alias("match")))]
    hits += [F.when(has(F.col(f"`{p}`")), F.struct(F.lit(p).alias("field"), F.col(f"`{p}`").alias("match"))) for p in props]
    return rows.select("id", F.coalesce(*hits).alias("h")).filter("h is not null").select("id", "h.field", "h.match").orderBy("id").limit(limit)


def find_edges(graph: Graph, text: str, props: Iterable[str] = (), limit: int = FIND_LIMIT) -> DataFrame:
    """Edges whose type, or one of the string properties, holds the text in any case. The first ones by id are
    kept of each table, then of all."""
    want = text.lower()
    parts = []
    for t in graph.edge_tables:
        has = F.lower(t.type_column()).contains(want)
        for c in t.strings(props):
            has = has | F.coalesce(F.lower(c).contains(want), F.lit(False))
        parts.append(Graph(graph.spark, (), [replace(t, df=t.df.filter(has))]).edges().select("id", "src", "dst", "type").orderBy("id").limit(limit))
    if not parts:
        return graph.edges().select("id", "src", "dst", "type")
    return reduce(DataFrame.unionByName, parts).orderBy("id").limit(limit)


def resolve_symbol(graph: Graph, name: str) -> tuple[int | None, list[str]]:
    """A node by its exact key, else by the only key that ends in ::name or .name, else by the only key that holds the
    name in any case. Several: none, and the candidates."""
    keys = graph.nodes(key=True).select("id", F.col("__key").alias("key")).filter("key is not null")
    rank = F.when(F.col("key") == name, 0).when(F.col("key").endswith("::" + name) | F.col("key").endswith("." + name), 1).when(F.lower("key").contains(name.lower()), 2)
    hits = keys.withColumn("rank", rank).filter("rank is not null").orderBy("rank", "key").limit(2 * LISTED).collect()
    for r in range(3):
        found = [h for h in hits if h["rank"] == r]
        if len(found) == 1 or found and r == 0:
            return found[0]["id"], [found[0]["key"]]
        if found:
            return None, [h["key"] for h in found]
    return None, []


def levels(graph: Graph, start: int, direction: str, types: Iterable[str] | None, depth: int) -> list[DataFrame]:
    """New nodes (id, parent) of each breadth-first level."""
    types = list(types) if types is not None else None
    around = graph.adjacency(direction, types[0] if types is not None and len(types) == 1 else None)
    if types is not None:
        around = around.filter(F.col("type").isin(types))
    seen = cut(graph.spark.createDataFrame([(start,)], "id long"), "seen")
    frontier, out = seen, []
    for _ in range(depth):
        new = frontier.select(F.col("id").alias("near")).join(around.select("near", "far"), "near").groupBy(F.col("far").alias("id")).agg(F.min("near").alias("parent"))
        new = cut(new.join(seen, "id", "left_anti"), "level")
        if new.isEmpty():
            break
        out.append(new)
        frontier = new
        seen = seen.union(new.select("id"))
    return out


def impact(graph: Graph, start: int, depth: int = 3) -> list[tuple[int, DataFrame]]:
    """For each level of what depends on a node, the exact count and the nodes."""
    found = levels(graph, start, "In", IMPACT_TYPES, max(1, min(IMPACT_DEPTH, depth)))
    return [(x.count(), x.select("id")) for x in found]


def trace(graph: Graph, start: int, goal: int, edge_type: str = "CALLS") -> tuple[list[int], bool]:
    """The shortest path of calls from start to goal, or else from goal to start (the flag tells)."""
    tables = [t for t in graph.edge_tables if t.type in (None, edge_type)]
    tables = [replace(t, df=t.df.filter(F.col("type") == edge_type)) if t.type is None else t for t in tables]
    only = Graph(graph.spark, graph.node_tables, tables)
    for reverse, (a, b) in enumerate(((start, goal), (goal, start))):
        path = algorithms.shortest_path(only, None, M.ShortestPath(M.Id(a), M.Id(b))).orderBy("pos").collect()
        if path:
            return [r["id"] for r in path], bool(reverse)
    return [], False


def context(graph: Graph, node: int, cap: int = SECTION_CAP, chars: int = CONTEXT_CHARS) -> str:
    """A node's edges as text: a section a direction and type, each with at most `cap` names and its full count; the
    cap is halved until the text fits."""
    near = cut(neighbours(graph, node), "neighbours")
    counts = {(r["dir"], r["type"]): r["n"] for r in near.groupBy("dir", "type").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = near.withColumn("at", F.row_number().over(Window.partitionBy("dir", "type").orderBy("id", "edge"))).filter(F.col("at") <= cap)
    named = first.join(graph.nodes(key=True), "id").select("dir", "type", "at", F.coalesce("__key", F.col("id").cast("string")).alias("name")).collect()
    while True:
        lines = []
        for d, kind in sorted(counts):
            lines.append(f"{'in' if d else 'out'} {kind} ({counts[d, kind]})")
            lines += [f"  {r['name']}" for r in sorted(named, key=lambda r: r["at"]) if (r["dir"], r["type"]) == (d, kind) and r["at"] <= cap]
        text = "\n".join(lines)
        if len(text) <= chars or cap <= 1:
            return text
        cap //= 2


def describe(graph: Graph, node: int, props: list[str]) -> list[str]:
    """Lines of a node's properties; names that begin with _ are hidden but for _generated_by, values are cut at 500
    bytes."""
    shown = [p for p in props if not p.startswith("_") or p == "_generated_by"]
    values = graph.values(None, shown)
    row = graph.nodes(None, shown).filter(F.col("id") == node).select(*(F.coalesce(as_text(v), _json(v)).alias(p) for p, v in values.items())).first()
    if row is None:
        return []
    out = []
    for p in shown:
        if row[p] is not None:
            raw = row[p].encode()
            out.append(f"{p}: {raw[:VALUE_BYTES].decode(errors='ignore')}{'…' if len(raw) > VALUE_BYTES else ''}")
    return out


def _json(v: Value) -> Column:
    return v.col["j"] if v.kind == "any" else F.lit(None).cast("string")


def search(graph: Graph, query, k: int = 10, prop: str = "embedding") -> tuple[DataFrame, DataFrame | None]:
    """The nearest nodes of any label by cosine, and the neighbours of the best."""
    hits = cut(vector_top_k(graph, None, prop, query, "Cosine", k), "hits")
    best = hits.orderBy("distance", "id").first()
    return hits, expand(graph, best["id"])[0] if best else None


def grep(spark, path: str, text: str, cap: int = 50, line_chars: int = 300) -> DataFrame:
    """file, line and text of lines that hold the text, in files of up to 2 MiB without a zero byte; at most 200."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= 2 * 1024 * 1024)
    body = F.col("content").cast("string")
    lines = files.filter(F.locate("\x00", body) == 0).select("path", F.posexplode(F.split(body, "\n")).alias("at", "line"))
    hits = lines.filter(F.col("line").contains(text)).select(F.col("path").alias("file"), (F.col("at") + 1).alias("line"), F.substr("line", F.lit(1), F.lit(line_chars)).alias("text"))
    return hits.orderBy("file", "line").limit(min(cap, 200))


def grouped(rows: DataFrame, group: str, limit: int = LISTED) -> tuple[DataFrame, int]:
    """Up to `limit` rows of an algorithm's groups, and the exact number of groups."""
    rows = cut(rows, "groups")
    return rows.orderBy(group, "id").limit(limit), rows.select(group).distinct().count()


def records(graph: Graph, ids: DataFrame, props: list[str]) -> list[dict]:
    """Nodes as Python records, for a bounded list of ids."""
    nodes = graph.nodes(None, props, True, True).join(ids.select("id").distinct(), "id", "left_semi")
    out = []
    for r in nodes.collect():
        own = {p: untag(r[f"__p{i}"]) if graph.property_kind(None, p)[0] == "any" else r[f"__p{i}"] for i, p in enumerate(props)}
        out.append({"id": r["id"], "key": r["__key"], "labels": r["__labels"], "props": {k: v for k, v in own.items() if v is not None}})
    return sorted(out, key=lambda r: r["id"])


def union_subgraphs(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of several subgraphs, each once."""
    return tuple(reduce(DataFrame.union, [p[i] for p in parts]).distinct() for i in (0, 1))


def snippet(graph: Graph, node: int, root: str | None = None, around: int = 20) -> str | None:
    """A node's stored `source`, else the lines of its `file` from its `line` on, from the files under `root`."""
    values = graph.values(None, ["source", "file", "line"])
    row = graph.nodes(None, ["source", "file", "line"]).filter(F.col("id") == node).select(*(as_text(v).alias(p) for p, v in values.items())).first()
    if row is None or row["source"] is not None:
        return row and row["source"]
    if root is None or row["file"] is None:
        return None
    at = int(row["line"] or 1)
    lines = graph.spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{row['file']}").select(F.split(F.col("content").cast("string"), "\n").alias("l"))
    found = lines.select(F.array_join(F.slice("l", F.lit(max(1, at)), F.lit(around)), "\n").alias("s")).first()
    return found["s"] if found else None
