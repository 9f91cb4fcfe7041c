"""A session over a store: statements, plans and the named methods of the read and write surface.

A version's graph, and the keyword indexes declared on it, are made once and kept for as long as the session reads that
version; a commit makes a new version, so nothing has to be invalidated. The index of a later version is made from an
earlier one's and what the commits between them changed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import algorithms, catalog, hybrid, keyword, reads, vectors, writes
from .operators.lowering import Query, vector_top_k, vectors_of
from .plans import language as L
from .plans import model as M
from .plans.values import Vector
from .sources.graph import PROPS, Graph
from .sources.store import STARTUP, Conflict, Store
from .sources.transaction import Transaction, WriteSummary, counters, props_row
from .storage import cut

#: Graphs of versions that a session keeps.
KEPT = 8
BULK_NODES = T.StructType([T.StructField("key", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("props", PROPS)])
BULK_EDGES = T.StructType([*(T.StructField(c, T.StringType()) for c in ("src_key", "dst_key", "type")), T.StructField("props", PROPS)])


class Session:
    def __init__(self, store: Store, plane: str = STARTUP, embed: Callable[[str], Any] | None = None):
        self.store, self.plane, self.embed = store, plane, embed
        self.graphs: dict[int, Graph] = {}
        self.indexes: dict[tuple[str, str, str], tuple[int, Any]] = {}

    # reading

    def graph(self, seq: int | None = None, ms: int | None = None) -> Graph:
        seq = self.store.resolve(seq, ms)
        if seq not in self.graphs:
            while len(self.graphs) >= KEPT:
                self.graphs.pop(next(iter(self.graphs)))
            self.graphs[seq] = self.store.graph(self.plane, seq)
        return self.graphs[seq]

    def query(self, plan: M.LogicalPlan | str | dict, as_of: L.AsOf | None = None) -> Query:
        """A query of a plan, with the keyword indexes that it reads."""
        plan = plan if isinstance(plan, M.LogicalPlan) else M.LogicalPlan.from_json(plan)
        g = self.graph(as_of.seq if as_of else None, as_of.ms if as_of else None)
        match plan.source:
            case M.KeywordTopK(label, prop):
                self._index(g, "keyword", label, prop)
            case M.VectorTopK(label, prop) if label is not None:
                self._index(g, "vector", label, prop)
            case M.Hybrid(label, _, keyword_part) if keyword_part is not None and label is not None:
                self._index(g, "keyword", label, keyword_part.property)
        return Query(g, plan)

    def _declared(self, kind: str, label: str, prop: str) -> dict | None:
        return next((i for i in self.store.commit().indexes if (i["plane"], i["kind"], i["label"], i["property"]) == (self.plane, kind, label, prop)), None)

    def _index(self, g: Graph, kind: str, label: str, prop: str) -> None:
        """Make the index of a version's graph, if it is declared: from the one that the session has of an earlier version
        and the nodes that commits have changed since, else from all nodes."""
        own = g.keyword_indexes if kind == "keyword" else g.vector_indexes
        declared = self._declared(kind, label, prop)
        if declared is None or (label, prop) in own:
            return
        seq = next(s for s, x in self.graphs.items() if x is g)
        had, index = self.indexes.get((kind, label, prop), (None, None))
        rows = keyword.texts_of(g, label, prop) if kind == "keyword" else vectors_of(g, label, prop)
        module = keyword if kind == "keyword" else vectors
        if had is not None and had <= seq and had >= self.store.history()[0]:
            changed = self.store.changes(list(range(had + 1, seq + 1))).filter((F.col("kind") == "node") & (F.col("plane") == self.store.commit(seq).planes[self.plane]["id"])).select("id").distinct()
            index = module.upsert(index, cut(changed.join(rows, "id", "left"), "changed"))
        elif kind == "keyword":
            index = keyword.build(rows, declared["language"])
        else:
            index = vectors.build(rows, declared["lists"], declared["metric"])
        own[label, prop] = index
        self.indexes[kind, label, prop] = (seq, index)

    def run(self, text: str, params: dict[str, Any] | None = None) -> DataFrame | WriteSummary:
        """A statement: rows (id, key, labels, hops, score) of a read in its order, or the counts of a write."""
        statement = L.parse(text, params, self.embed)
        if isinstance(statement, L.WriteStatement):
            return writes.apply(self.store, statement, self.plane)
        return self.query(statement.plan, statement.as_of).nodes(ordered=True)

    def declare_keyword_index(self, label: str, prop: str, language: str = "english") -> None:
        """Declare an index for all later versions; another language for the same pair is an error."""
        language = keyword.language(language)
        self._declare("keyword", label, prop, language=language)

    def declare_vector_index(self, label: str, prop: str, metric: str = "Cosine", lists: int = 64) -> None:
        """Declare an approximate index: a search of the label by this metric goes through it from then on."""
        self._declare("vector", label, prop, metric=metric, lists=lists)

    def _declare(self, kind: str, label: str, prop: str, **how: Any) -> None:
        held, c = self._declared(kind, label, prop), self.store.commit()
        if held is not None:
            if any(held[k] != v for k, v in how.items()):
                raise Conflict(f"a {kind} index on ({label}, {prop}) was declared in another way")
            return
        self.store.publish(None, c, {"indexes": [*c.indexes, {"plane": self.plane, "kind": kind, "label": label, "property": prop, **how}]})

    # named methods

    def call(self, method: str, **params: Any) -> Any:
        """A method by its name. Lists are bounded by their method's limit; DataFrames are lazy."""
        found = METHODS.get(method)
        if found is None:
            raise KeyError(f"no method {method!r}")
        return found(self, **params)


def _subgraph(s: Session, text: str, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
    statement = L.parse(text, params, s.embed)
    if isinstance(statement, L.WriteStatement):
        raise L.CompileProblem("a write has no rows")
    return reads.query_subgraph(s.query(statement.plan, statement.as_of))


def _search(s: Session, query, k: int = 10, label: str | None = None, prop: str = "embedding", metric: str = "Cosine") -> DataFrame:
    return vector_top_k(s.graph(), frozenset([label]) if label else None, prop, Vector(query), metric, k)


def _algo(s: Session, name: str, label: str | None = None, limit: int = reads.LISTED, **args: Any) -> dict[str, Any]:
    """The first rows of an algorithm and exact totals."""
    algo = L.algorithm(name, args)
    rows, order = algorithms.rows(s.graph(), frozenset([label]) if label else None, algo)
    rows = cut(rows, "rows")
    keys = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c) for c in order]
    out = {"rows": [(r["id"], r["value"]) for r in rows.orderBy(*keys).limit(limit).collect()], "total": rows.count()}
    if isinstance(algo, (M.ConnectedComponents, M.Louvain)):
        out["groups"] = rows.select("value").distinct().count()
    return out


def _write_nodes(s: Session, nodes: list[dict], edges: list[dict] = (), embed: Callable[[str], Any] | None = None) -> dict[str, int]:
    """Nodes (key, labels, props) and edges (src, dst, type, props; ends by key). A node without an embedding gets one
    of its text, if an embedder is given."""
    tx, rows = Transaction(s.store, s.plane), []
    keys = [n["key"] for n in nodes if n.get("key") is not None]
    taken = tx.current("node").filter(F.col("key").isin(keys)).select("key").first() if keys else None
    if taken:
        raise Conflict(f"key {taken['key']!r} is taken")
    for n in nodes:
        props = dict(n.get("props") or {})
        if embed is not None and "embedding" not in props:
            props["embedding"] = Vector(embed("\n".join([n.get("key") or "", *(f"{k}: {v}" for k, v in sorted(props.items()) if not k.startswith("_"))])))
        rows.append((n.get("key"), list(dict.fromkeys(n.get("labels") or [])), props_row(props)))
    if rows:
        tx.bulk_load(s.store.spark.createDataFrame(rows, BULK_NODES))
    if edges:
        tx.bulk_load_edges(s.store.spark.createDataFrame([(e["src"], e["dst"], e["type"], props_row(e.get("props"))) for e in edges], BULK_EDGES))
    tx.commit()
    return asdict(tx.summary)


def _stats(s: Session) -> dict[str, Any]:
    c = s.store.commit()
    own = counters(s.store, s.plane)
    return {"planes": sorted(c.planes), "seq": c.seq, "nodes": own.get("node:", 0), "edges": own.get("edge:", 0), "indexes": len(c.indexes), "counters": own}


METHODS: dict[str, Callable[..., Any]] = {
    "db.stats": _stats,
    "plane.query": lambda s, plan: s.query(plan).nodes(ordered=True),
    "plane.cypher": lambda s, text, params=None: s.run(text, params),
    "plane.subgraph": _subgraph,
    "plane.search": _search,
    "plane.hybrid": lambda s, spec: hybrid.run(s.query(M.LogicalPlan(spec)).graph, spec),
    "plane.algo": _algo,
    "plane.catalog": lambda s: {"labels": catalog.labels(s.graph()), "properties": catalog.properties(s.graph()), "connections": catalog.connections(s.graph())},
    "plane.summary": lambda s: catalog.summary(s.graph()),
    "plane.neighbors": lambda s, id, dir="Both", edge_type=None: reads.neighbours(s.graph(), id, dir, edge_type),
    "plane.find": lambda s, text, props=(), limit=reads.FIND_LIMIT: {"nodes": reads.find_nodes(s.graph(), text, list(props), limit), "edges": reads.find_edges(s.graph(), text, list(props), limit)},
    "plane.indexes": lambda s: [i for i in s.store.commit().indexes if i["plane"] == s.plane],
    "graph.seed": lambda s, how="degree", n=50, label=None: reads.seed(s.graph(), how, n, frozenset([label]) if label else None),
    "graph.expand": lambda s, id, limit=reads.NEIGHBOURS: reads.expand(s.graph(), id, limit),
    "graph.traverse": lambda s, ids, dir="Out", edge_type=None, low=1, high=1: reads.traverse(s.graph(), ids, dir, edge_type, low, high),
    "symbol.resolve": lambda s, name: reads.resolve_symbol(s.graph(), name),
    "symbol.context": lambda s, id: reads.context(s.graph(), id),
    "symbol.trace": lambda s, src, dst: reads.trace(s.graph(), src, dst),
    "symbol.impact": lambda s, id, depth=3: reads.impact(s.graph(), id, depth),
    "symbol.describe": lambda s, id, props: reads.describe(s.graph(), id, props),
    "write.nodes": _write_nodes,
}
