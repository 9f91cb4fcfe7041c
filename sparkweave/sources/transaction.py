"""Write transactions: buffered changes over a version of the store, committed as the next one.

Changes are rows (the state of a node or edge after a step). The view inside a transaction lays them over the
version it started from, so a statement over a million matched nodes is one join, not a loop. At commit each entity's
steps become one net change: created and deleted again is nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import tagged_literal, tagged_row
from ..storage import cut
from .graph import EdgeTable, Graph, NodeTable
from .store import RECORD, STARTUP, STATE, Commit, Conflict, NotFound, Store, newest, numbered

STEPPED = T.StructType([*RECORD.fields, T.StructField("step", T.IntegerType())])


@dataclass
class WriteSummary:
    nodes_created: int = 0
    nodes_deleted: int = 0
    edges_created: int = 0
    edges_deleted: int = 0
    props_set: int = 0
    labels_changed: int = 0


def props_row(props: dict[str, Any] | None) -> dict[str, tuple]:
    return {k: tagged_row(v) for k, v in (props or {}).items()}


class Transaction:
    def __init__(self, store: Store, plane: str = STARTUP):
        self.store, self.spark = store, store.spark
        self.before: Commit = store.commit()
        if plane not in self.before.planes:
            raise NotFound(f"no plane {plane!r}")
        self.plane = self.before.planes[plane]["id"]
        self.next_id, self.types, self.step = self.before.next_id, list(self.before.types), 0
        self.steps: list[DataFrame] = []
        #: Whether all steps so far made new nodes and edges, each once.
        self.only_new = True
        #: Kind (None for both) and op of each step.
        self.done: list[tuple[str | None, str]] = []
        self.rows: list[tuple] = []
        self.keys: set[str] = set()
        self.summary = WriteSummary()

    # the view

    def flush(self) -> None:
        """Buffered single changes become one table."""
        if self.rows:
            self.steps.append(self.spark.createDataFrame(self.rows, STEPPED))
            self.done.append((None, "create"))
            self.rows = []

    def committed(self, kind: str) -> DataFrame:
        return self.store.records(kind, self.before.seq, self.plane)

    def current(self, kind: str) -> DataFrame:
        """Nodes or edges as this transaction sees them (RECORD)."""
        self.flush()
        every = self.committed(kind).withColumn("step", F.lit(0))
        if not self.steps:
            return every.drop("step")
        later = reduce(DataFrame.unionByName, (s.filter(F.col("kind") == kind) for s in self.steps))
        if self.only_new:
            return every.unionByName(later).drop("step")
        return newest(every, later, "step")

    def graph(self) -> Graph:
        nodes = self.current("node").select("id", "key", "labels", "props")
        edges = self.current("edge").select("id", "src", "dst", "type", "props")
        return Graph(self.spark, [NodeTable(nodes)], [EdgeTable(edges)], self.types)

    def _next(self) -> int:
        self.step += 1
        return self.step

    def add(self, df: DataFrame, op: str, written: bool = False, kind: str | None = None) -> DataFrame:
        """Changed records as a step, each once, written once (unless they are read off a written table as it is). `kind`
        says that they are all nodes or all edges."""
        self.flush()
        self.done.append((kind, op))
        self.only_new &= op == "create"
        out = df.withColumn("op", F.lit(op)).withColumn("step", F.lit(self._next())).select(*STEPPED.fieldNames())
        out = out if written else cut(out, "step")
        self.steps.append(out)
        return out

    # single entities

    def take_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def create_node(self, labels: Iterable[str] = (), props: dict[str, Any] | None = None, key: str | None = None) -> int:
        if key is not None:
            if key in self.keys or not self.current_key(key).isEmpty():
                raise Conflict(f"key {key!r} is taken")
            self.keys.add(key)
        node = self.take_id()
        self.rows.append(("node", node, self.plane, "create", key, list(dict.fromkeys(labels)), None, None, None, props_row(props), self._next()))
        self.summary.nodes_created += 1
        return node

    def current_key(self, key: str) -> DataFrame:
        return self.current("node").filter(F.col("key") == key)

    def find_key(self, key: str) -> int | None:
        row = self.current_key(key).select("id").first()
        return row["id"] if row else None

    def create_edge(self, src: int, dst: int, edge_type: str, props: dict[str, Any] | None = None) -> int:
        new = {r[1] for r in self.rows if r[0] == "node" and r[3] == "create"}
        rest = {src, dst} - new
        if rest and self.current("node").filter(F.col("id").isin(*rest)).count() < len(rest):
            raise NotFound(f"an end of the edge ({src}, {dst}) is not in this plane")
        edge = self.take_id()
        self.rows.append(("edge", edge, self.plane, "create", None, None, src, dst, edge_type, props_row(props), self._next()))
        self._types([edge_type])
        self.summary.edges_created += 1
        return edge

    def _types(self, names: Iterable[str]) -> None:
        self.types += [n for n in dict.fromkeys(names) if n not in self.types]

    def ids(self, ids: Iterable[int]) -> DataFrame:
        return self.spark.createDataFrame([(int(i),) for i in ids], "id long")

    def _one(self, kind: str, entity: int) -> DataFrame:
        found = self.ids([entity])
        if self.current(kind).filter(F.col("id") == entity).isEmpty():
            raise NotFound(f"no {kind} {entity}")
        return found

    def set_prop(self, node: int, name: str, value: Any) -> None:
        self.set_props(self._one("node", node), {name: value})

    def remove_prop(self, node: int, name: str) -> None:
        self.change(self._one("node", node), props=lambda p: F.map_filter(p, lambda k, _: k != name))

    def set_labels(self, node: int, labels: Iterable[str]) -> None:
        self.change(self._one("node", node), labels=lambda _: F.array(*map(F.lit, dict.fromkeys(labels))).cast("array<string>"))

    def set_edge_prop(self, edge: int, name: str, value: Any) -> None:
        self.set_props(self._one("edge", edge), {name: value}, "edge")

    def remove_edge_prop(self, edge: int, name: str) -> None:
        self.change(self._one("edge", edge), "edge", props=lambda p: F.map_filter(p, lambda k, _: k != name))

    def set_edge_type(self, edge: int, edge_type: str) -> None:
        self._types([edge_type])
        self.change(self._one("edge", edge), "edge", type=lambda _: F.lit(edge_type))

    def delete_node(self, node: int) -> None:
        """Delete a node with its edges; one that is not there is fine."""
        self.delete_nodes(self.ids([node]), True)

    def delete_edge(self, edge: int) -> None:
        gone = self.add(self.current("edge").join(F.broadcast(self.ids([edge])), "id", "left_semi"), "delete", kind="edge")
        self.summary.edges_deleted += gone.count()

    # sets of entities

    def change(self, ids: DataFrame, kind: str = "node", **how) -> DataFrame:
        """Update records of the ids: each keyword names a column and a function of it."""
        found = self.current(kind).join(ids.select("id").distinct(), "id", "left_semi")
        return self.add(found.withColumns({c: f(F.col(c)) for c, f in how.items()}), "update", kind=kind)

    def put(self, ids: DataFrame, values: dict[str, Any], labels: Iterable[str] = (), kind: str = "node") -> None:
        """Set properties and add labels, both in one step."""
        how: dict[str, Any] = {}
        if values:
            new = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), tagged_literal(v))))
            how["props"] = lambda p: F.map_concat(F.map_filter(F.coalesce(p, F.create_map().cast(RECORD["props"].dataType)), lambda k, _: ~k.isin(*values)), new)
        if labels:
            how["labels"] = lambda x: F.array_union(F.coalesce(x, F.array().cast("array<string>")), F.array(*map(F.lit, labels)))
        n = self.change(ids, kind, **how).count()
        self.summary.props_set += n * len(values)
        self.summary.labels_changed += n if labels else 0

    def set_props(self, ids: DataFrame, values: dict[str, Any], kind: str = "node") -> None:
        self.put(ids, values, kind=kind)

    def add_labels(self, ids: DataFrame, labels: Iterable[str]) -> None:
        self.put(ids, {}, list(labels))

    def remove_labels(self, ids: DataFrame, labels: Iterable[str]) -> None:
        done = self.change(ids, labels=lambda x: F.array_except(x, F.array(*map(F.lit, labels))))
        self.summary.labels_changed += done.count()

    def delete_nodes(self, ids: DataFrame, detach: bool, matched: int | None = None) -> None:
        """Delete nodes. Without detach, a node with edges in the committed version is refused."""
        ids = cut(ids.select("id").distinct(), "deleted")
        ends = lambda edges: edges.select("id", "src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("id").union(edges.select("id", "src", "dst").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("id")).distinct()
        if not detach and not ends(self.committed("edge")).isEmpty():
            raise Conflict("a node with relationships needs DETACH DELETE")
        edges = self.current("edge")
        self.summary.edges_deleted += self.add(edges.join(ends(edges), "id", "left_semi"), "delete", kind="edge").count()
        n = self.add(self.current("node").join(ids, "id", "left_semi"), "delete", kind="node").count()
        self.summary.nodes_deleted += n if matched is None else matched

    def bulk_load(self, nodes: DataFrame) -> DataFrame:
        """Nodes (key, labels, props) with contiguous new ids; returns key and id. Keys repeated in the batch are an
        error; keys that the plane has are not looked for."""
        rows, n = numbered(nodes.select("key", "labels", "props"), self.next_id)
        twice = rows.filter("key is not null").groupBy("key").count().filter("count > 1").limit(1).collect()
        if twice:
            raise Conflict(f"key {twice[0]['key']!r} occurs twice in the batch")
        self.next_id += n
        self.summary.nodes_created += n
        done = self.add(self._record(rows, "node"), "create", written=True, kind="node")
        return done.select("key", "id")

    def bulk_load_edges(self, edges: DataFrame) -> None:
        """Edges (src_key, dst_key, type, props) between nodes named by key; an unknown key is an error."""
        keys = self.current("node").filter("key is not null").select("key", "id")
        found = edges.select("src_key", "dst_key", "type", "props")
        for end in ("src", "dst"):
            found = found.join(keys.select(F.col("key").alias(f"{end}_key"), F.col("id").alias(end)), f"{end}_key", "left")
        rows, n = numbered(found, self.next_id)
        if not rows.filter("src is null or dst is null").isEmpty():
            raise NotFound("an edge's key is neither in the batch nor in the plane")
        self.next_id += n
        self._types(r["type"] for r in rows.groupBy("type").agg(F.min("src").alias("s")).orderBy("s", "type").collect())  # a row a type
        self.summary.edges_created += n
        self.add(self._record(rows, "edge"), "create", written=True, kind="edge")

    def _record(self, df: DataFrame, kind: str) -> DataFrame:
        have = set(df.columns)
        fixed = {"kind": F.lit(kind), "plane": F.lit(self.plane)}
        return df.select(*(fixed.get(f.name, F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD.fields))

    # commit

    def _apart(self) -> bool:
        """Whether no two steps can hold the same entity: then they are the net changes as they are."""
        ops = ([op for k, op in self.done if k in (None, kind)] for kind in ("node", "edge"))
        return all(len(x) < 2 or set(x) == {"create"} for x in ops)

    def net(self) -> DataFrame:
        """One change for each entity that differs from the version before."""
        self.flush()
        if not self.steps:
            return self.spark.createDataFrame([], RECORD)
        every = self.steps[0]
        for s in self.steps[1:]:
            every = every.unionByName(s)
        if self._apart():
            return every.select(*RECORD.fieldNames())
        ends = every.groupBy("kind", "id").agg(F.min_by("op", "step").alias("began"), F.max_by(F.struct("op", *STATE), F.col("step")).alias("r"))
        op = F.when(F.col("r.op") == "delete", "delete").when(F.col("began") == "create", "create").otherwise("update")
        return ends.filter("not (began = 'create' and r.op = 'delete')").select("kind", "id", op.alias("op"), *(f"r.{c}" for c in STATE)).select(*RECORD.fieldNames())

    def commit(self) -> Commit:
        part, changes = self.store.stage(self.net(), self.before)
        counters = self._counters(changes)
        return self.store.publish(None, self.before, {"next_id": self.next_id, "types": self.types, "counters": counters}, part)

    def _counters(self, changes: DataFrame) -> dict[str, dict]:
        """Totals of nodes and edges and of each label and type, of all planes, kept up by what changed."""
        names = F.when(F.col("kind") == "node", F.coalesce("labels", F.array().cast("array<string>"))).otherwise(F.array("type"))

        def tally(df: DataFrame, sign: int) -> DataFrame:
            return df.select("plane", "kind", F.explode(F.concat(F.array(F.lit("")), names)).alias("name"), F.lit(sign).alias("n"))

        each = tally(changes.filter("op <> 'delete'"), 1)
        if not self.only_new:
            old = self.committed("node").unionByName(self.committed("edge"))
            each = each.union(tally(old.join(changes.select("kind", "id"), ["kind", "id"], "left_semi"), -1))
        moved = each.groupBy("plane", "kind", "name").agg(F.sum("n").alias("n"))
        out = {k: dict(v) for k, v in self.before.counters.items()}
        for r in moved.collect():  # a row a label or type
            own = out.setdefault(str(r["plane"]), {})
            name = f"{r['kind']}:{r['name']}"
            own[name] = own.get(name, 0) + r["n"]
        return out


def counters(store: Store, plane: str = STARTUP, seq: int | None = None) -> dict[str, int]:
    """"node:" and "edge:" are totals, "node:<label>" and "edge:<type>" counts by name; zeros are left out."""
    c = store.commit(store.resolve(seq))
    return {k: v for k, v in c.counters.get(str(c.planes[plane]["id"]), {}).items() if v}


def summary_dict(s: WriteSummary) -> dict[str, int]:
    return asdict(s)
