"""Write statements on a store: find the nodes, then change them as sets, in one transaction."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import VALUE, tagged_literal
from ..plans import language as L
from ..sources.graph import PROPS
from ..sources.store import STARTUP, Store, numbered
from ..sources.transaction import Transaction, WriteSummary
from ..storage import cut
from .lowering import Query


def apply(store: Store, statement: L.WriteStatement, plane: str = STARTUP) -> WriteSummary:
    """Run a write statement and commit it."""
    tx = Transaction(store, plane)
    if statement.find is None:
        named: dict[str, int] = {}
        for op in statement.ops:
            if isinstance(op, L.Create):
                for path in op.paths:
                    _create(tx, path, named)
            else:
                _merge(tx, op, named)
    else:
        # matched once, against the version before the statement
        matched = cut(Query(store.graph(plane, tx.before.seq), statement.find).rows().select("id"), "matched")
        for op in statement.ops:
            _mutate(tx, op, matched, statement.var)
    tx.commit()
    return tx.summary


def _create(tx: Transaction, path: L.CreatePath, named: dict[str, int]) -> None:
    ids = []
    for n in path.nodes:
        if n.var is not None and n.var in named:
            ids.append(named[n.var])
            continue
        ids.append(tx.create_node([n.label] if n.label else [], n.own, n.key))
        if n.var is not None:
            named[n.var] = ids[-1]
    for e, a, b in zip(path.edges, ids, ids[1:], strict=False):
        tx.create_edge(*((a, b) if e.forward else (b, a)), e.type, dict(e.props))


def _merge(tx: Transaction, op: L.Merge, named: dict[str, int]) -> None:
    ids = [_upsert(tx, n, op, named) for n in op.path.nodes]
    for e, a, b in zip(op.path.edges, ids, ids[1:], strict=False):
        src, dst = (a, b) if e.forward else (b, a)
        # an edge is looked for in the committed version only
        there = tx.committed("edge").filter((F.col("src") == src) & (F.col("dst") == dst) & (F.col("type") == e.type))
        if there.isEmpty():
            tx.create_edge(src, dst, e.type, dict(e.props))


def _upsert(tx: Transaction, n: L.NodePattern, op: L.Merge, named: dict[str, int]) -> int:
    if n.var is not None and n.var in named:
        return named[n.var]
    found = tx.find_key(n.key)
    if found is None:
        node = tx.create_node([n.label] if n.label else [], n.own, n.key)
        items = op.on_create
    else:
        node, items = found, op.on_match
    if n.var is not None:
        named[n.var] = node
        _set(tx, tx.ids([node]), [i for i in items if i.var == n.var])
    return node


def _set(tx: Transaction, ids: DataFrame, items: list[L.SetItem]) -> None:
    values: dict[str, Any] = {}
    labels = []
    for i in items:
        if i.label is not None:
            labels.append(i.label)
        elif i.prop is not None:
            values[i.prop] = i.value
        else:
            values |= dict(i.more)
    if values or labels:
        tx.put(ids, values, labels)


def _mutate(tx: Transaction, op: Any, matched: DataFrame, var: str | None) -> None:
    match op:
        case L.SetProps(items):
            _set(tx, matched, list(items))
        case L.Remove(items):
            props = [i.prop for i in items if i.prop is not None]
            labels = [i.label for i in items if i.label is not None]
            if props:
                tx.change(matched, props=lambda p: F.map_filter(p, lambda k, _: ~k.isin(props)))
            if labels:
                tx.remove_labels(matched, labels)
        case L.Delete(_, detach):
            tx.delete_nodes(matched, detach, matched.count())
        case L.Create(paths):
            for path in paths:
                _create_each(tx, path, matched, var)
        case L.Merge():
            _merge_each(tx, op, matched, var)


def _create_each(tx: Transaction, path: L.CreatePath, matched: DataFrame, var: str | None) -> None:
    """The path once for each matched row; its node named `var` is the matched one."""
    rows, n = numbered(matched.withColumnRenamed("id", "bound"), 0, "at")
    if not n:
        return
    rows = cut(rows, "rows")
    ids, places, new = [], {}, []
    for node in path.nodes:
        if node.var is not None and node.var == var:
            ids.append(F.col("bound"))
            continue
        if node.var is None or node.var not in places:
            if node.key is not None and n > 1:
                raise ValueError(f"key {node.key!r} would be created {n} times")
            places[node.var or object()] = len(new)
            new.append(node)
            ids.append(F.lit(tx.next_id + (len(new) - 1) * n) + F.col("at"))
        else:
            ids.append(F.lit(tx.next_id + places[node.var] * n) + F.col("at"))
    tx.next_id += len(new) * n
    for i, node in enumerate(new):
        made = rows.select((F.lit(tx.next_id - (len(new) - i) * n) + F.col("at")).alias("id"), F.lit(node.key).alias("key"), (F.array(F.lit(node.label)) if node.label else F.array().cast("array<string>")).alias("labels"), _props(node.own).alias("props"))
        tx.add(tx._record(made, "node"), "create")
        tx.summary.nodes_created += n
    for e, a, b in zip(path.edges, ids, ids[1:], strict=False):
        src, dst = (a, b) if e.forward else (b, a)
        made = rows.select((F.lit(tx.next_id) + F.col("at")).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(e.type).alias("type"), _props(dict(e.props)).alias("props"))
        tx.next_id += n
        tx._types([e.type])
        tx.add(tx._record(made, "edge"), "create")
        tx.summary.edges_created += n


def _props(values: dict[str, Any]):
    if not values:
        return F.lit(None).cast(PROPS)
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), tagged_literal(v).cast(VALUE))))


def _merge_each(tx: Transaction, op: L.Merge, matched: DataFrame, var: str | None) -> None:
    """Keyed nodes are shared by all matched rows; each row gets the edges that the committed version lacks."""
    named: dict[str, int] = {}
    ids = [None if n.var is not None and n.var == var else _upsert(tx, n, op, named) for n in op.path.nodes]
    rows = matched.select(F.col("id").alias("bound")).distinct()
    _set(tx, matched, [i for i in op.on_match if i.var == var])
    for e, a, b in zip(op.path.edges, ids, ids[1:], strict=False):
        a, b = (F.col("bound") if x is None else F.lit(x).cast("bigint") for x in (a, b))
        src, dst = (a, b) if e.forward else (b, a)
        wanted = rows.select(src.alias("src"), dst.alias("dst")).distinct()
        there = tx.committed("edge").filter(F.col("type") == e.type).select("src", "dst")
        new, n = numbered(wanted.join(there, ["src", "dst"], "left_anti").select("src", "dst", F.lit(e.type).alias("type"), _props(dict(e.props)).alias("props")), tx.next_id)
        tx.next_id += n
        tx._types([e.type])
        tx.summary.edges_created += n
        tx.add(tx._record(new, "edge"), "create")
