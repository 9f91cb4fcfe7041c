"""The logical plan: one source and a list of steps, with expressions over a row's current node.

Plans are data. The wire form tags each variant from outside ({"ScanLabel": "Person"}, "Distinct") and a plan read
from its own JSON is equal to itself.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any

from .values import Vector, from_plan, to_plan

DIRECTIONS = ("Out", "In", "Both")
METRICS = ("Cosine", "Dot", "L2")
COMPARISONS = ("Eq", "Ne", "Lt", "Le", "Gt", "Ge")


class Node:
    """Base of the tagged variants. `_inner`: its one field stands for the whole; `_unit`: it has none."""

    def to_data(self) -> Any:
        name, parts = type(self).__name__, fields(self)
        if not parts:
            return name
        values = {f.name.rstrip("_"): _out(getattr(self, f.name)) for f in parts}
        return {name: next(iter(values.values())) if getattr(self, "_inner", False) else values}


def _out(x: Any) -> Any:
    if isinstance(x, Node):
        return x.to_data()
    if isinstance(x, Record):
        return {f.name: _out(getattr(x, f.name)) for f in fields(x)}
    if isinstance(x, (list, tuple)):
        return [_out(v) for v in x]
    return x


class Record:
    """Base of untagged groups of fields."""


# Expressions ---------------------------------------------------------------------------------------------------


class Expr(Node):
    def _cmp(self, op: str, other: Any) -> Compare:
        return Compare(op, self, as_expr(other))

    def eq(self, other):
        return self._cmp("Eq", other)

    def ne(self, other):
        return self._cmp("Ne", other)

    def lt(self, other):
        return self._cmp("Lt", other)

    def le(self, other):
        return self._cmp("Le", other)

    def gt(self, other):
        return self._cmp("Gt", other)

    def ge(self, other):
        return self._cmp("Ge", other)

    def __and__(self, other):
        return Logic("And", self, other)

    def __or__(self, other):
        return Logic("Or", self, other)

    def __invert__(self):
        return Not(self)

    def _arith(self, op: str, other: Any) -> Arith:
        return Arith(op, self, as_expr(other))

    def __add__(self, other):
        return self._arith("Add", other)

    def __sub__(self, other):
        return self._arith("Sub", other)

    def __mul__(self, other):
        return self._arith("Mul", other)

    def __truediv__(self, other):
        return self._arith("Div", other)

    def is_null(self):
        return IsNull(self)

    def contains(self, other):
        return StringMatch("Contains", self, as_expr(other))

    def starts_with(self, other):
        return StringMatch("StartsWith", self, as_expr(other))

    def ends_with(self, other):
        return StringMatch("EndsWith", self, as_expr(other))

    def is_in(self, other):
        return In(self, as_expr(other))


@dataclass(frozen=True)
class Property(Expr):
    name: str
    _inner = True


@dataclass(frozen=True)
class Literal(Expr):
    value: Any
    _inner = True

    def to_data(self):
        return {"Literal": to_plan(self.value)}


@dataclass(frozen=True)
class HasLabel(Expr):
    label: str
    _inner = True


@dataclass(frozen=True)
class ExternalKey(Expr):
    pass


@dataclass(frozen=True)
class Score(Expr):
    pass


@dataclass(frozen=True)
class Hops(Expr):
    pass


@dataclass(frozen=True)
class Distance(Expr):
    property: str
    query: Vector
    metric: str = "Cosine"


@dataclass(frozen=True)
class Similarity(Expr):
    property: str
    query: Vector
    metric: str = "Cosine"


@dataclass(frozen=True)
class IsNull(Expr):
    inner: Expr
    _inner = True


@dataclass(frozen=True)
class Not(Expr):
    inner: Expr
    _inner = True


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    lhs: Expr
    rhs: Expr


@dataclass(frozen=True)
class Logic(Expr):
    op: str
    lhs: Expr
    rhs: Expr


@dataclass(frozen=True)
class Arith(Expr):
    op: str
    lhs: Expr
    rhs: Expr


@dataclass(frozen=True)
class StringMatch(Expr):
    op: str
    lhs: Expr
    rhs: Expr


@dataclass(frozen=True)
class In(Expr):
    needle: Expr
    haystack: Expr


def as_expr(x: Any) -> Expr:
    return x if isinstance(x, Expr) else Literal(x)


def walk(e: Expr):
    yield e
    for f in fields(e):
        x = getattr(e, f.name)
        if isinstance(x, Expr):
            yield from walk(x)


# Sources -------------------------------------------------------------------------------------------------------


class Source(Node):
    pass


@dataclass(frozen=True)
class ScanAll(Source):
    pass


@dataclass(frozen=True)
class ScanLabel(Source):
    label: str
    _inner = True


@dataclass(frozen=True)
class SeekIds(Source):
    ids: tuple[int, ...]
    _inner = True


@dataclass(frozen=True)
class SeekKeys(Source):
    keys: tuple[str, ...]
    _inner = True


@dataclass(frozen=True)
class VectorTopK(Source):
    label: str | None
    property: str
    query: Vector
    metric: str = "Cosine"
    k: int = 10


@dataclass(frozen=True)
class KeywordTopK(Source):
    label: str
    property: str
    query: str
    k: int = 10


@dataclass(frozen=True)
class VectorChannel(Record):
    property: str
    query: Vector
    metric: str = "Cosine"


@dataclass(frozen=True)
class KeywordChannel(Record):
    property: str
    query: str


@dataclass(frozen=True)
class GraphChannel(Record):
    hops: int
    decay: float = 0.5
    seeds: int = 10


@dataclass(frozen=True)
class Weights(Record):
    vector: float = 1.0
    keyword: float = 1.0
    graph: float = 0.5


@dataclass(frozen=True)
class Hybrid(Source):
    label: str | None = None
    vector: VectorChannel | None = None
    keyword: KeywordChannel | None = None
    graph: GraphChannel | None = None
    weights: Weights = field(default_factory=Weights)
    candidates: int = 100
    k: int = 10


class Algorithm(Node):
    pass


@dataclass(frozen=True)
class PageRank(Algorithm):
    damping: float = 0.85
    max_iters: int = 20
    tolerance: float = 1e-6


@dataclass(frozen=True)
class ConnectedComponents(Algorithm):
    pass


@dataclass(frozen=True)
class Louvain(Algorithm):
    max_levels: int = 10
    min_gain: float = 1e-9


class NodeRef(Node):
    pass


@dataclass(frozen=True)
class Id(NodeRef):
    id: int
    _inner = True


@dataclass(frozen=True)
class Key(NodeRef):
    key: str
    _inner = True


@dataclass(frozen=True)
class ShortestPath(Algorithm):
    from_: NodeRef
    to: NodeRef
    dir: str = "Out"
    weight: str | None = None


@dataclass(frozen=True)
class Algo(Source):
    label: str | None
    algo: Algorithm


# Steps ---------------------------------------------------------------------------------------------------------


class Step(Node):
    pass


@dataclass(frozen=True)
class Expand(Step):
    dir: str = "Out"
    edge_type: str | None = None


@dataclass(frozen=True)
class ExpandVar(Step):
    dir: str
    edge_type: str | None
    min: int
    max: int


@dataclass(frozen=True)
class Filter(Step):
    expr: Expr
    _inner = True


@dataclass(frozen=True)
class Skip(Step):
    n: int
    _inner = True


@dataclass(frozen=True)
class Limit(Step):
    n: int
    _inner = True


@dataclass(frozen=True)
class Distinct(Step):
    pass


@dataclass(frozen=True)
class SortKey(Record):
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Sort(Step):
    keys: tuple[SortKey, ...]
    _inner = True


@dataclass(frozen=True)
class FrontierTopK(Step):
    property: str
    query: Vector
    metric: str = "Cosine"
    k: int = 10


@dataclass(frozen=True)
class ExpandBeam(Step):
    dir: str
    edge_type: str | None
    property: str
    query: Vector
    metric: str = "Cosine"
    width: int = 10
    depth: int = 1


@dataclass(frozen=True)
class LogicalPlan(Record):
    source: Source
    steps: tuple[Step, ...] = ()

    def to_json(self) -> str:
        return json.dumps(_out(self))

    @staticmethod
    def from_json(text: str | dict) -> LogicalPlan:
        data = json.loads(text) if isinstance(text, str) else text
        return LogicalPlan(_read(Source, data["source"]), tuple(_read(Step, s) for s in data["steps"]))


def _variants(base: type) -> dict[str, type]:
    return {c.__name__: c for c in base.__subclasses__()}


_RECORDS = {"vector": VectorChannel, "keyword": KeywordChannel, "graph": GraphChannel, "weights": Weights}


def _read(base: type, data: Any) -> Any:
    tag, body = (data, None) if isinstance(data, str) else next(iter(data.items()))
    kind = _variants(base).get(tag)
    if kind is None:
        raise ValueError(f"unknown {base.__name__.lower()} {tag}")
    if kind is Literal:
        return Literal(from_plan(body))
    parts = fields(kind)
    if not parts:
        return kind()
    body = {parts[0].name.rstrip("_"): body} if getattr(kind, "_inner", False) else body
    return kind(**{f.name: _field(kind, f.name, body[f.name.rstrip("_")]) for f in parts if f.name.rstrip("_") in body})


def _field(kind: type, name: str, x: Any) -> Any:
    if x is None:
        return None
    if issubclass(kind, Expr) and name in ("inner", "lhs", "rhs", "needle", "haystack") or name == "expr":
        return _read(Expr, x)
    if name == "query" and not isinstance(x, str):
        return Vector(x)
    if name == "algo":
        return _read(Algorithm, x)
    if kind is ShortestPath and name in ("from_", "to"):
        return _read(NodeRef, x)
    if kind is Hybrid and name in _RECORDS:
        r = _RECORDS[name]
        return r(**{f.name: Vector(x[f.name]) if f.name == "query" and not isinstance(x[f.name], str) else x[f.name] for f in fields(r) if f.name in x})
    if kind is Sort:
        return tuple(SortKey(_read(Expr, k["expr"]), k["descending"]) for k in x)
    return tuple(x) if isinstance(x, list) else x
