"""Plan expressions as columns, with total semantics: nothing raises, and predicates are two-valued.

A predicate column may be NULL where its meaning is false. Filters, AND and OR treat the two alike, so leaves stay bare
comparisons that reach the Parquet scan; NOT and projections make the difference disappear with coalesce.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import model as M
from .values import FIELD, RANK, Value, as_text, literal, number, tagged

INF = float("inf")


@dataclass
class Row:
    """How a row's current node is reached: its properties, labels, key, score and hops."""

    property: Callable[[str], Value]
    has_label: Callable[[str], Column]
    key: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    score: Column = field(default_factory=lambda: F.lit(None).cast("float"))
    hops: Column = field(default_factory=lambda: F.lit(0))


def evaluate(e: M.Expr, row: Row) -> Value:
    """The value of an expression."""
    match e:
        case M.Property(name):
            return row.property(name)
        case M.Literal(value):
            return literal(value)
        case M.ExternalKey():
            return Value("str", row.key)
        case M.Score():
            return Value("float", row.score.cast("double"))
        case M.Hops():
            return Value("int", row.hops.cast("bigint"))
        case M.Distance(name, query, metric):
            return Value("float", _measure(row.property(name), query, metric, distance, INF))
        case M.Similarity(name, query, metric):
            return Value("float", _measure(row.property(name), query, metric, similarity, -INF))
        case M.Arith(op, lhs, rhs):
            return arithmetic(op, evaluate(lhs, row), evaluate(rhs, row))
        case _:
            return Value("bool", F.coalesce(predicate(e, row), F.lit(False)))


def predicate(e: M.Expr, row: Row) -> Column:
    """A boolean column that is true exactly where e is true; NULL stands for false."""
    match e:
        case M.HasLabel(label):
            return row.has_label(label)
        case M.IsNull(inner):
            return evaluate(inner, row).is_null
        case M.Not(inner):
            return ~F.coalesce(predicate(inner, row), F.lit(False))
        case M.Logic("And", lhs, rhs):
            return predicate(lhs, row) & predicate(rhs, row)
        case M.Logic("Or", lhs, rhs):
            return predicate(lhs, row) | predicate(rhs, row)
        case M.Compare(op, lhs, rhs):
            return compare(op, evaluate(lhs, row), evaluate(rhs, row), isinstance(lhs, M.Literal) or isinstance(rhs, M.Literal))
        case M.StringMatch(op, lhs, rhs):
            a, b = as_text(evaluate(lhs, row)), as_text(evaluate(rhs, row))
            return {"Contains": a.contains, "StartsWith": a.startswith, "EndsWith": a.endswith}[op](b)
        case M.In(needle, haystack):
            return member(evaluate(needle, row), evaluate(haystack, row))
        case _:
            v = evaluate(e, row)
            if v.kind == "bool":
                return v.col
            return (v.col["t"] == 1) & v.col["b"] if v.kind == "any" else F.lit(False)


def compare(op: str, a: Value, b: Value, constant: bool = False) -> Column:
    if op == "Eq":
        return equal(a, b, constant)
    if op == "Ne":
        return ~F.coalesce(equal(a, b, constant), F.lit(False))
    less = {"Lt": lambda x, y: x < y, "Le": lambda x, y: x <= y, "Gt": lambda x, y: x > y, "Ge": lambda x, y: x >= y}[op]
    if "any" in (a.kind, b.kind):
        x, y = tagged(a), tagged(b)
        both = lambda t: (x["t"] == t) & (y["t"] == t)
        p, q = number(Value("any", x)), number(Value("any", y))
        return F.when(both(2), less(x["i"], y["i"])).when(both(1), less(x["b"], y["b"])).when(both(4), less(x["s"], y["s"])).otherwise(~F.isnan(p) & ~F.isnan(q) & less(p, q))
    if a.kind == b.kind and a.kind in ("int", "bool", "str"):
        return less(a.col, b.col)
    if {a.kind, b.kind} <= {"int", "float"}:
        p, q = number(a), number(b)
        return ~F.isnan(p) & ~F.isnan(q) & less(p, q)
    return F.lit(False)


def equal(a: Value, b: Value, constant: bool = False) -> Column:
    """Cross-numeric equality; Null = Null is true, NaN = NaN is not. With a constant on one side, no NULL meets
    another, and the plain comparison that Parquet can prune by does."""
    if "null" in (a.kind, b.kind):
        return (b if a.kind == "null" else a).is_null
    same = (lambda x, y: x == y) if constant else (lambda x, y: x.eqNullSafe(y))
    if "any" in (a.kind, b.kind):
        x, y = tagged(a), tagged(b)
        t, u = F.coalesce(x["t"], F.lit(0)), F.coalesce(y["t"], F.lit(0))
        p, q = number(Value("any", x)), number(Value("any", y))
        out = F.when((t == 2) & (u == 2), x["i"] == y["i"]).when(t.isin(2, 3) & u.isin(2, 3), ~F.isnan(p) & ~F.isnan(q) & (p == q)).when(t != u, False).when(t == 0, True)
        for kind in ("bool", "str", "bytes", "vector", "list"):
            out = out.when(t == RANK[kind], x[FIELD[kind]] == y[FIELD[kind]])
        return out.otherwise(x["j"] == y["j"])
    if a.kind == b.kind and a.kind == "float" or {a.kind, b.kind} == {"int", "float"}:
        p, q = number(a), number(b)
        return same(p, q) & ~F.coalesce(F.isnan(p), F.lit(False))
    if a.kind == b.kind and a.items == b.items:
        return same(a.col, b.col)
    return a.col.isNull() & b.col.isNull()


def member(needle: Value, haystack: Value) -> Column:
    """An element of a list by equality, or a key of a map."""
    if haystack.kind == "list":
        return F.exists(haystack.col, lambda x: equal(Value(haystack.items, x), needle))
    if haystack.kind != "any":
        return F.lit(False)
    json, n = haystack.col["j"], tagged(needle)
    items = F.when(haystack.col["t"] == 7, F.try_parse_json(json)).cast("array<variant>")

    def same(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        text, real = F.try_variant_get(x, "$", "string"), F.try_variant_get(x, "$", "double")
        numeric = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        return (
            F.when(n["t"].isin(2, 3), numeric & (real == number(Value("any", n))))
            .when(n["t"] == 4, (kind == "STRING") & (text == n["s"]))
            .when(n["t"] == 1, (kind == "BOOLEAN") & (F.try_variant_get(x, "$", "boolean") == n["b"]))
            .when(n["t"] == 0, kind == "VOID")
            .otherwise(F.to_json(x) == n["j"])
        )

    keys = F.json_object_keys(F.when(haystack.col["t"] == 8, json))
    return F.coalesce(F.exists(items, same), F.array_contains(keys, as_text(needle)))


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Int with Int wraps around (and / truncates, NULL by zero); with a Float it is IEEE; else Null."""
    if "any" in (a.kind, b.kind):
        x, y = Value("any", tagged(a)), Value("any", tagged(b))
        ints = _int(op, x.col["i"], y.col["i"])
        reals = _float(op, number(x), number(y))
        both = (x.col["t"] == 2) & (y.col["t"] == 2)
        whole, real = Value("int", F.when(both, ints)), Value("float", F.when(~both, reals))
        return Value("any", F.when(both, tagged(whole)).otherwise(tagged(real)))
    if a.kind == b.kind == "int":
        return Value("int", _int(op, a.col, b.col))
    if {a.kind, b.kind} <= {"int", "float"}:
        return Value("float", _float(op, number(a), number(b)))
    return Value("null", F.lit(None))


def _int(op: str, x: Column, y: Column) -> Column:
    if op == "Div":
        # -2**63 / -1 wraps to itself
        low = F.lit(-(2**63))
        return F.when(y == 0, None).when((x == low) & (y == -1), low).otherwise(F.call_function("div", x, F.when(y != 0, y)))
    # exact as decimal(38), then wrapped; the plain operator would raise in ANSI mode
    a, b = (c.cast("decimal(19,0)") for c in (x, y))
    r = {"Add": lambda: a + b, "Sub": lambda: a - b, "Mul": lambda: a * b}[op]()
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    half = F.lit("9223372036854775808").cast("decimal(20,0)")
    inside = F.call_function({"Add": "try_add", "Sub": "try_subtract", "Mul": "try_multiply"}[op], x, y)
    wrapped = F.pmod((r.cast("decimal(38,0)") + half).cast("decimal(38,0)"), two64) - half
    return F.coalesce(inside, wrapped.cast("decimal(20,0)").cast("bigint"))


def _float(op: str, x: Column, y: Column) -> Column:
    if op == "Div":
        # 1 / y of a zero would raise or be NULL: the sign of a zero is read from its text
        negative = y.cast("string").startswith("-") != (x.cast("string").startswith("-"))
        by_zero = F.when(F.isnan(x) | (x == 0), float("nan")).when(negative, -INF).otherwise(INF)
        return F.when(x.isNull() | y.isNull(), None).when(y == 0, by_zero).otherwise(x / F.when(y != 0, y))
    return {"Add": x + y, "Sub": x - y, "Mul": x * y}[op]


# Vectors -------------------------------------------------------------------------------------------------------


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0, clamped to -1..1."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.when(norms != 0, norms))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def distance(metric: str, a: Column, b: Column) -> Column:
    return {"Cosine": lambda: 1 - cosine(a, b), "Dot": lambda: -dot(a, b), "L2": lambda: l2(a, b)}[metric]()


def similarity(metric: str, a: Column, b: Column) -> Column:
    return {"Cosine": lambda: cosine(a, b), "Dot": lambda: dot(a, b), "L2": lambda: -l2(a, b)}[metric]()


def similarity_of_distance(metric: str, d: Column) -> Column:
    return 1 - d if metric == "Cosine" else -d


def vector_of(v: Value) -> Column:
    """The vector a value holds, NULL if it is none."""
    if v.kind == "vector":
        return v.col
    return F.when(v.col["t"] == RANK["vector"], v.col["v"]) if v.kind == "any" else F.lit(None).cast("array<float>")


def _measure(v: Value, query, metric: str, measure, mismatch: float) -> Column:
    c, q = vector_of(v), literal(M.Vector(query)).col
    return F.when(c.isNull(), None).when(F.size(c) != len(query), mismatch).otherwise(measure(metric, c, q))
