import itertools
import math
import random

import pytest
from pyspark.sql import types as T

from sparkweave.functions.values import tagged_row, untag
from sparkweave.operators.lowering import Query
from sparkweave.plans import model as M
from sparkweave.plans.values import from_json, from_plan, plain, to_json, to_plan
from sparkweave.sources.graph import SOFT_EDGES, SOFT_NODES, Graph, NodeTable, soft_graph

from evaluator import VALUES, evaluate


def soft(spark, rows):
    """Nodes with properties a and b."""
    nodes = [(i, None, ["N"], {k: tagged_row(v) for k, v in r.items()}) for i, r in enumerate(rows)]
    return soft_graph(spark, spark.createDataFrame(nodes, SOFT_NODES), spark.createDataFrame([], SOFT_EDGES))


def same(a, b):
    a, b = plain(a), plain(b)
    if isinstance(a, float) and isinstance(b, float):
        return math.isnan(a) and math.isnan(b) or a == b and math.copysign(1, a) == math.copysign(1, b)
    return type(a) is type(b) and a == b


OPS = [lambda a, b, op=op: M.Compare(op, a, b) for op in M.COMPARISONS] + [lambda a, b, op=op: M.StringMatch(op, a, b) for op in ("Contains", "StartsWith", "EndsWith")] + [M.In, lambda a, b: M.Logic("And", a, M.Not(b)), lambda a, b: M.Logic("Or", M.IsNull(a), b)]


def test_predicates_over_all_kinds(spark):
    pairs = list(itertools.product(VALUES, VALUES))
    rows = [{k: v for k, v in (("a", x), ("b", y)) if v is not None} for x, y in pairs]
    g = soft(spark, rows)
    a, b = M.Property("a"), M.Property("b")
    exprs = {f"e{i}": op(a, b) for i, op in enumerate(OPS)} | {f"c{i}": op(a, M.Literal(v)) for i, (op, v) in enumerate(itertools.product(OPS[:10], [1, 1.0, "a", None, True, [1, "a"]]))}
    df = Query(g).scan_all().select(ordered=True, **exprs).collect()
    for r, props in zip(df, rows, strict=True):
        for name, e in exprs.items():
            assert r[name] == evaluate(e, props), (name, e, props)


def test_arithmetic_over_all_kinds(spark):
    pairs = [(x, y) for x in VALUES for y in VALUES]
    g = soft(spark, [{"a": x, "b": y} for x, y in pairs])
    exprs = {op: M.Arith(op, M.Property("a"), M.Property("b")) for op in ("Add", "Sub", "Mul", "Div")}
    for r, (x, y) in zip(Query(g).scan_all().select(ordered=True, **exprs).collect(), pairs, strict=True):
        for op, e in exprs.items():
            assert same(untag(r[op]), evaluate(e, {"a": x, "b": y})), (op, x, y, untag(r[op]))


def test_typed_columns_mean_the_same(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("i", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType())])
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0, 1, -7, 2**63 - 1]), rng.choice([None, math.nan, -0.0, 1.0, 2.5, math.inf]), rng.choice([None, "a", "1", "2.5"]), rng.choice([None, True, False])) for i in range(80)]
    g = Graph(spark, [NodeTable(spark.createDataFrame(rows, schema), ("T",), "id", None, {c: c for c in "ifsb"})], [])
    names = list("ifsb")
    exprs = {}
    for n, (x, y) in enumerate(itertools.product(names, names)):
        for k, op in enumerate(OPS[:9]):
            exprs[f"p{n}_{k}"] = op(M.Property(x), M.Property(y))
    for n, (x, v) in enumerate(itertools.product(names, [1, 1.0, "1", True, None])):
        for k, op in enumerate(OPS[:9]):
            exprs[f"l{n}_{k}"] = op(M.Property(x), M.Literal(v))
    for r, row in zip(Query(g).scan_label("T").select(ordered=True, **exprs).collect(), rows, strict=True):
        props = dict(zip(names, row[1:], strict=True))
        for name, e in exprs.items():
            assert r[name] == evaluate(e, props), (e, props)


@pytest.mark.parametrize("e", [M.Not(M.Property("a").gt(5)), M.Property("a").ne(1), M.Property("zzz").ne(1), ~M.HasLabel("X"), M.Property("a").eq(None)])
def test_filters_keep_what_is_true(spark, e):
    rows = [{"a": v} for v in VALUES]
    got = [r["id"] for r in Query(soft(spark, rows)).scan_all().filter(e).ids().collect()]
    assert got == [i for i, p in enumerate(rows) if evaluate(e, p, ("N",)) is True]


def test_sort_orders_mixed_kinds(spark):
    values = [v for v in VALUES if not (isinstance(v, float) and math.isnan(v))]
    shuffled = random.Random(1).sample(values, len(values))
    got = [untag(r["v"]) for r in Query(soft(spark, [{"a": v} for v in shuffled])).scan_all().sort_asc(M.Property("a")).select(ordered=True, v=M.Property("a")).collect()]
    kinds = [type(plain(v)).__name__ for v in got]
    order = ["NoneType", "bool", "number", "str", "bytes", "Vector", "list", "dict"]
    ranks = [order.index("number" if k in ("int", "float") else k) for k in kinds]
    assert ranks == sorted(ranks)
    numbers = [v for v in got if type(v) in (int, float)]
    assert numbers == sorted(numbers)


def test_values_in_json_and_plans():
    for v in VALUES:
        if not (isinstance(v, float) and math.isnan(v)):
            assert plain(from_plan(to_plan(v))) == plain(v)
            assert from_json(to_json(v)) == v
    assert to_json(VALUES[20], lean=True) == "$vector(2 dims, omitted)"
    with pytest.raises(ValueError):
        from_json({"$bytes": [300]})
