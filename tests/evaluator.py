"""A plain Python version of the expressions' meaning, for comparison."""

import math

from sparkweave.plans import model as M
from sparkweave.plans.values import Described, Vector, kind_of, plain, wrap64


def text_of(v):
    kind = kind_of(v)
    if kind == "str":
        return v
    if kind == "bool":
        return "true" if v else "false"
    if kind == "int":
        return str(v)
    if kind == "float":
        if math.isnan(v):
            return "NaN"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return ("-0" if math.copysign(1, v) < 0 and v == 0 else str(int(v))) if v == int(v) else repr(v)
    return None


def equal(a, b):
    a, b = plain(a), plain(b)
    ka, kb = kind_of(a), kind_of(b)
    if {ka, kb} <= {"int", "float"}:
        return a == b if ka == kb else float(a) == float(b)
    return ka == kb and a == b


def compare(op, a, b):
    if op == "Eq":
        return equal(a, b)
    if op == "Ne":
        return not equal(a, b)
    ka, kb = kind_of(a), kind_of(b)
    if not ({ka, kb} <= {"int", "float"} or ka == kb and ka in ("bool", "str")):
        return False
    if ka == "str":
        a, b = a.encode(), b.encode()
    if ka != kb:
        a, b = float(a), float(b)
    return {"Lt": a < b, "Le": a <= b, "Gt": a > b, "Ge": a >= b}[op]


def arithmetic(op, a, b):
    ka, kb = kind_of(a), kind_of(b)
    if not {ka, kb} <= {"int", "float"}:
        return None
    if ka == kb == "int":
        if op == "Div":
            if b == 0:
                return None
            q = abs(a) // abs(b)
            return wrap64(q if (a < 0) == (b < 0) else -q)
        return wrap64({"Add": a + b, "Sub": a - b, "Mul": a * b}[op])
    a, b = float(a), float(b)
    if op == "Div":
        if b == 0:
            return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)
        return a / b
    return {"Add": a + b, "Sub": a - b, "Mul": a * b}[op]


def evaluate(e, props, labels=(), key=None):
    ev = lambda x: evaluate(x, props, labels, key)
    match e:
        case M.Property(name):
            return plain(props.get(name))
        case M.Literal(v):
            return plain(v)
        case M.HasLabel(label):
            return label in labels
        case M.ExternalKey():
            return key
        case M.IsNull(x):
            return ev(x) is None
        case M.Not(x):
            return ev(x) is not True
        case M.Logic(op, a, b):
            a, b = ev(a) is True, ev(b) is True
            return a and b if op == "And" else a or b
        case M.Compare(op, a, b):
            return compare(op, ev(a), ev(b))
        case M.Arith(op, a, b):
            return arithmetic(op, ev(a), ev(b))
        case M.StringMatch(op, a, b):
            a, b = text_of(ev(a)), text_of(ev(b))
            return a is not None and b is not None and {"Contains": b in a, "StartsWith": a.startswith(b), "EndsWith": a.endswith(b)}[op]
        case M.In(n, h):
            n, h = ev(n), ev(h)
            if kind_of(h) == "list":
                return any(equal(n, x) for x in h)
            return text_of(n) in h if kind_of(h) == "map" and text_of(n) is not None else False
    raise TypeError(e)


VALUES = [None, True, False, 1, -7, 0, 2, 2**63 - 1, -(2**63), 1.0, -0.0, 0.5, math.nan, math.inf, -math.inf, "a", "1", "", "ä", b"x", Vector([1, 0]), [1, "a"], {"k": 1, "1": None}, Described("a", "said")]
