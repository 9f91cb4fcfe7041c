"""Property values: nine kinds, their plan form ({"Int": 1}) and their JSON form ({"$vector": [...]})."""

from __future__ import annotations

import struct
from typing import Any


class Vector(tuple):
    """A vector of 32-bit floats; a list of numbers is another kind of value."""

    __slots__ = ()

    def __new__(cls, items=()):
        return super().__new__(cls, (struct.unpack("<f", struct.pack("<f", float(x)))[0] for x in items))


class Described:
    """A value with a description (properties and map entries may carry one)."""

    def __init__(self, value: Any, description: str | None = None):
        self.value, self.description = value, description

    def __eq__(self, other):
        return isinstance(other, Described) and (self.value, self.description) == (other.value, other.description)

    def __repr__(self):
        return f"Described({self.value!r}, {self.description!r})"


def plain(value: Any) -> Any:
    return value.value if isinstance(value, Described) else value


def kind_of(value: Any) -> str:
    value = plain(value)
    if value is None:
        return "null"
    for kind, types in (("bool", bool), ("int", int), ("float", float), ("str", str), ("bytes", (bytes, bytearray)), ("vector", Vector), ("list", (list, tuple)), ("map", dict)):
        if isinstance(value, types):
            return kind
    raise TypeError(f"no property value: {type(value).__name__}")


def wrap64(x: int) -> int:
    return (x + 2**63) % 2**64 - 2**63


def to_plan(value: Any) -> Any:
    kind, value = kind_of(value), plain(value)
    if kind == "null":
        return "Null"
    if kind in ("vector", "bytes"):
        return {kind.capitalize(): list(value)}
    if kind == "list":
        return {"List": [to_plan(x) for x in value]}
    if kind == "map":
        return {"Map": {k: {"description": v.description if isinstance(v, Described) else None, "value": to_plan(v)} for k, v in sorted(value.items())}}
    return {kind.capitalize(): value}


def from_plan(data: Any) -> Any:
    if data == "Null":
        return None
    ((tag, x),) = data.items()
    if tag == "Float":
        return float(x)
    if tag in ("Int", "Bool", "Str"):
        return x
    if tag == "Bytes":
        return bytes(x)
    if tag == "Vector":
        return Vector(x)
    if tag == "List":
        return [from_plan(v) for v in x]
    if tag == "Map":
        return {k: from_plan(v["value"]) if v.get("description") is None else Described(from_plan(v["value"]), v["description"]) for k, v in x.items()}
    raise ValueError(f"unknown value {tag}")


def to_json(value: Any, lean: bool = False) -> Any:
    """The wire form. lean leaves the numbers of vectors out."""
    if isinstance(value, Described):
        inner = to_json(value.value, lean)
        return inner if value.description is None else {"$desc": value.description, "$value": inner}
    kind = kind_of(value)
    if kind == "vector":
        return f"$vector({len(value)} dims, omitted)" if lean else {"$vector": list(value)}
    if kind == "bytes":
        return {"$bytes": list(value)}
    if kind == "list":
        return [to_json(x, lean) for x in value]
    if kind == "map":
        return {k: to_json(v, lean) for k, v in value.items()}
    return value


def from_json(data: Any) -> Any:
    if isinstance(data, dict):
        if set(data) == {"$vector"}:
            return Vector(data["$vector"])
        if set(data) == {"$bytes"}:
            if not all(isinstance(b, int) and 0 <= b <= 255 for b in data["$bytes"]):
                raise ValueError("$bytes takes integers from 0 to 255")
            return bytes(data["$bytes"])
        if "$value" in data and set(data) <= {"$value", "$desc"}:
            return Described(from_json(data["$value"]), data.get("$desc"))
        return {k: from_json(v) for k, v in data.items()}
    if isinstance(data, list):
        return [from_json(x) for x in data]
    if isinstance(data, int) and not isinstance(data, bool):
        return wrap64(data)
    return data
