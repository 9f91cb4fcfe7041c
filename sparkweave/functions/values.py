"""Property values as Spark columns.

A value is native where its kind is known from the table (a BIGINT column is an Int), and a tagged struct where it is
not (soft schema, or tables that disagree): t ranks the kind, and one of the other fields holds the value. The struct
keeps every operation inside generated code, and Parquet stores its empty fields in a few bits.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.values import Described, kind_of, plain, to_json

VALUE = T.StructType(
    [
        T.StructField("t", T.ByteType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("i", T.LongType()),
        T.StructField("f", T.DoubleType()),
        T.StructField("s", T.StringType()),
        T.StructField("x", T.BinaryType()),
        T.StructField("v", T.ArrayType(T.FloatType())),
        T.StructField("j", T.StringType()),
        T.StructField("d", T.StringType()),
    ]
)
#: Field and rank of each kind; ranks order kinds when values are sorted (Int and Float sort as one).
FIELD = {"bool": "b", "int": "i", "float": "f", "str": "s", "bytes": "x", "vector": "v", "list": "j", "map": "j"}
RANK = {"null": 0, "bool": 1, "int": 2, "float": 3, "str": 4, "bytes": 5, "vector": 6, "list": 7, "map": 8}


@dataclass
class Value:
    """A kind ("any" for the tagged struct) and its column; `items` is the kind of a native list's elements."""

    kind: str
    col: Column
    items: str = ""

    @property
    def is_null(self) -> Column:
        if self.kind == "null":
            return F.lit(True)
        return F.coalesce(self.col["t"], F.lit(0)) == 0 if self.kind == "any" else self.col.isNull()


def kind_of_type(t: T.DataType) -> tuple[str, str]:
    """Kind (and kind of elements) that a table's column type stands for. Times are Int epoch milliseconds."""
    if isinstance(t, T.BooleanType):
        return "bool", ""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "int", ""
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float", ""
    if isinstance(t, T.StringType):
        return "str", ""
    if isinstance(t, T.BinaryType):
        return "bytes", ""
    if isinstance(t, T.ArrayType):
        if isinstance(t.elementType, (T.FloatType, T.DoubleType)):
            return "vector", ""
        return "list", kind_of_type(t.elementType)[0]
    if isinstance(t, T.StructType) and t.fieldNames() == VALUE.fieldNames():
        return "any", ""
    raise TypeError(f"no property kind for {t.simpleString()}")


def native(c: Column, t: T.DataType) -> Column:
    """A table's column in the one Spark type of its kind."""
    if isinstance(t, T.DateType):
        c, t = c.cast("timestamp_ntz"), T.TimestampNTZType()
    if isinstance(t, T.TimestampNTZType):
        return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    if isinstance(t, T.TimestampType):
        return F.unix_millis(c)
    kind = kind_of_type(t)[0]
    if kind == "int":
        return c.cast("bigint")
    if kind == "float":
        return c.cast("double")
    if kind == "vector" and not isinstance(t.elementType, T.FloatType):
        return c.cast("array<float>")
    return c


def literal(value: Any) -> Value:
    kind, value = kind_of(value), plain(value)
    if kind == "null":
        return Value("null", F.lit(None))
    if kind == "vector":
        return Value(kind, F.array(*(F.lit(float(x)).cast("float") for x in value)) if value else F.array().cast("array<float>"))
    if kind in ("list", "map"):
        return Value("any", tagged_literal(value))
    return Value(kind, F.lit(bytes(value) if kind == "bytes" else value).cast({"int": "bigint", "float": "double"}.get(kind, {"bool": "boolean", "str": "string", "bytes": "binary"}.get(kind))))


def tagged_row(value: Any) -> tuple:
    """A Python value as a row of VALUE, for createDataFrame."""
    kind, inner = kind_of(value), plain(value)
    out = dict.fromkeys(VALUE.fieldNames())
    out["t"] = RANK[kind]
    out["d"] = value.description if isinstance(value, Described) else None
    if kind in ("list", "map"):
        out["j"] = json.dumps(to_json(inner), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    elif kind != "null":
        out[FIELD[kind]] = list(inner) if kind == "vector" else bytes(inner) if kind == "bytes" else inner
    return tuple(out.values())


def untag(row: Any) -> Any:
    """A collected row of VALUE as a Python value."""
    from ..plans.values import Vector, from_json

    if row is None or not row["t"]:
        return None
    kind = next(k for k, r in RANK.items() if r == row["t"])
    x = row[FIELD[kind]]
    x = Vector(x) if kind == "vector" else from_json(json.loads(x)) if kind in ("list", "map") else bytes(x) if kind == "bytes" else x
    return Described(x, row["d"]) if row["d"] is not None else x


def tagged_literal(value: Any) -> Column:
    row = tagged_row(value)
    return F.struct(*(F.lit(x if not isinstance(x, list) else None).cast(f.dataType).alias(f.name) if not isinstance(x, list) else F.array(*map(F.lit, x)).cast(f.dataType).alias(f.name) for x, f in zip(row, VALUE.fields, strict=True)))


def tagged(v: Value) -> Column:
    """Any value as the tagged struct."""
    if v.kind == "any":
        return v.col
    cells = {f.name: F.lit(None).cast(f.dataType) for f in VALUE.fields}
    if v.kind == "null":
        cells["t"] = F.lit(0).cast("tinyint")
    else:
        cells["t"] = F.when(v.col.isNull(), 0).otherwise(RANK[v.kind]).cast("tinyint")
        cells[FIELD[v.kind]] = F.to_json(v.col) if v.kind == "list" else v.col
    return F.struct(*(c.alias(k) for k, c in cells.items()))


def number(v: Value) -> Column:
    """A numeric value as a double, NULL if it is none."""
    if v.kind in ("int", "float"):
        return v.col.cast("double")
    if v.kind == "any":
        return F.when(v.col["t"] == 2, v.col["i"].cast("double")).when(v.col["t"] == 3, v.col["f"])
    return F.lit(None).cast("double")


def as_text(v: Value) -> Column:
    """The text form of scalars, NULL for the rest. Floats are written without exponent and without ".0"; from 1e18
    up and under 1e-18 the digits are those of a decimal of 18 places."""
    if v.kind == "str":
        return v.col
    if v.kind in ("int", "bool"):
        return v.col.cast("string")
    if v.kind == "float":
        return _float_text(v.col)
    if v.kind == "any":
        c = v.col
        return F.when(c["t"] == 4, c["s"]).when(c["t"] == 2, c["i"].cast("string")).when(c["t"] == 3, _float_text(c["f"])).when(c["t"] == 1, c["b"].cast("string"))
    return F.lit(None).cast("string")


def _float_text(c: Column) -> Column:
    raw = c.cast("string")
    digits = F.regexp_replace(raw.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return (
        F.when(F.isnan(c), F.lit("NaN"))
        .when(c == float("inf"), F.lit("inf"))
        .when(c == float("-inf"), F.lit("-inf"))
        .when((c == 0) & raw.startswith("-"), F.lit("-0"))
        .when(~raw.contains("E"), F.regexp_replace(raw, r"\.0$", ""))
        .when(digits.contains("."), digits)
        .otherwise(F.regexp_replace(F.coalesce(raw.try_cast("decimal(38,18)").cast("string"), raw.try_cast("decimal(38,0)").cast("string"), raw), r"\.0+$", ""))
    )


def sort_keys(v: Value) -> list[Column]:
    """Columns whose order (nulls first) is the order of all values: by rank of kind, then by value."""
    if v.kind == "null":
        return []
    if v.kind == "bool":
        return [v.col]
    if v.kind in ("int", "float", "str", "bytes", "vector"):
        return [v.col]
    if v.kind == "list":
        return [F.to_json(v.col)]
    c, t = v.col, F.coalesce(v.col["t"], F.lit(0))
    return [F.when(t == 3, 2).otherwise(t), c["b"], number(v), c["i"], c["s"], c["x"], c["v"], c["j"]]
