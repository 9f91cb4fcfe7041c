"""JSON lines and the CSV files of the load benchmark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import tagged_row, untag
from ..plans.values import from_json, to_json
from ..storage import cut
from .graph import PROPS
from .store import RECORD, STARTUP, Store
from .transaction import Transaction


def export_jsonl(store: Store, path: str, plane: str = STARTUP, seq: int | None = None, lean: bool = False) -> None:
    """Node lines in `<path>/nodes`, edge lines in `<path>/edges`. lean leaves the numbers of vectors out."""
    g = store.graph(plane, seq)
    nodes = g.node_tables[0].df
    keys = nodes.select("id", "key")
    edges = g.edge_tables[0].df
    edges = edges.join(keys.select(F.col("id").alias("src"), F.col("key").alias("src_key")), "src").join(keys.select(F.col("id").alias("dst"), F.col("key").alias("dst_key")), "dst")

    def lines(kind: str, fields: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"value": pa.array([_line(kind, fields, r, lean) for r in _rows(batch)], pa.string())})

        return run

    flat = F.map_entries("props").alias("props")
    nodes.select("id", "key", "labels", flat).mapInArrow(lines("node", ["id", "key", "labels"]), "value string").write.text(f"{path}/nodes")
    edges.select("id", "src", "dst", "src_key", "dst_key", "type", flat).mapInArrow(lines("edge", ["id", "src", "dst", "src_key", "dst_key", "type"]), "value string").write.text(f"{path}/edges")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch; the fields of its property values are read as columns, of which most are empty."""
    props = batch.column("props")
    names, values = props.flatten().flatten()
    names, fields = names.to_pylist(), values.type.names
    cells = zip(*(c.to_pylist() if c.null_count < len(c) else [None] * len(c) for c in values.flatten()), strict=True)
    entries = ({"key": k, "value": dict(zip(fields, v, strict=True))} for k, v in zip(names, cells, strict=True))
    lengths = pc.list_value_length(props).to_pylist()
    for row, n in zip(batch.drop_columns(["props"]).to_pylist(), lengths, strict=True):
        yield row | {"props": [next(entries) for _ in range(n or 0)]}


def _line(kind: str, fields: list[str], row: dict, lean: bool) -> str:
    out = {"kind": kind} | {f: list(row[f]) if f == "labels" and row[f] is not None else row[f] for f in fields}
    out["props"] = {e["key"]: to_json(untag(e["value"]), lean) for e in row["props"]}
    return json.dumps({k: v for k, v in out.items() if v is not None}, ensure_ascii=False, allow_nan=True)


_NODE = "kind string, id long, key string, labels array<string>, src long, dst long, src_key string, dst_key string, type string, props array<struct<key:string,value:struct<t:tinyint,b:boolean,i:bigint,f:double,s:string,x:binary,v:array<float>,j:string,d:string>>>"


def read_jsonl(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of an export as rows; props as a map of tagged values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _NODE.split(", ")[:9]]
        for pdf in batches:
            rows = [json.loads(x) for x in pdf["value"] if x.strip()]
            out = {n: [r.get(n) for r in rows] for n in names}
            fields = ("t", "b", "i", "f", "s", "x", "v", "j", "d")
            out["props"] = [[{"key": k, "value": dict(zip(fields, tagged_row(from_json(v)), strict=True))} for k, v in (r.get("props") or {}).items()] for r in rows]
            yield pd.DataFrame(out).astype({n: "Int64" for n in ("id", "src", "dst")})

    lines = spark.read.text(list(paths))
    return lines.mapInPandas(run, _NODE).withColumn("props", F.map_from_entries("props").cast(PROPS))


def import_jsonl(store: Store, path: str, plane: str = STARTUP, on_conflict: str = "error") -> None:
    """Load exported lines under new ids. A key that the plane has is an error, skipped or updated."""
    if on_conflict not in ("error", "skip", "update"):
        raise ValueError("on_conflict is error, skip or update")
    tx = Transaction(store, plane)
    # lines are parsed once
    nodes = cut(read_jsonl(store.spark, f"{path}/nodes").filter("kind = 'node'").select("key", F.col("id").alias("old"), "labels", "props"), "lines")
    taken = tx.current("node").filter("key is not null").select("key", F.col("id").alias("have"))
    clash = nodes.join(taken, "key")
    if on_conflict == "error":
        row = clash.select("key").first()
        if row:
            from .store import Conflict

            raise Conflict(f"key {row['key']!r} is taken")
    elif on_conflict == "update":
        new = clash.select(F.col("have").alias("id"), F.col("labels").alias("l"), F.col("props").alias("p")).dropDuplicates(["id"])
        put = tx.current("node").join(new, "id").withColumns({"labels": F.col("l"), "props": F.map_concat(F.map_filter(F.coalesce("props", F.create_map().cast(PROPS)), lambda k, _: ~F.array_contains(F.map_keys("p"), k)), F.col("p"))})
        tx.add(put.select(*RECORD.fieldNames()), "update")
    fresh = nodes.join(taken.select("key"), "key", "left_anti") if on_conflict != "error" else nodes
    # nodes without a key are found again by their old id
    named = fresh.withColumn("key", F.coalesce("key", F.concat(F.lit("\x00"), F.col("old").cast("string"))))
    made = tx.bulk_load(named.select("key", "labels", "props"))
    edges = read_jsonl(store.spark, f"{path}/edges").filter("kind = 'edge'")
    ends = [F.coalesce(f"{e}_key", F.concat(F.lit("\x00"), F.col(e).cast("string"))).alias(f"{e}_key") for e in ("src", "dst")]
    tx.bulk_load_edges(edges.select(*ends, "type", "props"))
    hidden = made.filter(F.col("key").startswith("\x00")).select("id")
    if not hidden.isEmpty():
        tx.change(hidden, key=lambda _: F.lit(None).cast("string"))
    tx.commit()


def vector_text(v: Column) -> Column:
    """A vector as a field of vectors.csv: numbers in as many digits as bring back the same floats."""
    return F.when(F.size(v) == 0, "[]").otherwise(F.array_join(F.transform(v, lambda x: x.cast("float").cast("string")), " ", "null"))


def read_benchmark_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, labels, props) and edges (src_key, dst_key, type, props) of nodes.csv, edges.csv and vectors.csv,
    ready for bulk_load."""
    from ..functions.values import VALUE, Value, tagged

    read = lambda name, schema: spark.read.csv(f"{path}/{name}", header=True, schema=schema)
    nodes = read("nodes.csv", "id long, key string, label string, name string, value long")
    vectors = read("vectors.csv", "id long, vector string").select("id", F.transform(F.filter(F.split("vector", " "), lambda x: x != "[]"), lambda x: F.when(x != "null", x).cast("float")).alias("vector"))
    one = lambda kind, c: tagged(Value(kind, F.col(c))).cast(VALUE)
    rows = nodes.join(vectors, "id", "left")
    props = F.map_filter(F.create_map(F.lit("name"), one("str", "name"), F.lit("value"), one("int", "value"), F.lit("embedding"), one("vector", "vector")), lambda _, v: v["t"] != 0)
    edges = read("edges.csv", "src_key string, dst_key string, type string")
    return rows.select("key", F.array("label").alias("labels"), props.alias("props")), edges.withColumn("props", F.lit(None).cast(PROPS))
