"""A versioned graph store on any file system that Spark knows.

    commits/<seq>.json                 one small file a commit, created whole and never replaced: the compare-and-swap
    log/seq=<seq>/part=<id>/           Parquet by plane and kind: the state of each node or edge that a writer changed
    base/<seq>-<id>/                   Parquet by plane and kind: all nodes and edges as of seq, written by compact()
    kept/<seq>                         an empty file: versions before seq are forgotten

A writer's rows go to a folder of its own, which its commit file names; what a writer leaves that lost the race or died is
named nowhere and read by nobody. A commit file lists the folders since the base that its version needs, so a version
is that base with those folders laid over: of each id the row of the latest folder. Only ids of the folders after the first
are looked up for that, and only the files of the wanted plane and kind, and the wanted columns, are read. compact() keeps the list short; a commit writes what it changed, never the graph.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut, own_shuffles
from .graph import PROPS, EdgeTable, Graph, NodeTable

STARTUP = "startup"
RECORD = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("plane", T.IntegerType()),
        T.StructField("op", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("props", PROPS),
    ]
)
STATE = [f.name for f in RECORD.fields if f.name not in ("kind", "id", "op")]


class Conflict(ValueError):
    """A key that is taken, or a commit that another writer has overtaken."""


class NotFound(KeyError):
    """No such node, edge, plane or version."""


@dataclass
class Commit:
    seq: int = 0
    ts_ms: int = 0
    next_id: int = 1
    base: str | None = None
    parts: dict[str, str] = field(default_factory=dict)
    planes: dict[str, dict] = field(default_factory=lambda: {STARTUP: {"id": 0, "props": {}}})
    types: list[str] = field(default_factory=list)
    indexes: list[dict] = field(default_factory=list)
    counters: dict[str, dict] = field(default_factory=dict)


class Files:
    """The few file operations that commits need, through Hadoop's API, so any path Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def list(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(name))]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Create a file as a whole; False if it exists. No check comes before the step that creates it: a hard link on a
        local disk, else a rename, which on HDFS refuses to replace a file."""
        temp = f"temp/{uuid.uuid4().hex}"
        out = self.fs.create(self.path(temp), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(self.path(name).getParent())
        try:
            if self.fs.getUri().getScheme() == "file":
                os.link(self.path(temp).toUri().getPath(), self.path(name).toUri().getPath())
                return True
            return bool(self.fs.rename(self.path(temp), self.path(name)))
        except FileExistsError:
            return False
        finally:
            if self.exists(temp):
                self.fs.delete(self.path(temp), False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.observers: list[Callable[[int], None]] = []
        if self.latest() is None:
            self.files.publish("commits/0.json", json.dumps(asdict(Commit(ts_ms=int(time.time() * 1000)))))

    # versions

    def sequences(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.list("commits") if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int | None:
        return max(self.sequences(), default=None)

    def commit(self, seq: int | None = None) -> Commit:
        return Commit(**json.loads(self.files.read(f"commits/{self.latest() if seq is None else seq}.json")))

    def history(self) -> tuple[int, int]:
        """Oldest and latest version that can be read."""
        return max(map(int, self.files.list("kept")), default=0), self.latest()

    def resolve(self, seq: int | None = None, ms: int | None = None) -> int:
        """The version at or before a commit or an instant. Later than the latest is the latest; earlier than what
        is kept is an error."""
        oldest, latest = self.history()
        if ms is not None:
            # commit times rise with seq: a binary search reads a few commit files
            seqs = [s for s in self.sequences() if s >= oldest]
            low, high = 0, len(seqs)
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if self.commit(seqs[mid]).ts_ms <= ms else (low, mid)
            if not low:
                raise NotFound(f"nothing is kept from before {ms} ms")
            return seqs[low - 1]
        if seq is None or seq >= latest:
            return latest
        if seq < oldest:
            raise NotFound(f"version {seq} is older than {oldest}, the oldest kept")
        return max(s for s in self.sequences() if s <= seq)

    def _read(self, folder: str, paths: list[str]) -> DataFrame:
        schema = T.StructType([*RECORD.fields, T.StructField("seq", T.LongType())])
        if not paths:
            # the limit tells the optimizer that there are no rows
            return self.spark.createDataFrame([], schema).limit(0)
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/{folder}").parquet(*(f"{self.path}/{folder}/{p}" for p in paths))
        return found.select(*schema.fieldNames())

    def _write(self, rows: DataFrame, folder: str) -> None:
        with own_shuffles(self.spark):
            rows.select(*RECORD.fieldNames()).write.partitionBy("plane", "kind").parquet(f"{self.path}/{folder}")

    def changes(self, seqs: list[int]) -> DataFrame:
        """What some commits changed: RECORD and seq."""
        parts = [self.commit(s).parts.get(str(s)) for s in seqs]
        return self._read("log", [f"seq={s}/part={p}" for s, p in zip(seqs, parts, strict=True) if p])

    def records(self, kind: str, seq: int, plane: int | None = None) -> DataFrame:
        """Nodes or edges of a plane, or of all, as of a version, with the columns of RECORD."""
        c = self.commit(seq)
        parts = [f"seq={s}/part={c.parts[s]}" for s in sorted(c.parts, key=int)]
        if c.base is not None:
            first, later = self._read("base", [c.base]).withColumn("seq", F.lit(-1).cast("bigint")), parts
        else:
            first, later = self._read("log", parts[:1]), parts[1:]

        def wanted(rows: DataFrame) -> DataFrame:
            rows = rows.filter(F.col("kind") == kind)
            return rows if plane is None else rows.filter(F.col("plane") == plane)

        return newest(wanted(first), wanted(self._read("log", later)) if later else None, "seq")

    def graph(self, plane: str = STARTUP, seq: int | None = None, ms: int | None = None) -> Graph:
        """The graph of a plane, now or as of a version."""
        seq = self.resolve(seq, ms)
        c = self.commit(seq)
        if plane not in c.planes:
            raise NotFound(f"no plane {plane!r}")
        own = c.planes[plane]["id"]
        nodes = self.records("node", seq, own).select("id", "key", "labels", "props")
        edges = self.records("edge", seq, own).select("id", "src", "dst", "type", "props")
        return Graph(self.spark, [NodeTable(nodes)], [EdgeTable(edges)], c.types)

    # commits

    def stage(self, changes: DataFrame, before: Commit) -> tuple[str, DataFrame]:
        """Write changes (RECORD) into a folder of their own for the version after `before`: its name and its rows. Nobody
        reads it before a commit names it."""
        part = uuid.uuid4().hex
        self._write(changes, f"log/seq={before.seq + 1}/part={part}")
        return part, self._read("log", [f"seq={before.seq + 1}/part={part}"])

    def publish(self, changes: DataFrame | None, before: Commit, after: dict[str, Any] | None = None, part: str | None = None) -> Commit:
        """Make changes (RECORD, or a part that is staged; neither for none) the version after `before`. Conflict if
        another writer was first; then nothing has changed."""
        seq, parts = before.seq + 1, dict(before.parts)
        if changes is not None:
            part, _ = self.stage(changes, before)
        if part is not None:
            parts[str(seq)] = part
        done = Commit(**(asdict(before) | {"parts": parts} | (after or {}) | {"seq": seq, "ts_ms": max(int(time.time() * 1000), before.ts_ms)}))
        if not self.files.publish(f"commits/{seq}.json", json.dumps(asdict(done))):
            if part is not None:
                self.files.delete(f"log/seq={seq}/part={part}")
            raise Conflict(f"version {seq} was committed by another writer")
        for tell in self.observers:
            tell(seq)
        return done

    def copy_commit(self, changes: DataFrame, commit: Commit) -> bool:
        """Take over another store's commit at its own number; False if that number is taken."""
        before, part = self.commit(commit.seq - 1), uuid.uuid4().hex
        self._write(changes, f"log/seq={commit.seq}/part={part}")
        own = asdict(commit) | {"base": before.base, "parts": before.parts | {str(commit.seq): part}}
        return self.files.publish(f"commits/{commit.seq}.json", json.dumps(own))

    def compact(self) -> int:
        """Write all records of the latest version as a base; later reads start from it."""
        c = self.commit()
        base = f"{c.seq}-{uuid.uuid4().hex}"
        nodes, edges = self.records("node", c.seq), self.records("edge", c.seq)
        self._write(nodes.unionByName(edges).withColumn("op", F.lit("create")), f"base/{base}")
        self.publish(None, c, {"base": base, "parts": {}})
        return c.seq

    def vacuum(self, keep: int) -> int:
        """Forget versions older than the last `keep`; returns the oldest one left. No commit file that is kept changes;
        folders go that no kept version needs (compact first to make them few)."""
        c = self.commit()
        oldest = max(self.history()[0], c.seq - keep + 1)
        self.files.publish(f"kept/{oldest}", "")
        needed = [self.commit(s) for s in self.sequences() if s >= oldest]
        parts = {p for x in needed for p in x.parts.values()}
        bases = {x.base for x in needed}
        for s in self.sequences():
            if s < oldest:
                self.files.delete(f"commits/{s}.json")
        # a writer or compaction under way is at work on numbers past the latest commit, or at it
        for n in self.files.list("log"):
            for part in self.files.list(f"log/{n}") if n.startswith("seq=") and int(n[4:]) <= c.seq else []:
                if part[5:] not in parts:
                    self.files.delete(f"log/{n}/{part}")
        for n in self.files.list("base"):
            if n not in bases and int(n.split("-")[0]) < c.seq:
                self.files.delete(f"base/{n}")
        return oldest

    # planes

    def _planes(self, change: Callable[[dict], None]) -> None:
        c = self.commit()
        planes = json.loads(json.dumps(c.planes))
        change(planes)
        self.publish(None, c, {"planes": planes})

    def create_plane(self, name: str, props: dict | None = None) -> None:
        def change(planes: dict) -> None:
            if name in planes:
                raise Conflict(f"plane {name!r} exists")
            planes[name] = {"id": 1 + max(self._plane_ids()), "props": props or {}}

        self._planes(change)

    def _plane_ids(self) -> list[int]:
        return [p["id"] for s in self.sequences() for p in self.commit(s).planes.values()]

    def drop_plane(self, name: str) -> None:
        """Remove a plane with all it holds; one that is not there is fine."""
        if name == STARTUP:
            raise ValueError("the startup plane cannot be dropped")
        c = self.commit()
        if name not in c.planes:
            return
        own = c.planes[name]["id"]
        gone = self.records("node", c.seq, own).unionByName(self.records("edge", c.seq, own)).withColumn("op", F.lit("delete"))
        self.publish(cut(gone, "dropped"), c, {"planes": {k: v for k, v in c.planes.items() if k != name}})

    def rename_plane(self, name: str, to: str) -> None:
        def change(planes: dict) -> None:
            if name == STARTUP:
                raise ValueError("the startup plane cannot be renamed")
            if name not in planes:
                raise NotFound(f"no plane {name!r}")
            if to in planes:
                raise Conflict(f"plane {to!r} exists")
            planes[to] = planes.pop(name)

        self._planes(change)

    def set_plane_props(self, name: str, props: dict) -> None:
        def change(planes: dict) -> None:
            if name not in planes:
                raise NotFound(f"no plane {name!r}")
            planes[name]["props"] = props

        self._planes(change)

    # copies

    def snapshot(self, path: str, seq: int | None = None) -> None:
        """All planes of a version, with ids, as one Parquet folder and its commit."""
        seq = self.resolve(seq)
        self.records("node", seq).unionByName(self.records("edge", seq)).write.parquet(f"{path.rstrip('/')}/records")
        Files(self.spark, path).publish("commit.json", json.dumps(asdict(self.commit(seq))))

    def restore(self, path: str) -> None:
        """Load a snapshot into this store, which must be empty."""
        c = self.commit()
        if c.next_id != 1 or c.seq and not self.records("node", c.seq).isEmpty():
            raise Conflict("a snapshot is restored into an empty store only")
        kept = json.loads(Files(self.spark, path).read("commit.json"))
        records = self.spark.read.schema(RECORD).parquet(f"{path.rstrip('/')}/records").withColumn("op", F.lit("create"))
        self.publish(records, c, {k: kept[k] for k in ("next_id", "planes", "types", "indexes", "counters")})


def newest(old: DataFrame, later: DataFrame | None, order: str) -> DataFrame:
    """Of each id the row that is last in an order, with the columns of RECORD; ids whose last row deletes are left out.
    Rows of old come before those of later and have no id twice, so the ids of later alone say which rows are
    overtaken: few ids are sent to the rows, and columns that nobody reads are not read."""
    every = old
    if later is not None:
        last = later.groupBy("id").agg(F.max(order).alias("__last"))
        every = old.unionByName(later).join(last, "id", "left").filter(F.col("__last").isNull() | (F.col(order) == F.col("__last")))
    return every.filter("op <> 'delete'").select(*RECORD.fieldNames())


def numbered(df: DataFrame, start: int, name: str = "id") -> tuple[DataFrame, int]:
    """df with contiguous numbers from start, and their count. Partitions number their own rows; only a count of each
    partition reaches the driver."""
    part = cut(df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    sizes = {r["__part"]: r["n"] for r in part.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, at = {}, start
    for p in sorted(sizes):
        base[p], at = at, at + sizes[p]
    if not base:
        return part.drop("__part", "__at").withColumn(name, F.lit(0).cast("bigint")), 0
    starts = df.sparkSession.createDataFrame(pa.table({"__part": pa.array(base.keys(), pa.int32()), "__start": pa.array(base.values(), pa.int64())}))
    # monotonically_increasing_id counts rows inside a partition in its low 33 bits
    place = F.col("__at").bitwiseAND(F.lit(2**33 - 1))
    return part.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + place).drop("__part", "__at", "__start"), at - start
