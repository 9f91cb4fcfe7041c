"""The change feed: Structured Streaming over a store's commits.

The stream's source is the folder of commit files, which appear only after a commit's data is complete; each micro-batch
joins its few commits with their log partitions. State is bounded by a commit, so no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.values import RANK
from ..sources.store import STARTUP, Store

#: Changes of a commit that are listed; `truncated` tells of more.
CAP = 256


def net_changes(log: DataFrame) -> DataFrame:
    """One change for each (seq, kind, id) of a log of steps (with `ord`): created and deleted again cancels."""
    ends = log.groupBy("seq", "kind", "id").agg(F.min_by("op", "ord").alias("began"), F.max_by("op", "ord").alias("ended"))
    op = F.when(F.col("ended") == "delete", "delete").when(F.col("began") == "create", "create").otherwise("update")
    return ends.filter("not (began = 'create' and ended = 'delete')").select("seq", "kind", "id", op.alias("op"))


def shown(changes: DataFrame, cap: int = CAP) -> DataFrame:
    """What a follower sees: vectors and properties that begin with _ are left out, a deleted entity is its id alone,
    and a commit lists its first `cap` changes (nodes first, by id)."""
    gone = F.col("op") == "delete"
    props = F.map_filter("props", lambda k, v: ~k.startswith("_") & (v["t"] != RANK["vector"]))
    out = changes.select("seq", "plane", "kind", "op", "id", *(F.when(~gone, F.col(c)).alias(c) for c in ("key", "labels", "src", "dst", "type")), F.when(~gone, props).alias("props"))
    # bounded before it is sorted: each partition of a commit keeps `cap` rows at most (window group limit)
    w = Window.partitionBy("seq").orderBy(F.when(F.col("kind") == "node", 0).otherwise(1), "id")
    sizes = changes.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    first = out.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= cap)
    return first.join(sizes, "seq").select(*out.columns, (F.col("n") > cap).alias("truncated"))


def changes_of(store: Store, seqs: list[int], plane: str | None = None) -> DataFrame:
    """The changes of some commits."""
    rows = store.changes([int(s) for s in seqs])
    if plane is not None:
        rows = rows.filter(F.col("plane") == store.commit().planes[plane]["id"])
    return rows


def follow(store: Store, handle: Callable[[DataFrame], None], checkpoint: str, plane: str = STARTUP, label: str | None = None, since: int = 0, once: bool = False) -> StreamingQuery:
    """Call handle with the changes of each batch of commits after `since`. With a label, only changes of nodes that
    carry it; edges are on unfiltered feeds only. `once` ends when all commits are read."""

    def batch(commits: DataFrame, _: int) -> None:
        seqs = [r["seq"] for r in commits.filter(F.col("seq") > since).select("seq").distinct().collect()]  # a number a commit
        if not seqs:
            return
        found = changes_of(store, seqs, plane)
        if label is not None:
            found = found.filter((F.col("kind") == "node") & F.array_contains("labels", label))
        handle(shown(found))

    stream = store.spark.readStream.schema("seq long, ts_ms long").option("maxFilesPerTrigger", 100).json(f"{store.path}/commits")
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def replicate(source: Store, target: Store, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Apply the commits of source to target at their own sequence; one that is there already is skipped, so a batch
    that is run again changes nothing. A gap (history that source no longer keeps) asks for a full copy."""
    def batch(commits: DataFrame, _: int) -> None:
        for seq in sorted(r["seq"] for r in commits.select("seq").distinct().collect()):
            have = target.latest()
            if seq <= have:
                continue
            if seq != have + 1:
                raise RuntimeError(f"commit {have + 1} is gone: copy the store anew")
            target.copy_commit(source.changes([seq]).drop("seq"), source.commit(seq))

    stream = source.spark.readStream.schema("seq long, ts_ms long").json(f"{source.path}/commits")
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
