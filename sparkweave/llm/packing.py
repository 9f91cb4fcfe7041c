"""Best-fit packing under conflicts: no bin holds two documents of one source or of one duplicate cluster.

Documents are dealt by a hash of their id into shards of about SHARD_ROWS rows (their number follows the rows, so
a shard stays bounded at any size, and a source or cluster that holds a third of all rows is dealt evenly). A shard
is packed by decreasing length. Its bins are kept in order of their residual room, each with a bitmap of its
sources and one of its clusters; the successor of a length is the tightest residual with a bin whose source bitmap
allows it, and the search goes on to the next residual until a bin of it is free of the cluster too, else a bin is
opened. Texts longer than a bin are cut into parts: whole parts fill bins of their own and the rest is packed.

Lengths are those of a column that the caller names (such as the tokens a document has in token files), or words; null
or negative ones are 0. Clusters are a column named by the caller, or the classes that the caller gives for its values;
where it names none or holds null, they are texts of the same words (64-bit key).

Edge cases: texts without words take no room and sit in a bin under the same rules. Null sources are one source
each (no conflict). Ties go to the smaller id, then the earlier bin. Repeated rows are packed each. A table without
rows gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Words, mapped, record, sequence_key, signed

CAPACITY = 2048
SHARD_ROWS = 10_000
PACKED = "doc_id long, part int, bin_id long, bin_offset int, n_tokens int, source string, cluster long"


def pack_shard(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken in the given order. A source of -1 conflicts with none."""
    n_sources = int(sources.max(initial=-1)) + 1
    total = np.zeros(capacity + 1, np.int32)  # bins by residual
    holding = np.zeros((n_sources, capacity + 1), np.int32)  # of them, those with the source
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    source_map: list[int] = []
    cluster_map: list[int] = []
    members: list[list[int]] = []
    room: list[int] = []
    where, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k in range(len(lengths)):
        need, source, cluster = int(lengths[k]), int(sources[k]), int(clusters[k])
        free = total[need:] - holding[source, need:] if source >= 0 else total[need:]
        bit, mark, found = 1 << source if source >= 0 else 0, 1 << cluster, -1
        for residual in np.flatnonzero(free > 0) if len(free) else ():
            for b in bins[residual + need]:
                if not source_map[b] & bit and not cluster_map[b] & mark:
                    found = b
                    break
            if found >= 0:
                break
        if found < 0:
            found = len(room)
            room.append(capacity)
            source_map.append(0)
            cluster_map.append(0)
            members.append([])
        else:
            bins[room[found]].remove(found)
            total[room[found]] -= 1
            for s in members[found]:
                holding[s, room[found]] -= 1
        where[k], at[k] = found, capacity - room[found]
        room[found] -= need
        source_map[found] |= bit
        cluster_map[found] |= mark
        if source >= 0:
            members[found].append(source)
        left = room[found]
        bins[left].append(found)
        total[left] += 1
        for s in members[found]:
            holding[s, left] += 1
    return where, at


def _pack(capacity: int):
    def fn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard = key[0]
        length = pdf["n_tokens"].to_numpy()
        whole, rest = length // capacity, length % capacity
        whole = np.where((rest == 0) & (whole > 0), whole - 1, whole)
        rest = length - whole * capacity
        order = np.lexsort((pdf["cluster"].to_numpy(), pdf["doc_id"].to_numpy(), -rest))
        sources = pd.factorize(pdf["source"])[0]
        clusters = pd.factorize(pdf["cluster"])[0]
        where, at = pack_shard(rest[order], sources[order], clusters[order], capacity)
        parts = np.concatenate([whole[order], np.concatenate([np.arange(w) for w in whole]) if len(whole) else []]).astype(np.int32)
        rows = np.concatenate([order, np.repeat(np.arange(len(pdf)), whole)])
        extra = np.arange(int(whole.sum())) + (where.max(initial=-1) + 1)
        out = pdf.iloc[rows].reset_index(drop=True)
        return pd.DataFrame(
            {
                "doc_id": out["doc_id"],
                "known": out["known"],
                "part": parts,
                "bin_id": (np.int64(shard) << 32) + np.concatenate([where, extra]),
                "bin_offset": np.concatenate([at, np.zeros(len(extra), np.int64)]),
                "n_tokens": np.concatenate([rest[order], np.full(len(extra), capacity)]),
                "source": out["source"],
                "cluster": out["cluster"],
            }
        )

    return fn


def _lengths():
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("named", pa.int64()), ("n_tokens", pa.int64()), ("cluster", pa.int64()), ("n_words", pa.int64())])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        size = words.n if "size" not in batch.schema.names else np.maximum(pc.fill_null(batch.column("size"), 0).to_numpy(zero_copy_only=False), 0)
        return record(schema, batch.column("doc_id"), batch.column("source"), batch.column("named"), size, signed(sequence_key(words.hashes()[words.codes], words.first, 1)), words.n)

    return fn


def _named(docs: DataFrame, cluster: str | None):
    """The cluster column as a long: integers as they are, other values by hash, null where there is none."""
    if cluster is None:
        return F.lit(None).cast("long")
    if isinstance(docs.schema[cluster].dataType, IntegralType):
        return F.col(f"`{cluster}`").cast("long")
    return F.when(F.col(f"`{cluster}`").isNotNull(), F.xxhash64(F.col(f"`{cluster}`")))


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, cluster: str | None = None, classes: DataFrame | None = None, length: str | None = None) -> DataFrame:
    """One row for each part of each document: doc_id, part, bin_id, bin_offset, n_tokens, source, cluster.

    length names a column of docs, cluster another. With classes (id, class; ids distinct), that column holds ids and a document's
    cluster is the class of its id, so that no text is shuffled to learn it."""
    shards = max(1, -(-docs.count() // shard_rows))
    rows = docs.select("text", "doc_id", F.col("source").cast("string").alias("source"), _named(docs, cluster).alias("named"), *([F.col(f"`{length}`").cast("long").alias("size")] if length else []))
    rows = mapped(rows, _lengths(), "doc_id long, source string, named long, n_tokens long, cluster long, n_words long")
    if classes is not None:
        rows = rows.join(classes.select(F.col("id").alias("named"), "class").hint("merge"), "named", "left").withColumn("named", F.col("class")).drop("class")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)))
    # a text without words is in no cluster with others
    rows = rows.withColumn("cluster", F.coalesce("named", F.when(F.col("n_words") > 0, F.col("cluster")).otherwise(F.xxhash64("doc_id")))).drop("named", "n_words")
    # pandas has no nulls among integers
    rows = rows.withColumn("known", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)))
    packed = rows.groupBy("shard").applyInPandas(_pack(capacity), PACKED.replace(", part", ", known boolean, part"))
    return packed.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")
