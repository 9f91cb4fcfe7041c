"""Embedding near-dedup: pairs of vectors with a cosine of 0.9 or more, by collision-counting projections.

Vectors are projected on many random lines. The signs of some projections choose the cells in which vectors meet
(their number grows with the logarithm of the rows, so a cell keeps about `cell_rows` of them). A cell's rows are sorted
by one projection, and each row looks only at those in the window of that line that is centred on it; for these pairs
the other lines count in how many of them one also lies in the window centred on the other. A pair that
collides in at least `least_collisions` lines is verified by its cosine in double precision. Windows and
threshold are calibrated so that a pair at the similarity itself passes with probability over 0.998; the number
of tables of cells is chosen so that it shares a cell with probability `recall`. Closer pairs pass more often.

A pair counts in the first table in which both share a cell, so links are counted without pairs being gathered:
a cell returns a number of links for each vector and a spanning forest of its links. Cells over `block_rows` are
dealt out as pairs of blocks, so none is gathered in one task. Equal vectors are collapsed to one row first. A task
reads its cells in sorted order as one stream, some thousand rows at a time.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors
of different lengths do not link; components of any finite magnitude count (a vector is divided by its largest
component first). Repeated vec_ids are vectors of their own; each of them is kept where its vec_id is its
component_id. Labels and other columns are not read. A table without rows gives no rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from .common import cut, cut_counted, discard, record

SIMILARITY = 0.9
LINES = 24
#: Large cells (five numbers each) that are sent to every task; more are joined by a shuffle.
BROADCAST_CELLS = 100_000
SEED = 97


def calibrated(similarity: float, lines: int = LINES, miss: float = 5e-4) -> tuple[float, float, int]:
    """Windows (for unit vectors and standard normal lines) on the line that is sorted and on the others, and the least
    number of collisions on the others. Each of the two steps loses a pair at the similarity with probability `miss`."""
    spread = math.sqrt(2 - 2 * similarity)
    first = NormalDist().inv_cdf(1 - miss / 2) * spread
    window = 1.6 * spread
    p = math.erf(window / spread / math.sqrt(2))
    total, least = 0.0, 0
    for k in range(lines + 1):
        total += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if total > miss:
            least = k
            break
    return first, window, least


def tables_for(rows: int, similarity: float, recall: float, cell_rows: int) -> tuple[int, int]:
    """Signs in a cell's key, and tables of cells."""
    bits = max(0, min(24, math.ceil(math.log2(max(rows, 1) / cell_rows))))
    same = (1 - math.acos(similarity) / math.pi) ** bits
    tables = 1 if bits == 0 else math.ceil(math.log(1 - recall) / math.log(1 - same))
    return bits, tables


def _gauss(seed: int, dim: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, n))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component, so that squares neither overflow nor vanish."""
    return x / np.abs(x).max(axis=1)[:, None]


def _units(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _matrix(blobs: pa.Array, dim: int, kind: type) -> np.ndarray:
    """Vectors of one length from their bytes."""
    lo, hi = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, blobs.offset * 4)[[0, -1]]
    return np.frombuffer(blobs.buffers()[2], np.uint8)[lo:hi].view(kind).reshape(-1, dim).astype(np.float64)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    ends = (np.arange(len(rows) + 1) * rows[0].nbytes if len(rows) else np.zeros(1)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


KEYED = pa.schema([("rid", pa.int64()), ("copies", pa.int64()), ("dim", pa.int32()), ("vector", pa.binary()), ("cells", pa.list_(pa.int32()))])


def _keys(bits: int, tables: int, kind: type):
    """Rows (rid, copies, vector) to KEYED: the vector's bytes (as `kind`, which holds it exactly) and its cell in each
    table."""

    def run(batches):
        for batch in batches:
            vectors = batch.column("vector")
            off = vectors.offsets.to_numpy()
            flat = vectors.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False)
            size = np.diff(off)
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                raw = flat[(off[own] - off[0])[:, None] + np.arange(dim)]
                x = _scaled(raw)
                cells = np.zeros((len(x), tables), np.int64)
                if bits:
                    signs = (x @ _gauss(SEED, int(dim), bits * tables) >= 0).reshape(len(x), tables, bits)
                    cells = (signs * (1 << np.arange(bits))).sum(axis=2)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(cells.astype(np.int32).ravel()))
                rid, copies = (batch.column(c).to_numpy()[own] for c in ("rid", "copies"))
                yield record(KEYED, rid, copies, np.full(len(x), dim, np.int32), _binary(raw.astype(kind)), lists)

    return run


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links make a forest."""
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    keep = np.zeros(len(a), bool)
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        i, j = find(i), find(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
            keep[k] = True
    return keep


def linked_pairs(x: np.ndarray, side: np.ndarray, similarity: float, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the rows of unit vectors x that are linked. Side 0: all among themselves; sides 1 and 2: each
    of one with each of the other. lines: projections of x, of which the first is sorted."""
    first, window, least = calibrated(similarity)
    order = np.argsort(lines[:, 0])
    left, right = order[side[order] != 2], order[side[order] != 1]
    on, along = lines[left, 0], lines[right, 0]
    whole = not side.any()
    # a row of the sorted line meets the ones in its window: after it only, where both sides are one
    begin = np.arange(len(left)) + 1 if whole else np.searchsorted(along, on - first, "left")
    end = np.searchsorted(along, on + first, "right")
    one, two = [], []
    at = 0
    while at < len(left):
        last = at + 1
        while last < len(left) and (last - at + 1) * (end[last] - begin[at]) <= STRIP and last - at < STRIP_ROWS:
            last += 1
        rows, others = left[at:last], right[begin[at] : end[last - 1]]
        if len(others):
            hits = np.zeros((len(rows), len(others)), np.int8)
            for line in range(1, lines.shape[1]):
                hits += np.abs(lines[rows, line][:, None] - lines[others, line][None, :]) <= window
            place = np.arange(begin[at], end[last - 1])
            i, j = np.nonzero((hits >= least) & (place >= begin[at:last, None]) & (place < end[at:last, None]))
            good = np.einsum("ij,ij->i", x[rows[i]], x[others[j]]) >= similarity
            one.append(rows[i[good]])
            two.append(others[j[good]])
        at = last
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *one]), np.concatenate([none, *two])


#: Pairs, and rows of the sorted line, that are compared at a time.
STRIP, STRIP_ROWS = 1_000_000, 128
#: Rows of sorted cells that a task looks at together, more only where a block of one cell has more.
PIECE_ROWS = 4_000
GROUP = ("dim", "tab", "cell", "i", "j")
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _compare(similarity: float, kind: type):
    """Rows sorted by GROUP to links: (a, a, number) for each vector, and (a, b, 0) for a forest."""

    def group(rows: pa.Table) -> pa.RecordBatch:
        table, dim = rows.column("tab")[0].as_py(), rows.column("dim")[0].as_py()
        rid, copies, side = (rows.column(c).to_numpy() for c in ("rid", "copies", "side"))
        cells = rows.column("cells").combine_chunks().flatten().to_numpy().reshape(len(rid), -1)
        x = _units(_matrix(rows.column("vector").combine_chunks(), dim, kind))
        i, j = linked_pairs(x, side, similarity, x @ _gauss(SEED + 1 + table, dim, LINES + 1))
        if table:
            new = ~(cells[i, :table] == cells[j, :table]).any(axis=1)
            i, j = i[new], j[new]
        links = np.bincount(i, weights=copies[j], minlength=len(rid)) + np.bincount(j, weights=copies[i], minlength=len(rid))
        some, keep = np.flatnonzero(links), spanning(i, j, len(rid))
        zero = np.zeros(int(keep.sum()), np.int64)
        return record(LINKS, np.concatenate([rid[some], rid[i[keep]]]), np.concatenate([rid[some], rid[j[keep]]]), np.concatenate([links[some].astype(np.int64), zero]))

    def groups(table: pa.Table, last: bool):
        """Results of the whole groups, and how many rows they have; the last one may go on in the next batch."""
        keys = np.stack([table.column(c).to_numpy() for c in GROUP])
        starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
        if not last:
            starts = starts[:-1]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a > 1:
                yield group(table.slice(a, b - a))
        yield int(starts[-1])

    def run(batches):
        held, rows, enough = [], 0, PIECE_ROWS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= enough:
                table = pa.Table.from_batches(held)
                *done, used = groups(table, False)
                yield from done
                held = table.slice(used).to_batches()
                rows -= used
                enough = max(PIECE_ROWS, 2 * rows)
        if rows:
            *done, _ = groups(pa.Table.from_batches(held), True)
            yield from done

    return run


def embedding_near_duplicates(
    vectors: DataFrame, similarity: float = SIMILARITY, recall: float = 0.998, cell_rows: int = 200, block_rows: int = 4_000
) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept."""
    kind = np.float32 if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else np.float64
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    odd = rows.groupBy("vec_id").count().filter("count > 1 or vec_id is null").limit(1)
    if odd.isEmpty():
        rows = rows.withColumn("rid", F.col("vec_id"))
    else:
        ordered = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
        rows = cut(ordered.withColumn("rid", F.monotonically_increasing_id()), "rows")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = rows.filter(usable).select("rid", F.col("embedding").alias("vector"))
    same = cut(valid.groupBy("vector").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    total = same.count()
    bits, tables = tables_for(total, similarity, recall, cell_rows)
    keyed = same.select(F.col("rep").alias("rid"), "copies", "vector").mapInArrow(_keys(bits, tables, kind), "rid long, copies long, dim int, vector binary, cells array<int>")
    keyed = cut(keyed, "cells")
    sizes = keyed.select("dim", F.posexplode("cells").alias("tab", "cell")).groupBy("dim", "tab", "cell").count()
    large, n = cut_counted(sizes.filter(F.col("count") > block_rows).withColumn("blocks", F.ceil(F.col("count") / block_rows).cast("int")), "sizes")
    located = keyed.select("rid", "copies", "dim", "vector", "cells", F.posexplode("cells").alias("tab", "cell"))
    if n:
        located = located.join(F.broadcast(large) if n <= BROADCAST_CELLS else large.hint("merge"), ["dim", "tab", "cell"], "left")
    located = located.withColumn("blocks", F.coalesce("blocks", F.lit(1)) if n else F.lit(1)).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    # block pairs (i, j): a row of block i goes to (i, i), to (i, j) as side 1 and to (j, i) as side 2
    seats = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"), F.when(k == F.col("block"), 0).when(F.col("block") < k, 1).otherwise(2).alias("side")),
    )
    seated = located.withColumn("seat", F.explode(seats)).select("rid", "copies", "dim", "vector", "cells", "tab", "cell", "seat.i", "seat.j", "seat.side")
    ordered = seated.repartition(*GROUP).sortWithinPartitions(*GROUP, "rid")
    found = cut(ordered.mapInArrow(_compare(similarity, kind), "a long, b long, links long"), "links")
    discard(keyed, large)
    counts = found.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("a <> b").select("a", "b"))
    members = valid.join(same.hint("merge"), "vector").select("rid", "rep", "copies")
    members = members.join(counts.hint("merge"), "rep", "left").join(parts.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left")
    members = members.select("rid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "rid").join(members.hint("merge"), "rid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "rid").alias("component"))
    if odd.isEmpty():
        out = out.withColumnRenamed("component", "component_id")
    else:
        names = rows.select(F.col("rid").alias("component"), F.col("vec_id").alias("component_id"))
        out = out.join(names.hint("merge"), "component", "left")
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
