"""Nearest vectors for many queries at once: exact in blocks, and approximate through an inverted file.

Exact: a block of queries (bounded by BLOCK_FLOATS) is broadcast; each task multiplies its Arrow batches with it and
keeps its own k best of each query, so k rows a query and task are shuffled.
Inverted file: centroids are fitted on a bounded sample; every vector is indexed under its nearest one, in a table
ordered by list; a query looks into the lists of its `probes` nearest centroids. A block of queries is broadcast with its
lists, only those lists are read, and a task keeps its own k best of each query, however long a list is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

BLOCK_FLOATS = 4_000_000
#: Distances that a task holds at a time, and rows of them at least.
CELLS, ROWS = 1_000_000, 512
#: Vectors that centroids are fitted on.
SAMPLE = 20_000


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Rows of x against rows of q."""
    if metric == "L2":
        d = (x * x).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * (x @ q.T)
        return np.sqrt(np.maximum(d, 0))
    dots = x @ q.T
    if metric == "Dot":
        return -dots
    norms = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((q * q).sum(axis=1))[None, :]
    cosines = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
    return np.subtract(1, np.clip(cosines, -1, 1, out=cosines), out=cosines)


def batch_top_k(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "Cosine") -> DataFrame:
    """query, id, distance: for each query (id, vector) its k nearest vectors (id, vector); ties by id. Vectors of
    another length than the query's are skipped."""
    rows = queries.select("id", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null and size(vector) > 0").orderBy("id")
    parts = [_block(vectors.select("id", "vector"), b, k, metric) for b in _blocks(rows)]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], FOUND)


FOUND = "query long, id long, distance double"


def _blocks(rows: DataFrame) -> Iterator[list[tuple[int, list[float]]]]:
    """Queries (id, vector) of one length, in blocks of a bounded size; they pass through the driver one at a time."""
    block, floats = [], 0
    for r in rows.toLocalIterator():
        if block and (floats + len(r["vector"]) > BLOCK_FLOATS or len(r["vector"]) != len(block[0][1])):
            yield block
            block, floats = [], 0
        block.append((r["id"], r["vector"]))
        floats += len(r["vector"])
    if block:
        yield block


def _block(vectors: DataFrame, block: list, k: int, metric: str, probed: list[np.ndarray] | None = None) -> DataFrame:
    """The k nearest rows (id, vector) of each query; with probed (the queries that look into each list), rows have a
    list too and meet only these."""
    ids = np.array([b[0] for b in block], np.int64)
    q = np.array([b[1] for b in block], np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q, probed))

    def merge(best: np.ndarray, who: np.ndarray, d: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        limit = best[:, k - 1]
        if d.shape[1] > k:
            # all within the k-th distance stay, so that ties are decided by id
            limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
            keep = np.flatnonzero((d <= limit[:, None]).any(axis=0))
            d, names = d[:, keep], names[keep]
        every, whose = np.concatenate([best, d], axis=1), np.concatenate([who, np.broadcast_to(names, d.shape)], axis=1)
        order = np.lexsort((whose, every), axis=1)[:, :k]
        return np.take_along_axis(every, order, 1), np.take_along_axis(whose, order, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, probed = shared.value
        best = np.full((len(ids), k), np.inf)
        who = np.full((len(ids), k), np.iinfo(np.int64).max)
        for pdf in batches:
            pdf = pdf[[v is not None and len(v) == q.shape[1] for v in pdf["vector"]]]
            if not len(pdf):
                continue
            groups = [(np.arange(len(ids)), pdf)] if probed is None else [(probed[n], part) for n, part in pdf.groupby("list")]
            for asked, rows in groups:
                step = max(ROWS, CELLS // max(len(asked), 1))
                for at in range(0, len(rows), step) if len(asked) else ():
                    part = rows.iloc[at : at + step]
                    x, names = np.array(part["vector"].tolist(), np.float64), part["id"].to_numpy(np.int64)
                    some = max(1, CELLS // len(part))
                    for one in (asked[i : i + some] for i in range(0, len(asked), some)):
                        best[one], who[one] = merge(best[one], who[one], _distances(x, q[one], metric).T, names)
        row, col = np.nonzero(np.isfinite(best))
        yield pd.DataFrame({"query": ids[row], "id": who[row, col], "distance": best[row, col]})

    found = vectors.withColumn("vector", F.col("vector").cast("array<double>")).mapInPandas(run, "query long, id long, distance double")
    w = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).drop("n")


@dataclass
class InvertedFile:
    centroids: np.ndarray
    lists: DataFrame  # list, id, vector
    metric: str


def build(vectors: DataFrame, lists: int = 64, metric: str = "Cosine", sample: int = SAMPLE, rounds: int = 10, seed: int = 1) -> InvertedFile:
    """An index of vectors (id, vector) of one length; every row is indexed."""
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null and size(vector) > 0")
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    x = np.array([r["vector"] for r in some], np.float64)
    if not len(x):
        return InvertedFile(np.zeros((0, 0)), rows.select(F.lit(0).alias("list"), "id", "vector"), metric)
    if metric == "Cosine":
        x /= np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    centroids = x[np.random.default_rng(seed).permutation(len(x))[: min(lists, len(x))]]
    for _ in range(rounds):
        home = _nearest(x, centroids, metric)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        n = np.bincount(home, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return InvertedFile(centroids, _written(_listed(rows, centroids, metric)), metric)


def _written(lists: DataFrame) -> DataFrame:
    """In the order of lists, so that a search reads the row groups of its own."""
    return cut(lists.repartitionByRange("list", "id").sortWithinPartitions("list", "id"), "lists")


def _listed(rows: DataFrame, centroids: np.ndarray, metric: str) -> DataFrame:
    dim = centroids.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[len(v) == dim for v in pdf["vector"]]]
            if len(pdf):
                yield pd.DataFrame({"list": _nearest(np.array(pdf["vector"].tolist(), np.float64), shared.value, metric).astype(np.int32), "id": pdf["id"], "vector": pdf["vector"]})

    return rows.mapInPandas(run, "list int, id long, vector array<double>")


def upsert(index: InvertedFile, vectors: DataFrame) -> InvertedFile:
    """The index after rows (id, vector) are put in place of those of the same id; a null vector removes one. Centroids
    stay as they were fitted; an index without any is built anew."""
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    rest = index.lists.join(rows.select("id").distinct(), "id", "left_anti")
    new = rows.filter("vector is not null and size(vector) > 0")
    if not len(index.centroids):
        return build(rest.select("id", "vector").unionByName(new), metric=index.metric)
    return InvertedFile(index.centroids, _written(rest.select("list", "id", "vector").unionByName(_listed(new, index.centroids, index.metric))), index.metric)


def _nearest(x: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    return _distances(x, centroids, "Cosine" if metric == "Cosine" else "L2").argmin(axis=1)


#: Lists that a query looks into.
PROBES = 16


def search(index: InvertedFile, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
    """query, id, distance: approximately the k nearest of each query (id, vector)."""
    rows = queries.select("id", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null and size(vector) > 0").orderBy("id")
    parts = [_probe(index, b, k, probes) for b in _blocks(rows)]
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], FOUND)


def nearest(index: InvertedFile, query: list[float], k: int, probes: int = PROBES) -> DataFrame:
    """id and distance of approximately the k nearest of one query."""
    found = _probe(index, [(0, list(query))], k, probes)
    return (index.lists.sparkSession.createDataFrame([], FOUND) if found is None else found).select("id", "distance")


def _probe(index: InvertedFile, block: list, k: int, probes: int) -> DataFrame | None:
    c = index.centroids
    if not len(c) or len(block[0][1]) != c.shape[1]:
        return None
    d = _distances(np.array([b[1] for b in block], np.float64), c, "Cosine" if index.metric == "Cosine" else "L2")
    n = min(probes, len(c))
    near = np.argpartition(d, n - 1, axis=1)[:, :n]
    probed = [np.flatnonzero((near == i).any(axis=1)) for i in range(len(c))]
    wanted = [i for i, p in enumerate(probed) if len(p)]
    return _block(index.lists.filter(F.col("list").isin(wanted)) if len(wanted) < len(c) else index.lists, block, k, index.metric, probed)
