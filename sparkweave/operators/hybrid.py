"""Hybrid retrieval: vector, keyword and graph-proximity channels, normalised and fused.

Each channel holds at most `candidates` rows (the graph channel what its hops reach), so the fused part is small; the
work is in the channels themselves, which are top-k scans and joins of a frontier with the edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import model as M
from ..sources.graph import Graph
from ..storage import cut
from . import keyword

#: Scores that differ by no more than this are equally good.
EPSILON = 1.1920929e-07


def run(graph: Graph, spec: M.Hybrid) -> DataFrame:
    """id, score, vector, keyword, graph (raw channel scores; NULL where the channel lacks the node); the k best."""
    from .lowering import vector_top_k

    channels: dict[str, tuple[DataFrame, bool, float]] = {}
    labels = frozenset([spec.label]) if spec.label is not None else None
    if spec.vector:
        v = spec.vector
        hits = vector_top_k(graph, labels, v.property, v.query, v.metric, spec.candidates).select("id", F.col("distance").alias("raw"))
        channels["vector"] = cut(hits, "channel"), False, spec.weights.vector
    if spec.keyword:
        if spec.label is None:
            raise ValueError("the hybrid keyword channel requires a label")
        hits = keyword.top_k(graph, spec.label, spec.keyword.property, spec.keyword.query, spec.candidates)
        channels["keyword"] = cut(hits.select("id", F.col("score").alias("raw")), "channel"), True, spec.weights.keyword
    if spec.graph:
        seeds = top_seeds(channels, spec.graph.seeds)
        if seeds is None:
            near = graph.spark.createDataFrame([], "id long, raw double")
        else:
            near = proximity(graph, seeds, spec.graph.hops, spec.graph.decay)
        channels["graph"] = near, True, spec.weights.graph
    return fuse(graph, channels, spec.k)


def top_seeds(channels: dict, n: int) -> DataFrame | None:
    """The n best of each primary channel, each node once."""
    tops = [df.orderBy(F.desc("raw") if higher else "raw", "id").limit(n).select("id") for df, higher, _ in channels.values()]
    return reduce(DataFrame.union, tops).distinct() if tops else None


def proximity(graph: Graph, seeds: DataFrame, hops: int, decay: float) -> DataFrame:
    """id and decay ** distance of the nodes within `hops` undirected edges of a seed."""
    reached = cut(seeds.select("id", F.lit(0).alias("d")), "reached")
    frontier = reached
    around = graph.adjacency("Both", None)
    for d in range(1, hops + 1):
        new = frontier.select(F.col("id").alias("near")).join(around, "near").select(F.col("far").alias("id")).distinct()
        frontier = cut(new.join(reached, "id", "left_anti").select("id", F.lit(d).alias("d")), "reached")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.select("id", F.pow(F.lit(float(decay)), F.col("d")).alias("raw"))


def normalised(df: DataFrame, higher: bool) -> DataFrame:
    """Adds norm: 0 to 1 with the best at 1; all 1 if scores do not differ."""
    lo, hi = df.agg(F.min("raw"), F.max("raw")).first()
    if lo is None or hi - lo <= EPSILON:
        return df.select("id", "raw", F.lit(1.0).alias("norm"))
    return df.select("id", "raw", ((F.col("raw") - lo if higher else hi - F.col("raw")) / (hi - lo)).alias("norm"))


def fuse(graph: Graph, channels: dict, k: int) -> DataFrame:
    """Union of the channels' nodes by weighted sum of their normalised scores; ties by id."""
    names = ("vector", "keyword", "graph")
    parts = []
    for name, (df, higher, weight) in channels.items():
        n = normalised(df, higher).withColumn("part", F.col("norm") * F.lit(float(weight)))
        parts.append(n.select("id", "part", *(F.col("raw").alias(x) if x == name else F.lit(None).cast("double").alias(x) for x in names)))
    if not parts:
        return graph.spark.createDataFrame([], "id long, score double, vector double, keyword double, graph double")
    every = reduce(DataFrame.unionByName, parts)
    out = every.groupBy("id").agg(F.sum("part").alias("score"), *(F.max(x).alias(x) for x in names))
    return out.orderBy(F.desc("score"), "id").limit(k)
