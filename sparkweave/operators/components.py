"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round joins tables that were written before, so both sides of each join are plain exchanges and AQE can
split a node that holds a large share of the links; minima are partially aggregated before they are shuffled.
The number of rounds grows with the logarithm of a component's diameter. Nothing is gathered on the driver but
one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, cut_counted

MAX_ROUNDS = 60


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node of a link; component is the smallest id that links reach. Links are
    undirected; repeated links, self-links and links with a null end are allowed (a self-link makes its node
    a component, a null end is ignored)."""
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    edges, n = cut_counted(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    nodes = edges
    # a round's tables have no more rows than the links, so small ones stay in few files
    for _ in range(MAX_ROUNDS if n else 0):
        work = edges.filter("u <> v")
        both = work.union(work.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars", 2 * n)
        # large star: larger neighbours of u point to the smallest node around u
        large = both.filter("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u <> v").distinct(), "stars", 2 * n)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "stars", 2 * n)
        # small star: smaller neighbours of u, and u, point to the smallest of them
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links", 2 * n)
        rest = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if rest.isEmpty():
            break
    else:
        if n:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    ids = nodes.select(F.col("u").alias("id")).union(nodes.select(F.col("v").alias("id"))).distinct()
    return ids.join(edges.select(F.col("u").alias("id"), F.col("v").alias("m")), "id", "left").select("id", F.coalesce("m", "id").alias("component"))
