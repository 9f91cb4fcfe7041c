"""Headline queries, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


def load(spark, loaded: list[int]):
    """Customers, orders and the edges between them into a new store; appends how many rows that is."""
    from pyspark.sql import functions as F

    from sparkweave.catalogue_stores import folder, props
    from sparkweave.sources.graph import PROPS
    from sparkweave.sources.store import Store
    from sparkweave.sources.transaction import Transaction

    read = lambda t: spark.read.parquet(f"{SF_DIR}/{t}.parquet")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    c, o = read("customer"), read("orders")
    nodes = c.select(name("customer", "c_custkey").alias("key"), F.array(F.lit("Customer")).alias("labels"), props(name=("str", "c_name"), balance=("float", "c_acctbal")).alias("props"))
    nodes = nodes.union(o.select(name("order", "o_orderkey"), F.array(F.lit("Order")), props(price=("float", "o_totalprice"))))
    edges = o.select(name("customer", "o_custkey").alias("src_key"), name("order", "o_orderkey").alias("dst_key"), F.lit("PLACED").alias("type"), F.lit(None).cast(PROPS).alias("props"))
    store = Store(spark, folder(spark, "bench"))
    tx = Transaction(store)
    tx.bulk_load(nodes)
    tx.bulk_load_edges(edges)
    tx.commit()
    loaded.append(tx.summary.nodes_created + tx.summary.edges_created)
    return spark.range(1)


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from sparkweave import catalogue as C
    from sparkweave.operators import algorithms, catalog, keyword, vectors
    from sparkweave.operators.lowering import Query
    from sparkweave.plans.language import parse

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = C.doc_graph(spark, SF_DIR)
    items = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector").cache()
    n_items = items.count()
    # graphs are opened once, as a database is; each run plans and reads anew
    star, places, trade, one = C.graph(spark, SF_DIR), C.graph(spark, SF_DIR, C.PLACES), C.graph(spark, SF_DIR, ("Customer", "Order")), C.graph(spark, SF_DIR, ("Item",))
    rows = lambda text, g=star: Query(g, parse(text).plan).rows()
    # 128 numbers a row: pairs of the table's vectors, up to 100,000 rows
    pairs = items.alias("a").crossJoin(items.filter(F.col("id") < max(1, 100_000 // n_items)).alias("b"))
    wide = pairs.select((F.col("a.id") * 100_000 + F.col("b.id")).alias("id"), F.concat("a.vector", "b.vector").alias("vector")).cache()
    n_wide = wide.count()
    asked = wide.orderBy(F.xxhash64("id")).limit(1_000).cache()
    asked.count()
    index = vectors.build(wide, 256)
    keys = [f"order:{r[0]}" for r in spark.read.parquet(f"{SF_DIR}/orders.parquet").select("o_orderkey").orderBy(F.xxhash64("o_orderkey")).limit(10_000).collect()]
    loaded = []
    timed = {
        "flagship": lambda: rows(C.FLAGSHIP),
        "expand_1_hop_all": lambda: rows("MATCH (o:Order)-[:CONTAINS]->(p) RETURN p"),
        "expand_2_hop_distinct": lambda: rows("MATCH (c:Customer)-[:PLACED]->(o)-[:CONTAINS]->(p) RETURN DISTINCT p"),
        "vector_top10": lambda: rows(f"SEARCH (i:Item) NEAR {list(C.QUERY_VECTOR)} RETURN i", one),
        "vector_top10_batch": lambda: vectors.batch_top_k(items, items, 10),
        "bm25_top10": lambda: keyword.top_k(docs, "Doc", "text", C.KEYWORDS, 10),
        "pagerank_20": lambda: algorithms.pagerank(places, tolerance=0.0),
        "components": lambda: algorithms.components(trade),
        "degrees": lambda: algorithms.degrees(star),
        "catalog_connections": lambda: catalog.connections(star),
        "index_build": lambda: keyword.build(spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("doc_id AS id", "text"), "none").docs,
        "graph_load": lambda: load(spark, loaded),
        "point_lookup_10000": lambda: Query(star).seek_keys(keys).rows(),
        "vector_index_build": lambda: vectors.build(wide, 256).lists,
        "vector_index_top10_1000": lambda: vectors.search(index, asked, 10),
    }
    out, spread, counts = {}, {}, {}
    for name, make in timed.items():
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            counts[name] = make().count()
            times.append(time.perf_counter() - began)
        out[name] = round(statistics.median(times[1:]), 3)
        spread[name] = round(max(times[1:]) - min(times[1:]), 3)
    per_second = {k: round(counts[k] / out[k]) for k in ("expand_1_hop_all", "expand_2_hop_distinct", "degrees")} | {
        "vector_top10_batch_queries": round(n_items / out["vector_top10_batch"]),
        "graph_load": round(loaded[-1] / out["graph_load"]),
        "point_lookup_keys": round(counts["point_lookup_10000"] / out["point_lookup_10000"]),
        "vector_index_build": round(n_wide / out["vector_index_build"]),
        "vector_index_queries": round(1_000 / out["vector_index_top10_1000"]),
    }
    print(json.dumps({"metric": "sum of medians of warm runs", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "spread": spread, "rows": counts, "rows_per_second": per_second, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
