"""The engine's registered queries over the driver's tables, and their SQL.

Each query runs the operator it is named after over whole tables through the public interface (the query language or
the builder). Floats are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import chunks, crawl, entities, html
from .operators import algorithms, catalog, keyword, reads, vectors
from .operators.lowering import Query
from .plans import model as M
from .plans.language import parse
from .sources import driver_graph
from .sources.driver_graph import LABELS, OFFSET
from .sources.graph import EdgeTable, Graph
from .streaming import feed

STAR = ("Region", "Nation", "Customer", "Supplier", "Part", "Order")
PLACES = ("Region", "Nation", "Customer", "Supplier")
P, KEY = M.Property, M.ExternalKey()
QUERY_VECTOR = tuple(round(((i * 37) % 19 - 9) / 10, 1) for i in range(64))
FLAGSHIP = 'MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.c_mktsegment = "BUILDING" AND o.o_totalprice > 200000 RETURN o ORDER BY o.o_totalprice DESC LIMIT 10'
KEYWORDS = "of the data with quality and"

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql.format(**SQL)
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(graph(spark, sf_dir), FLAGSHIP, key=KEY, price=P("o_totalprice"))


def graph(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] = STAR) -> Graph:
    return driver_graph.load(spark, sf_dir, labels)


def run(g: Graph, text: str, **columns: M.Expr) -> DataFrame:
    """A read statement's rows as columns."""
    return Query(g, parse(text).plan).select(**columns)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


def key_of(c: str = "id"):
    """The external key of a driver graph's node id."""
    names = F.create_map(*(F.lit(x) for label, (_, _, n) in LABELS.items() for x in (n, f"{label.lower()}:")))
    return F.concat(names[(F.col(c) / OFFSET).cast("int")], F.pmod(F.col(c), F.lit(OFFSET)).cast("string"))


def _vector(v=QUERY_VECTOR) -> str:
    return "[" + ", ".join(f"{x}::DOUBLE" for x in v) + "]"


SQL = {
    "q": _vector(),
    # ids and edges of the small star graph
    "place_nodes": "SELECT 'region:' || r_regionkey AS k FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'customer:' || c_custkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier",
    "place_edges": "SELECT 'nation:' || n_nationkey AS s, 'region:' || n_regionkey AS d FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier",
    "order_of": "CASE split_part(k, ':', 1) WHEN 'region' THEN 1 WHEN 'nation' THEN 2 WHEN 'customer' THEN 3 WHEN 'supplier' THEN 4 END * 1000000000000 + split_part(k, ':', 2)::BIGINT",
    "words": r"list_filter(string_split_regex(coalesce(text, ''), '[^\p{L}\p{N}]+'), lambda x: x <> '')",
}


# Sources and steps ---------------------------------------------------------------------------------------------


@query("SELECT 'order:' || o_orderkey AS key, o_totalprice::DOUBLE AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000 ORDER BY o_totalprice DESC, c_custkey, o_orderkey LIMIT 10")
def flagship_match(spark, sf):
    return flagship(spark, sf)


@query("SELECT k AS key FROM ({place_nodes})")
def scan_all(spark, sf):
    return run(graph(spark, sf, PLACES), "MATCH (n) RETURN n", key=KEY)


@query("SELECT 'supplier:' || s_suppkey AS key, s_name AS name, round(s_acctbal, 6) AS balance FROM supplier")
def scan_label(spark, sf):
    return rounded(run(graph(spark, sf), "MATCH (s:Supplier) RETURN s", key=KEY, name=P("s_name"), balance=P("s_acctbal")), "balance")


@query("SELECT * FROM (VALUES ('nation:3', 1), ('nation:1', 1), ('nation:3', 1)) t(key, n)")
def seek_ids(spark, sf):
    ids = [2 * OFFSET + 3, 2 * OFFSET + 1, 17, 2 * OFFSET + 3]
    return Query(graph(spark, sf, PLACES)).seek_ids(ids).select(key=KEY, n=M.Literal(1)).withColumn("n", F.col("n").cast("int"))


@query("SELECT 'customer:' || c_custkey AS key, c_name AS name FROM customer WHERE c_custkey IN (7, 2) UNION ALL SELECT 'customer:' || c_custkey, c_name FROM customer WHERE c_custkey = 7")
def seek_keys(spark, sf):
    return Query(graph(spark, sf)).seek_keys(["customer:7", "customer:2", "nobody", "customer:7"]).select(key=KEY, name=P("c_name"))


@query("SELECT 'customer:' || c_custkey AS key FROM customer WHERE c_custkey IN (4, 5) AND c_acctbal IS NOT NULL")
def key_seek_rewrite(spark, sf):
    return run(graph(spark, sf), 'MATCH (c:Customer) WHERE key(c) IN ["customer:4", "customer:5", "order:1"] AND c.c_acctbal IS NOT NULL RETURN c', key=KEY)


@query(
    "SELECT k AS key FROM ({place_nodes}) WHERE k NOT LIKE 'customer:%' UNION ALL SELECT 'customer:' || c_custkey FROM customer WHERE NOT coalesce(c_acctbal > 5000, false) OR c_mktsegment <> 'BUILDING'"
)
def filter_total_logic(spark, sf):
    # a node without the property is not over 5000, so NOT keeps it
    return run(graph(spark, sf, PLACES), 'MATCH (n) WHERE NOT n.c_acctbal > 5000 OR n.c_mktsegment <> "BUILDING" RETURN n', key=KEY)


@query("SELECT 'part:' || p_partkey AS key FROM part WHERE contains(p_name, 'e') AND NOT starts_with(p_name, 'r') AND (p_size IN (1, 5, 10) OR ends_with(p_type, 'BRASS') OR contains(p_size::VARCHAR, '3'))")
def filter_strings(spark, sf):
    text = 'MATCH (p:Part) WHERE p.p_name CONTAINS "e" AND NOT p.p_name STARTS WITH "r" AND (p.p_size IN [1, 5.0, 10] OR p.p_type ENDS WITH "BRASS" OR p.p_size CONTAINS 3) RETURN p'
    return run(graph(spark, sf), text, key=KEY)


@query(
    "SELECT 'order:' || o_orderkey AS key, (o_orderkey * 3 - 7)::BIGINT AS i, (o_orderkey // 7)::BIGINT AS q, round(o_totalprice / 3.0 + o_orderkey, 6) AS f, NULL::BIGINT AS z, -o_orderkey::BIGINT AS m FROM orders"
)
def arithmetic(spark, sf):
    k = P("o_orderkey")
    out = Query(graph(spark, sf)).scan_label("Order").select(key=KEY, i=k * 3 - M.Literal(7), q=k / 7, f=P("o_totalprice") / 3.0 + k, z=k / 0, m=M.Arith("Sub", M.Literal(0), k))
    return rounded(out, "f")


@query("SELECT 'order:' || o_orderkey AS key, round(o_totalprice, 6) AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def expand_out(spark, sf):
    return rounded(run(graph(spark, sf), 'MATCH (c:Customer)-[:PLACED]->(o) WHERE c.c_mktsegment = "BUILDING" RETURN o', key=KEY, price=P("o_totalprice")), "price")


@query("SELECT 'customer:' || c_custkey AS key, n FROM (SELECT c_custkey, 1 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)")
def expand_in(spark, sf):
    out = run(graph(spark, sf), "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) WHERE n.n_regionkey = 1 RETURN c", key=KEY, n=M.Hops())
    return out.withColumn("n", F.col("n").cast("int"))


@query("WITH e AS ({place_edges}) SELECT o AS key FROM (SELECT d AS o, s AS a FROM e UNION ALL SELECT s, d FROM e) WHERE a LIKE 'nation:%'")
def expand_both(spark, sf):
    return run(graph(spark, sf, PLACES), "MATCH (n:Nation)-[]-(x) RETURN x", key=KEY)


@query("SELECT DISTINCT 'part:' || l_partkey AS key FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY'")
def two_hop_distinct(spark, sf):
    return run(graph(spark, sf), 'MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p) WHERE c.c_mktsegment = "MACHINERY" RETURN DISTINCT p', key=KEY)


@query(
    "WITH RECURSIVE e AS ({place_edges}), b AS (SELECT s AS a, d AS o FROM e UNION ALL SELECT d, s FROM e), w AS (SELECT 'nation:' || n_nationkey AS k, 0 AS hops FROM nation UNION ALL SELECT o, hops + 1 FROM w JOIN b ON a = k WHERE hops < 3) SELECT k AS key, hops::BIGINT AS hops, count(*) AS n FROM w WHERE hops >= 1 GROUP BY ALL"
)
def expand_var_1_3(spark, sf):
    return Query(graph(spark, sf, PLACES), parse("MATCH (n:Nation)-[*1..3]-(x) RETURN x").plan).counts(key=KEY, hops=M.Hops())


@query("SELECT 'part:' || p_partkey AS key, p_size::BIGINT AS size FROM part ORDER BY p_size DESC, p_name, p_partkey LIMIT 25 OFFSET 10")
def skip_limit(spark, sf):
    return run(graph(spark, sf), "MATCH (p:Part) RETURN p ORDER BY p.p_size DESC, p.p_name SKIP 10 LIMIT 25", key=KEY, size=P("p_size"))


@query("SELECT k AS key FROM (SELECT k, {order_of} AS id FROM ({place_nodes})) LEFT JOIN customer ON k = 'customer:' || c_custkey ORDER BY c_mktsegment IS NOT NULL, c_mktsegment, id LIMIT 1000")
def sort_mixed(spark, sf):
    # nodes without the property come first, as Null is the lowest of all values
    return Query(graph(spark, sf, PLACES)).scan_all().sort_asc(P("c_mktsegment")).limit(1000).select(key=KEY)


@query(
    "SELECT key, hops FROM (SELECT 'nation:' || c_nationkey AS key, 1::BIGINT AS hops, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE n = 1"
)
def distinct_first(spark, sf):
    return run(graph(spark, sf, PLACES), "MATCH (c:Customer)-[:IN_NATION]->(n) RETURN DISTINCT n", key=KEY, hops=M.Hops())


@query("SELECT 'order' AS kind, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7 UNION ALL SELECT 'edge', count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7")
def subgraph(spark, sf):
    g = graph(spark, sf)
    nodes, edges = Query(g, parse("MATCH (c:Customer)-[:PLACED]->(o) WHERE c.c_nationkey = 7 RETURN o").plan).subgraph()
    n = nodes.filter((F.col("id") / OFFSET).cast("int") == 6).agg(F.count(F.lit(1)).alias("n")).select(F.lit("order").alias("kind"), "n")
    return n.union(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge"), "n"))


# Vectors and text ----------------------------------------------------------------------------------------------


def top_k(spark, sf, metric):
    text = f"SEARCH (i:Item) ON embedding NEAR {list(QUERY_VECTOR)} METRIC {metric} TOPK 10 RETURN i"
    return rounded(run(graph(spark, sf, ("Item",)), text, key=KEY, score=M.Similarity("embedding", M.Vector(QUERY_VECTOR), {"cosine": "Cosine", "dot": "Dot", "l2": "L2"}[metric])), "score")


@query("SELECT 'item:' || vec_id AS key, round(list_cosine_similarity(embedding::DOUBLE[], {q}::FLOAT[]::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {q}::FLOAT[]::DOUBLE[]) DESC, vec_id LIMIT 10")
def vector_topk_cosine(spark, sf):
    return top_k(spark, sf, "cosine")


@query("SELECT 'item:' || vec_id AS key, round(list_inner_product(embedding::DOUBLE[], {q}::FLOAT[]::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_inner_product(embedding::DOUBLE[], {q}::FLOAT[]::DOUBLE[]) DESC, vec_id LIMIT 10")
def vector_topk_dot(spark, sf):
    return top_k(spark, sf, "dot")


@query("SELECT 'item:' || vec_id AS key, round(-list_distance(embedding::DOUBLE[], {q}::FLOAT[]::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {q}::FLOAT[]::DOUBLE[]), vec_id LIMIT 10")
def vector_topk_l2(spark, sf):
    return top_k(spark, sf, "l2")


@query("SELECT 'item:' || vec_id AS key, round(list_distance(embedding::DOUBLE[], {q}::FLOAT[]::DOUBLE[]), 6) AS l2 FROM embeddings WHERE label IN (0, 2, 4, 6, 8) ORDER BY list_distance(embedding::DOUBLE[], {q}::FLOAT[]::DOUBLE[]), vec_id LIMIT 7")
def frontier_topk(spark, sf):
    q = Query(graph(spark, sf, ("Item",))).scan_label("Item").filter(M.Compare("Eq", P("label"), M.Literal(0)) | P("label").eq(2) | P("label").eq(4) | P("label").eq(6) | P("label").eq(8))
    return rounded(q.frontier_top_k("embedding", QUERY_VECTOR, 7, "L2").select(key=KEY, l2=M.Distance("embedding", M.Vector(QUERY_VECTOR), "L2")), "l2")


def item_graph(spark, sf) -> Graph:
    """Items with three outgoing edges each, to ids that follow from their own."""
    g = graph(spark, sf, ("Item",))
    items = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id")
    n = items.count()
    hops = items.select("vec_id", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.pmod(F.col("vec_id") * a + b, F.lit(n)).alias("to")) for i, (a, b) in enumerate(((17, 3), (29, 11), (5, 1)))))).alias("h"))
    hops = hops.select((F.col("vec_id") * 3 + F.col("h.i")).alias("id"), (F.col("vec_id") + 8 * OFFSET).alias("src"), (F.col("h.to") + 8 * OFFSET).alias("dst"))
    return Graph(spark, g.node_tables, [EdgeTable(hops, "NEAR", src_labels=("Item",), dst_labels=("Item",))])


@query(
    "WITH n AS (SELECT count(*) AS c FROM embeddings), e AS (SELECT vec_id AS s, (vec_id * a + b) % c AS d, vec_id * 3 + i AS id FROM embeddings, n, (VALUES (0, 17, 3), (1, 29, 11), (2, 5, 1)) t(i, a, b)), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {q}::FLOAT[]::DOUBLE[]) AS v FROM embeddings), l1 AS (SELECT d, v FROM e JOIN s ON d = s.vec_id ORDER BY v DESC, d, id LIMIT 5), l2 AS (SELECT e.d, s.v FROM l1 JOIN e ON e.s = l1.d JOIN s ON e.d = s.vec_id ORDER BY s.v DESC, e.d, id LIMIT 5), r AS (SELECT d, v, 1::BIGINT AS hops FROM l1 UNION ALL SELECT d, v, 2 FROM l2) SELECT 'item:' || d AS key, round(v, 5) AS score, hops FROM r"
)
def expand_beam(spark, sf):
    q = Query(item_graph(spark, sf)).scan_label("Item").expand_beam("Out", "NEAR", "embedding", QUERY_VECTOR, 5, 2)
    return rounded(q.select(key=KEY, score=M.Similarity("embedding", M.Vector(QUERY_VECTOR)), hops=M.Hops()), "score", places=5)


@query(
    "WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT query, vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], e) AS distance FROM q, embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS n FROM d) SELECT query, count(*) AS hits, round(sum(distance), 5) AS distance FROM r WHERE n <= 10 GROUP BY query"
)
def vector_topk_batch(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = vectors.batch_top_k(rows.filter(F.pmod("id", F.lit(20)) == 0), rows, 10)
    return rounded(found.groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.sum("distance").alias("distance")), "distance", places=5)


@query()
def vector_topk_inverted_file(spark, sf):
    """Approximate: tests measure recall against vector_topk_batch."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = vectors.build(rows, lists=32)
    return vectors.search(index, rows.filter(F.pmod("id", F.lit(20)) == 0), 10, probes=20)


def doc_graph(spark, sf, lang="none") -> Graph:
    g = graph(spark, sf, ("Doc",))
    keyword.declare(g, "Doc", "text", lang)
    return g


BM25_SQL = (
    "WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, unnest(list_transform(w, lambda x: lower(x))) AS term FROM d), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY ALL), n AS (SELECT count(*) AS n, avg(len) AS mean FROM dl), "
    "q AS (SELECT unnest(['of', 'the', 'data', 'with', 'quality', 'and']) AS term), df AS (SELECT term, count(*) AS df FROM tf SEMI JOIN q USING (term) GROUP BY ALL), "
    "s AS (SELECT tf.doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id), n GROUP BY ALL) "
)


@query(BM25_SQL + "SELECT 'doc:' || doc_id AS key, round(score, 4) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20")
def keyword_topk(spark, sf):
    g = doc_graph(spark, sf)
    return rounded(keyword.top_k(g, "Doc", "text", KEYWORDS, 20).select(key_of().alias("key"), "score"), "score", places=4)


@query()
def keyword_topk_english(spark, sf):
    """Stems and stopwords have no SQL; tests hold the ranking to a Python version."""
    g = doc_graph(spark, sf, "english")
    return run(g, f'SEARCH (d:Doc) ON text MATCHING "the thatin ononst inoran" TOPK 20 RETURN d', key=KEY, score=M.Score())


@query(
    BM25_SQL
    + ", k AS (SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 100), lo AS (SELECT min(score) AS lo, max(score) AS hi FROM k) SELECT 'doc:' || doc_id AS key, round(CASE WHEN hi - lo <= 1.1920929e-07 THEN 1.0 ELSE (score - lo) / (hi - lo) END * 2, 4) AS score, round(score, 4) AS keyword FROM k, lo ORDER BY score DESC, doc_id LIMIT 15"
)
def hybrid_keyword(spark, sf):
    from .operators import hybrid

    plan = parse(f'HYBRID (d:Doc) KEYWORD ON text MATCHING "{KEYWORDS}" WEIGHT 2 TOPK 15 RETURN d').plan
    out = hybrid.run(doc_graph(spark, sf), plan.source)
    return rounded(out.select(key_of().alias("key"), "score", "keyword"), "score", "keyword", places=4)


@query(
    "WITH n AS (SELECT count(*) AS c FROM embeddings), e AS (SELECT vec_id AS s, (vec_id * a + b) % c AS d FROM embeddings, n, (VALUES (17, 3), (29, 11), (5, 1)) t(a, b)), b AS (SELECT s, d FROM e UNION ALL SELECT d, s FROM e), v AS (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], {q}::FLOAT[]::DOUBLE[]) AS x FROM embeddings ORDER BY x, vec_id LIMIT 100), "
    "s0 AS (SELECT vec_id FROM v ORDER BY x, vec_id LIMIT 10), s1 AS (SELECT DISTINCT d AS vec_id FROM b SEMI JOIN s0 ON s = vec_id), g AS (SELECT vec_id, 1.0 AS g FROM s0 UNION ALL SELECT vec_id, 0.5 FROM s1 ANTI JOIN s0 USING (vec_id)), lo AS (SELECT min(x) AS lo, max(x) AS hi FROM v), "
    "f AS (SELECT vec_id, (hi - x) / (hi - lo) AS p FROM v, lo UNION ALL SELECT vec_id, 0.5 * (g - 0.5) / 0.5 FROM g) SELECT 'item:' || vec_id AS key, round(sum(p), 5) AS score FROM f GROUP BY vec_id ORDER BY sum(p) DESC, vec_id LIMIT 10"
)
def hybrid_fuse(spark, sf):
    text = f"HYBRID (i:Item) VECTOR NEAR {list(QUERY_VECTOR)} GRAPH HOPS 1 RETURN i"
    return rounded(run(item_graph(spark, sf), text, key=KEY, score=M.Score()), "score", places=5)


# Algorithms ----------------------------------------------------------------------------------------------------

_PAGERANK = "WITH v AS ({place_nodes}), e AS ({place_edges}), n AS (SELECT count(*)::DOUBLE AS n FROM v), o AS (SELECT s, count(*) AS out FROM e GROUP BY s), r0 AS (SELECT k, 1 / n AS r FROM v, n)"
for _i in range(20):
    _PAGERANK += f", r{_i + 1} AS (SELECT v.k, 0.15 / n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(r), 0) FROM r{_i} ANTI JOIN o ON k = o.s) / n) AS r FROM v LEFT JOIN (SELECT d, sum(r / out) AS got FROM e JOIN r{_i} ON s = k JOIN o ON o.s = e.s GROUP BY d) g ON v.k = g.d, n)"


@query(_PAGERANK + " SELECT k AS key, round(r, 8) AS rank FROM r20")
def pagerank_20(spark, sf):
    return rounded(algorithms.pagerank(graph(spark, sf, PLACES), tolerance=0.0).select(key_of().alias("key"), "rank"), "rank", places=8)


@query("SELECT 'customer:' || c_custkey AS key, (3000000000000 + c_custkey)::BIGINT AS a FROM customer UNION ALL SELECT 'order:' || o_orderkey, (3000000000000 + o_custkey)::BIGINT FROM orders")
def components(spark, sf):
    g = graph(spark, sf, ("Customer", "Order"))
    return algorithms.components(g).select(key_of().alias("key"), F.col("component").alias("a"))


@query(
    "WITH RECURSIVE e AS ({place_edges}), b AS (SELECT s AS a, d AS o FROM e UNION ALL SELECT d, s FROM e), g AS (SELECT 'supplier:' || min(s_suppkey) AS goal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = (SELECT n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1)), w AS (SELECT 'customer:1' AS k, 0 AS n, ['customer:1'] AS path UNION ALL SELECT o, n + 1, list_append(path, o) FROM w JOIN b ON a = k, g WHERE n < 4 AND NOT list_contains(path, o) AND o NOT LIKE 'customer:%' AND (o NOT LIKE 'supplier:%' OR o = goal)), p AS (SELECT path FROM w, g WHERE k = goal ORDER BY n LIMIT 1) SELECT unnest(path) AS key, (unnest(range(len(path))))::BIGINT AS pos FROM p"
)
def shortest_path_unit(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    region = read("customer").filter("c_custkey = 1").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    goal = read("supplier").join(read("nation").filter(F.col("n_regionkey") == region), F.col("s_nationkey") == F.col("n_nationkey")).agg(F.min("s_suppkey")).first()[0]
    out = run(graph(spark, sf, PLACES), f'CALL shortest_path(from: "customer:1", to: "supplier:{goal}", dir: "both") ON (n) RETURN n', key=KEY, pos=M.Score())
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "WITH e AS (SELECT 'customer:' || o_custkey AS s, 'order:' || o_orderkey AS d, o_totalprice AS w FROM orders UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 1 FROM lineitem), p AS (SELECT b.w + 1 AS cost FROM e b JOIN e c ON b.d = c.s WHERE b.s = 'customer:' || (SELECT min(o_custkey) FROM orders) AND c.d = (SELECT 'part:' || min(l_partkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = (SELECT min(o_custkey) FROM orders))) SELECT 3::BIGINT AS nodes, round(min(cost), 4) AS cost FROM p"
)
def shortest_path_weighted(spark, sf):
    g = graph(spark, sf, ("Customer", "Order", "Part"))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    first = orders.agg(F.min("o_custkey")).first()[0]
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey")
    goal = items.join(orders.filter(F.col("o_custkey") == first), F.col("l_orderkey") == F.col("o_orderkey")).agg(F.min("l_partkey")).first()[0]
    path = algorithms.shortest_path(g, None, M.ShortestPath(M.Key(f"customer:{first}"), M.Key(f"part:{goal}"), "Out", "price"))
    return rounded(path.agg(F.count(F.lit(1)).alias("nodes"), F.max("cost").alias("cost")), "cost", places=4)


@query()
def louvain(spark, sf):
    """Sequential moves have no SQL; tests hold it to a Python version."""
    return algorithms.louvain(graph(spark, sf, PLACES)).select(key_of().alias("key"), "community")


@query("WITH e AS ({place_edges}), x AS (SELECT s AS k FROM e UNION ALL SELECT d FROM e) SELECT v.k AS key, count(x.k) AS degree FROM ({place_nodes}) v LEFT JOIN x USING (k) GROUP BY v.k")
def degrees(spark, sf):
    return algorithms.degrees(graph(spark, sf, PLACES)).select(key_of().alias("key"), "degree")


@query("SELECT k AS key, r AS index FROM (SELECT 'customer:' || c_custkey AS k, (dense_rank() OVER (ORDER BY c_custkey) - 1)::BIGINT AS r FROM customer)")
def algo_components_rows(spark, sf):
    out = run(graph(spark, sf, ("Customer",)), "CALL components() ON (c:Customer) RETURN c", key=KEY, index=M.Score())
    return out.withColumn("index", F.col("index").cast("bigint"))


# Catalogue and reads -------------------------------------------------------------------------------------------


@query("SELECT 'Region' AS label, count(*) AS count FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders")
def catalog_labels(spark, sf):
    return catalog.labels(graph(spark, sf))


@query(
    "SELECT 'Customer' AS label, unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS property, unnest(['Int', 'Str', 'Int', 'Float', 'Str']) AS kind, unnest([count(c_custkey), count(c_name), count(c_nationkey), count(c_acctbal), count(c_mktsegment)]) AS count FROM customer"
)
def catalog_properties(spark, sf):
    return catalog.properties(graph(spark, sf, ("Customer",))).drop("described")


@query(
    "SELECT 'IN_REGION' AS type, 'Nation' AS src_label, 'Region' AS dst_label, count(*) AS count FROM nation UNION ALL SELECT 'IN_NATION', 'Customer', 'Nation', count(*) FROM customer UNION ALL SELECT 'IN_NATION', 'Supplier', 'Nation', count(*) FROM supplier UNION ALL SELECT 'PLACED', 'Customer', 'Order', count(*) FROM orders UNION ALL SELECT 'CONTAINS', 'Order', 'Part', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', 'Order', 'Supplier', count(*) FROM lineitem"
)
def catalog_connections(spark, sf):
    return catalog.connections(graph(spark, sf))


@query("SELECT 'order:' || o_orderkey AS key, 1::BIGINT AS n FROM orders WHERE o_custkey = 10 UNION ALL SELECT 'nation:' || c_nationkey, 1 FROM customer WHERE c_custkey = 10")
def neighbours(spark, sf):
    return reads.neighbours(graph(spark, sf), 3 * OFFSET + 10).groupBy(key_of().alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH c AS (SELECT 'customer:' || c_custkey AS key, CASE WHEN contains('customer:' || c_custkey, 'er:1') THEN 'key' WHEN contains('customer', 'er:1') THEN 'label' WHEN contains(lower(c_name), 'er:1') THEN 'c_name' END AS field, 3000000000000 + c_custkey AS id FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, CASE WHEN contains('supplier:' || s_suppkey, 'er:1') THEN 'key' END, 4000000000000 + s_suppkey FROM supplier) SELECT key, field FROM c WHERE field IS NOT NULL ORDER BY id LIMIT 50"
)
def find_nodes(spark, sf):
    return reads.find_nodes(graph(spark, sf, PLACES), "er:1", ["c_name", "s_name"]).select(key_of().alias("key"), "field")


@query("WITH e AS ({place_edges}), x AS (SELECT s AS k FROM e UNION ALL SELECT d FROM e), t AS (SELECT k, count(*) AS degree FROM x GROUP BY k ORDER BY degree DESC, {order_of} LIMIT 12) SELECT 'node' AS kind, count(*) AS n FROM t UNION ALL SELECT 'edge', count(*) FROM e WHERE s IN (SELECT k FROM t) AND d IN (SELECT k FROM t)")
def seed_by_degree(spark, sf):
    top, edges, _ = reads.seed(graph(spark, sf, PLACES), "degree", 12)
    n = top.agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "n")
    return n.union(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge"), "n"))


@query("SELECT 1 AS level, count(DISTINCT o_orderkey) AS n FROM orders WHERE o_custkey = 10 UNION ALL SELECT 2, count(DISTINCT x) FROM (SELECT l_partkey AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 10)")
def breadth_levels(spark, sf):
    g = graph(spark, sf, ("Customer", "Order", "Part"))
    found = reads.levels(g, 3 * OFFSET + 10, "Out", ["PLACED", "CONTAINS"], 3)
    parts = [x.agg(F.lit(i + 1).alias("level"), F.count(F.lit(1)).alias("n")) for i, x in enumerate(found)]
    return parts[0].union(parts[1])


# Versions and the feed -----------------------------------------------------------------------------------------


def event_log(spark, sf) -> DataFrame:
    """The events as a log of changes of users: signup creates, error deletes, the rest update."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("update")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), op.alias("op"), "value", F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")).alias("ms"))


@query(
    "WITH l AS (SELECT event_id // 100 AS seq, user_id AS id, event_id AS ord, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS op FROM events), e AS (SELECT seq, id, arg_min(op, ord) AS began, arg_max(op, ord) AS ended FROM l GROUP BY ALL) SELECT seq, id, CASE WHEN ended = 'delete' THEN 'delete' WHEN began = 'create' THEN 'create' ELSE 'update' END AS op FROM e WHERE NOT (began = 'create' AND ended = 'delete')"
)
def change_feed_net(spark, sf):
    log = event_log(spark, sf).select(F.floor(F.col("seq") / 100).cast("bigint").alias("seq"), F.lit("node").alias("kind"), "id", "op", F.col("seq").alias("ord"))
    return feed.net_changes(log).select("seq", "id", "op")


def stored_places(spark, sf):
    """The places in a versioned store of their own."""
    import uuid

    from .functions.values import Value, tagged
    from .sources.graph import PROPS
    from .sources.store import Store
    from .sources.transaction import Transaction
    from .storage import shared_dir

    store = Store(spark, f"{shared_dir(spark)}/sparkweave/store-{uuid.uuid4().hex}")
    tx = Transaction(store)
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    region = read("region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("key"), F.array(F.lit("Region")).alias("labels"), F.create_map(F.lit("name"), tagged(Value("str", F.col("r_name")))).cast(PROPS).alias("props"))
    nation = read("nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("key"), F.array(F.lit("Nation")).alias("labels"), F.create_map(F.lit("name"), tagged(Value("str", F.col("n_name")))).cast(PROPS).alias("props"))
    tx.bulk_load(region.union(nation))
    edges = read("nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("src_key"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("dst_key"), F.lit("IN_REGION").alias("type"), F.lit(None).cast(PROPS).alias("props"))
    tx.bulk_load_edges(edges)
    tx.commit()
    return store


def state_of(store) -> DataFrame:
    out = Query(store.graph()).scan_all().nodes("name", "seen")
    return out.select("key", F.array_join(F.sort_array("labels"), ",").alias("labels"), F.col("name.s").alias("name"), F.col("seen.i").alias("seen"))


@query(
    "SELECT 'region:' || r_regionkey AS key, 'Region' AS labels, r_name AS name, NULL::BIGINT AS seen FROM region UNION ALL SELECT 'nation:' || n_nationkey, CASE WHEN n_regionkey = 2 THEN 'Nation,Visited' ELSE 'Nation' END, n_name, CASE WHEN n_regionkey = 2 THEN 1 END FROM nation UNION ALL SELECT 'new', 'Place', NULL, 2"
)
def write_merge(spark, sf):
    from .operators.writes import apply

    store = stored_places(spark, sf)
    apply(store, parse('MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WHERE key(r) = "region:2" SET n.seen = 1, n:Visited'))
    apply(store, parse('MERGE (p:Place {key: "new"}) ON CREATE SET p.seen = 1'))
    apply(store, parse('MERGE (p:Place {key: "new"}) ON MATCH SET p.seen = 2'))
    return state_of(store)


@query("SELECT 'region:' || r_regionkey AS key, 'Region' AS labels, r_name AS name, NULL::BIGINT AS seen FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, NULL FROM nation")
def detach_delete(spark, sf):
    from .operators.writes import apply

    store = stored_places(spark, sf)
    apply(store, parse('MATCH (r:Region) WHERE key(r) = "region:1" DETACH DELETE r'))
    return state_of(store)


# Documents -----------------------------------------------------------------------------------------------------


@query()
def chunk_documents(spark, sf):
    """White-space cutting has no SQL; tests hold it to a direct version."""
    return chunks.chunk_documents(spark.read.parquet(f"{sf}/documents.parquet"), 1500)


_FOLD = r"lower(regexp_replace(p_name, '[^\p{L}\p{N}]', '', 'g'))"


@query(
    "WITH c AS (SELECT name, count(*) AS n FROM (SELECT p_name AS name FROM part UNION ALL SELECT upper(p_name) FROM part WHERE p_size > 25 UNION ALL SELECT replace(p_name, ' ', '-') FROM part WHERE p_retailprice > 1000) GROUP BY name), f AS (SELECT name, n, "
    + _FOLD.replace("p_name", "name").replace("{", "{{").replace("}", "}}")
    + " AS fold FROM c), s AS (SELECT *, first_value(name) OVER (PARTITION BY fold ORDER BY n DESC, name) AS survivor FROM f) SELECT name, survivor FROM s WHERE name <> survivor"
)
def fold_keys(spark, sf):
    # spellings of a part's name that differ in case and signs, as several readers would write it
    p = spark.read.parquet(f"{sf}/part.parquet")
    names = p.select(F.col("p_name").alias("name")).union(p.filter("p_size > 25").select(F.upper("p_name"))).union(p.filter("p_retailprice > 1000").select(F.replace("p_name", F.lit(" "), F.lit("-"))))
    return entities.fold_renames(names.groupBy("name").agg(F.count(F.lit(1)).alias("count")))


@query(
    "WITH k AS (SELECT DISTINCT p_name AS key, '' AS label, {0} AS fold FROM part UNION ALL SELECT DISTINCT split_part(p_name, ' ', 1), '', lower(split_part(p_name, ' ', 1)) FROM part), p AS (SELECT i.key AS \"inner\", o.key AS \"outer\", row_number() OVER (PARTITION BY i.key ORDER BY o.key) AS n FROM k i JOIN k o ON i.key <> o.key AND length(o.fold) > length(i.fold) AND contains(o.fold, i.fold) AND i.fold <> '') SELECT \"inner\", \"outer\" FROM p WHERE n <= 4 ORDER BY \"inner\", \"outer\" LIMIT 200".replace("{0}", _FOLD.replace("{", "{{").replace("}", "}}"))
)
def containment_pairs(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    keys = p.select(F.col("p_name").alias("key")).distinct().union(p.select(F.split("p_name", " ")[0]).distinct())
    return entities.containment_pairs(keys.withColumn("label", F.lit("")))


@query(
    "WITH b AS (SELECT item_id, text, {words} AS w FROM benchmark), c AS (SELECT item_id AS ord, list_distinct(list_transform(w, lambda x: lower(x))) AS t FROM b), k AS (SELECT DISTINCT list_distinct(list_transform(w[1:2], lambda x: lower(x))) AS t, array_to_string(w[1:2], ' ') AS key FROM b WHERE len(w) >= 2) SELECT key, list_sort(list(ord)) AS fresh FROM k JOIN c ON list_has_all(c.t, k.t) GROUP BY key"
)
def mention_gate(spark, sf):
    from .functions.analyzer import NOT_A_WORD

    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    heads = b.select(F.filter(F.split("text", NOT_A_WORD), lambda x: x != "").alias("w")).filter("size(w) >= 2").select(F.concat_ws(" ", F.slice("w", 1, 2)).alias("key")).distinct()
    ents = heads.select("key", F.lit("").alias("label"), F.create_map().cast("map<string,string>").alias("props"), F.array().cast("array<bigint>").alias("origins"))
    rel = spark.createDataFrame([], "src string, dst string, type string")
    return entities.mention_gate(b.select(F.col("item_id").alias("ord"), F.col("text").alias("chunk")), ents, rel, "none").select("key", "fresh")


@query()
def html_links(spark, sf):
    """Tree building has no SQL; tests check each rule."""
    pages = html.extract_pages(spark.read.parquet(f"{sf}/pages.parquet"))
    return pages.select("page_id", "title", F.length("markdown").alias("chars"), F.size("links").alias("links"), F.sha2("markdown", 256).alias("markdown_sha256"))


@query(r"SELECT page_id, array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/]*', ''), '[?#].*$', ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^a-zA-Z0-9]+'), lambda x: x <> ''), lambda x: x || ' '), '') AS words FROM pages")
def url_words(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", crawl.url_words(F.col("url")).alias("words"))


@query()
def relevance_rank(spark, sf):
    """Stemmed terms have no SQL; tests hold it to a Python version."""
    pages = html.extract_pages(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", F.col("markdown").alias("text"))
    first = pages.orderBy("page_id").limit(1)
    return rounded(crawl.score(pages, crawl.target(first, "data quality")), "relevance")
