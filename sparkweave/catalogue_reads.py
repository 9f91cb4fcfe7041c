"""Registered queries of terminals, statements, algorithms on graphs with cycles, and read verbs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import KEY, PLACES, QUERY_VECTOR, SQL, P, doc_graph, graph, item_graph, key_of, query, rounded, run
from .operators import algorithms, catalog, reads, vectors
from .operators.deadline import deadline
from .operators.lowering import Query
from .plans import model as M
from .plans.language import CompileProblem, SyntaxProblem, parse
from .sources.driver_graph import OFFSET
from .sources.graph import EdgeTable, Graph, NodeTable
from .storage import cut, shared_dir

ITEM = 8 * OFFSET
SQL |= {
    "hops": "SELECT vec_id AS s, (vec_id * a + b) % c AS d, vec_id * 3 + i AS id FROM embeddings, (SELECT count(*) AS c FROM embeddings), (VALUES (0, 17, 3), (1, 29, 11), (2, 5, 1)) t(i, a, b)",
    "cos": "list_cosine_similarity(embedding::DOUBLE[], {q}::FLOAT[]::DOUBLE[])".format(**SQL),
}
#: Nodes at each distance from an item, over the edges `e`.
_REACHED = "WITH RECURSIVE e AS ({{hops}}), w AS (SELECT {start}::BIGINT AS k, 0 AS n UNION SELECT {to}, n + 1 FROM w JOIN e ON {of} = k WHERE n < {most}), near AS (SELECT k, min(n) AS n FROM w GROUP BY k) "


# Terminals -----------------------------------------------------------------------------------------------------


@query("SELECT 3000000000000 + c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 4000000000000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def terminal_ids(spark, sf):
    return Query(graph(spark, sf, PLACES)).scan_label("Nation").filter(P("n_regionkey").eq(1)).expand_in("IN_NATION").ids()


@query("SELECT (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0)::BIGINT AS n, (SELECT count(DISTINCT o_custkey) FROM orders)::BIGINT AS customers")
def terminal_count(spark, sf):
    g = graph(spark, sf, ("Customer", "Order"))
    n = Query(g).scan_label("Customer").filter(P("c_acctbal").lt(0)).expand_out("PLACED").count()
    return spark.createDataFrame([(n, Query(g).scan_label("Order").expand_in("PLACED").distinct().count())], "n long, customers long")


@query("SELECT 'item:' || vec_id AS key, 'Item' AS labels, label::BIGINT AS label, 0::BIGINT AS hops, round({cos}, 5) AS score FROM embeddings ORDER BY {cos} DESC, vec_id LIMIT 12")
def terminal_scored_nodes(spark, sf):
    found = Query(graph(spark, sf, ("Item",))).vector_top_k("Item", "embedding", QUERY_VECTOR, 12).scored_nodes("label", ordered=True)
    found = found.select("key", F.array_join("labels", ",").alias("labels"), F.col("label").cast("bigint").alias("label"), F.col("hops").cast("bigint").alias("hops"), "score")
    return rounded(found, "score", places=5)


@query("SELECT 'part:' || p_partkey AS key FROM part WHERE p_size >= 40 AND p_retailprice < 1200 ORDER BY p_retailprice, p_partkey LIMIT 30")
def terminal_plan(spark, sf):
    """The plan goes through its JSON form."""
    g = graph(spark, sf)
    plan = Query(g).scan_label("Part").filter(P("p_size").ge(40) & P("p_retailprice").lt(1200)).sort_asc(P("p_retailprice")).limit(30).plan()
    return Query(g, M.LogicalPlan.from_json(plan.to_json())).select(key=KEY)


@query("SELECT 'supplier:' || s_suppkey AS key FROM supplier WHERE s_acctbal > 1000")
def deadline_query(spark, sf):
    with deadline(spark, 3600):
        return cut(run(graph(spark, sf), "MATCH (s:Supplier) WHERE s.s_acctbal > 1000 RETURN s", key=KEY), "rows")


# Expressions and statements ------------------------------------------------------------------------------------


@query("SELECT 'part:' || p_partkey AS key FROM part WHERE list_contains(string_split(p_name, ' '), (SELECT split_part(p_name, ' ', 1) FROM part WHERE p_partkey = 2)) AND NOT list_contains([p_size, p_size + 1], 8)")
def in_value(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet")
    word = parts.filter("p_partkey = 2").select(F.split("p_name", " ")[0]).first()[0]
    rows = parts.select("p_partkey", F.split("p_name", " ").alias("words"), F.array(F.col("p_size"), F.col("p_size") + 1).alias("sizes"))
    g = Graph(spark, [NodeTable(rows, ("Part",), F.col("p_partkey"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")), {"words": "words", "sizes": "sizes"})], [])
    return run(g, f'MATCH (p:Part) WHERE "{word}" IN p.words AND NOT 8 IN p.sizes RETURN p', key=KEY)


@query("SELECT 'customer:' || c_custkey AS key FROM customer WHERE -c_acctbal > 100 AND 2 + c_nationkey >= 10 AND -(c_nationkey - 3) < 0")
def unary_minus(spark, sf):
    return run(graph(spark, sf), "MATCH (c:Customer) WHERE -c.c_acctbal > 100 AND 2 - -c.c_nationkey >= 10 AND -(c.c_nationkey - 3) < 0 RETURN c", key=KEY)


@query("SELECT 'customer:' || c_custkey AS key FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9000 OR c_custkey = 3")
def parameters(spark, sf):
    text = "MATCH (c:Customer) WHERE c.c_mktsegment = $segment AND c.c_acctbal > $least OR c.c_custkey = $who RETURN c"
    return Query(graph(spark, sf), parse(text, {"segment": "MACHINERY", "least": 9000, "who": 3}).plan).select(key=KEY)


@query("SELECT 'item:' || vec_id AS key, round({cos}, 5) AS score FROM embeddings ORDER BY {cos} DESC, vec_id LIMIT 8")
def text_query_vector(spark, sf):
    plan = parse('SEARCH (i:Item) ON embedding NEAR "a text" TOPK 8 RETURN i', embed=lambda text: QUERY_VECTOR if text == "a text" else None).plan
    return rounded(Query(graph(spark, sf, ("Item",)), plan).select(key=KEY, score=M.Score()), "score", places=5)


@query(
    "WITH e AS ({hops}), s AS (SELECT vec_id, {cos} AS v FROM embeddings), l1 AS (SELECT d, v FROM e JOIN s ON d = s.vec_id JOIN embeddings x ON x.vec_id = e.s WHERE x.label < 3 ORDER BY v DESC, d, id LIMIT 4), l2 AS (SELECT e.d, s.v FROM l1 JOIN e ON e.s = l1.d JOIN s ON e.d = s.vec_id ORDER BY s.v DESC, e.d, id LIMIT 4) SELECT 'item:' || d AS key, round(v, 5) AS score FROM l1 UNION ALL SELECT 'item:' || d, round(v, 5) FROM l2"
)
def beam_statement(spark, sf):
    text = f"MATCH (i:Item) BEAM (b:Item) OUT :NEAR ON embedding NEAR {list(QUERY_VECTOR)} WIDTH 4 DEPTH 2 WHERE i.label < 3 RETURN b"
    return rounded(run(item_graph(spark, sf), text, key=KEY, score=M.Similarity("embedding", M.Vector(QUERY_VECTOR))), "score", places=5)


_WRONG = {
    "MATCH (a)-[*]->(b) RETURN b": "compile",
    "MATCH (a)-[*3..2]->(b) RETURN b": "compile",
    "MATCH (a)-->(a) RETURN a": "compile",
    "MATCH (a)-->(b) RETURN a": "compile",
    "MATCH (a)-->(b) WHERE a.x = b.x RETURN b": "compile",
    "MATCH (n) WHERE n.v = $x RETURN n": "compile",
    "CALL nothing() ON (n) RETURN n": "compile",
    "MATCH (a)-->(b) SET a.x = 1": "compile",
    "MERGE (a {name: 1})": "compile",
    "MATCH n RETURN n": "syntax",
    "MATCH (n) RETURN n LIMIT -1": "syntax",
    "CREATE (a)-[:T]-(b)": "syntax",
    "SELECT 1": "syntax",
    "MATCH (n) RETURN n": "none",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t.replace('{', '{{').replace('}', '}}')}', '{k}')" for t, k in _WRONG.items()) + ") v(statement, kind)")
def statement_errors(spark, sf):
    def kind(text: str) -> str:
        try:
            parse(text)
        except (CompileProblem, SyntaxProblem) as e:
            return "compile" if isinstance(e, CompileProblem) else "syntax"
        return "none"

    return spark.createDataFrame([(t, kind(t)) for t in _WRONG], "statement string, kind string")


@query(_REACHED.format(start=3, to="d", of="s", most=3) + "SELECT 'item:' || k AS key, n::BIGINT AS hops FROM near WHERE n > 0 UNION ALL SELECT 'item:3', min(w.n) FROM w WHERE k = 3 AND n > 0 HAVING min(w.n) IS NOT NULL")
def distinct_first_hops(spark, sf):
    # the rows of one start come in the order of their hops, so the first row of a node has the fewest
    out = Query(item_graph(spark, sf)).seek_ids([ITEM + 3]).expand_var("Out", "NEAR", 1, 3).distinct().select(key=KEY, hops=M.Hops())
    return out.withColumn("hops", F.col("hops").cast("bigint"))


@query(
    "WITH RECURSIVE e AS ({place_edges}), w AS (SELECT 'supplier:' || s_suppkey AS k, 0 AS hops FROM supplier UNION ALL SELECT d, hops + 1 FROM w JOIN e ON s = k WHERE hops < 2) SELECT k AS key, hops::BIGINT AS hops, count(*) AS n FROM w GROUP BY ALL"
)
def expand_var_0_2(spark, sf):
    out = Query(graph(spark, sf, PLACES), parse("MATCH (s:Supplier)-[*0..2]->(x) RETURN x").plan).counts(key=KEY, hops=M.Hops())
    return out.withColumn("hops", F.col("hops").cast("bigint"))


_WORDS = "the thatin ononst inoran"


def _bm25_sql(words: str) -> str:
    from .catalogue import BM25_SQL

    return BM25_SQL.replace("['of', 'the', 'data', 'with', 'quality', 'and']", str(words.split()))


@query(_bm25_sql(_WORDS) + "SELECT 'doc:' || doc_id AS key, round(score, 4) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 25")
def search_matching(spark, sf):
    """Through the language and the plan's source."""
    g = doc_graph(spark, sf)
    return rounded(run(g, f'SEARCH (d:Doc) ON text MATCHING "{_WORDS}" TOPK 25 RETURN d', key=KEY, score=M.Score()), "score", places=4)


_STEMMED = "running run runs tables table the"


@query(
    "WITH d AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Runs of the table, ' ELSE '' END || CASE WHEN c_custkey % 4 = 0 THEN 'RUNNING it was; tables ' ELSE '' END || CASE c_mktsegment WHEN 'BUILDING' THEN 'and 7 buildings' ELSE 'an automobile' END AS t FROM customer), "
    "f AS (SELECT id, (CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END) AS run, CASE WHEN contains(t, 'buildings') THEN 2 ELSE 1 END AS rest FROM d), x AS (SELECT id, run, run AS tab, 2 * run + rest AS len FROM f), n AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (run > 0) AS df FROM x) "
    "SELECT id AS node, round(2 * ln((n - df + 0.5) / (df + 0.5) + 1) * run * 2.2 / (run + 1.2 * (0.25 + 0.75 * len / mean)), 4) AS score FROM x, n WHERE run > 0"
)
def keyword_english_stems(spark, sf):
    """Texts whose stems and stopwords are known: runs, running and run have one stem, tables and table another."""
    from .operators import keyword

    c = spark.read.parquet(f"{sf}/customer.parquet")
    text = F.concat(
        F.when(F.col("c_custkey") % 3 == 0, "Runs of the table, ").otherwise(""), F.when(F.col("c_custkey") % 4 == 0, "RUNNING it was; tables ").otherwise(""), F.when(F.col("c_mktsegment") == "BUILDING", "and 7 buildings").otherwise("an automobile")
    )
    index = keyword.build(c.select(F.col("c_custkey").alias("id"), text.alias("text")), "english")
    return rounded(keyword.bm25(index, _STEMMED), "score", places=4)


@query(
    "WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 3), t AS (SELECT doc_id, unnest(list_transform(w, lambda x: lower(x))) AS term FROM d UNION ALL SELECT doc_id, unnest(['new', 'text', 'the']) FROM documents WHERE doc_id % 10 = 3), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY ALL), n AS (SELECT count(*) AS n, avg(len) AS mean FROM dl), df AS (SELECT term, count(*) AS df FROM tf WHERE term IN ('new', 'the') GROUP BY ALL) SELECT tf.doc_id AS node, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 4) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id), n GROUP BY tf.doc_id"
)
def keyword_upsert(spark, sf):
    """An index in which a tenth of the documents is replaced."""
    from .operators import keyword

    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    index = keyword.build(docs, "none")
    index = keyword.upsert(index, docs.filter("id % 10 = 3").select("id", F.lit("New text, the").alias("text")))
    return rounded(keyword.bm25(index, "new the"), "score", places=4)


# Algorithms on graphs with cycles ------------------------------------------------------------------------------

_RANKS = "WITH e AS ({hops}), n AS (SELECT count(*)::DOUBLE AS n FROM embeddings), r0 AS (SELECT vec_id AS k, 1 / n AS r FROM embeddings, n)"
for _i in range(12):
    _RANKS += f", r{_i + 1} AS (SELECT vec_id AS k, 0.3 / n + 0.7 * coalesce(got, 0) AS r FROM embeddings LEFT JOIN (SELECT d, sum(r / 3) AS got FROM e JOIN r{_i} ON s = k GROUP BY d) ON vec_id = d, n)"


@query(_RANKS + " SELECT 'item:' || k AS key, round(r, 6) AS rank FROM r12")
def algo_pagerank(spark, sf):
    out = run(item_graph(spark, sf), "CALL pagerank(damping: 0.7, iterations: 12, tolerance: 0) ON (i:Item) RETURN i", key=KEY, rank=M.Score())
    return rounded(out, "rank")


@query("SELECT 'supplier:' || s_suppkey AS key, (dense_rank() OVER (ORDER BY m) - 1)::BIGINT AS index FROM (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS m FROM supplier)")
def algo_louvain(spark, sf):
    """Suppliers of one nation know each other: each nation is a community."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_nationkey")
    # pairs are made by many tasks, whatever the file's size and the number of nations
    one = s.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
    pairs = one.join(F.broadcast(s.withColumnRenamed("s_suppkey", "other")), "s_nationkey").filter("s_suppkey < other")
    links = pairs.select((F.col("s_suppkey") * 10**6 + F.col("other")).alias("id"), (F.col("s_suppkey") + 4 * OFFSET).alias("src"), (F.col("other") + 4 * OFFSET).alias("dst"))
    g = Graph(spark, graph(spark, sf, ("Supplier",)).node_tables, [EdgeTable(links, "KNOWS", src_labels=("Supplier",), dst_labels=("Supplier",))])
    out = run(g, "CALL louvain() ON (s:Supplier) RETURN s", key=KEY, index=M.Score())
    return out.withColumn("index", F.col("index").cast("bigint"))


@query(
    "WITH RECURSIVE e AS ({hops}), l AS (SELECT e.s, e.d FROM e JOIN embeddings a ON a.vec_id = s JOIN embeddings b ON b.vec_id = d WHERE a.label % 4 = b.label % 4), b AS (SELECT s, d FROM l UNION SELECT d, s FROM l), w AS (SELECT vec_id AS k, vec_id AS r FROM embeddings UNION SELECT k, d FROM w JOIN b ON s = r) SELECT 'item:' || k AS key, 8000000000000 + min(r) AS component FROM w GROUP BY k"
)
def components_cycles(spark, sf):
    g = item_graph(spark, sf)
    label = spark.read.parquet(f"{sf}/embeddings.parquet").select((F.col("vec_id") + ITEM).alias("v"), (F.col("label") % 4).alias("l"))
    near = g.edges().join(label.toDF("src", "a"), "src").join(label.toDF("dst", "b"), "dst").filter("a = b").select("id", "src", "dst")
    own = Graph(spark, g.node_tables, [EdgeTable(near, "NEAR", src_labels=("Item",), dst_labels=("Item",))])
    return algorithms.components(own).select(key_of().alias("key"), "component")


@query(_REACHED.format(start=0, to="d", of="s", most=14) + "SELECT n + 1 AS nodes, n::DOUBLE AS cost FROM near WHERE k = 7")
def shortest_path_ids(spark, sf):
    path = algorithms.shortest_path(item_graph(spark, sf), frozenset(["Item"]), M.ShortestPath(M.Id(ITEM), M.Id(ITEM + 7), "Out", None))
    return path.agg(F.count(F.lit(1)).alias("nodes"), F.max("cost").alias("cost"))


# Read verbs ----------------------------------------------------------------------------------------------------


def calls(spark, sf) -> Graph:
    """The items' edges as calls."""
    g = item_graph(spark, sf)
    return Graph(spark, g.node_tables, [EdgeTable(g.edge_tables[0].df, "CALLS", src_labels=("Item",), dst_labels=("Item",))])


@query(_REACHED.format(start=5, to="d", of="s", most=14) + "SELECT false AS reverse, n + 1 AS nodes FROM near WHERE k = 9")
def symbol_trace(spark, sf):
    path, reverse = reads.trace(calls(spark, sf), ITEM + 5, ITEM + 9)
    return spark.createDataFrame([(reverse, len(path))], "reverse boolean, nodes long")


@query(_REACHED.format(start=5, to="s", of="d", most=3) + "SELECT n AS level, k + 8000000000000 AS id FROM near WHERE n > 0")
def symbol_impact(spark, sf):
    """Who calls item 5, directly or through others, up to three levels."""
    parts = [ids.select(F.lit(i + 1).alias("level"), "id") for i, (_, ids) in enumerate(reads.impact(calls(spark, sf), ITEM + 5, 3))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(
    "SELECT 'region:2' AS name, 1000000000002 AS id, 'region:2' AS found UNION ALL SELECT 'egion:3', 1000000000003, 'region:3' UNION ALL SELECT 'nothing', NULL, NULL UNION ALL SELECT 'ION:1', NULL, k FROM ({place_nodes}) WHERE contains(k, 'ion:1') UNION ALL SELECT 'ation:7', 2000000000007, 'nation:7'"
)
def symbol_resolve(spark, sf):
    g = graph(spark, sf, PLACES)
    rows = []
    for name in ("region:2", "egion:3", "nothing", "ION:1", "ation:7"):
        node, found = reads.resolve_symbol(g, name)
        rows += [(name, node, f) for f in found or [None]]
    return spark.createDataFrame(rows, "name string, id long, found string")


@query(
    "WITH x AS (SELECT 'customer:' || c_custkey AS k, 3000000000000 + c_custkey AS id FROM customer WHERE c_nationkey = 4 UNION ALL SELECT 'supplier:' || s_suppkey, 4000000000000 + s_suppkey FROM supplier WHERE s_nationkey = 4), t AS (SELECT count(*) AS n FROM x), f AS (SELECT k, id FROM x ORDER BY id LIMIT 20) "
    "SELECT 'out IN_REGION (1)' || chr(10) || '  region:' || (SELECT n_regionkey FROM nation WHERE n_nationkey = 4) || chr(10) || 'in IN_NATION (' || (SELECT n FROM t) || ')' || chr(10) || (SELECT string_agg('  ' || k, chr(10) ORDER BY id) FROM f) AS text"
)
def symbol_context(spark, sf):
    return spark.createDataFrame([(reads.context(graph(spark, sf, PLACES), 2 * OFFSET + 4),)], "text string")


@query("SELECT unnest(['c_name: ' || c_name, 'c_mktsegment: ' || c_mktsegment, 'c_nationkey: ' || c_nationkey]) AS line FROM customer WHERE c_custkey = 11")
def symbol_describe(spark, sf):
    lines = reads.describe(graph(spark, sf, ("Customer",)), 3 * OFFSET + 11, ["c_name", "_hidden", "c_mktsegment", "c_nationkey", "nothing"])
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("WITH b AS (SELECT vec_id FROM embeddings ORDER BY {cos} DESC, vec_id LIMIT 1), e AS ({hops}) SELECT 'hit' AS kind, vec_id AS item, 1::BIGINT AS n FROM (SELECT vec_id FROM embeddings ORDER BY {cos} DESC, vec_id LIMIT 10) UNION ALL SELECT 'near', x, count(*) FROM (SELECT d AS x FROM e SEMI JOIN b ON s = vec_id UNION ALL SELECT s FROM e SEMI JOIN b ON d = vec_id) GROUP BY x")
def symbol_search(spark, sf):
    hits, near = reads.search(item_graph(spark, sf), M.Vector(QUERY_VECTOR))
    item = (F.col("id") - ITEM).alias("item")
    return hits.select(F.lit("hit").alias("kind"), item, F.lit(1).cast("bigint").alias("n")).union(near.groupBy("id").count().select(F.lit("near"), item, "count"))


@query("SELECT row_number() OVER (ORDER BY item_id, i) AS line, substr(t, 1, 300) AS text FROM (SELECT item_id, unnest(p) AS t, unnest(range(len(p))) AS i FROM (SELECT item_id, string_split(text, chr(10)) AS p FROM benchmark)) QUALIFY contains(t, 'tion') ORDER BY line LIMIT 50")
def grep_lines(spark, sf):
    import uuid

    path = f"{shared_dir(spark)}/sparkweave/grep-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").select("text").coalesce(1).write.text(path)
    return reads.grep(spark, path, "tion").select(F.col("line").cast("bigint").alias("line"), "text")


@query("SELECT doc_id, text AS snippet FROM documents WHERE doc_id IN (0, 17)")
def symbol_snippet(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    g = Graph(spark, [NodeTable(docs, ("Doc",), F.col("doc_id"), F.col("doc_id").cast("string"), {"source": "text"})], [])
    return spark.createDataFrame([(i, reads.snippet(g, i)) for i in (0, 17)], "doc_id long, snippet string")


@query(_REACHED.format(start=2, to="d", of="s", most=3) + "SELECT k + 8000000000000 AS id FROM near WHERE n >= 2 UNION SELECT k + 8000000000000 FROM w WHERE n >= 2")
def traverse_hops(spark, sf):
    return reads.traverse(item_graph(spark, sf), [ITEM + 2], "Out", "NEAR", 2, 3).select("id")


@query("SELECT n + 1 AS total, least(100, n + 1) AS shown FROM (SELECT count(*) AS n FROM (SELECT c_custkey FROM customer WHERE c_nationkey = 3 UNION ALL SELECT s_suppkey FROM supplier WHERE s_nationkey = 3))")
def expand_capped(spark, sf):
    shown, total = reads.expand(graph(spark, sf, PLACES), 2 * OFFSET + 3)
    return shown.agg(F.lit(total).cast("bigint").alias("total"), F.count(F.lit(1)).alias("shown"))


@query("WITH e AS ({place_edges}), x AS (SELECT d, s FROM e WHERE d LIKE 'nation:%' AND s IN (SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_acctbal < 0)), k AS (SELECT DISTINCT d AS k FROM x) SELECT 'row' AS kind, d AS a, '' AS b, count(*) AS n FROM x GROUP BY d UNION ALL SELECT 'edge', s, d, count(*) FROM e WHERE s IN (SELECT k FROM k) AND d IN (SELECT k FROM k) GROUP BY s, d")
def statement_subgraph(spark, sf):
    rows, edges = reads.query_subgraph(Query(graph(spark, sf, PLACES), parse("MATCH (s:Supplier)-[:IN_NATION]->(n) WHERE s.s_acctbal < 0 RETURN n").plan))
    one = rows.groupBy(key_of().alias("a")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("row").alias("kind"), "a", F.lit("").alias("b"), "n")
    return one.union(edges.groupBy(key_of("src").alias("a"), key_of("dst").alias("b")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge"), "a", "b", "n"))


@query("SELECT 6000000000000 + o_orderkey AS id, 3000000000000 + o_custkey AS src, 'PLACED' AS type FROM orders WHERE contains(lower(o_orderpriority), '1-urg') ORDER BY o_orderkey LIMIT 50")
def find_edges(spark, sf):
    """Edges by the text of a property."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_orderkey") + 6 * OFFSET).alias("id"), (F.col("o_custkey") + 3 * OFFSET).alias("src"), (F.col("o_orderkey") + 6 * OFFSET).alias("dst"), "o_orderpriority")
    g = Graph(spark, graph(spark, sf, ("Customer", "Order")).node_tables, [EdgeTable(orders, "PLACED", src_labels=("Customer",), dst_labels=("Order",), props={"priority": "o_orderpriority"})])
    return reads.find_edges(g, "1-URG", ["priority"]).select("id", "src", "type")


@query(
    "SELECT '(:Customer) x' || (SELECT count(*) FROM customer) || ' {{c_acctbal: Float, c_custkey: Int, c_mktsegment: Str, c_name: Str, c_nationkey: Int}}' AS line UNION ALL SELECT '(:Nation) x' || (SELECT count(*) FROM nation) || ' {{n_name: Str, n_nationkey: Int, n_regionkey: Int}}' UNION ALL SELECT '(:Region) x' || (SELECT count(*) FROM region) || ' {{r_name: Str, r_regionkey: Int}}' UNION ALL SELECT '(:Supplier) x' || (SELECT count(*) FROM supplier) || ' {{s_acctbal: Float, s_name: Str, s_nationkey: Int, s_suppkey: Int}}' "
    "UNION ALL SELECT '(:Customer)-[:IN_NATION]->(:Nation) x' || (SELECT count(*) FROM customer) UNION ALL SELECT '(:Supplier)-[:IN_NATION]->(:Nation) x' || (SELECT count(*) FROM supplier) UNION ALL SELECT '(:Nation)-[:IN_REGION]->(:Region) x' || (SELECT count(*) FROM nation)"
)
def schema_summary(spark, sf):
    return spark.createDataFrame([(x,) for x in catalog.summary(graph(spark, sf, PLACES)).split("\n")], "line string")


@query("SELECT query, count(*) AS hits, round(sum(distance), 5) AS distance FROM (SELECT q.vec_id AS query, 1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, v.vec_id) AS n FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE n <= 5 GROUP BY query")
def vector_index_all_probes(spark, sf):
    """The inverted file with every list probed gives the exact answer."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = vectors.search(vectors.build(rows, lists=16), rows.filter(F.col("id") % 50 == 0), 5, probes=16)
    return rounded(found.groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.sum("distance").alias("distance")), "distance", places=5)


@query("SELECT 'item:' || vec_id AS key, round({cos}, 5) AS score FROM embeddings ORDER BY {cos} DESC, vec_id LIMIT 10")
def search_indexed(spark, sf):
    """Through a declared index, of which every list is probed; and after a tenth of it was taken out and put back."""
    g = graph(spark, sf, ("Item",))
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select((F.col("vec_id") + ITEM).alias("id"), F.col("embedding").alias("vector"))
    some = rows.filter(F.col("id") % 10 == 3)
    index = vectors.upsert(vectors.build(rows, lists=16), some.select("id", F.lit(None).cast("array<float>").alias("vector")))
    g.vector_indexes["Item", "embedding"] = vectors.upsert(index, some)
    return rounded(run(g, f"SEARCH (i:Item) ON embedding NEAR {list(QUERY_VECTOR)} TOPK 10 RETURN i", key=KEY, score=M.Score()), "score", places=5)
