"""Registered queries of the versioned store: write statements, versions, planes, copies, the change feed, sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import QUERY_VECTOR, query, rounded
from .functions.values import Value, tagged
from .operators import catalog
from .operators.lowering import Query
from .operators.writes import apply
from .plans.language import parse
from .plans.values import Vector
from .session import Session
from .sources.formats import export_jsonl, import_jsonl, read_benchmark_csv, vector_text
from .sources.graph import PROPS
from .sources.store import Conflict, NotFound, Store
from .sources.transaction import Transaction, counters, summary_dict
from .storage import shared_dir
from .streaming import feed


def folder(spark, what: str) -> str:
    return f"{shared_dir(spark)}/sparkweave/{what}-{uuid.uuid4().hex}"


def props(**columns) -> F.Column:
    """A map of tagged values: name=(kind, column)."""
    return F.create_map(*(x for n, (kind, c) in columns.items() for x in (F.lit(n), tagged(Value(kind, F.col(c)))))).cast(PROPS)


def customers(spark, sf) -> Store:
    """Version 1 of a store: all customers and nations with their edges."""
    store = Store(spark, folder(spark, "store"))
    tx = Transaction(store)
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    # a table of few row groups would be read, and everything after it done, by few tasks
    c = read("customer").repartition("c_custkey").withColumn("nation", F.col("c_nationkey").cast("bigint"))
    nodes = c.select(name("customer", "c_custkey").alias("key"), F.array(F.lit("Customer"), F.initcap("c_mktsegment")).alias("labels"), props(name=("str", "c_name"), balance=("float", "c_acctbal"), nation=("int", "nation")).alias("props"))
    n = read("nation").select(name("nation", "n_nationkey").alias("key"), F.array(F.lit("Nation")).alias("labels"), props(name=("str", "n_name")).alias("props"))
    tx.bulk_load(nodes.union(n))
    tx.bulk_load_edges(c.select(name("customer", "c_custkey").alias("src_key"), name("nation", "c_nationkey").alias("dst_key"), F.lit("IN").alias("type"), props(balance=("float", "c_acctbal")).alias("props")))
    tx.commit()
    return store


def state(graph, *names: str) -> DataFrame:
    """key, labels and properties (integers) of all nodes."""
    out = Query(graph).scan_all().nodes(*names)
    return out.select("key", F.array_join(F.array_sort("labels"), ",").alias("labels"), *(F.col(n)["i"].alias(n) for n in names))


def links(graph) -> DataFrame:
    """src, dst (keys), type of all edges."""
    keys = graph.nodes(key=True)
    e = graph.edges().join(keys.toDF("src", "a"), "src").join(keys.toDF("dst", "b"), "dst")
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "type")


_LABELS = "'Customer,' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))"
_SORTED = f"array_to_string(list_sort(string_split({_LABELS}, ',')), ',')"


# Versions ------------------------------------------------------------------------------------------------------


def three_versions(spark, sf) -> Session:
    s = Session(customers(spark, sf))
    s.run("MATCH (c:Building) WHERE c.balance > 5000.0 SET c.seen = 2, c:Rich")
    s.run("MATCH (n:Nation)<-[:IN]-(c:Customer) WHERE c.nation = 7 DETACH DELETE c")
    return s


_VERSION = "SELECT 'customer:' || c_custkey AS key, c_custkey, c_nationkey, c_mktsegment = 'BUILDING' AND c_acctbal > 5000 AS rich FROM customer"


@query(
    f"WITH v AS ({_VERSION}) SELECT 1 AS version, key, NULL::BIGINT AS seen FROM v UNION ALL SELECT 2, key, CASE WHEN rich THEN 2 END FROM v UNION ALL SELECT 3, key, CASE WHEN rich THEN 2 END FROM v WHERE c_nationkey <> 7"
)
def as_of_statement(spark, sf):
    s = three_versions(spark, sf)
    parts = [Query(s.graph(v), parse(f"MATCH (c:Customer) RETURN c AS OF {v}").plan).nodes("seen").select(F.lit(v).alias("version"), "key", F.col("seen")["i"].alias("seen")) for v in (1, 2, 3)]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT unnest(['2', 'time of 2', 'latest', 'after']) AS version, unnest([2, 2, 3, 3]) AS rank, unnest([b, b, a, a]) AS n FROM (SELECT count(*) AS b, count(*) FILTER (c_nationkey <> 7) AS a FROM customer)")
def as_of_instant(spark, sf):
    s = three_versions(spark, sf)
    at = s.store.commit(2).ts_ms
    rows = []
    for name, clause in (("2", " AS OF 2"), ("time of 2", f" AS OF TIME {at}"), ("latest", ""), ("after", " AS OF TIME 99999999999999")):
        found = s.run("MATCH (c:Customer) RETURN c" + clause)
        when = parse("MATCH (c:Customer) RETURN c" + clause).as_of
        rows.append((name, s.store.resolve(when.seq, when.ms) if when else s.store.latest(), found.count()))
    return spark.createDataFrame(rows, "version string, rank int, n long")


@query("SELECT unnest(['oldest', 'latest', 'nodes of the oldest', 'before the oldest']) AS what, unnest([3, 4, c + n, -1]) AS value FROM (SELECT count(*) AS c FROM customer WHERE c_nationkey <> 7), (SELECT count(*) AS n FROM nation)")
def history_window(spark, sf):
    store = three_versions(spark, sf).store
    store.compact()
    store.vacuum(2)
    oldest, latest = store.history()
    try:
        store.resolve(1)
        before = 1
    except NotFound:
        before = -1
    return spark.createDataFrame([("oldest", oldest), ("latest", latest), ("nodes of the oldest", store.graph(seq=oldest).nodes().count()), ("before the oldest", before)], "what string, value long")


@query("SELECT unnest(['winner', 'error', 'version']) AS what, unnest([1, 1, 2]) AS n UNION ALL SELECT 'customers', count(*) FROM customer")
def commit_race(spark, sf):
    """Two writers from one version: the second is refused and leaves nothing."""
    store = customers(spark, sf)
    one, two = Transaction(store), Transaction(store)
    one.create_node(["Mark"], key="winner")
    two.create_node(["Mark"], key="loser")
    two.delete_nodes(Query(store.graph()).scan_label("Customer").rows().select("id"), True)
    one.commit()
    refused = 0
    try:
        two.commit()
    except Conflict:
        refused = 1
    marks = Query(store.graph()).scan_label("Mark").nodes().groupBy(F.col("key").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    more = spark.createDataFrame([("error", refused), ("version", store.latest()), ("customers", Query(store.graph()).scan_label("Customer").count())], "what string, n long")
    return marks.union(more)


# Write statements ----------------------------------------------------------------------------------------------


def written(spark, sf, *statements: str) -> tuple[Store, list[dict]]:
    store = customers(spark, sf)
    return store, [summary_dict(apply(store, parse(t))) for t in statements]


def told(spark, done: list[dict]) -> DataFrame:
    return spark.createDataFrame([(i, k, v) for i, d in enumerate(done) for k, v in d.items() if v], "statement int, what string, n long")


@query("SELECT * FROM (VALUES ('a', 'b', 'KNOWS'), ('a', 'c', 'KNOWS')) t(src, dst, type)")
def write_create(spark, sf):
    store, _ = written(spark, sf, 'CREATE (a:P {key: "a", x: 1})-[:KNOWS {w: 1.5}]->(b:P {key: "b"}), (a)-[:KNOWS]->(c:P {key: "c"})')
    return links(store.graph()).filter("type = 'KNOWS'")


@query("SELECT * FROM (VALUES (0, 'nodes_created', 3), (0, 'edges_created', 2), (1, 'nodes_created', 1), (1, 'props_set', 1), (2, 'props_set', 1)) t(statement, what, n) UNION ALL SELECT 3, 'props_set', count(*) FROM customer UNION ALL SELECT 3, 'labels_changed', count(*) FROM customer UNION ALL SELECT 4, 'nodes_deleted', count(*) FROM nation UNION ALL SELECT 4, 'edges_deleted', count(*) FROM customer")
def write_summaries(spark, sf):
    _, done = written(
        spark,
        sf,
        'CREATE (a:P {key: "a"})-[:K]->(b:P {key: "b"}), (a)-[:K]->(c:P)',
        'MERGE (m:P {key: "m"}) ON CREATE SET m.x = 1 ON MATCH SET m.x = 2',
        'MERGE (m:P {key: "m"}) ON CREATE SET m.x = 1 ON MATCH SET m.x = 2',
        "MATCH (c:Customer) SET c.x = 1, c:Seen",
        "MATCH (n:Nation) DETACH DELETE n",
    )
    return told(spark, done)


@query("SELECT 'customer:' || c_custkey AS src, 'club' AS dst, 'JOINED' AS type FROM customer WHERE c_nationkey = 3")
def write_merge_edges(spark, sf):
    """An edge that is there is not made again."""
    text = 'MATCH (c:Customer) WHERE c.nation = 3 MERGE (c)-[:JOINED]->(k:Club {key: "club"})'
    store, _ = written(spark, sf, text, text)
    return links(store.graph()).filter("type = 'JOINED'")


@query("SELECT 'a' AS src, 'b' AS dst, 'T' AS type")
def write_merge_path(spark, sf):
    text = 'MERGE (a:P {key: "a"})-[:T]->(b:P {key: "b"})'
    store, _ = written(spark, sf, text, text)
    return links(store.graph()).filter("type = 'T'")


@query(f"SELECT 'customer:' || c_custkey AS key, CASE WHEN c_nationkey < 5 THEN 'Customer' ELSE {_SORTED} END AS labels, CASE WHEN c_nationkey >= 5 THEN c_nationkey::BIGINT END AS nation FROM customer WHERE c_mktsegment = 'BUILDING'")
def write_remove(spark, sf):
    store, _ = written(spark, sf, "MATCH (c:Building) WHERE c.nation < 5 REMOVE c.nation, c.balance, c:Building")
    segments = spark.read.parquet(f"{sf}/customer.parquet").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("key"))
    return state(store.graph(), "nation").join(segments, "key")


@query("SELECT 'nation:' || n_nationkey AS src, n_nationkey AS n, 5::BIGINT AS v FROM nation WHERE n_nationkey < 9")
def write_match_create(spark, sf):
    """A note for each matched row."""
    names = ", ".join(f'"nation:{i}"' for i in range(9))
    store, _ = written(spark, sf, f"MATCH (n:Nation) WHERE key(n) IN [{names}] CREATE (n)-[:HAS]->(x:Note {{v: 5}})")
    g = store.graph()
    notes = Query(g).scan_label("Note").nodes("v").select(F.col("id").alias("dst"), F.col("v")["i"].alias("v"))
    src = g.edges("HAS").join(notes, "dst").join(g.nodes(key=True).toDF("src", "key"), "src")
    return src.select(F.col("key").alias("src"), F.split("key", ":")[1].cast("int").alias("n"), "v")


@query("SELECT * FROM (VALUES ('n', 'X,Z', 'two', NULL), ('edge', 'LOOP', NULL, 3)) t(what, name, text, number)")
def write_values(spark, sf):
    """Single changes in a transaction, of which the net effect is committed."""
    store = customers(spark, sf)
    tx = Transaction(store)
    n = tx.create_node(["X"], {"v": 1, "gone": 1}, "n")
    tx.delete_node(tx.create_node(["Never"]))
    tx.set_prop(n, "v", "two")
    tx.remove_prop(n, "gone")
    tx.set_labels(n, ["Z", "X"])
    e = tx.create_edge(n, n, "SELF", {"old": 1})
    tx.set_edge_type(e, "LOOP")
    tx.set_edge_prop(e, "w", 3)
    tx.remove_edge_prop(e, "old")
    tx.commit()
    node = store.records("node", store.latest()).filter("key = 'n'").select(F.lit("n").alias("what"), F.array_join(F.array_sort("labels"), ",").alias("name"), F.col("props")["v"]["s"].alias("text"), F.coalesce(F.col("props")["gone"]["i"], F.lit(None)).cast("int").alias("number"))
    edge = store.records("edge", store.latest()).filter(F.col("id") == e).select(F.lit("edge"), "type", F.col("props")["old"]["s"], F.col("props")["w"]["i"].cast("int"))
    return node.union(edge)


@query("SELECT 'b' AS plane, count(*) AS nodes FROM nation UNION ALL SELECT 'startup', 0")
def write_planes(spark, sf):
    store = Store(spark, folder(spark, "store"))
    store.create_plane("a", {"p": 1})
    store.create_plane("gone")
    tx = Transaction(store, "a")
    n = spark.read.parquet(f"{sf}/nation.parquet")
    tx.bulk_load(n.select(F.col("n_name").alias("key"), F.array(F.lit("Nation")).alias("labels"), F.lit(None).cast(PROPS).alias("props")))
    tx.commit()
    store.rename_plane("a", "b")
    store.set_plane_props("b", {"p": 2})
    store.drop_plane("gone")
    return spark.createDataFrame([(p, store.graph(p).nodes().count()) for p in store.commit().planes], "plane string, nodes long")


# Catalogues and copies -----------------------------------------------------------------------------------------


@query("SELECT 'Nation' AS label, 2 * (SELECT count(*) FROM nation) AS count UNION ALL SELECT 'Customer', (SELECT count(*) FROM customer) UNION ALL SELECT upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)), count(*) FROM customer GROUP BY c_mktsegment")
def catalog_merged(spark, sf):
    """One catalogue of two planes."""
    store = customers(spark, sf)
    store.create_plane("other")
    tx = Transaction(store, "other")
    n = spark.read.parquet(f"{sf}/nation.parquet")
    tx.bulk_load(n.select(F.col("n_name").alias("key"), F.array(F.lit("Nation")).alias("labels"), F.lit(None).cast(PROPS).alias("props")))
    tx.commit()
    return catalog.merge([catalog.labels(store.graph()), catalog.labels(store.graph("other"))])


@query("WITH c AS (SELECT * FROM customer WHERE c_nationkey <> 7) SELECT 'node:' AS name, (SELECT count(*) FROM c) + (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'node:Nation', count(*) FROM nation UNION ALL SELECT 'node:Customer', count(*) FROM c UNION ALL SELECT 'node:Rich', count(*) FROM c WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000 UNION ALL SELECT 'edge:', count(*) FROM c UNION ALL SELECT 'edge:IN', count(*) FROM c UNION ALL SELECT 'node:' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)), count(*) FROM c GROUP BY c_mktsegment")
def plane_counters(spark, sf):
    """Totals that commits keep up."""
    return spark.createDataFrame(sorted(counters(three_versions(spark, sf).store).items()), "name string, n long")


@query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM customer) AS edges")
def catalog_count(spark, sf):
    return spark.createDataFrame([catalog.counts(customers(spark, sf).graph())], "nodes long, edges long")


@query(f"WITH v AS ({_VERSION}) SELECT key, CASE WHEN rich THEN 2 END::BIGINT AS seen FROM v WHERE c_nationkey <> 7 UNION ALL SELECT 'nation:' || n_nationkey, NULL FROM nation")
def snapshot_restored(spark, sf):
    store = three_versions(spark, sf).store
    path = folder(spark, "snapshot")
    store.snapshot(path)
    copy = Store(spark, folder(spark, "store"))
    copy.restore(path)
    return state(copy.graph(), "seen").select("key", "seen")


@query(f"SELECT 'customer:' || c_custkey AS key, {_SORTED} AS labels, c_nationkey::BIGINT AS nation, c_name AS name, round(c_acctbal, 6) AS balance FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', NULL, n_name, NULL FROM nation")
def jsonl_round_trip(spark, sf):
    path = folder(spark, "jsonl")
    export_jsonl(customers(spark, sf), path)
    copy = Store(spark, folder(spark, "store"))
    import_jsonl(copy, path)
    out = Query(copy.graph()).scan_all().nodes("nation", "name", "balance")
    return rounded(out.select("key", F.array_join(F.array_sort("labels"), ",").alias("labels"), F.col("nation")["i"].alias("nation"), F.col("name")["s"].alias("name"), F.col("balance")["f"].alias("balance")), "balance")


@query("SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 'IN' AS type FROM customer")
def jsonl_edges(spark, sf):
    path = folder(spark, "jsonl")
    export_jsonl(customers(spark, sf), path)
    copy = Store(spark, folder(spark, "store"))
    import_jsonl(copy, path)
    return links(copy.graph())


@query("SELECT 'n' || vec_id AS key, 'L' || label % 4 AS labels, vec_id * 3 AS value, len(embedding)::INTEGER AS size, embedding[1] > 0 AS first FROM embeddings")
def csv_loaded(spark, sf):
    path = folder(spark, "csv")
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    key = F.concat(F.lit("n"), F.col("vec_id").cast("string"))
    v.select(F.col("vec_id").alias("id"), key.alias("key"), F.concat(F.lit("L"), (F.col("label") % 4).cast("string")).alias("label"), F.lit("x").alias("name"), (F.col("vec_id") * 3).alias("value")).write.csv(f"{path}/nodes.csv", header=True)
    v.select(key.alias("src_key"), F.lit("n0").alias("dst_key"), F.lit("T").alias("type")).write.csv(f"{path}/edges.csv", header=True)
    v.select(F.col("vec_id").alias("id"), vector_text(F.col("embedding")).alias("vector")).write.csv(f"{path}/vectors.csv", header=True)
    store = Store(spark, folder(spark, "store"))
    tx = Transaction(store)
    nodes, edges = read_benchmark_csv(spark, path)
    tx.bulk_load(nodes)
    tx.bulk_load_edges(edges)
    tx.commit()
    out = Query(store.graph()).scan_all().nodes("value", "embedding")
    return out.select("key", F.array_join("labels", ",").alias("labels"), F.col("value")["i"].alias("value"), F.size(F.col("embedding")["v"]).alias("size"), (F.get(F.col("embedding")["v"], F.lit(0)) > 0).alias("first"))


# The feed ------------------------------------------------------------------------------------------------------


def followed(store: Store, **how) -> DataFrame:
    """The rows that a follower is handed, in a table."""
    path = folder(store.spark, "feed")
    feed.follow(store, lambda df: df.select("seq", "kind", "op", "id", "truncated").write.mode("append").parquet(path), folder(store.spark, "state"), once=True, **how).awaitTermination()
    return store.spark.read.parquet(path)


@query("SELECT 2 AS seq, 'update' AS op, least(256, count(*)) AS n, count(*) > 256 AS truncated FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def feed_by_label(spark, sf):
    """A label's feed: nodes that carry it after the commit."""
    rows = followed(three_versions(spark, sf).store, label="Rich", since=1)
    return rows.filter("op <> 'delete'").groupBy(F.col("seq").cast("int").alias("seq"), "op").agg(F.count(F.lit(1)).alias("n"), F.max("truncated").alias("truncated"))


@query("WITH v AS (SELECT (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000) AS b, (SELECT count(*) FROM customer WHERE c_nationkey = 7) AS c) SELECT 1 AS seq, 256 AS n FROM v UNION ALL SELECT 2, least(256, b) FROM v UNION ALL SELECT 3, least(256, 2 * c) FROM v")
def feed_followed(spark, sf):
    """All changes of three commits, each listed up to the cap."""
    return followed(three_versions(spark, sf).store).groupBy(F.col("seq").cast("int").alias("seq")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH v AS ({_VERSION}) SELECT key, CASE WHEN rich THEN 2 END::BIGINT AS seen, 3 AS version FROM v WHERE c_nationkey <> 7 UNION ALL SELECT 'nation:' || n_nationkey, NULL, 3 FROM nation")
def replica_state(spark, sf):
    """A store that followed all commits of another; a batch that runs again changes nothing."""
    source, target = three_versions(spark, sf).store, Store(spark, folder(spark, "store"))
    for _ in range(2):
        feed.replicate(source, target, folder(spark, "state"), once=True).awaitTermination()
    return state(target.graph(), "seen").select("key", "seen", F.lit(target.latest()).cast("int").alias("version"))


# Sessions ------------------------------------------------------------------------------------------------------


@query(
    "SELECT * FROM (VALUES ('db.stats nodes', 3), ('db.stats edges', 2), ('db.stats indexes', 1), ('plane.search', 1), ('keyword', 2), ('as of 1', 0), ('plane.algo', 1), ('symbol.resolve', 3), ('symbol.trace', 3), ('cap', 1)) t(what, n)"
)
def session_methods(spark, sf):
    s = Session(Store(spark, folder(spark, "store")), embed=lambda t: list(QUERY_VECTOR[:2]))
    s.declare_keyword_index("Doc", "body", "none")
    nodes = [{"key": k, "labels": ["Doc"], "props": {"body": body, "embedding": Vector(v)}} for k, body, v in (("a", "one graph", [1, 0]), ("b", "another graph", [0, 1]), ("c", "no", [1, 1]))]
    s.call("write.nodes", nodes=nodes, edges=[{"src": "a", "dst": "b", "type": "CALLS"}, {"src": "b", "dst": "c", "type": "CALLS"}])
    stats = s.call("db.stats")
    rows = [("db.stats nodes", stats["nodes"]), ("db.stats edges", stats["edges"]), ("db.stats indexes", stats["indexes"])]
    ids = {r["key"]: r["id"] for r in s.run("MATCH (d:Doc) RETURN d").collect()}
    rows.append(("plane.search", int(s.call("plane.search", query=[0, 1], k=1).first()["id"] == ids["b"])))
    rows.append(("keyword", s.run('SEARCH (d:Doc) ON body MATCHING "graph" RETURN d').count()))
    rows.append(("as of 1", s.run("MATCH (d:Doc) RETURN d AS OF 1").count()))
    rows.append(("plane.algo", s.call("plane.algo", name="components")["groups"]))
    rows.append(("symbol.resolve", ids["c"] - ids["a"] + len(s.call("symbol.resolve", name="c")[1])))
    rows.append(("symbol.trace", len(s.call("symbol.trace", src=ids["a"], dst=ids["c"])[0])))
    rows.append(("cap", len(s.call("plane.algo", name="pagerank", limit=1)["rows"])))
    return spark.createDataFrame(rows, "what string, n long")
