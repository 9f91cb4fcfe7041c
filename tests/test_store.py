import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkweave.catalogue_stores import customers, plane_counters
from sparkweave.functions.values import untag
from sparkweave.operators.lowering import Query
from sparkweave.operators.writes import _set, apply
from sparkweave.plans.language import parse
from sparkweave.sources import formats
from sparkweave.sources.formats import export_jsonl, import_jsonl, read_benchmark_csv, vector_text
from sparkweave.sources.store import Conflict, NotFound, Store
from sparkweave.sources.transaction import Transaction, counters
from sparkweave.streaming import feed


def state(store, *props, seq=None, plane="startup"):
    rows = Query(store.graph(plane, seq)).scan_all().nodes(*props).collect()
    return {r["key"] or r["id"]: (sorted(r["labels"]), {p: untag(r[p]) for p in props if untag(r[p]) is not None}) for r in rows}


def edges(store):
    return sorted((r["src"], r["type"], r["dst"]) for r in store.graph().edges().collect())


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db")
    apply(s, parse('CREATE (a:Person {key: "a", age: 30})-[:KNOWS {w: 2.5}]->(b:Person {key: "b"})'))
    return s


def test_statements_and_versions(spark, store, tmp_path):
    run = lambda t: apply(store, parse(t))
    assert run('MERGE (c:Paper {key: "c"}) ON CREATE SET c.year = 1 ON MATCH SET c.year = 2').nodes_created == 1
    assert run('MERGE (c:Paper {key: "c"}) ON CREATE SET c.year = 1 ON MATCH SET c.year = 2').nodes_created == 0
    assert state(store, "year", "age") == {"a": (["Person"], {"age": 30}), "b": (["Person"], {}), "c": (["Paper"], {"year": 2})}
    assert state(store, "year", seq=2)["c"] == (["Paper"], {"year": 1}) and set(state(store, seq=1)) == {"a", "b"}
    done = run('MATCH (n:Person) MERGE (n)-[:CITES]->(c {key: "c"})')
    assert done.edges_created == 2 and run('MATCH (n:Person) MERGE (n)-[:CITES]->(c {key: "c"})').edges_created == 0
    assert run("MATCH (n:Person) CREATE (n)-[:WROTE]->(m:Note {x: 1})").nodes_created == 2
    run("MATCH (n:Note) SET n.x = 2, n:Old, n += {y: 'z'} REMOVE n:Note")
    assert sum(v == (["Old"], {"x": 2, "y": "z"}) for v in state(store, "x", "y").values()) == 2
    with pytest.raises(Conflict):
        run('MATCH (n) WHERE key(n) = "a" DELETE n')
    gone = run('MATCH (n) WHERE key(n) = "a" DETACH DELETE n')
    assert (gone.nodes_deleted, gone.edges_deleted) == (1, 3) and "a" not in state(store)
    assert counters(store)["node:"] == 4 and counters(store)["edge:CITES"] == 1 and "edge:KNOWS" not in counters(store)
    last = store.latest()
    # versions by time, and their bounds
    assert store.resolve(ms=store.commit(3).ts_ms) >= 3 and store.resolve(seq=10**9) == last
    with pytest.raises(NotFound):
        store.resolve(ms=0)
    before = state(store, "x")
    store.compact()
    assert state(store, "x") == before and store.vacuum(2) == last
    with pytest.raises(NotFound):
        store.resolve(seq=1)
    assert state(store, "x") == before
    store.snapshot(f"file://{tmp_path}/copy")
    other = Store(spark, f"file://{tmp_path}/other")
    other.restore(f"file://{tmp_path}/copy")
    assert state(other, "x") == before
    with pytest.raises(Conflict):
        other.restore(f"file://{tmp_path}/copy")


def test_transactions(spark, store):
    tx, rival = Transaction(store), Transaction(store)
    with pytest.raises(Conflict):
        tx.create_node(key="a")
    n = tx.create_node(["X"], {"v": 1}, "n")
    gone = tx.create_node(["Y"])
    tx.delete_node(gone)
    tx.set_prop(n, "v", "two")
    tx.set_labels(n, ["Z", "X"])
    tx.remove_prop(n, "nothing")
    e = tx.create_edge(n, n, "SELF")
    tx.set_edge_type(e, "LOOP")
    tx.set_edge_prop(e, "w", 3)
    with pytest.raises(NotFound):
        tx.set_prop(10**6, "v", 1)
    with pytest.raises(NotFound):
        tx.create_edge(n, 10**6, "T")
    tx.delete_node(10**6)
    assert {(r["kind"], r["op"]) for r in tx.net().collect()} == {("node", "create"), ("edge", "create")}
    tx.commit()
    assert state(store, "v")["n"] == (["X", "Z"], {"v": "two"}) and (n, "LOOP", n) in edges(store)
    rival.create_node(["Late"])
    with pytest.raises(Conflict):
        rival.commit()


def test_planes_and_bulk(spark, store):
    store.create_plane("other", {"p": 1})
    with pytest.raises(Conflict):
        store.create_plane("other")
    from pyspark.sql import functions as F

    from sparkweave.sources.graph import PROPS

    tx = Transaction(store, "other")
    nodes = spark.range(1000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.array(F.lit("B")).alias("labels"), F.lit(None).cast(PROPS).alias("props"))
    found = tx.bulk_load(nodes)
    numbers = sorted(r["id"] for r in found.collect())
    assert numbers == list(range(numbers[0], numbers[0] + 1000))
    tx.bulk_load_edges(spark.range(999).select(F.concat(F.lit("k"), F.col("id")).alias("src_key"), F.concat(F.lit("k"), F.col("id") + 1).alias("dst_key"), F.lit("NEXT").alias("type"), F.lit(None).cast(PROPS).alias("props")))
    with pytest.raises(Conflict):
        tx.bulk_load(nodes.union(nodes))
    with pytest.raises(NotFound):
        tx.bulk_load_edges(spark.createDataFrame([("k1", "zz", "T", None)], "src_key string, dst_key string, type string, props string").withColumn("props", F.lit(None).cast(PROPS)))
    tx.commit()
    assert Query(store.graph("other")).seek_keys(["k0"]).expand_out().expand_out().count() == 1
    assert set(state(store)) == {"a", "b"} and counters(store, "other")["edge:"] == 999
    store.rename_plane("other", "name")
    store.drop_plane("name")
    store.drop_plane("name")
    with pytest.raises(NotFound):
        store.graph("name")
    for wrong in (lambda: store.drop_plane("startup"), lambda: store.rename_plane("startup", "x")):
        with pytest.raises(ValueError):
            wrong()


def test_feed_and_replica(spark, store, tmp_path):
    apply(store, parse('MATCH (n) WHERE key(n) = "a" SET n.v = 1, n._hidden = 2'))
    apply(store, parse('MATCH (n) WHERE key(n) = "b" DETACH DELETE n'))
    got = []
    feed.follow(store, lambda df: got.extend(df.collect()), f"{tmp_path}/c1", once=True).awaitTermination()
    assert [(r["seq"], r["kind"], r["op"], r["id"]) for r in sorted(got, key=lambda r: (r["seq"], r["kind"], r["id"]))] == [(1, "edge", "create", 3), (1, "node", "create", 1), (1, "node", "create", 2), (2, "node", "update", 1), (3, "edge", "delete", 3), (3, "node", "delete", 2)]
    update = next(r for r in got if r["op"] == "update")
    assert set(update["props"]) == {"age", "v"} and not update["truncated"]
    assert all(r["key"] is None and r["props"] is None for r in got if r["op"] == "delete")
    only = []
    feed.follow(store, lambda df: only.extend(df.collect()), f"{tmp_path}/c2", label="Person", since=1, once=True).awaitTermination()
    assert [(r["seq"], r["op"]) for r in sorted(only, key=lambda r: r["seq"])] == [(2, "update"), (3, "delete")]
    copy = Store(spark, f"file://{tmp_path}/copy")
    for _ in range(2):  # a batch that runs again changes nothing
        feed.replicate(store, copy, f"{tmp_path}/c3-{_}", once=True).awaitTermination()
    assert state(copy, "v") == state(store, "v") and copy.history() == store.history()


def test_change_list_is_capped(spark, store):
    tx = Transaction(store)
    for i in range(5):
        tx.create_node(["N"])
    tx.commit()
    rows = feed.shown(feed.changes_of(store, [2]), cap=3).collect()
    assert len(rows) == 3 and all(r["truncated"] for r in rows)


def test_json_lines(spark, store, tmp_path):
    apply(store, parse('MATCH (n) WHERE key(n) = "a" SET n.e = [1, 2], n.s = "ü"'))
    export_jsonl(store, f"{tmp_path}/out")
    other = Store(spark, f"file://{tmp_path}/other")
    import_jsonl(other, f"{tmp_path}/out")
    assert state(other, "e", "s", "age") == state(store, "e", "s", "age") and len(edges(other)) == 1
    with pytest.raises(Conflict):
        import_jsonl(other, f"{tmp_path}/out")
    apply(other, parse('MATCH (n) WHERE key(n) = "a" SET n.age = 1'))
    import_jsonl(other, f"{tmp_path}/out", on_conflict="update")
    assert state(other, "age")["a"] == (["Person"], {"age": 30})


def test_benchmark_csv(spark, tmp_path):
    (tmp_path / "nodes.csv").write_text("id,key,label,name,value\n1,n1,A,x,5\n2,n2,B,y,6\n")
    (tmp_path / "edges.csv").write_text("src_key,dst_key,type\nn1,n2,T\n")
    (tmp_path / "vectors.csv").write_text("id,vector\n1,0.6 0.8\n")
    store = Store(spark, f"file://{tmp_path}/db")
    tx = Transaction(store)
    nodes, links = read_benchmark_csv(spark, str(tmp_path))
    tx.bulk_load(nodes)
    tx.bulk_load_edges(links)
    tx.commit()
    assert state(store, "name", "value") == {"n1": (["A"], {"name": "x", "value": 5}), "n2": (["B"], {"name": "y", "value": 6})}
    assert [r["id"] for r in Query(store.graph()).vector_top_k(None, "embedding", [1, 1], 3).ids().collect()] == [1]


def test_the_loser_of_a_race_changes_nothing(spark, store):
    one, two = Transaction(store), Transaction(store)
    one.create_node(["W"], key="winner")
    two.create_node(["L"], key="loser")
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert set(state(store)) == {"a", "b", "winner"}
    # rows that a writer left without a commit file are not read
    three = Transaction(store)
    three.create_node(["L"], key="lost")
    store._write(three.net(), f"log/seq={store.latest()}/part=dead")
    store._write(three.net(), f"log/seq={store.latest() + 1}/part=dead")
    assert set(state(store)) == {"a", "b", "winner"}
    assert not store.files.publish("commits/1.json", "{}") and store.commit(1).seq == 1
    store.compact()
    store.vacuum(1)
    assert set(state(store)) == {"a", "b", "winner"} and not any(store.files.list(f"log/seq={n}") for n in (2, 3))


def test_csv_brings_back_the_same_floats(spark, tmp_path):
    """csv_loaded over values that six places round to nothing, and odd ones; against its SQL."""
    import duckdb

    from sparkweave import catalogue_stores  # noqa: F401
    from sparkweave.catalogue import oracle_sql, queries

    rows = [(0, [4e-7, 1.0], 0), (1, [-4e-7, 1.0], 1), (2, [1e-30, 2.0], 2), (3, [0.1234567, 3e9], 3), (4, [float("nan"), 1.0], 0), (5, [float("-inf"), 1.0], 1), (6, [None, 1.0, 2.0], 2), (7, [], 3), (8, None, 0), (9, [0.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = {tuple(r) for r in con.execute(oracle_sql()["csv_loaded"]).fetchall()}
    assert {tuple(r) for r in queries()["csv_loaded"](spark, str(tmp_path)).collect()} == want
    v = spark.createDataFrame([([0.1234567, 3.0e-39, 16777217.0, None],)], "v array<float>")
    (tmp_path / "nodes.csv").write_text("id,key,label,name,value\n1,n1,A,x,5\n")
    (tmp_path / "edges.csv").write_text("src_key,dst_key,type\n")
    (tmp_path / "vectors.csv").write_text("id,vector\n1," + v.select(vector_text(F.col("v"))).first()[0] + "\n")
    assert read_benchmark_csv(spark, str(tmp_path))[0].select("props.embedding.v").first()[0] == v.first()[0]


def test_a_version_reads_what_is_asked_of_it(spark, tmp_path):
    """Later commits are laid over by their ids: columns that nobody reads stay on disk, and one commit needs no grouping."""
    store = Store(spark, f"file://{tmp_path}/db")
    tx = Transaction(store)
    tx.bulk_load(spark.range(20).select(F.concat(F.lit("k"), "id").alias("key"), F.array(F.lit("P")).alias("labels"), F.create_map(F.lit("x"), F.struct(F.lit(2).cast("tinyint").alias("t"), F.lit(None).cast("boolean").alias("b"), F.col("id").alias("i"), F.lit(None).cast("double").alias("f"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("binary").alias("x"), F.lit(None).cast("array<float>").alias("v"), F.lit(None).cast("string").alias("j"), F.lit(None).cast("string").alias("d"))).alias("props")))
    tx.commit()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one = plan(store.records("node", 1, 0).select("id", "labels"))
    assert "Aggregate" not in one and "Exchange" not in one and "props" not in one
    apply(store, parse("MATCH (n:P) WHERE n.x > 14 SET n.x = 0, n:Q"))
    apply(store, parse("MATCH (n:P) WHERE n.x = 3 DETACH DELETE n"))
    assert "props" not in plan(store.records("node", 3, 0).select("id", "labels"))
    values = lambda seq=None: {k: v[1]["x"] for k, v in state(store, "x", seq=seq).items()}
    first = {f"k{i}": i for i in range(20)}
    second = {k: 0 if i > 14 else i for k, i in first.items()}
    third = {k: i for k, i in second.items() if i != 3}
    assert (values(1), values(2), values(3)) == (first, second, third)
    store.compact()
    apply(store, parse("MATCH (n:Q) SET n.x = 7"))
    assert values() == {k: 7 if first[k] > 14 else i for k, i in third.items()} and values(4) == third


def test_one_row_group_is_loaded_by_many_tasks(spark, tmp_path):
    n = 60_000
    c = spark.range(n).select(F.col("id").alias("c_custkey"), F.sha2(F.col("id").cast("string"), 256).alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.col("id").cast("double").alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
    c.coalesce(1).write.parquet(f"file://{tmp_path}/customer.parquet")
    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"), F.col("id").cast("string").alias("n_name")).coalesce(1).write.parquet(f"file://{tmp_path}/nation.parquet")
    store = customers(spark, f"file://{tmp_path}")
    rows = store.records("node", 1).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in rows) == n + 25 and max(r["count"] for r in rows) < n
    assert store.records("edge", 1).select("id", "src").distinct().count() == n


def test_import_parses_a_line_once(spark, store, tmp_path, monkeypatch):
    path, parsed, real = f"file://{tmp_path}/lines", spark.sparkContext.accumulator(0), formats.read_jsonl

    def read(spark, *paths):
        def run(batches):
            for b in batches:
                parsed.add(b.num_rows)
                yield b

        df = real(spark, *paths)
        return df.mapInArrow(run, df.schema)

    export_jsonl(store, path)
    monkeypatch.setattr(formats, "read_jsonl", read)
    copy = Store(spark, f"file://{tmp_path}/copy")
    import_jsonl(copy, path)
    assert parsed.value == 3  # two nodes and an edge
    assert state(copy, "age") == state(store, "age") and len(edges(copy)) == 1


def test_rows_of_a_batch_are_those_of_to_pylist():
    value = pa.struct([("t", pa.int8()), ("i", pa.int64()), ("s", pa.string()), ("d", pa.string())])
    v = [{"key": k, "value": x} for k, x in (("a", {"t": 2, "i": 5, "s": None}), ("b", None), ("c", {"t": 4, "i": None, "s": "x"}))]
    batch = pa.RecordBatch.from_pydict({"id": pa.array([1, 2, 3, 4, 5]), "props": pa.array([v[:2], None, [], v[2:], v[1:]], pa.list_(pa.struct([("key", pa.string()), ("value", value)])))})
    for part in (batch, batch.slice(1), batch.slice(3, 1), batch.slice(0, 0)):
        got = [(r["id"], [(e["key"], untag(e["value"])) for e in r["props"]]) for r in formats._rows(part)]
        assert got == [(r["id"], [(e["key"], untag(e["value"])) for e in r["props"] or []]) for r in part.to_pylist()]


def test_entities_of_one_step_are_not_grouped(spark, tmp_path):
    """Properties and labels are set in one step; what no two steps can hold is written as it is, the rest as one net change."""
    d = f"file://{tmp_path}"
    spark.createDataFrame([(i, f"c{i}", i % 9, 100.0 * i, "BUILDING" if i % 2 else "MACHINERY") for i in range(90)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    spark.range(9).select(F.col("id").cast("int").alias("n_nationkey"), F.col("id").cast("string").alias("n_name")).write.parquet(f"{d}/nation.parquet")
    store = customers(spark, d)
    ids = Query(store.graph()).scan_label("Building").rows().select("id")
    grouped = lambda tx: "Aggregate" in tx.net()._jdf.queryExecution().executedPlan().toString()
    one = Transaction(store)
    _set(one, ids, list(parse("MATCH (c:Building) SET c.v = 1, c.w = 2, c:Seen").ops[0].items))
    assert not grouped(one) and (one.summary.props_set, one.summary.labels_changed) == (90, 45)
    gone = Transaction(store)
    gone.delete_nodes(ids, True)
    assert not grouped(gone) and {(r["kind"], r["op"], r["count"]) for r in gone.net().groupBy("kind", "op").count().collect()} == {("node", "delete", 45), ("edge", "delete", 45)}
    # a step over rows of another one
    one.delete_nodes(ids, True)
    n = one.create_node(["X"])
    one.set_prop(n, "v", 1)
    assert grouped(one) and {(r["kind"], r["op"], r["count"]) for r in one.net().groupBy("kind", "op").count().collect()} == {("node", "delete", 45), ("edge", "delete", 45), ("node", "create", 1)}
    one.commit()
    assert counters(store) == {"node:": 55, "node:Nation": 9, "node:Customer": 45, "node:Machinery": 45, "node:X": 1, "edge:": 45, "edge:IN": 45}
    rich, left = (sum(f(i) for i in range(90) if i % 9 != 7) for f in (lambda i: i % 2 and 100.0 * i > 5000, lambda i: i % 2))
    assert {r["name"]: r["n"] for r in plane_counters(spark, d).collect()} == {"node:": 89, "node:Nation": 9, "node:Customer": 80, "node:Building": left, "node:Machinery": 80 - left, "node:Rich": rich, "edge:": 80, "edge:IN": 80}
