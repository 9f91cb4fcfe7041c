import time

import pytest
from pyspark.sql import functions as F

from sparkweave import catalogue
from sparkweave.operators.deadline import Timeout, deadline
from sparkweave.plans import model as M
from sparkweave.session import Session
from sparkweave.sources.store import Conflict, Store

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_push_filters_and_prune_columns(spark):
    text = plan_of(catalogue.flagship(spark, SF))
    assert "TakeOrderedAndProject" in text and "EqualTo(c_mktsegment,BUILDING)" in text and "GreaterThan(o_totalprice,200000" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in text
    assert "c_name" not in text and "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_order_is_carried_only_where_it_counts(spark):
    g = catalogue.graph(spark, SF, catalogue.PLACES)
    from sparkweave.operators.lowering import Query

    hop = Query(g).scan_label("Customer").expand_out("IN_NATION")
    assert "Sort" not in plan_of(hop.rows()).replace("SortMergeJoin", "") and len(hop.rows().columns) == 3
    assert "__o" not in plan_of(hop.rows())


def test_labels_that_an_edge_cannot_reach(spark):
    from sparkweave.operators.lowering import Query
    from sparkweave.plans.language import parse

    g = catalogue.graph(spark, SF)
    n = lambda text: Query(g, parse(text).plan).count()
    assert n("MATCH (c:Customer)-[:PLACED]->(x:Part) RETURN x") == 0 == n("MATCH (c:Customer)-[:PLACED]->(x:Nope) RETURN x")
    assert n("MATCH (c:Customer)-[:PLACED]->(x) WHERE x:Part RETURN x") == 0 == n("MATCH (c:Nope) RETURN c")
    assert n("MATCH (c:Customer)-[:PLACED]->(x) WHERE NOT x:Part RETURN x") == n("MATCH (c:Customer)-[:PLACED]->(x:Order) RETURN x") > 0


def test_deadline(spark):
    with pytest.raises(Timeout):
        with deadline(spark, 1.0):
            spark.range(8).repartition(8).mapInPandas(lambda it: (time.sleep(4) or p for p in it), "id long").count()
    with deadline(spark, 60):
        assert spark.range(5).count() == 5


def test_session(spark, tmp_path):
    s = Session(Store(spark, f"file://{tmp_path}/db"), embed=lambda t: [1.0, 0.0])
    done = s.call("write.nodes", nodes=[{"key": "a", "labels": ["Doc"], "props": {"body": "graphs and graph stores", "embedding": M.Vector([1, 0])}}, {"key": "b", "labels": ["Doc"], "props": {"body": "other"}}], edges=[{"src": "a", "dst": "b", "type": "CALLS"}], embed=lambda t: [0.0, 1.0])
    assert done["nodes_created"] == 2 and done["edges_created"] == 1
    keys = lambda df: [r["key"] for r in df.collect()]
    text = 'SEARCH (d:Doc) ON body MATCHING "graph" RETURN d'
    assert keys(s.run(text)) == []  # no index is declared
    s.declare_keyword_index("Doc", "body")
    s.declare_keyword_index("Doc", "body", "en")
    with pytest.raises(Conflict):
        s.declare_keyword_index("Doc", "body", "none")
    assert keys(s.run(text)) == ["a"]
    assert keys(s.run('SEARCH (d:Doc) NEAR "words" TOPK 1 RETURN d')) == ["a"]
    assert s.run('MATCH (d:Doc) WHERE key(d) = "b" SET d.body = $t', {"t": "a graph"}).props_set == 1
    assert sorted(keys(s.run(text))) == ["a", "b"] and keys(s.run("MATCH (d:Doc) RETURN d ORDER BY key(d) DESC AS OF 1")) == ["b", "a"]
    stats = s.call("db.stats")
    assert (stats["nodes"], stats["edges"], stats["indexes"], stats["planes"]) == (2, 1, 1, ["startup"])
    assert s.call("plane.algo", name="components")["groups"] == 1 and s.call("plane.algo", name="pagerank")["total"] == 2
    assert s.call("plane.search", query=[0, 1], k=1).first()["id"] == 2
    rows, edges = s.call("plane.subgraph", text="MATCH (a:Doc) RETURN a")
    assert rows.count() == 2 and edges.count() == 1
    plan = M.LogicalPlan(M.ScanLabel("Doc"), (M.Filter(M.Property("body").contains("graphs")),))
    assert keys(s.call("plane.query", plan=plan.to_json())) == ["a"]
    spec = M.Hybrid("Doc", M.VectorChannel("embedding", M.Vector([1, 0])), M.KeywordChannel("body", "graph"))
    assert s.call("plane.hybrid", spec=spec).orderBy(F.desc("score")).first()["id"] == 1
    assert s.call("symbol.resolve", name="b") == (2, ["b"]) and s.call("symbol.trace", src=1, dst=2) == ([1, 2], False)
    assert s.call("plane.find", text="GRAPHS", props=["body"])["nodes"].first()["field"] == "body"
    assert "(:Doc)-[:CALLS]->(:Doc) x1" in s.call("plane.summary")
    with pytest.raises(KeyError):
        s.call("nothing")


def test_declared_vector_index_is_kept_by_commits(spark, tmp_path):
    import random

    rng = random.Random(1)
    s = Session(Store(spark, f"file://{tmp_path}/db"))
    s.declare_vector_index("V", "embedding", "L2", lists=8)
    with pytest.raises(Conflict):
        s.declare_vector_index("V", "embedding", "Cosine", lists=8)
    points = {f"k{i}": [rng.random() for _ in range(4)] for i in range(200)}
    s.call("write.nodes", nodes=[{"key": k, "labels": ["V"], "props": {"embedding": M.Vector(v)}} for k, v in points.items()])

    def search(q, k=5):
        g = s.query(M.LogicalPlan(M.VectorTopK("V", "embedding", M.Vector(q), "L2", k)))
        assert g.graph.vector_indexes["V", "embedding"].lists is not None
        return {r["key"] for r in g.nodes().collect()}

    def exact(q, k=5):
        return set(sorted(points, key=lambda n: sum((a - b) ** 2 for a, b in zip(points[n], q, strict=True)))[:k])

    assert search([0.5] * 4) == exact([0.5] * 4)  # eight lists are fewer than the probes
    built = s.indexes["vector", "V", "embedding"]
    points["new"] = [0.5, 0.5, 0.5, 0.5]
    s.call("write.nodes", nodes=[{"key": "new", "labels": ["V"], "props": {"embedding": M.Vector(points["new"])}}])
    gone = next(iter(exact([0.5] * 4) - {"new"}))
    s.run(f'MATCH (v:V) WHERE key(v) = "{gone}" DELETE v')
    del points[gone]
    assert search([0.5] * 4) == exact([0.5] * 4)
    assert s.indexes["vector", "V", "embedding"][1].centroids is built[1].centroids  # changed, not built anew
