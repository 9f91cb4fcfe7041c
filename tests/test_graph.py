import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkweave.functions.values import tagged_row
from sparkweave.operators import algorithms, catalog, hybrid, keyword, reads, vectors
from sparkweave.operators.lowering import Query
from sparkweave.plans import model as M
from sparkweave.plans.language import parse
from sparkweave.plans.values import Vector
from sparkweave.sources.graph import SOFT_EDGES, SOFT_NODES, soft_graph

P = M.Property


def make(spark, nodes, edges, types=None):
    """nodes: (id, key, labels, props); edges: (src, type, dst[, props]), numbered from 1000."""
    rows = [(i, k, list(labels), {n: tagged_row(v) for n, v in p.items()}) for i, k, labels, p in nodes]
    links = [(1000 + n, e[0], e[2], e[1], {k: tagged_row(v) for k, v in (e[3] if len(e) > 3 else {}).items()}) for n, e in enumerate(edges)]
    return soft_graph(spark, spark.createDataFrame(rows, SOFT_NODES), spark.createDataFrame(links, SOFT_EDGES), types or list(dict.fromkeys(e[1] for e in edges)))


@pytest.fixture(scope="module")
def cites(spark):
    nodes = [(1, "p1", ["Paper"], {"year": 2020}), (2, "p2", ["Paper"], {"year": 2019}), (3, "p3", ["Paper"], {"year": 2021}), (4, "a1", ["Person"], {})]
    return make(spark, nodes, [(1, "CITES", 2), (1, "CITES", 3), (2, "CITES", 3), (4, "AUTHORED", 1)])


@pytest.fixture(scope="module")
def line(spark):
    nodes = [(i, f"d{i}", ["Doc"], {"emb": Vector([i, 0])}) for i in range(4)]
    return make(spark, nodes, [(i, "CITES", i + 1) for i in range(3)])


def ids(q):
    return [r["id"] for r in q.ids().collect()]


def q(g, text):
    return Query(g, parse(text).plan)


def test_scans_and_seeks(cites):
    assert ids(Query(cites).scan_label("Paper")) == [1, 2, 3]
    assert ids(Query(cites).scan_label("Person")) == [4] and ids(Query(cites).scan_label("Nope")) == []
    assert Query(cites).scan_all().count() == 4
    assert ids(Query(cites).seek_ids([3, 9, 1, 3])) == [3, 1, 3]
    assert ids(Query(cites).seek_keys(["a1", "zz", "p2", "a1"])) == [4, 2, 4]


def test_expansion_order_and_loops(spark, cites):
    assert ids(Query(cites).seek_ids([1]).expand_out("CITES")) == [2, 3]
    assert ids(Query(cites).seek_ids([1]).expand_both()) == [2, 3, 4]
    assert ids(Query(cites).seek_ids([3]).expand_in("CITES").distinct()) == [1, 2]
    loop = make(spark, [(1, None, ["N"], {}), (2, None, ["N"], {})], [(1, "T", 1), (1, "S", 2), (1, "T", 2), (1, "T", 2)])
    assert ids(Query(loop).seek_ids([1]).expand_both()) == [1, 2, 2, 2, 1]
    assert ids(Query(loop).seek_ids([1]).expand_out("T")) == [1, 2, 2]


def test_walks(spark):
    chain = make(spark, [(i, c, ["N"], {}) for i, c in enumerate("abcd")], [(0, "T", 1), (1, "T", 2), (2, "T", 3), (0, "T", 3)])
    assert ids(Query(chain).seek_ids([0]).expand_var("Out", None, 1, 2)) == [3, 1, 2]
    assert ids(Query(chain).seek_ids([0]).expand_var("Out", None, 0, 3)) == [0, 3, 1, 2, 3]
    rows = Query(chain).seek_ids([0]).expand_var("Out", None, 2, 3).rows(True).collect()
    assert [(r["id"], r["hops"]) for r in rows] == [(2, 2), (3, 3)]
    assert ids(Query(chain).seek_ids([0]).expand_var("Out", None, 1, 3).distinct().skip(1).limit(1)) == [1]


def test_steps(cites):
    assert ids(Query(cites).scan_label("Paper").sort_desc(P("year")).skip(1).limit(1)) == [1]
    assert ids(q(cites, "MATCH (a:Person)-[:AUTHORED]->(p)-[:CITES]->(c:Paper) WHERE c.year > 2019 RETURN c")) == [3]
    nodes, edges = q(cites, "MATCH (a:Person)-[*2]->(c) RETURN c").subgraph()
    assert sorted(r["id"] for r in nodes.collect()) == [1, 2, 3, 4] and edges.count() == 3
    assert [(r["key"], r["year"]) for r in Query(cites).scan_label("Paper").sort_asc(P("year")).select(ordered=True, key=M.ExternalKey(), year=P("year") + 0).withColumn("year", F.col("year.i")).collect()] == [("p2", 2019), ("p1", 2020), ("p3", 2021)]


def test_vectors_frontier_and_beam(line):
    assert ids(Query(line).vector_top_k("Doc", "emb", [0, 0], 2, "L2")) == [0, 1]
    rows = Query(line).vector_top_k("Doc", "emb", [0, 0], 3, "L2").rows(True).collect()
    assert [r["score"] for r in rows] == [0.0, -1.0, -2.0]
    assert ids(Query(line).vector_top_k("Doc", "emb", [0, 0, 0], 2)) == [] == ids(Query(line).vector_top_k("Doc", "emb", [0, 0], 0))
    top = Query(line).scan_all().filter(~M.ExternalKey().eq("d0")).frontier_top_k("emb", [0, 0], 2, "L2")
    assert ids(top) == [1, 2] and ids(top.expand_out()) == [2, 3]
    beam = Query(line).seek_ids([0]).expand_beam("Out", None, "emb", [3, 0], 1, 3, "L2").rows(True).collect()
    assert [(r["id"], r["hops"], r["score"]) for r in beam] == [(1, 1, -2.0), (2, 2, -1.0), (3, 3, 0.0)]


@pytest.fixture(scope="module")
def fusion(spark):
    texts = ["graph databases store connected data", "vector search finds similar items", "graph graph structure and graph queries", "entirely unrelated subject matter"]
    at = [[0, 0], [1, 0], [6, 0], [0, 4]]
    g = make(spark, [(i, f"d{i}", ["Doc"], {"body": t, "emb": Vector(e)}) for i, (t, e) in enumerate(zip(texts, at, strict=True))], [(0, "LINKS", 3)])
    keyword.declare(g, "Doc", "body", "english")
    return g


def test_keyword_ranking(fusion):
    rows = Query(fusion).keyword_top_k("Doc", "body", "Graphs", 5).rows(True).collect()
    assert [r["id"] for r in rows] == [2, 0] and all(r["score"] > 0 for r in rows)
    n, df, mean = 4, 2, (5 + 5 + 5 + 4) / 4  # "and" is no term
    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
    assert rows[0]["score"] == pytest.approx(idf * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 5 / mean)), rel=1e-6)
    assert ids(Query(fusion).keyword_top_k("Doc", "title", "graph", 5)) == []
    with pytest.raises(ValueError):
        keyword.declare(fusion, "Doc", "body", "none")
    index = keyword.upsert(fusion.keyword_indexes["Doc", "body"], fusion.spark.createDataFrame([(0, None), (9, "a graph")], "id long, text string"))
    assert sorted(r["node"] for r in keyword.bm25(index, "graph").collect()) == [2, 9]


def test_fusion(fusion):
    spec = M.Hybrid("Doc", M.VectorChannel("emb", Vector([0, 0]), "L2"), M.KeywordChannel("body", "graph"), M.GraphChannel(1, 0.5))
    rows = {r["id"]: r for r in hybrid.run(fusion, spec).collect()}
    best = max(rows.values(), key=lambda r: r["score"])
    assert best["id"] == 0 and None not in (best["vector"], best["keyword"], best["graph"])
    assert rows[3]["keyword"] is None and rows[3]["graph"] is not None
    only = M.Hybrid("Doc", spec.vector, spec.keyword, None, M.Weights(0, 1, 0))
    order = [r["id"] for r in hybrid.run(fusion, only).orderBy(F.desc("score"), "id").collect()]
    assert order.index(2) < order.index(0)
    with pytest.raises(ValueError):
        hybrid.run(fusion, M.Hybrid(None, None, spec.keyword))


def test_pagerank_and_components(spark):
    star = make(spark, [(i, c, ["N"], {}) for i, c in enumerate("habc")], [(i, "T", 0) for i in (1, 2, 3)])
    ranks = {r["id"]: r["rank"] for r in algorithms.pagerank(star).collect()}
    assert len(ranks) == 4 and sum(ranks.values()) == pytest.approx(1, abs=1e-6) and max(ranks, key=ranks.get) == 0
    assert ids(Query(star).algo(M.PageRank())) == [0, 1, 2, 3]
    parts = make(spark, [(i, None, ["D" if i < 4 else "O"], {}) for i in range(5)], [(1, "T", 0), (3, "T", 2)])
    assert {r["id"]: r["component"] for r in algorithms.components(parts).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    rows = Query(parts).algo(M.ConnectedComponents()).rows(True).collect()
    assert [(r["id"], r["score"]) for r in rows] == [(0, 0.0), (1, 0.0), (2, 1.0), (3, 1.0), (4, 2.0)]
    assert {r["component"] for r in algorithms.components(parts, frozenset(["O"])).collect()} == {4}


def test_shortest_paths(spark):
    g = make(spark, [(i, f"n{i}", ["N"], {}) for i in range(5)], [(0, "T", 1, {"w": 1}), (1, "T", 2, {"w": 1.0}), (2, "T", 3, {"w": "no"}), (0, "T", 3, {"w": 10}), (3, "T", 4, {"w": -5})])
    path = lambda a, b, **k: [(r["id"], r["cost"]) for r in algorithms.shortest_path(g, None, M.ShortestPath(M.Id(a), M.Key(f"n{b}"), **k)).orderBy("pos").collect()]
    assert path(0, 3) == [(0, 0), (3, 1)]
    assert path(0, 3, weight="w") == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert path(0, 4, weight="w")[-1] == (4, 3)
    assert path(3, 0) == [] and path(3, 0, dir="Both") == [(3, 0), (0, 1)] and path(3, 0, dir="In") == [(3, 0), (0, 1)]
    assert path(2, 2) == [(2, 0)] and path(0, 9) == []


def plain_louvain(n, edges, gain=1e-9):
    """The rounds of algorithms.louvain with dictionaries."""
    double, where, links = 2.0 * len(edges), {i: i for i in range(n)}, Counter()
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            links[x, y] += 1.0
    for _ in range(10):
        degree = Counter()
        for (a, _b), w in links.items():
            degree[a] += w
        home = {a: a for a in degree}
        best, height, stale, turn = dict(home), -math.inf, 0, 0
        while True:
            total, near = Counter(), defaultdict(Counter)
            for a, c in home.items():
                total[c] += degree[a]
            for (a, b), w in links.items():
                near[a][home[b]] += w * (a != b)
            high = sum(w for (a, b), w in links.items() if home[a] == home[b]) / double - sum(t * t for t in total.values()) / double**2
            if high > height + gain:
                best, height, stale = dict(home), high, 0
            else:
                stale += 1
            after, wanting = dict(home), 0
            for a, own in home.items():
                stay = near[a][own] - (total[own] - degree[a]) * degree[a] / double
                found = max(((w - total[c] * degree[a] / double, -c) for c, w in near[a].items() if c != own), default=(-math.inf, 0))
                if found[0] > stay + gain:
                    wanting += 1
                    if (-found[1] < own) == (turn % 2 == 0):
                        after[a] = -found[1]
            if stale >= 2 or not wanting:
                break
            home, turn = after, turn + 1
        if best == {a: a for a in degree}:
            break
        where = {i: best.get(w, w) for i, w in where.items()}
        merged = Counter()
        for (a, b), w in links.items():
            merged[best[a], best[b]] += w
        links = merged
    names = {}
    for i, w in where.items():
        names[w] = min(i, names.get(w, i))
    return {i: names[w] for i, w in where.items()}, height


def test_louvain(spark):
    edges = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)]
    g = make(spark, [(i, None, ["N"], {}) for i in range(7)], [(a, "T", b) for a, b in edges])
    assert {r["id"]: r["community"] for r in algorithms.louvain(g).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}
    rng = random.Random(2)
    edges = [(a := rng.randrange(60), a // 10 * 10 + rng.randrange(10) if rng.random() < 0.8 else rng.randrange(60)) for _ in range(150)]
    g = make(spark, [(i, None, ["N"], {}) for i in range(60)], [(a, "T", b) for a, b in edges])
    whole, height = plain_louvain(60, edges)
    got = {r["id"]: r["community"] for r in algorithms.louvain(g).collect()}
    assert got == whole and height > 0.5  # six groups with four fifths of the edges inside
    alone = make(spark, [(i, None, ["N"], {}) for i in range(3)], [])
    assert {r["id"]: r["community"] for r in algorithms.louvain(alone).collect()} == {0: 0, 1: 1, 2: 2}


def test_catalogue(spark):
    nodes = [(1, None, ["Person"], {"name": "Alice", "age": 30}), (2, None, ["Person", "Author"], {"name": "Bob", "age": 41.5}), (3, None, ["Paper"], {"year": 2026})]
    g = make(spark, nodes, [(1, "AUTHORED", 3), (2, "AUTHORED", 3)])
    assert catalog.counts(g) == (3, 2)
    assert {(r["label"], r["property"], r["kind"]): r["count"] for r in catalog.properties(g).collect()} == {("Person", "name", "Str"): 2, ("Person", "age", "Int"): 1, ("Person", "age", "Float"): 1, ("Author", "name", "Str"): 1, ("Author", "age", "Float"): 1, ("Paper", "year", "Int"): 1}
    assert {(r["src_label"], r["dst_label"]): r["count"] for r in catalog.connections(g).collect()} == {("Person", "Paper"): 2, ("Author", "Paper"): 1}
    both = catalog.merge([catalog.labels(g), catalog.labels(g)])
    assert {r["label"]: r["count"] for r in both.collect()} == {"Person": 4, "Author": 2, "Paper": 2}
    assert "(:Person)-[:AUTHORED]->(:Paper) x2" in catalog.summary(g)


def test_reads(spark):
    nodes = [(1, "m::api::go", ["Function"], {"file": "a.py", "_h": 1}), (2, "m::db::go", ["Function"], {}), (3, "m::run", ["Function"], {"body": "x" * 600}), (4, "T", ["Type"], {})]
    g = make(spark, nodes, [(3, "CALLS", 1), (1, "CALLS", 2), (4, "CONTAINS", 2), (3, "READS", 4)])
    assert reads.resolve_symbol(g, "m::run") == (3, ["m::run"]) and reads.resolve_symbol(g, "run") == (3, ["m::run"])
    assert reads.resolve_symbol(g, "go") == (None, ["m::api::go", "m::db::go"]) and reads.resolve_symbol(g, "API") == (1, ["m::api::go"])
    assert reads.trace(g, 3, 2) == ([3, 1, 2], False) and reads.trace(g, 2, 3) == ([3, 1, 2], True) and reads.trace(g, 4, 3) == ([], False)
    assert [(n, [r["id"] for r in df.collect()]) for n, df in reads.impact(g, 2, 6)] == [(1, [1]), (1, [3])]
    assert reads.describe(g, 1, ["file", "_h"]) == ["file: a.py"] and len(reads.describe(g, 3, ["body"])[0].encode()) < 520
    assert reads.context(g, 2).splitlines() == ["in CALLS (1)", "  m::api::go", "in CONTAINS (1)", "  T"]
    top, edges, total = reads.seed(g, "degree", 2)
    assert [r["id"] for r in top.orderBy(F.desc("value"), "id").collect()] == [1, 2] and edges.count() == 1 and total == 4
    assert reads.expand(g, 3, 1)[1] == 2 and sorted(r["id"] for r in reads.traverse(g, [3], "Out", None, 1, 2).collect()) == [1, 2, 4]
    assert [(r["id"], r["field"]) for r in reads.find_nodes(g, "TYPE", ["file"]).collect()] == [(4, "label")]
    assert [(r["id"], r["field"]) for r in reads.find_nodes(g, ".py", ["file"]).collect()] == [(1, "file")]
    assert reads.find_edges(g, "read").count() == 1
    assert reads.records(g, spark.createDataFrame([(1,)], "id long"), ["file", "_h"])[0]["props"] == {"file": "a.py", "_h": 1}


def test_grep(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\nneedle here\nthree")
    (tmp_path / "b.bin").write_bytes(b"needle\0")
    assert [(r["line"], r["text"]) for r in reads.grep(spark, str(tmp_path), "needle").collect()] == [(2, "needle here")]


def test_nearest_of_many(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 12]]) for i in range(600)] + [(600, None), (601, [1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = df.filter("id % 20 = 0")
    for metric in M.METRICS:
        got = defaultdict(set)
        for r in vectors.batch_top_k(asked, df, 5, metric).collect():
            got[r["query"]].add(r["id"])

        def dist(a, b):
            d = sum(x * y for x, y in zip(a, b, strict=True))
            return {"Dot": -d, "L2": math.dist(a, b), "Cosine": 1 - d / math.hypot(*a) / math.hypot(*b)}[metric]  # noqa: B023

        for i in range(0, 600, 20):
            want = sorted(range(600), key=lambda j: (round(dist(rows[i][1], rows[j][1]), 12), j))[:5]
            assert got[i] == set(want)
        index = vectors.build(df.filter("id < 600"), 12, metric)
        assert index.lists.count() == 600
        hits = sum(r["id"] in got[r["query"]] for r in vectors.search(index, asked, 5, 6).collect())
        assert hits >= 0.9 * sum(map(len, got.values()))
    assert vectors.batch_top_k(asked.filter("false"), df, 5).count() == 0


def test_walks_are_counted_and_not_listed(spark, cites):
    """A hub of 2,000 neighbours has 8 * 10**9 walks of five hops."""
    n = 2000
    hub = make(spark, [(i, f"k{i}", ["Hub" if i == 0 else "Leaf"], {}) for i in range(n + 1)], [(0, "T", i) for i in range(1, n + 1)])
    walks = q(hub, "MATCH (h:Hub)-[*1..5]-(x) RETURN x")
    found = walks.counts(key=M.ExternalKey(), hops=M.Hops()).groupBy("hops", F.col("key") == "k0").agg(F.count("key"), F.min("n"), F.max("n")).collect()
    assert {tuple(r) for r in found} == {(1, False, n, 1, 1), (2, True, 1, n, n), (3, False, n, n, n), (4, True, 1, n**2, n**2), (5, False, n, n**2, n**2)}
    assert walks.count() == n + n + n**2 + n**2 + n**3
    # rows are counted by themselves where a step takes them by their place
    assert q(hub, "MATCH (h:Hub)-[*1..2]-(x) RETURN x LIMIT 7").count() == 7
    assert {tuple(r) for r in q(cites, "MATCH (p:Paper)-[]-(x) RETURN x").counts(key=M.ExternalKey()).collect()} == {("p1", 2), ("p2", 2), ("p3", 2), ("a1", 1)}


def test_louvain_deals_many_links(spark, monkeypatch):
    """Tasks that group links are as many as their number asks for, with the same communities."""
    nodes = [(i, None, ["N"], {}) for i in range(40)]
    g = make(spark, nodes, [(a, "T", b) for a in range(40) for b in range(a) if a % 4 == b % 4])
    dealt = []
    whole = algorithms._dealt
    monkeypatch.setattr(algorithms, "TASK_LINKS", 20)
    monkeypatch.setattr(algorithms, "_dealt", lambda links, rows, *keys: dealt.append((rows, (out := whole(links, rows, *keys)).rdd.getNumPartitions())) or out)
    assert {(r["id"], r["community"]) for r in algorithms.louvain(g).collect()} == {(i, i % 4) for i in range(40)}
    assert (180, 9) in dealt and (360, 18) in dealt


def test_distances_are_held_a_few_at_a_time(spark, monkeypatch):
    whole = vectors._distances

    def small(x, q, metric):
        assert len(x) * len(q) <= 12
        return whole(x, q, metric)

    rows = [(i, [float(i * 7 % 11), float(i * 5 % 13), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    want = {(r["query"], r["id"], r["distance"]) for r in vectors.batch_top_k(df, df, 3, "L2").collect()}
    monkeypatch.setattr(vectors, "CELLS", 12)
    monkeypatch.setattr(vectors, "ROWS", 4)
    monkeypatch.setattr(vectors, "_distances", small)
    assert {(r["query"], r["id"], r["distance"]) for r in vectors.batch_top_k(df, df, 3, "L2").collect()} == want and len(want) == 180


def test_postings_are_shuffled_once(spark, monkeypatch):
    """Terms are counted in their text; an id's several rows are one document; stems of empty and missing texts."""
    seen, whole = {}, keyword.cut
    monkeypatch.setattr(keyword, "cut", lambda df, what, *a: (seen.__setitem__(what, df._jdf.queryExecution().executedPlan().toString()), whole(df, what, *a))[1])
    texts = spark.createDataFrame([(1, "b a b"), (1, "a"), (2, ""), (3, None), (4, "Running, RUNS the")], "id long, text string")
    index = keyword.build(texts, "none")
    assert {tuple(r) for r in index.postings.collect()} == {("a", 1, 2), ("b", 1, 2), ("running", 4, 1), ("runs", 4, 1), ("the", 4, 1)}
    assert {tuple(r) for r in index.docs.collect()} == {(1, 4), (4, 3)}
    assert seen["postings"].count("Exchange") == 1 and seen["terms"].count("Exchange") == 0
    assert {tuple(r) for r in keyword.build(texts, "english").postings.collect()} == {("b", 1, 2), ("run", 4, 2)}
