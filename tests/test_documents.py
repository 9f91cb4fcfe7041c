import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkweave.documents import ask, chunks, crawl, entities, html, providers
from sparkweave.functions import analyzer
from sparkweave.functions.stemmer import stem_english
from sparkweave.functions.stemmer_german import stem_german
from sparkweave.sources.graph import SOFT_EDGES, SOFT_NODES, soft_graph


@given(st.lists(st.text(alphabet="ab é\n", max_size=400), max_size=6), st.integers(0, 500))
@settings(max_examples=80, deadline=None)
def test_chunks_keep_every_word(parts, size):
    text = "\n\n".join(parts)
    out = chunks.chunk(text, size)
    assert "".join("".join(c.split()) for c in out) == "".join(text.split())
    for c in out:
        assert all(len(p) <= max(size, 200) for p in c.split("\n\n"))


def test_chunk_rules():
    assert chunks.chunk("a\n\nb", 200) == ["a\n\nb"] and chunks.chunk(" \n\n ", 200) == []
    assert chunks.chunk("a\n\n<!-- source x -->\n\nb", 200) == ["a", "<!-- source x -->\n\nb"]
    assert [len(c) for c in chunks.chunk("x" * 450, 10)] == [200, 200, 50]
    assert chunks.chunk(" ".join(["word"] * 50), 200) == [" ".join(["word"] * 40), " ".join(["word"] * 10)]
    calls = []

    def read(text):
        calls.append(len(text))
        if len(text) > 250:
            raise chunks.Truncated
        return [text]

    assert len(chunks.read_chunk(" ".join(["word"] * 100), read)) == 2 and calls == [499, 249, 249]
    with pytest.raises(chunks.Truncated):
        chunks.read_chunk("y" * 100, lambda _: (_ for _ in ()).throw(chunks.Truncated()))


def test_chunk_documents(spark):
    df = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, ""), (4, "c " * 300)], "doc_id long, text string")
    assert [(r.doc_id, r.ord) for r in chunks.chunk_documents(df, 200).orderBy("doc_id", "ord").collect()] == [(1, 0), (4, 0), (4, 1), (4, 2)]


def test_stems():
    # from the published sample vocabulary
    pairs = "consign consign consigned consign consigning consign consignment consign consistency consist consolation consol constantly constant knack knack knavish knavish kneeling kneel knightly knight knots knot caresses caress cries cri ties tie hopping hop hoping hope sky sky dying die generously generous proceed proceed".split()
    assert {a: stem_english(a) for a in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2], strict=True))


def test_german_stems(spark):
    # from the published sample vocabulary
    pairs = "aufeinander aufeinand aufeinanderfolgenden aufeinanderfolg aufenthalten aufenthalt auferweckung auferweck aufessen aufess kategorischen kategor kater kat kätzchen katzch käuflich kauflich kaufte kauft jederzeit jederzeit häuser haus".split()
    want = dict(zip(pairs[::2], pairs[1::2], strict=True))
    assert {a: stem_german(a) for a in want} == want
    df = spark.createDataFrame([("Die Häuser",)], "t string")
    assert df.select(analyzer.terms(F.col("t"), "de")).first()[0] == ["die", "haus"] == analyzer.query_terms("Die Häuser", "german")


def test_french_and_spanish_stems(spark):
    # from the published sample vocabularies
    from sparkweave.functions.stemmer_french import stem_french
    from sparkweave.functions.stemmer_spanish import stem_spanish

    pairs = (
        "continua continu continuait continu continuant continu continuation continu continué continu continuellement continuel continuelles continuel continuerait continu continueront continu continuité continu "
        "contorsions contors contournait contourn contractée contract contractions contract contradictoirement contradictoir contraindre contraindr contraires contrair contraria contrari "
        "maintenaient mainten maintenant mainten maintenir mainten maintenue maintenu maires mair mairie mair maîtresses maîtress majesté majest majestueuse majestu majestueusement majestu majestueux majestu majorités major maladie malad maladive malad"
    ).split()
    want = dict(zip(pairs[::2], pairs[1::2], strict=True))
    assert {a: stem_french(a) for a in want} == want
    pairs = (
        "checar chec checoslovaquia checoslovaqui chefs chefs chiapaneca chiapanec chicas chic chicharrones chicharron chichimecas chichimec torcer torc toreado tor toreados tor toreándolo tor torear tor toreara tor torearlo tor "
        "toreros torer tormentas torment tornados torn tornen torn torneos torne tornillo tornill torniquete torniquet toros tor torpedearon torped torrenciales torrencial torreón torreon torres torr"
    ).split()
    want = dict(zip(pairs[::2], pairs[1::2], strict=True))
    assert {a: stem_spanish(a) for a in want} == want
    df = spark.createDataFrame([("Les maisons continuaient",)], "t string")
    assert df.select(analyzer.terms(F.col("t"), "fr")).first()[0] == ["le", "maison", "continu"] == analyzer.query_terms("Les maisons continuaient", "french")


def test_analyzer(spark):
    text = "The Graphs-of_2 naïve databases, running!"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(analyzer.terms(F.col("t"), "en")).collect()]
    assert got == [["graph", "2", "naïv", "databas", "run"], None, []] and analyzer.query_terms(text, "en") == got[0]
    assert df.select(analyzer.terms(F.col("t"), "none")).first()[0] == ["the", "graphs", "of", "2", "naïve", "databases", "running"]
    assert analyzer.query_terms("数据库 ab", "zh") == ["数据", "据库", "ab"] == df.select(analyzer.terms(F.lit("数据库 ab"), "zh")).first()[0]
    for wrong in ("klingon", "finnish"):
        with pytest.raises(ValueError):
            analyzer.query_terms("x", wrong)


def test_merging(spark):
    ents = spark.createDataFrame([(1, "A", "", {"x": "late", "y": "1"}), (0, "A", "T", {"x": "first"}), (2, "B", "U", {})], "chunk int, key string, label string, props map<string,string>")
    rels = spark.createDataFrame([(1, "A", "B", "R"), (0, "A", "B", "R"), (2, "A", "a", "S"), (2, "a", "b", "R")], "chunk int, src string, dst string, type string")
    merged = entities.merge_entities(ents)
    rows = {r.key: r for r in merged.collect()}
    assert (rows["A"].label, rows["A"].props, rows["A"].origins) == ("T", {"x": "first", "y": "1"}, [0, 1])
    assert {tuple(r) for r in entities.merge_relations(rels).collect()} == {("A", "B", "R", 0), ("A", "a", "S", 2), ("a", "b", "R", 2)}
    names = spark.createDataFrame([("A-B", 2), ("ab", 2), ("a b", 1), ("C", 9)], "name string, count long")
    assert {tuple(r) for r in entities.fold_renames(names).collect()} == {("ab", "A-B"), ("a b", "A-B")}
    assert entities.resolve_chains({"a": "b", "b": "c", "x": "y", "y": "x"}) == {"a": "c", "b": "c"}
    renames = spark.createDataFrame([("a", "A"), ("b", "B")], "name string, survivor string")
    more = merged.union(spark.createDataFrame([("a", "V", {"x": "other", "z": "2"}, [5])], merged.schema))
    e, r = entities.apply_renames(more, rels, renames)
    got = {x.key: (x.label, x.props, x.origins) for x in e.collect()}
    assert got["A"] == ("T", {"x": "first", "y": "1", "z": "2"}, [0, 1, 5]) and set(got) == {"A", "B"}
    assert {tuple(x)[:3] for x in r.collect()} == {("A", "B", "R")}


def test_containment_and_mentions(spark):
    keys = spark.createDataFrame([("dropout", "T"), ("Dropout layer", "t"), ("Dropout: a way", "Paper"), ("drop", "")], "key string, label string")
    assert [tuple(r) for r in entities.containment_pairs(keys).collect()] == [("drop", "Dropout layer"), ("drop", "Dropout: a way"), ("drop", "dropout"), ("dropout", "Dropout layer")]
    ch = spark.createDataFrame([(0, "The Transformer uses softmax."), (1, "Transformers scale"), (2, "nothing")], "ord int, chunk string")
    ents = spark.createDataFrame([("Transformer", "", {"a": "1"}, [0]), ("Softmax", "", {}, [0]), ("the", "", {}, [0])], "key string, label string, props map<string,string>, origins array<int>")
    rel = spark.createDataFrame([("Transformer", "Softmax", "USES")], "src string, dst string, type string")
    assert [(r.key, r.fresh, r.context, r.degree) for r in entities.mention_gate(ch, ents, rel).collect()] == [("Transformer", [1], [0, 1], 1)]


def test_refine_link_stamp_and_text(spark):
    kind = "key string, label string, props map<string,string>, origins array<int>"
    ents = spark.createDataFrame([("A", "T", {"x": "1", "_s": "k"}, [0]), ("B", "", {}, [1])], kind)
    read = spark.createDataFrame([("A", {"x": "2", "_s": "no", "embedding": "no", "n": "3"})], "key string, props map<string,string>")
    assert {r.key: r.props for r in entities.refine(ents, read).collect()} == {"A": {"_s": "k", "x": "2", "n": "3"}, "B": {}}
    have = spark.createDataFrame([("B",), ("Z",)], "key string")
    rel = spark.createDataFrame([("A", "Z", "R"), ("A", "Q", "R")], "src string, dst string, type string")
    new, good, bad = entities.link(ents, rel, have)
    assert [r.key for r in new.collect()] == ["A"] and [r.dst for r in good.collect()] == ["Z"] and [r.dst for r in bad.collect()] == ["Q"]
    stamped = entities.stamp(ents, "src", "m", "r1")
    assert stamped.filter("key = 'B'").first().props == {"_source": "src", "_model": "m", "_run": "r1"}
    assert {r.key: r.text for r in entities.entity_text(stamped).collect()} == {"A": "A (T)\nx: 1", "B": "B"}
    made, skipped = entities.write_proposal(ents.union(ents.filter("key = 'A'")), have)
    assert [(r.key, r.label) for r in made.collect()] == [("A", "T")] and sorted((r.key, r.why) for r in skipped.collect()) == [("A", "repeated"), ("B", "taken")]
    stored = spark.createDataFrame([("A", "U", {"x": "1"}), ("C", "T", {}), ("S", "T", {"p": "1"})], "key string, label string, props map<string,string>")
    facts = spark.createDataFrame([("A", "T", {"x": "1"}), ("N", "T", {}), ("S", "T", {"p": "2"})], "key string, label string, props map<string,string>")
    assert {r.key: r.op for r in entities.synced(facts, stored).collect()} == {"A": "replace", "C": "delete", "S": "patch", "N": "create"}


def test_vectorize_embeds_distinct_stale_texts(spark):
    embed = providers.mock_embedder(4)
    assert math.isclose(sum(x * x for x in embed("abc")), 1, rel_tol=1e-9) and embed("abc") == embed("abc") != embed("abd")
    texts = spark.createDataFrame([("a", "same"), ("b", "same"), ("c", "ü" * 4000)], "key string, text string")
    none = spark.createDataFrame([], "key string, hash string")
    first = providers.vectorize(texts, none, embed)
    rows = {r.key: r for r in first.collect()}
    assert rows["a"].hash == rows["b"].hash and len(rows["c"].hash) == 16 and rows["a"].embedding == pytest.approx(embed("same"), rel=1e-6)
    assert providers.vectorize(texts, first.select("key", "hash"), embed).count() == 0


PAGE = """<html><head><title> Some
 title </title><style>x</style></head><body><nav><a href="/docs">Docs</a></nav>
<main><h2>Heading</h2><p>Some <strong>bold</strong> and <em></em>text, <a href="b.html" title="More">link</a>.<p>Next &amp; last<br>line
<ul><li>one<li>two</ul><ol><li>first</li></ol><pre><code>if x:
  y</code></pre><blockquote><p>said</p></blockquote><table><tr><td>a</td><td>b</td></tr></table><script>no()</script></main>
<footer>foot <a href="#top">top</a></footer></body></html>"""


def test_html():
    title, text, links = html.extract(PAGE)
    assert title == "Some title"
    assert text == "## Heading\n\nSome **bold** and text, link.\n\nNext & last\n\nline\n\n- one\n\n- two\n\n1. first\n\n```\nif x:\n  y\n```\n\n> said\n\na | b"
    assert links == [("/docs", "Docs", False), ("b.html", "link More", True)]
    assert html.extract("") == ("", "", []) and html.extract("<h1>T</h1>x")[0] == "T"
    deep = html.extract("<div>" * 10_000 + "<p>deep <b>word" + "</div>" * 10_000)
    assert deep[1] == "deep **word**"
    assert html.extract("<blockquote><p>a</p><ul><li>b <b> </b>c</li></ul></blockquote><pre> x\n  y</pre><table><tr><td>1</td> <td>2</td></tr></table>")[1] == "> a\n\n> - b c\n\n```\n x\n  y\n```\n\n1 | 2"
    teaser = html.extract("<body><main>hi</main><p>" + "long " * 50 + "</p></body>")
    assert teaser[1].startswith("hi\n\nlong")  # a main that holds little is not taken for the page


def test_addresses_and_robots(spark):
    df = spark.createDataFrame([("https://Ex.com/docs/someCamelCase-page.html?q=hidden#f",), ("HTTP://a.b/x/",), ("nope",), (None,)], "u string")
    assert [r[0] for r in df.select(crawl.url_words(F.col("u"))).collect()][:2] == ["docs some Camel Case page html ", "x "]
    assert [r[0] for r in df.select(crawl.normalize_url(F.col("u"))).collect()] == ["https://ex.com/docs/someCamelCase-page.html?q=hidden", "http://a.b/x", None, None]
    rules = crawl.robots_rules("User-agent: *\nDisallow: /\n\nUser-agent: Fetch\nDisallow: /p\nAllow: /p/ok\nDisallow: /*.pdf$\n", "myfetch/1")
    assert [crawl.robots_allow(rules, p) for p in ("/", "/p/x", "/p/ok/1", "/a.pdf", "/a.pdfx")] == [True, False, True, False, True]
    assert not crawl.robots_allow(crawl.robots_rules("User-agent: *\nDisallow: /", "x"), "/a") and crawl.robots_allow([], "/")
    assert crawl.robots_allow([("/a", False), ("/a", True)], "/a")


def test_relevance_and_crawl(spark):
    def page(i, path, text, *links):
        return (i, f"https://x.com{path}", "<body><main><p>" + text + "</p>" + " ".join(f'<a href="{h}">{a}</a>' for h, a in links) + "</main></body>")

    rows = [page(0, "/", "graph database graph engine", ("/graph", "graph store"), ("/food", "recipes"), ("mailto:x", "mail")), page(1, "/graph", "a graph database stores graphs", ("/deep/engine", "engine")), page(2, "/food", "soup and bread"), page(3, "/deep/engine", "database engine internals")]
    pages = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    weights = crawl.target(pages.filter("page_id = 0").select(F.col("markdown").alias("text")), "store")
    assert weights["graph"] == 1.0 and weights["store"] > 3.0
    got = {r.page_id: r.relevance for r in crawl.score(pages.select("page_id", F.col("markdown").alias("text")), weights).collect()}
    tokens = {r["page_id"]: analyzer_list(r["markdown"]) for r in pages.collect()}
    mean = sum(map(len, tokens.values())) / len(tokens)
    for i, toks in tokens.items():
        tf = Counter(toks)
        raw = sum(w * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(toks) / mean)) for t, w in weights.items() if tf[t])
        assert got[i] == pytest.approx(raw / (sum(weights.values()) * 2.2), rel=1e-9)
    kept = {r.url: r.depth for r in crawl.crawl(pages, "https://x.com/", depth=2, budget=10).collect()}
    assert kept == {"https://x.com": 0, "https://x.com/graph": 1, "https://x.com/deep/engine": 2}


def analyzer_list(text):
    import re

    return [stem_english(w.lower()) for w in re.findall(r"\w+", text) if w.lower() not in analyzer.STOPWORDS]


def test_ask(spark):
    from sparkweave.functions.values import tagged_row
    from sparkweave.plans.values import Vector

    embed = providers.mock_embedder(4)
    nodes = [(i, k, ["N"], {"embedding": tagged_row(Vector(embed(k)))}) for i, k in enumerate("ab")]
    g = soft_graph(spark, spark.createDataFrame(nodes, SOFT_NODES), spark.createDataFrame([(9, 0, 1, "KNOWS", None)], SOFT_EDGES), ["KNOWS"])
    assert ask.find_edge(g, "x", embed) == ["(:N)-[:KNOWS]->(:N)"] and ask.find_entity(g, "b", embed, 1) == ["b"]
    plan = '{"plan": {"source": {"SeekKeys": ["a"]}, "steps": [{"Expand": {"dir": "Out", "edge_type": null}}]}}'
    chat = providers.MockChat(['{"parts": ["one"]}', plan, '{"find_edge": "knows"}', '{"plan": {"source": "Bad", "steps": []}}', "so: " + plan])
    got = ask.ask(g, "who?", chat, embed)
    assert sorted(r[0] for r in got.nodes.collect()) == [0, 1] and got.edges.count() == 1 and got.turns == 5 and len(got.failures) == 1
    assert ask.limited(got.plans[0]) == got.plans[0]
    stubborn = ask.ask(g, "who?", providers.MockChat(["no"]), embed, 3)
    assert stubborn.turns == 3 and stubborn.nodes is None


def test_routing_and_reading(spark, tmp_path):
    for name in ("a.PY", "b.md", "c"):
        (tmp_path / name).write_text("x")
    df = spark.createDataFrame([(f"/r/{n}",) for n in ("a.PY", "b.md", "c", "d.tar.gz")], "path string")
    assert [r.handler for r in crawl.route(df, {"py": "python", "gz": "zip"}).collect()] == ["python", None, None, "zip"]
    assert [r.text for r in crawl.read_documents(spark, str(tmp_path)).collect()] == ["x"]


def test_plugins(spark, tmp_path):
    from sparkweave.documents import plugins as G

    (tmp_path / "a.py").write_text("def f(): pass")
    (tmp_path / "b.py").write_text("boom")
    (tmp_path / "c.txt").write_text("x")

    def python(path, content):
        if content == b"boom":
            raise ValueError("bad file")
        name = path.rsplit("/", 1)[1]
        yield {"node": (f"{name}::f", "Function", {"line": 1})}
        yield {"edge": (name, f"{name}::f", "CONTAINS")}

    handlers = [G.Handler("py", (".py",), python), G.Handler("other", ("PY", "c"), python)]
    assert G.claims(handlers) == ({"py": "py", "c": "other"}, [("py", "py", "other")])
    rows = G.parse_files(G.read_tree(spark, str(tmp_path)), handlers).collect()
    assert sorted((r.kind, r.key or r.dst or r.error) for r in rows) == [("edge", "a.py::f"), ("error", "ValueError: bad file"), ("node", "a.py::f")]
    assert next(r for r in rows if r.kind == "node").props == {"line": "1"}


def test_snippet(spark, tmp_path):
    from sparkweave.functions.values import tagged_row
    from sparkweave.operators import reads

    (tmp_path / "m.py").write_text("one\ntwo\nthree\n")
    nodes = [(1, "a", ["F"], {"source": tagged_row("code")}), (2, "b", ["F"], {"file": tagged_row("m.py"), "line": tagged_row(2)}), (3, "c", ["F"], {})]
    g = soft_graph(spark, spark.createDataFrame(nodes, SOFT_NODES), spark.createDataFrame([], SOFT_EDGES))
    assert [reads.snippet(g, i, str(tmp_path), 2) for i in (1, 2, 3, 4)] == ["code", "two\nthree", None, None]


def test_pages_are_read_a_few_at_a_time(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", None if i % 7 == 0 else f"<title>t{i}</title><a href='/{i}'>x</a>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    want = sorted(map(tuple, html.extract_pages(pages).collect()))
    monkeypatch.setattr(html, "PAGES_AT_ONCE", 3)
    assert sorted(map(tuple, html.extract_pages(pages).collect())) == want and [r[0] for r in want] == list(range(20))
    assert want[7][2:4] == ("", "") and want[8][2] == "t8"
