"""Registered queries of documents, entities and relations, with their SQL.

Entities are read off the tables: the words of a part's name stand for what a reader would find in a chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import SQL, query
from .documents import chunks, crawl, entities, plugins, providers

SQL |= {
    # a row for each word of a part: chunk, key, label, props
    "ents": "SELECT chunk, key, CASE WHEN chunk % 3 = 0 THEN '' ELSE 'T' || chunk % 4 END AS label, chunk % 5 AS five, chunk % 2 AS two FROM (SELECT DISTINCT (p_partkey // 10)::INTEGER AS chunk, unnest(list_transform(string_split(p_name, ' '), lambda w: w || p_size)) AS key FROM part)",
    "rels": "SELECT DISTINCT (p_partkey // 10)::INTEGER AS chunk, split_part(p_name, ' ', 1) || p_size AS src, split_part(p_name, ' ', 2) || p_size AS dst, 'R' || p_size % 2 AS type FROM part WHERE contains(p_name, ' ')",
    "firsts": "SELECT key, coalesce(arg_min(label, chunk) FILTER (label <> ''), '') AS label, arg_min(five, chunk) FILTER (two = 0) AS five, min(chunk) AS c, list_sort(list(DISTINCT chunk)) AS origins FROM ents GROUP BY key",
}
_WITH = "WITH ents AS ({ents}), rels AS ({rels}), merged AS ({firsts}) ".format(**SQL)
SQL["with"] = _WITH


def read_entities(spark, sf) -> DataFrame:
    """chunk, key, label, props; only every second chunk gives the property."""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.floor(F.col("p_partkey") / 10).cast("int").alias("chunk"), F.explode(F.transform(F.split("p_name", " "), lambda w: F.concat(w, F.col("p_size").cast("string")))).alias("key")).distinct()
    label = F.when(F.col("chunk") % 3 == 0, "").otherwise(F.concat(F.lit("T"), (F.col("chunk") % 4).cast("string")))
    props = F.when(F.col("chunk") % 2 == 0, F.create_map(F.lit("five"), (F.col("chunk") % 5).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return p.select("chunk", "key", label.alias("label"), props.alias("props"))


def read_relations(spark, sf) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet").filter(F.contains(F.col("p_name"), F.lit(" ")))
    words = F.transform(F.split("p_name", " "), lambda w: F.concat(w, F.col("p_size").cast("string")))
    return p.select(F.floor(F.col("p_partkey") / 10).cast("int").alias("chunk"), words[0].alias("src"), words[1].alias("dst"), F.concat(F.lit("R"), (F.col("p_size") % 2).cast("string")).alias("type")).distinct()


def flat(df: DataFrame) -> DataFrame:
    """key, label, five and origins as columns that SQL has too."""
    return df.select("key", "label", F.col("props")["five"].alias("five"), F.array_join(F.transform("origins", lambda x: x.cast("string")), ",").alias("origins"))


@query("{with} SELECT key, label, five::VARCHAR AS five, array_to_string(origins, ',') AS origins FROM merged")
def merge_entities(spark, sf):
    return flat(entities.merge_entities(read_entities(spark, sf)))


@query("{with} SELECT src, dst, type, min(chunk) AS chunk FROM rels GROUP BY src, dst, type")
def merge_relations(spark, sf):
    return entities.merge_relations(read_relations(spark, sf))


@query("SELECT unnest(['a', 'b', 'd', 'e']) AS name, unnest(['c', 'c', 'c', 'c']) AS survivor UNION ALL SELECT 'n' || i, 'n20' FROM range(20) t(i)")
def rename_chains(spark, sf):
    """Chains, and cycles that end where they close."""
    renames = {"a": "b", "b": "c", "d": "b", "e": "d", "x": "y", "y": "x", "same": "same"} | {f"n{i}": f"n{i + 1}" for i in range(20)}
    return spark.createDataFrame(sorted(entities.resolve_chains(renames).items()), "name string, survivor string")


_RENAMED = "{with}, ren AS (SELECT key AS name, upper(substr(key, 1, 1)) AS survivor FROM merged WHERE length(key) > 5), moved AS (SELECT coalesce(survivor, key) AS key, survivor IS NOT NULL AS other, key AS src, label, five, origins FROM merged LEFT JOIN ren ON key = name) "


@query(
    _RENAMED + "SELECT key, coalesce(arg_min(label, (other, src)) FILTER (label <> ''), '') AS label, arg_min(five, (other, src)) FILTER (five IS NOT NULL)::VARCHAR AS five, array_to_string(list_sort(list_distinct(flatten(list(origins)))), ',') AS origins FROM moved GROUP BY key"
)
def merges_applied(spark, sf):
    merged = entities.merge_entities(read_entities(spark, sf))
    renames = merged.filter(F.length("key") > 5).select(F.col("key").alias("name"), F.upper(F.substring("key", 1, 1)).alias("survivor"))
    return flat(entities.apply_renames(merged, read_relations(spark, sf), renames)[0])


@query(_RENAMED + "SELECT coalesce(a.survivor, src) AS src, coalesce(b.survivor, dst) AS dst, type, min(chunk) AS chunk FROM rels LEFT JOIN ren a ON a.name = src LEFT JOIN ren b ON b.name = dst WHERE coalesce(a.survivor, src) <> coalesce(b.survivor, dst) GROUP BY ALL")
def merges_applied_relations(spark, sf):
    merged = entities.merge_entities(read_entities(spark, sf))
    renames = merged.filter(F.length("key") > 5).select(F.col("key").alias("name"), F.upper(F.substring("key", 1, 1)).alias("survivor"))
    return entities.apply_renames(merged, read_relations(spark, sf), renames)[1]


@query("{with} SELECT key, CASE WHEN c % 2 = 1 THEN '9' ELSE five::VARCHAR END AS five, CASE WHEN c % 2 = 1 THEN 'read' END AS more, 0::BIGINT AS hidden FROM merged")
def refine_applied(spark, sf):
    """What is read again goes over what was there; hidden names and embeddings do not."""
    merged = entities.merge_entities(read_entities(spark, sf))
    new = F.create_map(F.lit("five"), F.lit("9"), F.lit("more"), F.lit("read"), F.lit("_hidden"), F.lit("no"), F.lit("embedding"), F.lit("no"))
    out = entities.refine(merged, merged.filter(F.col("origins")[0] % 2 == 1).select("key", new.alias("props")))
    hidden = F.size(F.filter(F.map_keys("props"), lambda k: k.isin("_hidden", "embedding"))).cast("bigint")
    return out.select("key", F.col("props")["five"].alias("five"), F.col("props")["more"].alias("more"), hidden.alias("hidden"))


_LINKED = "{with}, have AS (SELECT key FROM merged WHERE c < 20 UNION SELECT 'elsewhere'), own AS (SELECT key FROM merged WHERE c % 2 = 0), known AS (SELECT key FROM own UNION SELECT key FROM have) "


def linked(spark, sf):
    merged = entities.merge_entities(read_entities(spark, sf))
    have = merged.filter(F.col("origins")[0] < 20).select("key").union(spark.createDataFrame([("elsewhere",)], "key string"))
    return entities.link(merged.filter(F.col("origins")[0] % 2 == 0), read_relations(spark, sf).select("src", "dst", "type").distinct(), have)


@query(_LINKED + "SELECT key FROM own ANTI JOIN have USING (key)")
def link_new(spark, sf):
    return linked(spark, sf)[0].select("key")


@query(_LINKED + "SELECT DISTINCT src, dst, type, src IN (SELECT key FROM known) AND dst IN (SELECT key FROM known) AS kept FROM rels")
def link_relations(spark, sf):
    _, good, bad = linked(spark, sf)
    return good.select("src", "dst", "type", F.lit(True).alias("kept")).union(bad.select("src", "dst", "type", F.lit(False)))


@query("{with} SELECT key, 'part' AS source, 'none' AS model, 'r1' AS run, five::VARCHAR AS five FROM merged")
def stamped(spark, sf):
    out = entities.stamp(entities.merge_entities(read_entities(spark, sf)), "part", "none", "r1")
    return out.select("key", *(F.col("props")[f"_{c}"].alias(c) for c in ("source", "model", "run")), F.col("props")["five"].alias("five"))


@query("{with} SELECT key, key || CASE WHEN label <> '' THEN ' (' || label || ')' ELSE '' END || CASE WHEN five IS NOT NULL THEN chr(10) || 'five: ' || five ELSE '' END AS text FROM merged")
def entity_texts(spark, sf):
    return entities.entity_text(entities.stamp(entities.merge_entities(read_entities(spark, sf)), "part", "none", "r1"))


@query("{with} SELECT src || ' ' || type || ' ' || dst AS text, src, dst, type FROM (SELECT DISTINCT src, dst, type FROM rels)")
def fact_texts(spark, sf):
    return entities.fact_text(read_relations(spark, sf).select("src", "dst", "type").distinct())


@query("{with} SELECT key, CASE WHEN c % 4 = 0 THEN 'Parsed' ELSE label END AS label FROM merged")
def facts_folded(spark, sf):
    merged = entities.merge_entities(read_entities(spark, sf))
    return entities.fold_facts(merged.filter(F.col("origins")[0] % 4 == 0).withColumn("label", F.lit("Parsed")), merged).select("key", "label")


@query("{with}, two AS (SELECT * FROM merged UNION ALL SELECT * FROM merged WHERE c % 2 = 0) SELECT key, CASE WHEN key IN (SELECT key FROM merged WHERE c < 10) THEN 'taken' WHEN n = 2 THEN 'repeated' ELSE CASE WHEN label = '' THEN 'Entity' ELSE label END END AS what FROM (SELECT key, label, row_number() OVER (PARTITION BY key ORDER BY label) AS n FROM two)")
def proposal_written(spark, sf):
    merged = entities.merge_entities(read_entities(spark, sf))
    made, skipped = entities.write_proposal(merged.union(merged.filter(F.col("origins")[0] % 2 == 0)), merged.filter(F.col("origins")[0] < 10).select("key"))
    return made.select("key", F.col("label").alias("what")).union(skipped.select("key", "why"))


@query("{with} SELECT key, CASE WHEN c % 7 = 1 THEN 'create' WHEN c % 7 = 2 THEN 'delete' WHEN c % 7 = 3 THEN 'replace' WHEN c % 7 = 4 THEN 'patch' ELSE 'same' END AS op FROM merged")
def facts_synced(spark, sf):
    merged = entities.merge_entities(read_entities(spark, sf))
    first = F.col("origins")[0] % 7
    facts = merged.filter(first != 2).select("key", F.when(first == 3, "Other").otherwise(F.col("label")).alias("label"), F.when(first == 4, F.map_concat(F.map_filter("props", lambda k, _: k != "five"), F.create_map(F.lit("five"), F.lit("new")))).otherwise(F.col("props")).alias("props"))
    return entities.synced(facts, merged.filter(first != 1).select("key", "label", "props"))


@query("WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '') AS parts FROM documents) SELECT doc_id, 0 AS ord, sha256(array_to_string(parts, chr(10) || chr(10))) AS sha FROM p WHERE len(parts) > 0")
def chunks_whole(spark, sf):
    """At a size over every text, a chunk is a text's paragraphs."""
    out = chunks.chunk_documents(spark.read.parquet(f"{sf}/documents.parquet"), 1_000_000_000)
    return out.select("doc_id", "ord", F.sha2("chunk", 256).alias("sha"))


@query("WITH w AS (SELECT doc_id, list_transform(range(1, 401), lambda i: 'w' || (doc_id + i) % 97) AS w FROM documents) SELECT doc_id, i::INTEGER AS ord, array_to_string(w[i * 50 + 1:(i + 1) * 50], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, 8)) AS i FROM w) WHERE false UNION ALL SELECT doc_id, 0, 'd' || doc_id FROM documents UNION ALL SELECT doc_id, 1, '<!-- source ' || doc_id || ' -->' || chr(10) || chr(10) || 'after' FROM documents UNION ALL SELECT doc_id, 2, repeat('x', 250) FROM documents UNION ALL SELECT doc_id, 3, repeat('x', 250) FROM documents UNION ALL SELECT doc_id, 4, repeat('x', 100) || chr(10) || chr(10) || 'end' FROM documents")
def chunks_cut(spark, sf):
    """Source markers begin chunks, a long word is cut by characters."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("d"), i, F.lit("\n\n<!-- source "), i, F.lit(" -->\n\n  after \n\n"), F.repeat(F.lit("x"), F.lit(600)), F.lit("\n\nend"))
    return chunks.chunk_documents(d.select("doc_id", text.alias("text")), 250)


@query(
    "SELECT page_id, lower(split_part(url, '://', 1)) || '://' || lower(split_part(split_part(url, '://', 2), '/', 1)) || regexp_replace(coalesce(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1), ''), '/+$', '') || CASE WHEN contains(url, '?') THEN '?' || split_part(split_part(url, '?', 2), '#', 1) ELSE '' END AS at FROM pages"
)
def urls_normalized(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", crawl.normalize_url(F.col("url")).alias("at"))


_ROBOTS = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.html$\n\nUser-agent: weaver\nDisallow: /en/\nAllow: /en/6\n"


@query("SELECT page_id, NOT ends_with(path, '.html') AS anyone, NOT starts_with(path, '/en/') OR starts_with(path, '/en/6') AS weaver FROM (SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1), '') AS path FROM pages)")
def robots_match(spark, sf):
    rules = {who: crawl.robots_rules(_ROBOTS, agent) for who, agent in (("anyone", "other/1.0"), ("weaver", "Weaver/2.0"))}
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")).alias("path"))
    return pages.select("page_id", *(crawl.robots_column(F.col("path"), r).alias(who) for who, r in rules.items()))


@query("SELECT 'f' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.MD' WHEN 2 THEN '.txt' ELSE '' END AS path, CASE c_custkey % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'notes' END AS handler FROM customer")
def files_routed(spark, sf):
    handlers, _ = plugins.claims([plugins.Handler("code", ("py", ".rs"), lambda p, b: []), plugins.Handler("notes", ("md", "py"), lambda p, b: [])])
    kind = F.element_at(F.array(*map(F.lit, (".py", ".MD", ".txt", ""))), (F.col("c_custkey") % 4 + 1).cast("int"))
    files = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string"), kind).alias("path"))
    return crawl.route(files, handlers)


@query("SELECT 'customer:' || c_custkey AS key, c_mktsegment AS label, c_name AS name FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT NULL, 'error', 'ValueError: ' || c_custkey FROM customer WHERE c_custkey % 5 = 0")
def files_parsed(spark, sf):
    """A parser reads each file; one that fails is told and the others go on."""

    def parse(path: str, content: bytes):
        key, label, name = content.decode().split("|")
        if int(key) % 5 == 0:
            raise ValueError(key)
        yield {"node": (f"customer:{key}", label, {"name": name})}

    c = spark.read.parquet(f"{sf}/customer.parquet")
    files = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".row")).alias("path"), F.concat_ws("|", F.col("c_custkey").cast("string"), "c_mktsegment", "c_name").cast("binary").alias("content"))
    facts = plugins.parse_files(files, [plugins.Handler("rows", ("row",), parse)])
    return facts.select("key", F.coalesce("label", "kind").alias("label"), F.coalesce(F.col("props")["name"], "error").alias("name"))


def _eight(text: str) -> list[float]:
    return [float(text.count(c)) for c in "aeinorst"]


@query("SELECT 'part:' || p_partkey AS key, substr(sha256(p_name), 1, 16) AS hash, list_transform(string_split('aeinorst', ''), lambda c: (length(p_name) - length(replace(p_name, c, '')))::FLOAT) AS embedding FROM part WHERE p_size > 10")
def vectorized(spark, sf):
    """Only texts whose hash is not known are embedded."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    texts = p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("text"))
    known = p.filter("p_size <= 10").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"), F.substring(F.sha2("p_name", 256), 1, 16).alias("hash"))
    return providers.vectorize(texts, known, _eight)


@query(
    "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT c.vec_id AS chunk, k.vec_id AS id, round(list_cosine_similarity(c.e, k.e), 5) AS score, row_number() OVER (PARTITION BY c.vec_id ORDER BY 1 - list_cosine_similarity(c.e, k.e), k.vec_id) AS n FROM v c, v k WHERE c.vec_id % 25 = 3 AND k.vec_id % 2 = 0) SELECT chunk, 'item:' || id AS key, score FROM r WHERE n <= 8"
)
def link_candidates(spark, sf):
    """The nearest keyed nodes of each chunk, as candidates for linking."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    named = v.filter("id % 2 = 0").withColumn("key", F.concat(F.lit("item:"), F.col("id").cast("string")))
    nodes = named.unionByName(v.filter("id % 2 = 1").withColumn("key", F.lit(None).cast("string")))
    out = entities.candidates(v.filter("id % 25 = 3").select(F.col("id").alias("chunk"), "vector"), nodes)
    return out.select("chunk", "key", F.round("score", 5).alias("score"))


_TARGET = (
    "WITH d AS (SELECT doc_id, list_transform({words}, lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, unnest(w) AS t FROM d), r AS (SELECT t, count(*) AS n FROM t WHERE doc_id = 0 GROUP BY t ORDER BY n DESC, t LIMIT 40), "
    "k AS (SELECT t, sum(w) AS w FROM (SELECT t, n / (SELECT max(n) FROM r) AS w FROM r UNION ALL SELECT unnest(['quality', 'the']), 3.0) GROUP BY t) "
)


@query(
    _TARGET
    + ", l AS (SELECT doc_id, len(w) AS len, (SELECT avg(len(w)) FROM d) AS mean FROM d), f AS (SELECT doc_id, t, count(*) AS f FROM t SEMI JOIN k USING (t) GROUP BY ALL), s AS (SELECT doc_id, sum(k.w * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))) AS raw FROM f JOIN k USING (t) JOIN l USING (doc_id) GROUP BY doc_id) SELECT doc_id AS page_id, round(greatest(0, least(1, coalesce(raw, 0) / ((SELECT sum(w) FROM k) * 2.2))), 5) AS relevance FROM d LEFT JOIN s USING (doc_id)"
)
def relevance_to_target(spark, sf):
    """How near documents are to the terms of the first one and a topic."""
    pages = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").select(F.col("doc_id").alias("page_id"), "text")
    weights = crawl.target(pages.filter("page_id = 0"), "the quality", "none")
    return crawl.score(pages, weights, "none").select("page_id", F.round("relevance", 5).alias("relevance"))


@query("SELECT unnest(['en', 'DE', 'french', ' es ', 'zh', 'none', 'klingon']) AS name, unnest(['english', 'german', 'french', 'spanish', 'chinese', 'none', 'unknown']) AS language")
def language_names(spark, sf):
    from .functions.analyzer import language

    def of(name: str) -> str:
        try:
            return language(name)
        except ValueError:
            return "unknown"

    return spark.createDataFrame([(n, of(n)) for n in ("en", "DE", "french", " es ", "zh", "none", "klingon")], "name string, language string")


@query("SELECT c_custkey AS id, ['数据', '据库', 'c' || c_custkey, '图'] AS terms FROM customer")
def chinese_terms(spark, sf):
    from .functions.analyzer import terms

    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), terms(F.concat(F.lit("数据库, C"), F.col("c_custkey").cast("string"), F.lit(" 图!")), "zh").alias("terms"))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN ['le', 'maison', 'continu'] WHEN 1 THEN ['los', 'torner', 'torrencial'] ELSE ['die', 'haus'] END AS terms FROM customer")
def stemmed_terms(spark, sf):
    from .functions.analyzer import terms

    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"))
    texts = (("fr", "Les maisons continuaient"), ("es", "Los torneros torrenciales"), ("german", "Die Häuser"))
    parts = [c.filter(F.col("id") % 3 == i).select("id", terms(F.lit(t), lang).alias("terms")) for i, (lang, t) in enumerate(texts)]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT 'node' AS kind, 'region:' || r_regionkey AS a, '' AS b FROM region WHERE r_regionkey < 3 UNION ALL SELECT 'node', 'nation:' || n_nationkey, '' FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 'edge', 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation WHERE n_regionkey < 3")
def ask_loop(spark, sf):
    """A model that looks up an edge, gives a plan that is wrong, then one that is right."""
    import json

    from .catalogue import PLACES, P, graph, key_of
    from .documents import ask
    from .plans import model as M

    plan = M.LogicalPlan(M.ScanLabel("Region"), (M.Filter(P("r_regionkey").lt(3)), M.Expand("In", "IN_REGION")))
    replies = ['{"find_edge": "nations of regions"}', '{"plan": {"source": "Nothing", "steps": []}}', '{"plan": ' + plan.to_json() + "}"]
    json.loads(replies[-1])
    got = ask.ask(graph(spark, sf, PLACES), "Which nations?", providers.MockChat(replies), providers.mock_embedder(8))
    assert len(got.failures) == 1 and got.turns == 3
    return got.nodes.select(F.lit("node").alias("kind"), key_of().alias("a"), F.lit("").alias("b")).union(got.edges.select(F.lit("edge"), key_of("src"), key_of("dst")))


@query("SELECT doc_id, doc_id % 90 + 10 AS words, true AS fits FROM documents")
def truncated_replies(spark, sf):
    """A reply that does not fit halves its chunk; the halves' results come in order."""

    def read(text: str) -> list[str]:
        if len(text) > 250:
            raise chunks.Truncated
        return [text]

    def run(batches):
        for pdf in batches:
            got = [chunks.read_chunk("word " * n, read) for n in pdf["n"]]
            yield pdf[["doc_id"]].assign(words=[sum(len(p.split()) for p in g) for g in got], fits=[all(len(p) <= 250 for p in g) for g in got])

    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", (F.col("doc_id") % 90 + 10).cast("int").alias("n"))
    return d.mapInPandas(run, "doc_id long, words long, fits boolean")
