"""BM25 keyword search over declared indexes.

An index is two tables: postings (term, node, tf), written in the order of terms so that a query reads only the row
groups of its own terms, and documents (node, len). Terms are counted in their text; answering
a query touches the postings of a few terms, never the texts. Text without terms is not in an index.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analyzer import language, query_terms, terms
from ..functions.values import RANK
from ..sources.graph import Graph
from ..storage import cut, discard

#: Fixed values of the ranking.
K1, B = 1.2, 0.75


@dataclass
class KeywordIndex:
    postings: DataFrame
    docs: DataFrame
    language: str = "english"
    totals: tuple[int, int] | None = None

    def size(self) -> tuple[int, int]:
        """Documents, and terms in all of them."""
        if self.totals is None:
            self.totals = tuple(x or 0 for x in self.docs.agg(F.count(F.lit(1)), F.sum("len")).first())
        return self.totals


def declare(graph: Graph, label: str, prop: str, lang: str = "english") -> KeywordIndex:
    """Build the index of a label's texts and declare it on the graph."""
    held = graph.keyword_indexes.get((label, prop))
    lang = language(lang)
    if held is not None and held.language != lang:
        raise ValueError(f"a keyword index on ({label}, {prop}) has another language")
    index = build(texts_of(graph, label, prop), lang)
    graph.declare_keyword_index(label, prop, index)
    return index


def texts_of(graph: Graph, label: str, prop: str) -> DataFrame:
    """id and text of a label's nodes; NULL where the property is no string."""
    labels = frozenset([label])
    v = graph.values(labels, [prop])[prop]
    text = v.col if v.kind == "str" else F.when(v.col["t"] == RANK["str"], v.col["s"]) if v.kind == "any" else F.lit(None).cast("string")
    return graph.nodes(labels, [prop]).select("id", text.alias("text"))


def build(texts: DataFrame, lang: str = "english") -> KeywordIndex:
    """The index of texts (id, text)."""
    found = texts.filter("text is not null").select(F.col("id").alias("node"), F.sort_array(terms(F.col("text"), lang)).alias("t"))
    # the places at which a sorted text's next term begins
    found = found.withColumn("at", F.filter(F.when(F.size("t") > 0, F.sequence(F.lit(0), F.size("t") - 1)), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1))))
    tf = F.transform("at", lambda i, n: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("at", n + 1), F.size("t")) - i).cast("bigint").alias("tf")))
    # texts are analysed and written once (a filter on their terms would be pushed below and analyse them again); only postings are shuffled, and those of an id's several rows meet there
    found = cut(found.select("node", F.size("t").alias("len"), tf.alias("tf")), "terms")
    tf = found.select("node", F.inline("tf")).repartitionByRange("term", "node").groupBy("term", "node").agg(F.sum("tf").alias("tf"))
    postings = cut(tf.sortWithinPartitions("term", "node"), "postings")
    docs = cut(found.filter("len > 0").groupBy("node").agg(F.sum("len").alias("len")), "lengths")
    discard(found)
    return KeywordIndex(postings, docs, language(lang))


def upsert(index: KeywordIndex, texts: DataFrame) -> KeywordIndex:
    """The index after documents (id, text) are put in place of those of the same id; a null text removes one."""
    gone = texts.select(F.col("id").alias("node")).distinct()
    new = build(texts, index.language)
    parts = [x.join(gone, "node", "left_anti").select(*x.columns).unionByName(y) for x, y in ((index.postings, new.postings), (index.docs, new.docs))]
    return KeywordIndex(cut(parts[0].repartitionByRange("term", "node").sortWithinPartitions("term", "node"), "postings"), cut(parts[1], "lengths"), index.language)


def bm25(index: KeywordIndex, query: str) -> DataFrame:
    """node and score of all documents with a term of the query."""
    wanted = query_terms(query, index.language)
    n, total = index.size()
    if not wanted or not n:
        return index.docs.select("node", F.lit(0.0).alias("score")).filter("false")
    hits = index.postings.filter(F.col("term").isin(wanted))
    df = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row a query term
    if not df:
        return index.docs.select("node", F.lit(0.0).alias("score")).filter("false")
    # ln((n - df + 0.5) / (df + 0.5) + 1) of each term, as a column of constants
    idf = reduce(lambda c, t: c.when(F.col("term") == t, F.log((n - df[t] + 0.5) / F.lit(df[t] + 0.5) + 1)), list(df), F.when(F.lit(False), F.lit(0.0)))
    length = 1 - B + B * F.col("len") / F.lit(total / n)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)
    return hits.join(index.docs, "node").groupBy("node").agg(F.sum(part).alias("score"))


def top_k(graph: Graph, label: str, prop: str, query: str, k: int) -> DataFrame:
    """id and score of the k best documents, ties by id; none if no index is declared."""
    index = graph.keyword_indexes.get((label, prop))
    if index is None:
        return graph.spark.createDataFrame([], "id long, score double")
    return bm25(index, query).select(F.col("node").alias("id"), "score").orderBy(F.desc("score"), "id").limit(k)
