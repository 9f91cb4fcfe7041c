import re
from collections import Counter

import numpy as np
import pyarrow as pa

from sparkweave.llm import language_id as L
from sparkweave.llm import quality as Q
from sparkweave.llm.common import Words

SF = "/root/testdata/sf0.001"


def naive_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    often = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(often)


def test_counts_equal_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [None, "", " \n\t", "a b c a b c", "ä#ß €&\n\nx\nx\n x", "x\x1cy z\x0b\x0cq", "the " * 400]
    got = Q.counts(pa.array(texts, pa.string()))
    rows = list(zip(*(got[c].tolist() for c in Q.RESULT), strict=True))
    assert rows == [naive_counts(t) for t in texts]


def test_quality_keeps_good_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in Q.quality_rules(docs, labels).collect()}
    assert len(got) == docs.count()
    marks = [(r.quality, got[r.doc_id]) for r in labels.collect()]
    assert sum(r.kept or r.base_failed for q, r in marks if q) >= 0.97 * sum(q for q, _ in marks)
    assert sum(not r.kept for q, r in marks if not q) >= 0.9 * sum(not q for q, _ in marks)


def test_quality_of_held_out_labels(spark):
    """Rows whose labels were not learned from; and the order of words counts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    model = Q.fit(docs, labels.filter("doc_id % 4 <> 1"))
    got = {r.doc_id: r for r in Q.score(docs, model, "doc_id").collect()}
    marks = [(r.quality, got[r.doc_id]) for r in labels.filter("doc_id % 4 = 1").collect()]
    good, bad = [r for q, r in marks if q and not r.base_failed], [r for q, r in marks if not q]
    assert len(good) > 100 and len(bad) > 20
    assert np.mean([r.kept for r in good]) >= 0.97 and np.mean([not r.kept for r in bad]) >= 0.9
    p = model.probability(Words(pa.array(["one two three four five", "five three one two four"])))
    assert p[0] != p[1]


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "w%d " * 3, "x"), (2, None, "y"), (2, " ".join(map(str, range(60))), "z"), (None, "", "q")], "doc_id long, text string, kept string")
    rows = Q.quality_rules(docs, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")).collect()
    assert sorted((r.n_words, r.kept) for r in rows) == [(0, False), (0, False), (3, False), (60, True)]
    assert Q.quality_rules(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.language_id(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out]
    assert 100 < len(held) < 300
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_learns_nothing_from_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    from pyspark.sql import functions as F

    from sparkweave.llm.common import held_out

    other = docs.withColumn("lang", F.when(held_out(0), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(tuple, L.language_id(docs).collect())) == sorted(map(tuple, L.language_id(other).collect()))


def test_language_edges(spark):
    rows = [(1, None, "en", 0.5), (2, "123 !!", "en", 1.0), (3, "thé été où", "fr", 0.0), (None, "the and of the", "en", 1.0), (5, "the of and", None, 0.0)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")).collect()}
    assert got[1] == ("und", 0.0) and got[2] == ("und", 0.0) and got[5][0] in ("en", "fr", "und")
    nothing = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.language_id(nothing).collect()] == [("und", 0.0)]
    assert L.language_id(nothing.limit(0)).collect() == []
    assert len(Words(pa.array([], pa.string())).codes) == 0
