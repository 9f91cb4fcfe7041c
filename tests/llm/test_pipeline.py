from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkweave.llm import language_id, near_dedup, quality
from sparkweave.llm.suffix_dedup import LENGTH

from test_near_dedup import jaccard

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """documents with odd rows and columns whose names the operators use themselves."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"token{i % 4999}x{i}" for i in range(30_000))
    odd = [(None, "no id but text", "en", None, None), (900_001, None, "de", "s", 0), (900_002, "", None, None, None), (900_003, long, "en", "s", None), (900_004, long, None, "s", None), (900_004, long, None, "s", None), (900_005, "1234 5678 " * 40, None, None, 5)]
    kind = base.select("doc_id", "text", "lang", "source", "n_chars").schema
    rows = base.unionByName(spark.createDataFrame(odd, kind))
    return rows.select("*", F.lit(1).alias("rid"), F.lit("f").alias("found"), F.lit(2.5).alias("n_words"), F.lit(None).cast("string").alias("kept"), F.lit(True).alias("a.b"), F.lit(3).alias("h"), F.lit("c").alias("class_rid"))


def test_filters_keep_what_the_operators_keep(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == docs.columns
    verdict = quality.quality_rules(docs, labels).filter("kept")
    got = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert got == Counter(r.doc_id for r in verdict.select("doc_id").collect())
    assert got[900_001] == got[900_002] == 0
    known = corpus_pipeline.language(spark, docs, SF)
    assert known.dtypes == docs.dtypes
    verdict = language_id.language_id(docs).filter(f"lang_pred <> 'und' and score >= {language_id.LEAST_SCORE}")
    got = Counter(r.doc_id for r in known.select("doc_id").collect())
    assert got == Counter(r.doc_id for r in verdict.select("doc_id").collect())
    assert got[900_005] == 0 and got[900_004] == 2


def test_near_copies_and_repeats_equal_brute_force(spark, docs):
    sample = [r for r in docs.collect() if not r.text or len(r.text) < 6_000 or (r.doc_id or 0) > 900_000]
    rows = sorted(sample, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text is not None, r.text or ""))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    # texts that share no word run of five have no overlap
    seen = defaultdict(set)
    for i, r in enumerate(rows):
        w = (r.text or "").split()
        for k in range(max(1, len(w) - 4)) if w else ():
            seen[tuple(w[k : k + 5])].add(i)
    pairs = {(a, b) for s in seen.values() if len(s) < 200 for a in s for b in s if a < b}
    for a, b in pairs:
        la, lb = len(rows[a].text), len(rows[b].text)
        if min(la, lb) > 0.5 * max(la, lb) and jaccard(rows[a].text, rows[b].text) >= near_dedup.SIMILARITY:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    df = spark.createDataFrame(sample, docs.schema)
    want = [r for i, r in enumerate(rows) if find(i) == i]
    got = corpus_pipeline.near_copies(spark, df, SF)
    assert got.dtypes == docs.dtypes
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    assert [tuple(r) for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(want, key=key)]
    out = corpus_pipeline.repeats(spark, df, SF)
    assert out.columns == docs.columns
    windows, expected = set(), []
    for r in rows:
        data = (r.text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - LENGTH + 1):
            w = data[p : p + LENGTH]
            if w in windows:
                gone[p : p + LENGTH] = b"\1" * LENGTH
            windows.add(w)
        text, at = [], 0
        for c in r.text or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                text.append(c)
            at += n
        text = "".join(text)
        changed = text != (r.text or "")
        expected.append((r.doc_id, text if changed else r.text, len(text) if changed else r.n_chars, r.source))
    assert any(a[1] != r.text for a, r in zip(expected, rows, strict=True))
    key = lambda t: tuple((x is None, x or 0) for x in t[:1]) + (t[1] or "",)
    assert sorted(((r.doc_id, r.text, r.n_chars, r.source) for r in out.collect()), key=key) == sorted(expected, key=key)


def test_packing_places_every_word(spark, docs):
    parts = corpus_pipeline.packing(spark, docs, SF).collect()
    words = Counter()
    for r in docs.select("doc_id", "text").collect():
        words[r.doc_id] += len((r.text or "").split())
    placed, bins = Counter(), defaultdict(list)
    for p in parts:
        placed[p.doc_id] += p.n_tokens
        bins[p.bin_id].append(p)
    assert +placed == +words
    for members in bins.values():
        members.sort(key=lambda p: (p.bin_offset, p.n_tokens))
        end = 0
        for p in members:
            assert p.bin_offset == end or p.n_tokens == 0
            end = max(end, p.bin_offset + p.n_tokens)
        assert end <= 2048
        sources = [p.source for p in members if p.source is not None]
        assert len(sources) == len(set(sources)) and len({p.cluster for p in members}) == len(members)


def test_empty_documents(spark, docs):
    none = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_run_applies_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:4] == ["doc_id", "part", "bin_id", "bin_offset"] and got.count() > 50
