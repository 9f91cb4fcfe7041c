import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkweave.llm import lm_scoring as M


def naive(docs):
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0end"]
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in docs}
    c = Counter(w for d, t in docs if not held[d] for w in tok(t))
    n, v = sum(c.values()), len(c)
    out = {}
    for d, t in docs:
        w = tok(t)
        out[d] = (held[d], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    return out


def test_counts_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = [(r.doc_id, r.text) for r in df.collect()] + [(90001, None), (90002, "Ünseen WORD zzz"), (90003, "")]
    df = df.union(spark.createDataFrame(docs[-3:], df.schema))
    for head in (M.HEAD, 100):
        got = {r.doc_id: r for r in M.lm_scores(df, head=head).collect()}
        for d, want in naive(docs).items():
            r = got[d]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
            assert r.base_score == pytest.approx(want[4], rel=1e-9)
            assert r.score < 0


def test_context_gains_on_held_out_texts(spark):
    """A tenth of the log probability of unigrams, and repeated rows and long texts score as any."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = M.lm_scoring(df).collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 1500 and sum(r.score for r in held) > sum(r.base_score for r in held) * 0.9


def test_ties_repeats_and_a_long_text(spark):
    held = [d for d in range(60) if zlib.crc32(str(d).encode()) % 5 == 1]
    rows = [(d, "one two one two") for d in range(12)] + [(held[-1], "two one"), (held[-1], "two one"), (70, "word " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.lm_scoring(df).collect()
    assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id == 70} == {300_001}
    twins = [(r.base_score, r.score) for r in got if r.doc_id == held[-1] and r.n_tokens == 3]
    assert len(twins) == 2 and len(set(twins)) == 1 and all(math.isfinite(r.score) for r in got)


def test_classes_hold_words_of_like_company():
    rng = np.random.default_rng(3)
    company = rng.random((40, 8))
    company[:20, :4] *= 50
    company[20:, 4:] *= 50
    clusters = M.clustered(company, np.arange(40, 0, -1.0), 2)
    assert len(set(clusters[:20])) == 1 and len(set(clusters[20:])) == 1 and clusters[0] != clusters[39]


def test_model_sums_to_one():
    rng = np.random.default_rng(0)
    model = M.MaxEnt(rng.random(256) + 0.1, rng.standard_normal((2, 1 << M.BITS, 16)).astype(np.float32))
    features = rng.integers(0, 2**63, (4, 1), dtype=np.int64).astype(np.uint64)
    total = 0.0
    for leaf in range(256):
        parts = model.forward(features, np.array([leaf]))
        total += math.exp(sum(float(z[0, t[0]]) for _, z, t in parts))
    assert total == pytest.approx(1, abs=1e-4)


def test_without_training_rows(spark):
    held = [d for d in range(60) if zlib.crc32(str(d).encode()) % 5 == 1][:3]
    df = spark.createDataFrame([(d, "a b") for d in held], "doc_id long, text string")
    assert {(r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in M.lm_scoring(df).collect()} == {(3, 0, 0, 0.0)}
    assert M.lm_scoring(df.limit(0)).collect() == []
