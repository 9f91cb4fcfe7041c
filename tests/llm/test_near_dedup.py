import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkweave.llm import near_dedup as N


def bag(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    a, b = bag(a or ""), bag(b or "")
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            near = list(base)
            for _ in range(rng.randrange(0, 4)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            out.append(" ".join(near))
    return out + ["", None, " \n", "a b", "a b", "ha " * 80, "ha " * 90]


@pytest.mark.parametrize(("block_rows", "cross_per_row", "task_shingles"), [(N.BLOCK_ROWS, N.CROSS_PER_ROW, N.TASK_SHINGLES), (3, N.CROSS_PER_ROW, 100), (2, 0, 100)])
def test_classes_equal_brute_force(spark, monkeypatch, block_rows, cross_per_row, task_shingles):
    """With the production sizes, and with sizes that put the small corpus through blocks and rounds."""
    monkeypatch.setattr(N, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(N, "CROSS_PER_ROW", cross_per_row)
    monkeypatch.setattr(N, "TASK_SHINGLES", task_shingles)
    texts = corpus()
    n = len(texts)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, class_rid string")
    got = {r.doc_id: r.class_rid for r in N.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in range(n)}
    assert N.near_dedup(df).count() == sum(find(i) == i for i in range(n))


def test_signature_is_unbiased():
    a = np.arange(60, dtype=np.uint64)
    counts_a, counts_b = np.full(60, 3), np.where(np.arange(60) < 30, 3, 1)
    doc = np.repeat([0, 1], 60)
    agree = N.bag_min_hash(doc, np.concatenate([a, a]) * np.uint64(7919), np.concatenate([counts_a, counts_b]), 2, 4000)
    assert abs((agree[0] == agree[1]).mean() - 120 / 180) < 0.03
    assert N.overlaps(pa.array(["a b c d e f"]), pa.array(["a b c d e f"])).tolist() == [1.0]


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "CROSS_PER_ROW", 0.5)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(70):
        near = list(base)
        for at in rng.sample(range(len(base)), rng.randrange(1, 4)):
            near[at] = f"x{rng.random()}"
        texts.append(" ".join(near))
    n = len(texts)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_rid for r in N.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in range(n)} and len(set(got.values())) < n / 2


def test_overlap_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30))) for _ in range(20)]
    off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    left, right = np.arange(0, 20, 2), np.arange(1, 20, 3)
    got = N.overlap_counts(np.concatenate(sets), off, left, right)
    assert got.tolist() == [[float(len(set(sets[i].tolist()) & set(sets[j].tolist()))) for j in right] for i in left]
