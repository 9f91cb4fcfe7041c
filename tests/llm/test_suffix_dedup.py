import random

import numpy as np
import pytest

from sparkweave.llm import suffix_dedup as S


def texts(seed, n=60):
    rng = random.Random(seed)
    words = [rng.choice(["ab", "thé", "ion", "wh", "ß", "x y", "er"]) + str(rng.randrange(40)) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = []
    for i in range(n):
        body = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 90)))
        if i % 3 == 0:
            cut = rng.randrange(0, 40)
            body = body[: len(body) // 2] + passage[cut:] + body[len(body) // 2 :]
        if i % 7 == 1:
            body = "Of " * rng.randrange(30, 90)
        if i % 11 == 2 and out:
            body = out[rng.randrange(len(out))][1]
        out.append((i * 3 % n + (i * 3 // n) * n, body))
    out[3] = (out[3][0], None)
    out[4] = (out[4][0], "")
    return out


@pytest.mark.parametrize("hot", [50_000, 3])
def test_equals_brute_force(spark, hot):
    rows = texts(hot)
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, rid string")
    got = S.suffix_dedup(df, hot_group=hot, bucket_anchors=50, piece_rows=20)
    from pyspark.sql import functions as F

    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(S.brute_force(rows))
    assert sum(r[2] for r in got) > 1000


def test_edge_rows(spark):
    long = "word " * 50
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (2, "short"), (3, None)], "doc_id long, text string")
    got = sorted(S.suffix_dedup_digest(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_removed))
    assert [r.doc_id for r in got] == [1, 1, 2, 3, None]
    assert got[0].n_removed < 250 and got[1].n_removed == 250 and got[4].n_removed == 250
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.suffix_dedup_digest(empty).collect() == []


def test_one_shared_prefix_and_long_text(spark):
    """Strings that agree in over 8 bytes, and then in over 24, from the same anchor; and a text of half a million bytes."""
    rng = random.Random(5)
    head = "the common opening of every one of these passages, word for word, "
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(60)) + head + "".join(rng.choice("xy") for _ in range(rng.randrange(40, 120)))) for i in range(80)]
    rows += [(100 + i, head + rows[i][1]) for i in range(0, 80, 7)]
    words = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    rows.append((500, " ".join(words)))
    rows.append((501, " ".join(words[20_000:20_400])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.suffix_dedup(df, bucket_anchors=100, piece_rows=30)
    from pyspark.sql import functions as F

    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(S.brute_force(rows))


def test_multikey_runs_order_suffixes():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1300] = data[200:500]
    data[3000:3200] = data[300:500]
    at = np.arange(0, 3900)
    order, new = S.multikey_runs(data, at, np.zeros(len(at), np.int64), 100)
    windows = [data[p : p + 100].tobytes() for p in at[order]]
    assert windows == sorted(windows)
    assert all((a != b) == n for a, b, n in zip(windows, windows[1:], new[1:]))
    every = [data[p : p + 100].tobytes() for p in at]
    assert sorted(order) == [i for i in at if every.count(every[i]) > 1]
