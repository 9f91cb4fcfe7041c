import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkweave.llm import packing as P


def plain_best_fit(lengths, sources, clusters, capacity):
    """The tightest bin that is free of the source and the cluster; of equals, the one that got this room first."""
    bins, out, clock = [], [], 0
    for need, s, c in zip(lengths, sources, clusters, strict=True):
        fits = [b for b in bins if b["room"] >= need and (s < 0 or s not in b["s"]) and c not in b["c"]]
        if fits:
            b = min(fits, key=lambda b: (b["room"], b["since"]))
        else:
            b = {"room": capacity, "s": set(), "c": set(), "since": 0, "id": len(bins)}
            bins.append(b)
        out.append((b["id"], capacity - b["room"]))
        b["room"] -= need
        b["s"].add(s)
        b["c"].add(c)
        clock += 1
        b["since"] = clock
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equals_plain_best_fit(seed):
    rng = random.Random(seed)
    n, capacity = 400, 50
    lengths = np.array(sorted((rng.randrange(0, capacity + 1) for _ in range(n)), reverse=True))
    sources = np.array([rng.choice([-1, 0, 0, 0, *range(1, 12)]) for _ in range(n)])
    clusters = np.array([rng.randrange(60) for _ in range(n)])
    where, at = P.pack_shard(lengths, sources, clusters, capacity)
    assert list(zip(where.tolist(), at.tolist(), strict=True)) == plain_best_fit(lengths.tolist(), sources.tolist(), clusters.tolist(), capacity)


def test_documents_of_every_kind(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(0, 60))), rng.choice(["hot", "hot", "a", "b", None])) for i in range(300)]
    rows += [(1000, "x " * 205, "long"), (1001, None, "a"), (1002, "", None), (None, "no id", "b"), (None, "no id", "b"), (2005, "copy of one", "c"), (2006, "copy of one", "d")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, cluster string, shard int")
    for shard_rows in (10_000, 40):
        parts = P.best_fit_packing(df, 100, shard_rows).collect()
        placed, want, bins = Counter(), Counter(), defaultdict(list)
        for p in parts:
            placed[p.doc_id] += p.n_tokens
            bins[p.bin_id].append(p)
        for i, t, _ in rows:
            want[i] += len((t or "").split())
        assert +placed == +want and {p.doc_id for p in parts} == {r[0] for r in rows}
        assert sorted(p.n_tokens for p in parts if p.doc_id == 1000) == [5, 100, 100] and sum(p.doc_id is None for p in parts) == 2
        for members in bins.values():
            spans = sorted((p.bin_offset, p.n_tokens) for p in members)
            assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) <= 100
            own = [p.source for p in members if p.source is not None]
            assert len(own) == len(set(own)) and len({p.cluster for p in members}) == len(members)
        assert len({p.bin_id for p in parts if p.doc_id in (2005, 2006)}) == 2
    assert P.best_fit_packing(df.filter("false")).count() == 0


def test_lengths_of_token_files(spark):
    """Bins hold the ids that the token files have for their documents."""
    import public_tokenizers

    from sparkweave.llm.token_files import token_file_digest

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokens = token_file_digest(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens")
    want = {r.doc_id: r.n_tokens for r in tokens.collect()}
    parts = P.best_fit_packing(docs.join(tokens, "doc_id"), 4096, length="n_tokens").collect()
    got, bins = Counter(), Counter()
    for p in parts:
        got[p.doc_id] += p.n_tokens
        bins[p.bin_id] += p.n_tokens
    assert got == want and max(bins.values()) <= 4096
