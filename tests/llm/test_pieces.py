import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweave.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", None, " ", "  two  spaces ", "Hello, World!", "naïve café 日本語 한국어 🎉👩‍👩‍👧", "\n\ttabs\r\n", "x" * 3000, "a\u0000b", "▁mark ▁▁", "1234567890" * 30, "ﬁ Ⅷ İ ſ", "<s> </s> <unk> <0x41>"]


@pytest.fixture(scope="module")
def model():
    return P.PieceModel.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def encoded(model, texts):
    ids, first = model.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)], ids, first


def test_equals_the_library(model, library):
    rng = random.Random(7)
    words = ["the", "Quality", "tokenization", "ünïcode", "of", "x9", "datastructure", "…", "日本", "aaaaaaa", "internationalization"]
    texts = [t for t in HARD if t is None or "\u0000" not in t] + [" ".join(rng.choice(words) + rng.choice(["", ",", ".", "s"]) for _ in range(rng.randrange(120))) for _ in range(60)]
    got, ids, first = encoded(model, texts)
    assert got == [library.encode(t or "") for t in texts]
    back = model.decode(ids, first)
    assert [b.decode() for b in back] == [(t or "").replace("▁", " ") for t in texts]


@given(st.lists(st.text(max_size=60), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_round_trip_of_any_text(texts):
    model = test_round_trip_of_any_text.model = getattr(test_round_trip_of_any_text, "model", None) or P.PieceModel.from_file(PATH)
    _, ids, first = encoded(model, texts)
    assert [b.decode() for b in model.decode(ids, first)] == [t.replace("▁", " ") for t in texts]


def test_lattice_equals_merges(model):
    """Short segments together, long ones by themselves, and the merges, on strings full of ties."""
    rng = random.Random(11)
    texts = ["".join(rng.choice(rng.choice(["aab", "the ing", "0011", "   x", "日本é"])) for _ in range(rng.randrange(70))) for _ in range(2000)]
    texts += ["".join(rng.choice("aeiounrstl") for _ in range(n)) for n in (1001, 1500)] + [" " * 1200 + "end", "ab" * 700]
    want = encoded(model, texts)[0]
    merged = P.PieceModel.from_file(PATH)
    merged._paths = merged._walk = lambda grid: merged._merge(grid)[:2]
    assert encoded(merged, texts)[0] == want


def best(pieces, scores, segment):
    """Best sum of scores by trying every segmentation."""
    table = {0: (0.0, [])}
    for i in range(1, len(segment) + 1):
        options = []
        for j in range(i):
            part = segment[j:i]
            if part in pieces:
                options.append((table[j][0] + scores[pieces.index(part)], [*table[j][1], pieces.index(part)]))
            elif i - j == 1:
                options.append((table[j][0] + P.UNKNOWN_SCORE, [*table[j][1], 0]))
        table[i] = max(options, key=lambda o: o[0])
    return table[len(segment)]


def test_viterbi_finds_the_best_segmentation():
    rng = random.Random(1)
    names = ["<unk>", "▁"] + sorted({"".join(rng.choice("▁abc") if i == 0 else rng.choice("abc") for i in range(rng.randrange(1, 5))) for _ in range(25)} - {"▁"})
    scores = [0.0] + [-rng.random() * 9 - 0.01 * i for i in range(len(names) - 1)]
    model = P.PieceModel(names, scores, bpe=False, plain=[False] + [True] * (len(names) - 1))
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 14))) for _ in range(80)]
    for text, ids in zip(texts, encoded(model, texts)[0], strict=True):
        marked = "▁" + text.replace(" ", "▁")
        cuts = [i for i in range(len(marked)) if marked[i] == "▁" and (i == 0 or marked[i - 1] != "▁")] + [len(marked)]
        want = [best(names, scores, marked[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        got = sum(P.UNKNOWN_SCORE if i == 0 else scores[i] for i in ids)
        assert got == pytest.approx(sum(w[0] for w in want)) and ids == [i for w in want for i in w[1]]


def test_digest_and_edge_cases(spark, library):
    rows = [(i, t) for i, t in enumerate(t for t in HARD if t is None or "▁" not in t and "\u0000" not in t)] + [(None, "no id"), (0, "again"), (0, "again")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = sorted((tuple(r) for r in P.pieces_digest(df, PATH).collect()), key=str)
    want = sorted(((i, len(x := library.encode(t or "")), zlib.crc32(np.array(x, "<u4").tobytes()), True) for i, t in rows), key=str)
    assert got == want
    assert P.pieces_digest(df.filter("false"), PATH).count() == 0
    listed = {r.doc_id: r.ids for r in P.encode(df.filter("doc_id = 4"), P.PieceModel.from_file(PATH)).collect()}
    assert listed == {4: library.encode(HARD[4])}
