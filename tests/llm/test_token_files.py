import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkweave.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", None, " \n\t ", "Hello, World. don't STOP,it's", "İstanbul ǅ ﬁ Ⅷ café café 日本語 テスト 123 1,000.50", "a<|endoftext|>b <|startoftext|> <| x", "...!?,,,", "x" * 5000, "한국어 각 각", "𝔘𝔫𝔦 👩‍👩‍👧 e‍b", "a b c\u0085d", "tab\x0bvt\x0cff\x1cfs"]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.integers(1, 1024))
@settings(max_examples=60, deadline=None)
def test_pack_round_trip(ids, block):
    ids = np.array(ids, np.uint32)
    data = T.pack(ids, block)
    assert (T.unpack(data) == ids).all() and len(T.unpack(data)) == len(ids)
    blocks = -(-len(ids) // block)
    if blocks > 1:
        assert (T.unpack(data, 1, 2) == ids[block : 2 * block]).all()


def test_pack_patches_outliers():
    ids = np.array([5, 7, 6, 4] * 256 + [2**31], np.uint32)
    ids[100] = 4_000_000_000
    data = T.pack(ids)
    assert (T.unpack(data) == ids).all() and len(data) < 600


def test_not_a_token_file():
    with pytest.raises(ValueError):
        T.unpack(b"nope")


def texts(n=60):
    rng = random.Random(5)
    words = ["word", "Word.", "it's", "naïve", "x1", "end,", "Straße", "ﬃ", "a-b", "(q)", "日本", "№"]
    return HARD + [" ".join(rng.choice(words) + rng.choice(["", ".", ",", "!", "s"]) for _ in range(rng.randrange(200))) for _ in range(n)]


def test_encoder_equals_the_tokenizer_on_whole_texts():
    whole = Tokenizer.from_file(PATH)
    encoder = T.WordEncoder(open(PATH, encoding="utf-8").read())
    rows = texts()
    for part in (rows, rows[::-1], ["letters only"], [""]):
        ids, first = encoder.texts(pa.array(part, pa.string()), 1)
        for i, t in enumerate(part):
            assert ids[first[i] : first[i + 1]].tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 1]


def test_digest_and_files(spark):
    whole = Tokenizer.from_file(PATH)
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    rows += [(3, "repeated id"), (None, "no id"), (3, "repeated id")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, rid string").repartition(5)
    got = sorted((tuple(r) for r in T.token_file_digest(df, PATH).collect()), key=lambda r: r[1])
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert T.token_file_digest(df.filter("false"), PATH).count() == 0
