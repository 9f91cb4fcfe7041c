import numpy as np

import corpus_pipeline
from sparkweave.llm import language_id as L

SF = "/root/testdata/sf0.01"


def strangers():
    """Texts of over 50 words in languages and scripts that the documents do not have, and letter junk."""
    rng = np.random.default_rng(0)
    return [
        "ja kuitenkin kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki " * 5,
        "minden emberi lény szabadon születik és egyenlő méltósága és joga van az emberek ésszel bírván " * 6,
        "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом " * 6,
        "人人 生而 自由 在 尊严 和 权利 上 一律 平等 " * 8,
        " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(80)),
        "xqz kjw vvb qqx zzk " * 20,
    ]


def test_texts_of_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(900_100 + i, t, None, None, None) for i, t in enumerate(strangers())]
    assert all(len(t.split()) > 50 for _, t, *_ in odd)
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    got = {r.doc_id: r for r in L.language_id(both).collect()}
    assert [(got[r[0]].lang_pred, got[r[0]].score) for r in odd] == [("und", 0.0)] * len(odd)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, both, SF).select("doc_id").collect()}
    assert not kept & {r[0] for r in odd}
    own = {r.doc_id for r in docs.filter("lang is not null").select("doc_id").collect()}
    assert len(kept & own) >= 0.995 * len(own)


def test_no_least_fit_without_enough_held_out_rows(spark):
    rows = [(i, "the and of the", "en") for i in range(L.LEAST_ROWS)]
    model = L.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.least.tolist() == [-np.inf]
