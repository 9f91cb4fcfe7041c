from collections import Counter, defaultdict

from sparkweave.llm import packing as P
from sparkweave.llm import registry


def bins_of(parts, ids):
    return len({p.bin_id for p in parts if p.doc_id in ids})


def test_near_copies_share_no_bin(spark, tmp_path):
    text = [f"word{i}" for i in range(80)]
    near = [(i, " ".join([*text[:40], f"other{i}", *text[41:]]), f"s{i}") for i in range(12)]
    rows = near + [(20, " ".join(text), "a"), (21, " ".join(text), "b"), (22, "", "c"), (23, None, "d"), (24, "quite another text", "e"), (None, " ".join(text), "f"), (None, None, "g")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    parts = registry.op6_best_fit_packing(spark, str(tmp_path)).collect()
    assert parts[0].asDict().keys() == {"doc_id", "part", "bin_id", "bin_offset", "n_tokens", "source", "cluster"}
    assert Counter(p.source for p in parts) == Counter(r[2] for r in rows)
    assert {p.source: p.n_tokens for p in parts} == {s: len((t or "").split()) for _, t, s in rows}
    copies = [p for p in parts if p.n_tokens == 80]
    assert len(copies) == 15 and len({p.cluster for p in copies}) == 1 and len({p.bin_id for p in copies}) == 15


def test_near_copies_of_the_documents_share_no_bin(spark):
    sf = "/root/testdata/sf0.001"
    classes = {r.doc_id: r.class_id for r in registry.op2_minhash_near_dedup(spark, sf).collect()}
    assert len(set(classes.values())) < len(classes)
    bins = defaultdict(dict)
    for p in registry.op6_best_fit_packing(spark, sf).collect():
        assert bins[p.bin_id].setdefault(classes[p.doc_id], p.doc_id) == p.doc_id


def test_named_column(spark):
    rows = [(i, f"text {i}", f"s{i}", "red" if i < 5 else None, 7 if i < 3 else i) for i in range(10)]
    rows += [(10, "text 9", "s10", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, colour string, number int")
    assert bins_of(P.best_fit_packing(df).collect(), range(9)) == 1
    parts = P.best_fit_packing(df, cluster="colour").collect()
    assert bins_of(parts, range(5)) == 5 and bins_of(parts, (9, 10)) == 2 and bins_of(parts, range(11)) == 5
    parts = P.best_fit_packing(df, cluster="number").collect()
    assert bins_of(parts, range(3)) == 3 and bins_of(parts, (9, 10)) == 1
