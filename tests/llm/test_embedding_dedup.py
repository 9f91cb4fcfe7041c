import numpy as np

from sparkweave.llm import embedding_dedup as E


def vectors(n=1500, dim=32, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(300, 700):
        x[i] = x[i % 20] + 0.28 * np.linalg.norm(x[i % 20]) / np.sqrt(dim) * rng.standard_normal(dim) * rng.uniform(0.2, 1.6)
    x[700:720] = x[5]
    return x.astype(np.float32).astype(np.float64)


def test_links_against_brute_force(spark):
    x = vectors()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(5000, None, 1), (5001, [], 2), (5002, [0.0] * 32, 3), (5003, [float("nan")] * 32, 1), (5004, [1.0] * 31, 1), (5005, [None] + [1.0] * 31, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, component_id int")
    for block in (4000, 40):
        got = {r.vec_id: r for r in E.embedding_near_duplicates(df, cell_rows=60, block_rows=block).collect()}
        assert len(got) == len(rows) + len(bad)
        assert all(got[b[0]].n_links == 0 and got[b[0]].kept for b in bad)
        links = np.array([got[i].n_links for i in range(len(x))])
        true = near.sum(1) - 1
        assert (links <= true).all() and links.sum() >= 0.995 * true.sum()
        assert got[700].component_id == got[5].component_id
        assert all(got[i].kept == (got[i].component_id == i) for i in range(len(x)))


def test_repeated_ids_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.embedding_near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]  # kept: vec_id = component_id
    assert E.embedding_near_duplicates(df.limit(0)).collect() == []


def test_any_magnitude(spark):
    base = [3.0, -1.0, 2.0, 0.5]
    rows = []
    for n, size in enumerate((1.0, 1e200, 1e-200, 1.7e308, 5e-324)):
        rows.append((10 * n, [x / 3.0 * size if size < 1.7e308 else x / 3.0 * 1.7e308 for x in base]))
        rows.append((10 * n + 1, [x / 3.0 * size * 0.5 for x in (base if size != 5e-324 else [0, 0, 0, 0])]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in E.embedding_near_duplicates(df).collect()}
    x = np.array([r[1] for r in rows], dtype=np.longdouble)
    for i, (vec, v) in enumerate(rows):
        norm = np.sqrt((x * x).sum(1))
        near = [(x[i] @ x[j]) / (norm[i] * norm[j]) >= 0.9 if norm[i] > 0 and norm[j] > 0 else False for j in range(len(rows))]
        assert got[vec].n_links == (sum(near) - 1 if norm[i] > 0 else 0), vec
    assert got[10].component_id == got[21].component_id == 0


def test_calibration():
    first, window, least = E.calibrated(0.9)
    rng = np.random.default_rng(0)
    diff = np.abs(rng.standard_normal((20000, E.LINES + 1)) * np.sqrt(0.2))
    assert ((diff[:, 0] <= first) & ((diff[:, 1:] <= window).sum(1) >= least)).mean() > 0.998
