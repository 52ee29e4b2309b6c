import numpy as np

from spreadlens.operators import similarity as S


def test_blocked_knn_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    n, d, k, thr = 60, 8, 5, 0.2
    x = rng.normal(size=(n, d))
    x[5] = x[4]  # exact duplicate: ties must break by id
    ids = [f"d{i:03d}" for i in range(n)]
    df = spark.createDataFrame([(ids[i], x[i].tolist()) for i in range(n)], "news_id string, embedding array<double>")
    # tiny block budget forces several blocks
    got = S.knn(S.dense_rows(df), d, k, thr, block_bytes=d * 8 * 16)
    got = sorted((r["src"], r["dst"], round(r["weight"], 9)) for r in got.collect())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, S.SIM_DECIMALS)
    want = []
    for i in range(n):
        cand = [(-s[i, j], ids[j], j) for j in range(n) if j != i and s[i, j] >= thr]
        for negs, _, j in sorted(cand)[:k]:
            want.append((ids[i], ids[j], round(float(-negs), 9)))
    assert got == sorted(want)


def _lists(ids, x, k, thr):
    s = np.round(x @ x.T, S.SIM_DECIMALS)
    out = []
    for i in range(len(ids)):
        cand = [(-s[i, j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i] and s[i, j] >= thr]
        out += [(ids[i], b, round(float(-neg), 9)) for neg, b in sorted(cand)[:k]]
    return sorted(out)


def _sparse(n, dim, copies):
    rng = np.random.default_rng(3)
    x = np.zeros((n, dim))
    for i in range(n):
        held = np.unique(np.concatenate([rng.integers(0, 4, 3), rng.integers(0, dim, 12)]))
        x[i, held] = rng.uniform(0.1, 1.0, len(held))
    x[:copies] = x[0]
    x[-1] = 0
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def test_knn_tiles_of_sparse_rows_with_copies_match_brute_force(spark, monkeypatch):
    for name, value in {"TILE_ROWS": 16, "TILE_COLUMNS": 48, "PRODUCTS": 500}.items():
        monkeypatch.setattr(S, name, value)
    n, dim, k, thr = 240, 300, 3, 0.25
    x = _sparse(n, dim, 90)
    ids = [f"d{(i * 7) % n:03d}" for i in range(n)]
    import pyarrow as pa
    tab = pa.table({"news_id": ids, "idx": [np.flatnonzero(r).astype(np.int32) for r in x], "val": [r[r > 0] for r in x],
                    "side": pa.array([0] * n, pa.int32())})
    got = S._block_fn(dim, k, thr)((pa.scalar(0), pa.scalar(0)), tab).to_pylist()
    assert sorted((r["a"], r["b"], round(r["sim"], 9)) for r in got) == _lists(ids, x, k, thr)
    df = spark.createDataFrame([(ids[i], [int(j) for j in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] > 0]]) for i in range(n)],
                               "news_id string, idx array<int>, val array<double>")
    got = S.knn(df, dim, k, thr, block_bytes=4000)
    assert sorted((r["src"], r["dst"], round(r["weight"], 9)) for r in got.collect()) == _lists(ids, x, k, thr)


def test_knn_blocks_hold_entries_and_not_the_whole_vocabulary():
    """256,410 documents of 200 of 20,000 terms: blocks of dense rows within the old budget held 838 rows, 306 copies of each."""
    assert S.knn_blocks(256_410, 256_410 * 200, 12, 48 * 1024 * 1024) <= 16
    assert S.knn_blocks(10_000, 2_000_000, 12, 48 * 1024 * 1024) <= 9
    assert S.knn_blocks(1, 0, 12, 48 * 1024 * 1024) == 1


def test_knn_row_without_a_vector_has_no_neighbours(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", None)], "news_id string, embedding array<double>")
    got = {(r["src"], r["dst"]) for r in S.knn(S.dense_rows(df), 2, 5, 0.25).collect()}
    assert got == {("a", "b"), ("b", "a")}
