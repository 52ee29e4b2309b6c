from spreadlens.operators import similarity as S


def test_pca_line(spark):
    pts = [(f"p{i}", [float(i), 2.0 * i, 1.0]) for i in range(10)]
    df = spark.createDataFrame(pts, "news_id string, embedding array<double>")
    out = {r["news_id"]: r for r in S.pca_2d(df).collect()}
    assert all(abs(r["pc2"]) < 1e-9 for r in out.values())
    # centred, and the first component follows the line with a positive largest loading
    assert abs(sum(r["pc1"] for r in out.values())) < 1e-9
    assert out["p9"]["pc1"] > out["p0"]["pc1"]


def exact(x, k):
    import numpy as np
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    load = vt[:k].T
    load = load * np.where(load[np.argmax(np.abs(load), axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return c @ load, s[:k] ** 2 / (len(x) - 1)


def test_pca_sparse_small(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    x = np.where(rng.random((60, 40)) < 0.2, rng.random((60, 40)), 0.0)
    x[:, 3] += 2 * (np.arange(60) % 2)
    x[7] = 0.0  # without a term
    vec = spark.createDataFrame([(str(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "news_id string, term_idx int, weight double")
    ids = spark.createDataFrame([(str(i),) for i in range(60)], "news_id string")
    got = {r["news_id"]: r for r in S.pca_sparse(ids, vec, 40, 3).collect()}
    want, variances = exact(x, 3)
    assert len(got) == 60
    for i in range(60):
        assert np.allclose([got[str(i)][f"pc{j}"] for j in (1, 2, 3)], want[i], atol=1e-6)
    # rows without a term count for the mean, so they are part of the rows here
    rows = ids.join(S.sparse_rows(vec), "news_id", "left").selectExpr(
        "news_id", "coalesce(idx, cast(array() as array<int>)) idx", "coalesce(val, cast(array() as array<double>)) val")
    assert np.allclose(S.sparse_components(rows, 40, 3)[1], variances, atol=1e-9)


def test_pca_sparse_nothing(spark):
    vec = spark.createDataFrame([], "news_id string, term_idx int, weight double")
    none = spark.createDataFrame([], "news_id string")
    assert S.pca_sparse(none, vec, 10).collect() == []
    one = spark.createDataFrame([("a",), ("b",)], "news_id string")
    assert [(r["pc1"], r["pc2"]) for r in S.pca_sparse(one, vec, 10).collect()] == [(0.0, 0.0)] * 2


def test_pca_of_the_articles(spark):
    import numpy as np

    import __spark_entry__ as E
    from spreadlens.plans import q_text as Q
    d = "/root/testdata/sf0.001"
    got = E.queries()["pca_2d_tfidf"](spark, d).toPandas().set_index("news_id")
    vec, _ = Q.tfidf_df(spark, d)
    pdf = vec.select("news_id", "term_idx", "weight").toPandas()
    row = {a: i for i, a in enumerate(got.index)}
    x = np.zeros((len(row), Q.MAX_FEATURES))
    x[pdf["news_id"].map(row), pdf["term_idx"]] = pdf["weight"]
    want, _ = exact(x, 2)
    assert np.abs(got[["pc1", "pc2"]].to_numpy() - want).max() < 1e-6
