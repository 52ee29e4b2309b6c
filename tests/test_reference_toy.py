"""The reference's end-to-end toy: two articles, one raw list, 2x2 identity vectors."""
from pyspark.sql import functions as F

from spreadlens.operators import graph as G
from spreadlens.operators import metrics as M
from spreadlens.operators import similarity as S


def test_toy(spark):
    news = spark.createDataFrame([("1", "a", "a", 0, "site_a"), ("2", "b", "b", 1, "site_a")],
                                 "news_id string, text string, clean_text string, label int, source string")
    raw = spark.createDataFrame([("1", "", "t1", "111\t222 333"), ("2", "", "t2", "")],
                                "id string, news_url string, title string, tweet_ids string")
    m = M.article_metrics(news, raw.select("id", "tweet_ids"))
    counts = {r["news_id"]: r["tweet_count"] for r in m.collect()}
    assert counts == {"1": 3, "2": 0}
    nodes, edges = G.bipartite_graph(m, raw.select("id", "tweet_ids"))
    assert edges.count() == 3
    vec = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 1.0])], "news_id string, embedding array<double>")
    knn = S.undirected(S.knn(S.dense_rows(vec), 2, k=10, threshold=0.01))
    assert vec.count() == 2          # two similarity nodes
    assert knn.count() == 0          # orthogonal vectors: similarity 0 < threshold
