"""Cases that failed before: long chains, large ties, rankings by graph, convergence, JSON ids."""
import json

import pytest
from pyspark.sql import functions as F

from spreadlens.operators import cascades as C
from spreadlens.operators import communities as CM
from spreadlens.operators import links as L
from spreadlens.operators import metrics as M
from spreadlens.operators.components import contract
from spreadlens.sources import files as S


def _graph(spark, pairs, name="g"):
    edges = spark.createDataFrame([(name, a, b) for a, b in pairs], "graph string, src long, dst long")
    nodes = edges.select("graph", F.col("src").alias("node_id")).union(edges.select("graph", "dst")).distinct()
    return nodes, edges


def test_components_of_a_long_chain_and_a_star(spark):
    chain = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    star = spark.range(5001, 9000).select(F.col("id").alias("src"), F.lit(5000).cast("long").alias("dst"))
    got = contract(chain.union(star).repartition(4)).groupBy("component").count().collect()
    assert sorted((r["component"], r["count"]) for r in got) == [(0, 3001), (5000, 4000)]


def test_components_of_random_graphs(spark):
    import random
    rng = random.Random(3)
    for n, m in ((40, 25), (60, 60), (5, 0)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        root = list(range(n))
        for _ in range(n):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        got = contract(spark.createDataFrame(pairs, "src long, dst long")).collect()
        assert {r["node"]: r["component"] for r in got} == {x: root[x] for p in pairs for x in p if p[0] != p[1]}


def test_mann_whitney_with_millions_of_ties(spark):
    df = spark.range(2_300_000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") < 100, F.col("id")).otherwise(F.lit(1000)).alias("v"))
    r = M.mann_whitney(df, "v", "g", 0, 1).first()
    assert r["n1"] == r["n2"] == 1_150_000 and 0 <= r["p_value"] <= 1


def test_top_k_ranks_each_graph(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.8), ("a", 3, 0.7), ("b", 1, 0.1), ("b", 2, 0.2)], "graph string, node_id long, s double")
    got = sorted((r["graph"], r["rank"], r["node_id"]) for r in M.top_k(df, "s", 2, "node_id", by="graph").collect())
    assert got == [("a", 1, 1), ("a", 2, 2), ("b", 1, 2), ("b", 2, 1)]


def test_no_silent_stop(spark):
    nodes, edges = _graph(spark, [(1, 2), (2, 3), (3, 1), (1, 3)])
    with pytest.raises(RuntimeError, match="PageRank"):
        L.pagerank(spark, nodes, edges, max_iter=1)
    with pytest.raises(RuntimeError, match="HITS"):
        L.hits(spark, nodes, edges, max_iter=1)


def test_widest_step_beyond_a_thousand(spark):
    act = spark.createDataFrame([("a", i, 0) for i in range(2)] + [("a", 10 + i, 1500) for i in range(3)], "article_id string, node_id long, step int")
    m = C.cascade_metrics(act, spark.createDataFrame([("a", 0)], "news_id string, label int")).first()
    assert (m["max_width"], m["time_to_max_width"]) == (3, 1500)


def test_last_article_by_number(spark):
    raw = spark.createDataFrame([("9", "5"), ("10", "5")], "id string, tweet_ids string")
    metrics = spark.createDataFrame([("10", 1, "s"), ("10", 0, "t"), ("9", 1, "u")], "news_id string, label int, source string")
    r = C.user_tweet_map(raw, metrics).first()
    assert (r["article_id"], r["label"], r["source"]) == ("10", 0, "t")


def test_tweet_json_ids_and_self_edges(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": 7, "user": {"id": 1}, "in_reply_to_user_id": 1, "entities": {"user_mentions": [{"id": 2}]}}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"id_str": "8", "text": "no user"}))
    (tmp_path / "d.json").write_text(json.dumps({"id_str": "9", "user": {"id_str": "3"}, "retweeted_status": {"id_str": "7", "user": {"id": 1}}}))
    flat = S.read_tweets(spark, str(tmp_path))
    got = sorted((r["src"], r["dst"], r["kind"]) for r in S.tweet_interactions(flat).collect())
    assert got == [("1", "1", "reply"), ("1", "2", "mention"), ("3", "1", "retweet")]


def test_weighted_pagerank(spark):
    edges = spark.createDataFrame([("g", 1, 2, 3.0), ("g", 1, 3, 1.0), ("g", 2, 1, None), ("g", 3, 1, 0.0)],
                                  "graph string, src long, dst long, w double")
    nodes = edges.select("graph", F.col("src").alias("node_id")).distinct()
    got = {r["node_id"]: r["pagerank"] for r in L.pagerank(spark, nodes, edges, tol=1e-10, weight_col="w").collect()}
    x = {1: 1 / 3, 2: 1 / 3, 3: 1 / 3}
    for _ in range(300):  # node 3 has no outgoing weight: it is dangling
        x = {1: 0.05 + 0.85 * (x[2] + x[3] / 3), 2: 0.05 + 0.85 * (0.75 * x[1] + x[3] / 3), 3: 0.05 + 0.85 * (0.25 * x[1] + x[3] / 3)}
    assert all(abs(got[n] - x[n]) < 1e-6 for n in x)


def test_hits_without_normalising(spark):
    nodes, edges = _graph(spark, [(1, 3), (2, 3), (2, 4)])
    plain = {r["node_id"]: r for r in L.hits(spark, nodes, edges, normalized=False).collect()}
    unit = {r["node_id"]: r for r in L.hits(spark, nodes, edges).collect()}
    assert max(r["authority"] for r in plain.values()) == 1.0
    assert abs(plain[2]["hub"] - plain[3]["authority"] - plain[4]["authority"]) < 1e-12
    total = sum(r["authority"] for r in plain.values())
    assert all(abs(plain[n]["authority"] / total - unit[n]["authority"]) < 1e-9 for n in plain)


def test_dense_lookup_with_odd_vectors(spark):
    from spreadlens.operators import similarity as S2
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", [1.0, 1.0])], "news_id string, embedding array<float>")
    got = [(r["news_id"], round(r["similarity"], 6)) for r in S2.dense_similar_to(v, "a").collect()]
    assert got == [("b", 1.0), ("d", 0.707107), ("c", 0.0)]
    assert S2.dense_similar_to(v, "none").count() == 0


def test_lookup_shows_articles(spark):
    from spreadlens.operators import similarity as S2
    found = spark.createDataFrame([(1, "a"), (1, "gone")], "query_id long, news_id string")
    arts = spark.createDataFrame([("a", "x" * 201, "s", 0)], "news_id string, text string, source string, label int")
    got = {r["news_id"]: (r["label_name"], r["source"], r["snippet"]) for r in S2.with_articles(found, arts).collect()}
    assert got == {"a": ("fake", "s", "x" * 200 + "..."), "gone": (None, None, None)}


def test_row_index_stands_in_for_a_missing_id(spark, tmp_path):
    (tmp_path / "site_fake.csv").write_text('title\n"one\nline"\ntwo\nthree\n')
    got = sorted((r["news_id"], r["text"], r["label"]) for r in S.load_news(spark, str(tmp_path)).collect())
    assert got == [("0", "one\nline", 0), ("1", "two", 0), ("2", "three", 0)]
