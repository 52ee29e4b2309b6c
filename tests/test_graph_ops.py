import math

from pyspark.sql import functions as F

from spreadlens.operators import cascades as C
from spreadlens.operators import communities as CM
from spreadlens.operators import graph as G
from spreadlens.operators import links as L


def _edges(spark, pairs, graph="g"):
    return spark.createDataFrame([(graph, a, b) for a, b in pairs], "graph string, src long, dst long")


def _nodes(spark, ids, graph="g"):
    return spark.createDataFrame([(graph, i) for i in ids], "graph string, node_id long")


def test_dup_pair_reply_wins(spark):
    inter = spark.createDataFrame(
        [(1, 2, "retweet", 10, "a", None), (1, 2, "reply", 11, "a", None)],
        "src long, dst long, kind string, tweet_id long, article_id string, ts timestamp")
    e = G.interaction_edges(inter).collect()
    assert len(e) == 1 and e[0]["interaction_type"] == "reply" and e[0]["n_interactions"] == 2


def test_pagerank_dangling_sums_to_one(spark):
    pr = L.pagerank(spark, _nodes(spark, [1, 2, 3]), _edges(spark, [(1, 2), (3, 2)]))
    total = sum(r["pagerank"] for r in pr.collect())
    assert abs(total - 1.0) < 1e-9


def test_hits_star(spark):
    h = {r["node_id"]: r for r in L.hits(spark, _nodes(spark, [1, 2, 3, 4]),
                                          _edges(spark, [(2, 1), (3, 1), (4, 1)])).collect()}
    assert max(h, key=lambda n: h[n]["authority"]) == 1
    assert abs(h[2]["hub"] - h[3]["hub"]) < 1e-12 and abs(h[3]["hub"] - h[4]["hub"]) < 1e-12


def test_two_triangles_modularity_and_isolate(spark):
    pairs = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]
    nodes = _nodes(spark, [1, 2, 3, 4, 5, 6, 9])
    und = CM.undirected(_edges(spark, pairs))
    part = CM.louvain(spark, nodes, und)
    comm = {r["node_id"]: r["community_id"] for r in part.collect()}
    assert comm[1] == comm[2] == comm[3] and comm[4] == comm[5] == comm[6] and comm[1] != comm[4]
    assert comm[9] == 9  # isolate -> singleton community
    q = CM.modularity(nodes, und, part).collect()[0]["modularity"]
    assert abs(q - 5 / 14) < 1e-9
    stats = {r["community_id"]: r for r in CM.community_stats(nodes, und, part).collect()}
    assert stats[9]["density"] == 0.0 and stats[9]["avg_degree"] == 0.0


def test_self_loop_and_components(spark):
    und = CM.undirected(_edges(spark, [(5, 5), (1, 2)]))
    cc = {r["node_id"]: r["component"] for r in
          CM.connected_components(spark, _nodes(spark, [1, 2, 5, 7]), und).collect()}
    assert cc == {1: 1, 2: 1, 5: 5, 7: 7}


def test_icm_chain(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    seeds = spark.createDataFrame([("a", 1)], "article_id string, node_id long")
    act = C.icm_activation(spark, edges, seeds, p=1.0)
    arts = spark.createDataFrame([("a", 0)], "news_id string, label int")
    m = C.cascade_metrics(act, arts).collect()[0]
    assert (m["cascade_size"], m["cascade_depth"], m["max_width"], m["time_to_max_width"]) == (4, 3, 1, 0)
    assert math.isclose(m["avg_spread_rate"], 4 / 3)


def test_lt_half(spark):
    edges = spark.createDataFrame([(1, 3), (2, 3)], "src long, dst long")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node_id long")
    seeds = spark.createDataFrame([("a", 1)], "article_id string, node_id long")
    act = {r["node_id"]: r["step"] for r in C.lt_activation(spark, edges, nodes, seeds).collect()}
    # influence on 3 is 1/2 >= every uniform threshold in [0.1, 0.5]
    assert act == {1: 0, 3: 1}


def test_no_seed_article_omitted(spark):
    tw = spark.createDataFrame([("a", 99), ("b", 1)], "article_id string, user_id long")
    nodes = spark.createDataFrame([(1,), (2,)], "node_id long")
    seeds = C.diffusion_seeds(tw, nodes)
    assert [r["article_id"] for r in seeds.collect()] == ["b"]
