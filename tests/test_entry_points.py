"""The entry points that write whole sets of tables, and the cascade fallback."""
import os

from spreadlens.operators import cascades as C
from spreadlens.plans import pipeline as P
from spreadlens.sources import files as FS

NEWS = [("1", "Breaking news at http://a.b", 0, "x"), ("2", "The cat sat", 1, "x"), ("3", "Dogs run", 1, "y"), ("3", "Dogs run", 1, "y")]
RAW = [("1", "10,10,11"), ("2", "11;12"), ("3", "")]


def tables(spark):
    return (spark.createDataFrame(NEWS, "news_id string, text string, label int, source string"),
            spark.createDataFrame(RAW, "id string, tweet_ids string"))


def test_profile_writes_every_table(spark, tmp_path):
    news, raw = tables(spark)
    P.profile(spark, news, raw, str(tmp_path), bins=4, top_k=2)
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}").collect()
    assert len([f for f in os.listdir(tmp_path)]) == 17
    assert read("tweet_count_describe")[0]["p50"] == 1.0 and read("duplicate_ids")[0]["n_duplicates"] == 1
    assert {r["label"]: (r["count"], r["max"]) for r in read("tweet_count_by_label")} == {0: (1, 3.0), 1: (3, 2.0)}
    assert [r["news_id"] for r in sorted(read("top_articles"), key=lambda r: r["rank"])] == ["1", "2"]
    assert sum(r["n_http"] for r in read("text_patterns")) == 1 and read("missing_values") == []


def test_validate_reports_planted_faults(spark, tmp_path):
    news, raw = tables(spark)
    nodes = spark.createDataFrame([("1",), ("2",), ("3",)], "node_id string")
    edges = spark.createDataFrame([("1", "1", 0.5), ("1", "2", 1.5)], "src string, dst string, weight double")
    got = {r["check"]: r["n"] for r in P.validate(spark, news, raw, nodes, edges, str(tmp_path)).collect()}
    assert got["news_id_duplicates"] == 1 and got["per_article_tweet_dupes"] == 1 and got["global_tweet_dupes"] == 1
    assert got["similarity_isolates"] == 1 and got["similarity_selfloops"] == 1 and got["similarity_bad_weights"] == 1
    assert got["bipartite_degree_mismatch"] == 1
    assert [(r["id"], r["tweet_id"]) for r in spark.read.parquet(f"{tmp_path}/tweet_dupe_samples").collect()] == [("1", "10")]


def test_prepare_graphs_and_links(spark, tmp_path):
    news, raw = tables(spark)
    P.prepare(spark, news, f"{tmp_path}/a")
    clean = spark.read.parquet(f"{tmp_path}/a/news_clean")
    tweets = spark.createDataFrame([(10, 1, "1", "post", None), (11, 2, "1", "retweet", None), (12, 3, "2", "post", None)],
                                   "tweet_id bigint, user_id bigint, article_id string, kind string, ts timestamp")
    inter = spark.createDataFrame([(2, 1, "retweet", 11, "1", None)], "src bigint, dst bigint, kind string, tweet_id bigint, article_id string, ts timestamp")
    P.graphs(spark, clean, raw, tweets, inter, f"{tmp_path}/b", max_features=50)
    edges = spark.read.parquet(f"{tmp_path}/b/cascade_edges").collect()
    assert sorted((r["src"], r["dst"]) for r in edges) == [("2", "1"), ("A_1", "1"), ("A_1", "2"), ("A_2", "3")]
    nodes = spark.createDataFrame([("g", i) for i in (1, 2, 3)], "graph string, node_id bigint")
    ring = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 1)], "graph string, src bigint, dst bigint")
    P.links(spark, nodes, ring, f"{tmp_path}/c")
    assert all(abs(r["pagerank"] - 1 / 3) < 1e-6 for r in spark.read.parquet(f"{tmp_path}/c/link_scores").collect())


def test_association_only_for_articles_without_users(spark):
    _, raw = tables(spark)
    users = spark.createDataFrame([(10, 1, "1", None)], "tweet_id bigint, user_id bigint, article_id string, ts timestamp")
    none = spark.createDataFrame([], "src bigint, dst bigint, kind string, tweet_id bigint, article_id string, ts timestamp")
    got = sorted((r["src"], r["dst"], r["edge_type"]) for r in C.cascades_or_association(raw, users, none).collect())
    assert got == [("A_1", "1", "posts"), ("A_2", "T_11", "association"), ("A_2", "T_12", "association")]


def test_json_interactions_hold_both_kinds_of_files(spark, tmp_path):
    os.mkdir(f"{tmp_path}/t"), os.mkdir(f"{tmp_path}/r")
    with open(f"{tmp_path}/t/1.json", "w") as f:
        f.write('{"id_str": "5", "user": {"id_str": "1"}, "in_reply_to_user_id_str": "2"}')
    with open(f"{tmp_path}/r/1.json", "w") as f:
        f.write('[{"user": {"id_str": "3"}, "retweeted_status": {"id_str": "5", "user": {"id_str": "1"}}}, {"user": {}}]')
    both = FS.json_interactions(FS.read_tweets(spark, f"{tmp_path}/t", multi_line=False), FS.read_retweets(spark, f"{tmp_path}/r"))
    assert sorted((r["src"], r["dst"], r["kind"]) for r in both.collect()) == [("1", "2", "reply"), ("3", "1", "retweet")]
