"""Observed cascades, the validation report and retweet arrays on small made tables."""
import json

from spreadlens.operators import cascades as C
from spreadlens.operators import graph as G
from spreadlens.operators import metrics as M
from spreadlens.sources import files as FS

TWEETS = "tweet_id bigint, user_id bigint, article_id string, kind string, ts timestamp"
LINKS = "src bigint, dst bigint, kind string, tweet_id bigint, article_id string"


def test_observed_levels_follow_chains_and_end_in_cycles(spark):
    tweets = spark.createDataFrame([(1, 1, "a", "post", None), (2, 9, "b", "post", None)], TWEETS)
    links = spark.createDataFrame(
        [(2, 1, "retweet", 3, "a"), (3, 2, "reply", 4, "a"), (2, 3, "reply", 5, "a"), (4, 3, "retweet", 6, "a"),
         (1, 4, "reply", 7, "a"), (5, 1, "mention", 8, "a"), (7, 8, "retweet", 9, "a"), (9, 9, "reply", 10, "b")], LINKS)
    levels = C.observed_levels(tweets, links)
    assert sorted(map(tuple, levels.collect())) == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3), ("b", 9, 0)]
    articles = spark.createDataFrame([("a", 0)], "news_id string, label int")
    rows = {r["article_id"]: r for r in C.observed_metrics(levels, tweets, articles).collect()}
    assert (rows["a"]["label"], rows["a"]["cascade_size"], rows["a"]["cascade_depth"], rows["a"]["max_width"]) == ("fake", 4, 3, 1)
    assert rows["b"]["label"] == "unknown" and rows["b"]["has_timestamps"] is False
    assert C.observed_levels(tweets.limit(0), links).count() == 0


def test_validation_report_counts_every_fault(spark):
    news = spark.createDataFrame([("1", "x", 0, "s"), ("2", "y", 1, "s"), ("2", "y", 1, "s"), ("3", "z", 1, "s")],
                                 "news_id string, text string, label int, source string")
    raw = spark.createDataFrame([("1", "10,10,11"), ("2", "11;12"), ("3", "")], "id string, tweet_ids string")
    metrics = M.article_metrics(news, raw)
    nodes = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "node_id string")
    edges = spark.createDataFrame([("1", "2", None), ("2", "2", 1.0), ("1", "3", 1.5)], "src string, dst string, weight double")
    report = G.validation_report(news, metrics, raw, *G.bipartite_graph(metrics, raw), nodes, edges)
    assert {r["check"]: r["n"] for r in report.collect()} == {
        "news_id_duplicates": 1, "per_article_tweet_dupes": 1, "global_tweet_dupes": 1, "bipartite_articles_isolates": 1,
        "bipartite_tweets_isolates": 0, "bipartite_edges": 4, "bipartite_degree_mismatch": 1, "similarity_isolates": 1,
        "similarity_edges": 3, "similarity_selfloops": 1, "similarity_bad_weights": 1}


def test_retweet_arrays_and_path_fields(spark, tmp_path):
    folder = tmp_path / "siteA" / "fake" / "n1" / "retweets"
    folder.mkdir(parents=True)
    time = "Wed Oct 10 20:19:24 +0000 2018"
    (folder / "1.json").write_text(json.dumps([
        {"user": {"id": 5}, "created_at": time, "retweeted_status": {"id": 77, "user": {"id_str": "6"}}},
        {"user": {"id_str": "8"}, "created_at": time},
        {"user": {}, "retweeted_status": {"id": 1, "user": {"id_str": "6"}}}], indent=1))
    (folder / "2.json").write_text(json.dumps({"user": {"id": 5}, "retweeted_status": {"user": {"id": 6}}}))
    (folder / "3.json").write_text("[{broken")
    (folder / "4.json").write_text("[]")
    rows = FS.path_fields(FS.read_retweets(spark, str(tmp_path))).collect()
    assert [(r["retweeter_id"], r["original_user_id"], r["tweet_id"], r["domain"], r["label_name"], r["article_id"]) for r in rows] == \
        [("5", "6", "77", "siteA", "fake", "n1")]
    assert rows[0]["created_at"].isoformat() == "2018-10-10T20:19:24"
