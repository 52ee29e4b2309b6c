"""Graph construction and validation as node/edge DataFrames.

Graphs are two tables: ``nodes(node_id, ...)`` and ``edges(src, dst, ...)``.
Undirected graphs keep one row per pair with ``src <= dst``; directed simple
graphs keep one row per ordered pair.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_ids

# --- fixed values -----------------------------------------------------------
ARTICLE_PREFIX = "A_"
TWEET_PREFIX = "T_"
# Interaction kinds by precedence when one (src, dst) pair has several: the
# reference adds retweets, then replies, then mentions, later ones overwriting.
INTERACTION_PRIORITY = {"retweet": 1, "reply": 2, "mention": 3}
# ---------------------------------------------------------------------------


def article_tweet_pairs(raw: DataFrame) -> DataFrame:
    """(news_id, tweet_id) for every id in every raw list (duplicates kept)."""
    return raw.select(F.col("id").alias("news_id"),
                      F.explode(parse_ids(F.col("tweet_ids"))).alias("tweet_id"))


def bipartite_graph(metrics: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Article <-> tweet association graph: (nodes, edges)."""
    arts = metrics.select("news_id").distinct()
    pairs = article_tweet_pairs(raw).join(arts, "news_id", "left_semi").distinct()
    edges = pairs.select(F.concat(F.lit(ARTICLE_PREFIX), "news_id").alias("src"),
                         F.concat(F.lit(TWEET_PREFIX), "tweet_id").alias("dst"))
    art_nodes = (metrics.groupBy("news_id")
                 .agg(F.max(F.struct("label", "source", "tweet_count")).alias("m"))
                 .select(F.concat(F.lit(ARTICLE_PREFIX), "news_id").alias("node_id"),
                         F.lit("article").alias("bipartite"), "news_id",
                         F.col("m.label").alias("label"), F.col("m.source").alias("source"),
                         F.col("m.tweet_count").alias("tweet_count"), F.lit(None).cast("string").alias("tweet_id")))
    tweet_nodes = (pairs.select("tweet_id").distinct()
                   .select(F.concat(F.lit(TWEET_PREFIX), "tweet_id").alias("node_id"),
                           F.lit("tweet").alias("bipartite"), F.lit(None).cast("string").alias("news_id"),
                           F.lit(None).cast("int").alias("label"), F.lit(None).cast("string").alias("source"),
                           F.lit(None).cast("bigint").alias("tweet_count"), "tweet_id"))
    return art_nodes.unionByName(tweet_nodes), edges


def undirected_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree) over an undirected edge list; a self-loop counts 2."""
    ends = edges.select(F.col("src").alias("node_id")).unionAll(edges.select(F.col("dst").alias("node_id")))
    deg = ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    return (nodes.select("node_id").join(deg, "node_id", "left")
            .select("node_id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree")))


def interaction_edges(interactions: DataFrame) -> DataFrame:
    """Directed simple graph: one edge per (src, dst); the surviving attributes come
    from the highest-precedence kind, then the latest (ts, tweet_id).  The
    aggregate combines map-side, so a hub pair never lands whole in one task."""
    prio = F.lit(0)
    for kind, p in INTERACTION_PRIORITY.items():
        prio = F.when(F.col("kind") == kind, F.lit(p)).otherwise(prio)
    win = F.struct(prio.alias("p"), F.col("ts"), F.col("tweet_id"))
    return (interactions.groupBy("src", "dst")
            .agg(F.max_by(F.struct(F.col("kind").alias("interaction_type"), "tweet_id", "ts"), win).alias("w"),
                 F.count(F.lit(1)).alias("n_interactions"))
            .select("src", "dst", F.col("w.interaction_type").alias("interaction_type"),
                    F.col("w.tweet_id").alias("tweet_id"), F.col("w.ts").alias("ts"),
                    F.col("n_interactions").cast("bigint").alias("n_interactions")))


def interaction_nodes(user_map: DataFrame, edges: DataFrame) -> DataFrame:
    """Users from the user map plus every edge end."""
    users = (user_map.select(F.col("user_id").alias("node_id"))
             .unionAll(edges.select(F.col("src").alias("node_id")))
             .unionAll(edges.select(F.col("dst").alias("node_id"))).distinct())
    return users.withColumn("node_type", F.lit("user"))


def label_users(user_map: DataFrame, articles: DataFrame) -> DataFrame:
    """(label_name, user_id): users who engaged with fake / real articles (may overlap)."""
    lab = articles.where(F.col("label").isin(0, 1)).select(
        F.col("news_id").alias("article_id"),
        F.when(F.col("label") == 0, F.lit("fake")).otherwise(F.lit("real")).alias("label_name"))
    return user_map.join(lab, "article_id").select("label_name", "user_id").distinct()


def induced_subgraph(edges: DataFrame, nodes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Edges whose two ends are both in ``nodes(node_id[, key...])`` (double semi join)."""
    key = key or []
    n = nodes.select(*key, "node_id")
    left = edges.join(n.withColumnRenamed("node_id", "src"), key + ["src"], "left_semi") if key else \
        edges.join(n.withColumnRenamed("node_id", "src"), ["src"], "left_semi")
    return left.join(n.withColumnRenamed("node_id", "dst"), key + ["dst"], "left_semi")


def label_subgraph(edges: DataFrame, label_user_df: DataFrame) -> DataFrame:
    """Fake and real induced interaction subgraphs in one table, keyed by label_name."""
    keyed = label_user_df.select("label_name", F.col("user_id").alias("node_id"))
    lab_edges = (edges.join(keyed.withColumnRenamed("node_id", "src"), "src")
                 .join(keyed.withColumnRenamed("node_id", "dst"), ["label_name", "dst"], "left_semi"))
    return lab_edges


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") == F.col("dst"))


def bad_weights(edges: DataFrame, weight: str = "weight") -> DataFrame:
    w = F.coalesce(F.col(weight), F.lit(1.0)) if weight in edges.columns else F.lit(1.0)
    return edges.where((w < 0.0) | (w > 1.0) | w.isNull())


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node_id")).unionAll(edges.select(F.col("dst").alias("node_id")))
    return nodes.join(ends, "node_id", "left_anti")


def degree_mismatch(metrics: DataFrame, bip_edges: DataFrame) -> DataFrame:
    """Articles whose tweet_count differs from their bipartite degree (distinct tweets)."""
    deg = (bip_edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
           .select(F.expr(f"substring(src, {len(ARTICLE_PREFIX) + 1})").alias("news_id"), "degree"))
    return (metrics.select("news_id", "tweet_count").join(deg, "news_id", "left")
            .select("news_id", "tweet_count", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))
            .where(F.col("tweet_count") != F.col("degree")))


def tweet_dupes(raw: DataFrame) -> DataFrame:
    """Articles whose own id list repeats an id: (id, n_ids, n_distinct)."""
    lst = raw.select("id", parse_ids(F.col("tweet_ids")).alias("l"))
    return (lst.where(F.size("l") != F.size(F.array_distinct("l")))
            .select("id", F.size("l").cast("bigint").alias("n_ids"),
                    F.size(F.array_distinct("l")).cast("bigint").alias("n_distinct")))


def tweet_dupe_samples(raw: DataFrame, n_articles: int = 5, n_ids: int = 10) -> DataFrame:
    """Up to ``n_ids`` repeated ids (smallest first) for the first ``n_articles``
    articles (by id) that repeat an id.  Counting happens per (article, id)
    after a map-side combine; only the repeated pairs reach the window."""
    rep = (article_tweet_pairs(raw).groupBy("news_id", "tweet_id").agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("n") > 1))
    first_articles = rep.select("news_id").distinct().orderBy("news_id").limit(n_articles)
    from pyspark.sql import Window
    w = Window.partitionBy("news_id").orderBy("tweet_id")
    return (rep.join(first_articles, "news_id", "left_semi")
            .withColumn("k", F.row_number().over(w)).where(F.col("k") <= n_ids)
            .select(F.col("news_id").alias("id"), "tweet_id", F.col("n").cast("bigint").alias("n_repeats")))


def tweet_dupes_global(raw: DataFrame) -> DataFrame:
    """Tweet ids that appear in more than one distinct article."""
    pairs = article_tweet_pairs(raw).distinct()
    return (pairs.groupBy("tweet_id").agg(F.count(F.lit(1)).alias("n_articles"))
            .where(F.col("n_articles") > 1))


def validation_report(news: DataFrame, metrics: DataFrame, raw: DataFrame, bip_nodes: DataFrame, bip_edges: DataFrame,
                      sim_nodes: DataFrame, sim_edges: DataFrame) -> DataFrame:
    """(check, n): every data check in one table, a row for each check even if nothing fails it.

    ``bip_nodes`` has node_id and bipartite, ``sim_nodes`` node_id, ``sim_edges``
    src, dst and weight (missing means 1).  Each check is an aggregate that
    combines on the map side.
    """
    rows = lambda df, name: df.agg(F.count(F.lit(1)).cast("bigint").alias("n")).select(F.lit(name).alias("check"), "n")
    one_count = metrics.groupBy("news_id").agg(F.max("tweet_count").alias("tweet_count"))
    alone = lambda side: isolates(bip_nodes.where(F.col("bipartite") == side).select("node_id"), bip_edges)
    repeats = (news.groupBy("news_id").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("bigint").alias("n"))
               .select(F.lit("news_id_duplicates").alias("check"), "n"))
    parts = [rows(tweet_dupes(raw), "per_article_tweet_dupes"), rows(tweet_dupes_global(raw), "global_tweet_dupes"),
             rows(alone("article"), "bipartite_articles_isolates"), rows(alone("tweet"), "bipartite_tweets_isolates"),
             rows(bip_edges, "bipartite_edges"), rows(degree_mismatch(one_count, bip_edges), "bipartite_degree_mismatch"),
             rows(isolates(sim_nodes, sim_edges), "similarity_isolates"), rows(sim_edges, "similarity_edges"),
             rows(self_loops(sim_edges), "similarity_selfloops"), rows(bad_weights(sim_edges), "similarity_bad_weights")]
    for part in parts:
        repeats = repeats.unionByName(part)
    return repeats
