"""Source queries: the adapter tables are written in the reference's file
layouts (article CSVs per source and label, raw id CSVs, tweet JSON) to the
staging folder, then read back through the file sources."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import label_name
from ..operators import graph as G
from ..session import staging_path
from ..sources import adapters as A
from ..sources import files as S
from .registry import query

def stage_articles(spark, d) -> str:
    path = staging_path(spark, "articles")
    arts = A.articles(spark, d)
    bucket = F.concat(F.col("source"), F.lit("_"),
                      F.when(F.col("label") == 0, "fake").when(F.col("label") == 1, "real").otherwise("unknown"))
    S.write_table(arts.select(F.col("news_id").alias("id"), F.lit("").alias("news_url"),
                              F.col("text").alias("title"), bucket.alias("bucket")),
                  path, fmt="csv", partition_by=["bucket"])
    return path


def stage_raw(spark, d) -> str:
    path = staging_path(spark, "raw")
    S.write_table(A.raw_articles(spark, d), path, fmt="csv")
    return path


def stage_tweet_json(spark, d) -> str:
    """Tweets as Twitter-shaped JSON lines, each with its article: as many files as tasks, whatever the number of articles."""
    path = staging_path(spark, "tweets_json")
    tw = A.tweets(spark, d)
    inter = A.interactions(spark, d, tweets_df=tw).select("tweet_id", "dst")
    t = tw.join(inter, "tweet_id", "left")
    uid = lambda c: F.struct(F.col(c).cast("string").alias("id_str"))
    doc = t.select(
        "article_id",
        F.col("tweet_id").cast("string").alias("id_str"),
        F.date_format(F.col("ts"), S.TWITTER_TIME_FORMAT).alias("created_at"),
        uid("user_id").alias("user"),
        F.when((F.col("kind") == "retweet") & F.col("dst").isNotNull(),
               F.struct(F.lit(None).cast("string").alias("id_str"), uid("dst").alias("user")))
        .alias("retweeted_status"),
        F.when(F.col("kind") == "reply", F.col("dst").cast("string")).alias("in_reply_to_user_id_str"),
        F.struct(F.when((F.col("kind") == "mention") & F.col("dst").isNotNull(), F.array(uid("dst")))
                 .otherwise(F.array().cast("array<struct<id_str:string>>")).alias("user_mentions"))
        .alias("entities"))
    doc.write.mode("overwrite").json(path)
    return path


@query("load_news", """
    SELECT news_id, CASE label WHEN 0 THEN 'fake' WHEN 1 THEN 'real' ELSE 'unknown' END AS label_name, source, text
    FROM articles""")
def q_load_news(spark, d):
    news = S.load_news(spark, stage_articles(spark, d))
    return news.select("news_id", label_name(F.col("label")).alias("label_name"), "source", "text")


@query("raw_stack", "SELECT id, tweet_ids FROM raw_articles")
def q_raw_stack(spark, d):
    return S.raw_stack(spark, stage_raw(spark, d))


@query("file_catalog")
def q_file_catalog(spark, d):
    return S.file_catalog(spark, stage_articles(spark, d))


@query("tweet_json_flat", """
    SELECT CAST(t.tweet_id AS VARCHAR) AS tweet_id, CAST(t.user_id AS VARCHAR) AS user_id,
           strftime(t.ts, '%Y-%m-%d %H:%M:%S') AS created_at,
           (t.kind = 'retweet' AND i.dst IS NOT NULL) AS is_retweet,
           CASE WHEN t.kind = 'retweet' THEN CAST(i.dst AS VARCHAR) END AS original_user_id,
           CASE WHEN t.kind = 'reply' THEN CAST(i.dst AS VARCHAR) END AS in_reply_to_user_id,
           CAST(CASE WHEN t.kind = 'mention' AND i.dst IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS n_mentions
    FROM tweets t LEFT JOIN interactions i ON t.tweet_id = i.tweet_id""")
def q_tweet_json_flat(spark, d):
    flat = S.read_tweets(spark, stage_tweet_json(spark, d), multi_line=False)
    return flat.select("tweet_id", "user_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                       "is_retweet", "original_user_id", "in_reply_to_user_id",
                       F.size("mentioned_user_ids").cast("bigint").alias("n_mentions"))


@query("interaction_edges_json", """
    SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, interaction_type,
           CAST(tweet_id AS VARCHAR) AS tweet_id, n_interactions FROM (
        SELECT src, dst, kind AS interaction_type, tweet_id,
               count(*) OVER (PARTITION BY src, dst) AS n_interactions,
               row_number() OVER (PARTITION BY src, dst ORDER BY
                   CASE kind WHEN 'mention' THEN 3 WHEN 'reply' THEN 2 WHEN 'retweet' THEN 1 ELSE 0 END DESC,
                   date_trunc('second', ts) DESC, CAST(tweet_id AS VARCHAR) DESC) AS rn
        FROM interactions) x WHERE rn = 1""")
def q_interaction_edges_json(spark, d):
    flat = S.read_tweets(spark, stage_tweet_json(spark, d), multi_line=False)
    return G.interaction_edges(S.tweet_interactions(flat)).drop("ts")
