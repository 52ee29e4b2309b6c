"""Adapter from the shared parquet tables to the data model of the analytics.

The analytics work on articles, the tweets that shared them, the raw per-article
tweet-id lists, user interactions, and article vectors.  The shared tables
provide ``documents``, ``labels``, ``events`` and ``embeddings``; the views below
derive the data model from them (same meaning as the SQL in
``spreadlens.plans.sqlviews``):

* ``articles(news_id, text, source, label)``  documents left-join labels,
  label = quality (0 fake, 1 real, null unknown); the whole document text.
* ``tweets(tweet_id, user_id, article_id, kind, ts)``  one per event;
  ``article_id = (props.k * user_id) mod n_documents``; signup/purchase -> post,
  click -> retweet, view -> reply, error -> mention.
* ``raw_articles(id, tweet_ids)``  the messy id string per article: ids in
  ``tweet_id`` order, each id after the first preceded by the separator chosen
  by ``tweet_id mod 5`` from (tab, comma, semicolon, pipe, space); "" when the
  article has no tweet.
* ``interactions(src, dst, kind, tweet_id, article_id, ts)``  every non-post
  tweet points at the user of the latest earlier post of the same article by
  (ts, tweet_id); dropped when there is none or when it is the same user.
* ``vectors(news_id, embedding)``  dense vectors keyed by id.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import read_table, spread

# --- fixed values -----------------------------------------------------------
KIND_BY_EVENT = {"signup": "post", "purchase": "post", "click": "retweet",
                 "view": "reply", "error": "mention"}
RAW_SEPARATORS = ("\t", ",", ";", "|", " ")
# ---------------------------------------------------------------------------


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return (docs.join(labels, "doc_id", "left")
            .select(F.col("doc_id").cast("string").alias("news_id"),
                    F.col("text"),
                    F.col("source"),
                    F.col("label").cast("int").alias("label")))


def _kind(col):
    expr = None
    for event, kind in KIND_BY_EVENT.items():
        expr = (F.when(col == event, F.lit(kind)) if expr is None
                else expr.when(col == event, F.lit(kind)))
    return expr


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    n_docs = read_table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        F.col("event_id").alias("tweet_id"),
        F.col("user_id"),
        F.pmod(k * F.col("user_id"), n_docs).cast("string").alias("article_id"),
        _kind(F.col("event_type")).alias("kind"),
        F.col("ts"),
    )


def raw_articles(spark: SparkSession, sf_dir: str, tweets_df: DataFrame | None = None,
                 articles_df: DataFrame | None = None) -> DataFrame:
    tw = tweets_df if tweets_df is not None else tweets(spark, sf_dir)
    arts = articles_df if articles_df is not None else articles(spark, sf_dir)
    seps = F.array(*[F.lit(s) for s in RAW_SEPARATORS])
    token = F.concat(F.element_at(seps, (F.pmod(F.col("tweet_id"), 5) + 1).cast("int")),
                     F.col("tweet_id").cast("string"))
    # One string per article is the raw data model itself (a CSV field); the
    # sort inside the group is over that article's ids only.
    joined = (tw.groupBy("article_id")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tweet_id", token.alias("tok")))),
                                            lambda s: s["tok"]), "").alias("joined")))
    raw = joined.select(F.col("article_id").alias("id"), F.expr("substring(joined, 2)").alias("tweet_ids"))
    return (arts.select(F.col("news_id").alias("id")).join(raw, "id", "left")
            .select("id", F.coalesce("tweet_ids", F.lit("")).alias("tweet_ids")))


def interactions(spark: SparkSession, sf_dir: str, tweets_df: DataFrame | None = None,
                 bucket: str = "1 hour") -> DataFrame:
    """As-of join "latest earlier post of the same article", split by time bucket.

    A plain window over each article would put a hot article into one task, so
    the search runs in two levels: the last post of each (article, bucket) is
    carried forward over the (small) per-bucket table, and the exact search runs
    inside (article, bucket) partitions only.
    """
    tw = tweets_df if tweets_df is not None else tweets(spark, sf_dir)
    is_post = F.col("kind") == "post"
    tb = tw.withColumn("bucket", F.window("ts", bucket).start)
    per_bucket = (tb.groupBy("article_id", "bucket")
                  .agg(F.max_by(F.when(is_post, F.col("user_id")),
                                F.when(is_post, F.struct("ts", "tweet_id"))).alias("bucket_last_post")))
    w_buckets = (Window.partitionBy("article_id").orderBy("bucket")
                 .rowsBetween(Window.unboundedPreceding, -1))
    carry = per_bucket.select("article_id", "bucket",
                              F.last("bucket_last_post", ignorenulls=True).over(w_buckets).alias("carry_in"))
    w_in = (Window.partitionBy("article_id", "bucket").orderBy("ts", "tweet_id")
            .rowsBetween(Window.unboundedPreceding, -1))
    dst_in_bucket = F.last(F.when(is_post, F.col("user_id")), ignorenulls=True).over(w_in)
    out = (tb.join(carry, ["article_id", "bucket"])
           .select(F.col("user_id").alias("src"),
                   F.coalesce(dst_in_bucket, F.col("carry_in")).alias("dst"),
                   "kind", "tweet_id", "article_id", "ts"))
    return out.where((F.col("kind") != "post") & F.col("dst").isNotNull() & (F.col("dst") != F.col("src")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").cast("string").alias("news_id"), F.col("embedding"))
