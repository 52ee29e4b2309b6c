"""Observed cascades, the one-call validation report over deliberately messy tables, and small profile queries.

The messy tables are the adapter tables with faults that every check must find:
ids listed twice, ids shared by two articles, repeated articles, self loops,
missing weights and weights above 1.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import label_name, snippet
from ..operators import cascades as C
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import similarity as S
from ..session import cut_lineage, read_table, staging_path
from ..sources import adapters as A
from ..sources import files as FS
from .q_cascades import _compare_sql
from .q_graph import LABEL_NAME_SQL
from .q_profile import box_sql, hist_sql, metrics_df
from .q_sources import stage_articles, stage_tweet_json
from .q_text import dense_knn_df
from .registry import query, sql_view

REPEAT_ID, SHARE_ID, REPEAT_NEWS, LOOP, NO_WEIGHT, LARGE_WEIGHT = 7, 11, 13, 17, 3, 5


# ------------------------------------------------------------------------ observed cascades

def observed(spark, d):
    tw = A.tweets(spark, d)
    levels = C.observed_levels(tw, A.interactions(spark, d, tweets_df=tw))
    return C.observed_metrics(levels, tw, A.articles(spark, d))


# only users who posted are targets of an interaction, so nobody stands below level 1 and the recursion ends
sql_view("obs_links", """
    SELECT DISTINCT i.article_id, i.dst AS user_id, i.src AS child FROM interactions i
    WHERE i.kind IN ('retweet', 'reply') AND NOT EXISTS (
        SELECT 1 FROM tweets t WHERE t.kind = 'post' AND t.article_id = i.article_id AND t.user_id = i.src)""",
         ("interactions", "tweets"))
sql_view("obs_levels", """
    SELECT article_id, user_id, min(step) AS step FROM (
        WITH RECURSIVE reach(article_id, user_id, step) AS (
            SELECT DISTINCT article_id, user_id, CAST(0 AS BIGINT) FROM tweets WHERE kind = 'post'
            UNION
            SELECT l.article_id, l.child, r.step + 1 FROM reach r
            JOIN obs_links l ON l.article_id = r.article_id AND l.user_id = r.user_id)
        SELECT * FROM reach) x GROUP BY article_id, user_id""", ("tweets", "obs_links"))
sql_view("obs_metrics", f"""
    SELECT m.article_id, coalesce({LABEL_NAME_SQL.replace('label', 'a.label', 1)}, 'unknown') AS label,
           m.cascade_size, m.cascade_depth, m.max_width,
           CASE WHEN m.cascade_depth > 0 THEN m.cascade_size / m.cascade_depth
                ELSE CAST(m.cascade_size AS DOUBLE) END AS avg_spread_rate,
           m.widest_level,
           EXISTS (SELECT 1 FROM tweets t WHERE t.article_id = m.article_id AND t.ts IS NOT NULL) AS has_timestamps
    FROM (SELECT article_id, CAST(sum(width) AS BIGINT) AS cascade_size, max(step) AS cascade_depth,
                 max(width) AS max_width, arg_max(step, width * 1000000 - step) AS widest_level
          FROM (SELECT article_id, step, count(*) AS width FROM obs_levels GROUP BY article_id, step) w
          GROUP BY article_id) m
    LEFT JOIN articles a ON m.article_id = a.news_id""", ("obs_levels", "articles", "tweets"))

KNOWN_LABEL = "label IN ('fake', 'real')"
OBSERVED = ("cascade_size", "cascade_depth", "max_width", "avg_spread_rate")


def _known(spark, d):
    return cut_lineage(observed(spark, d).where(KNOWN_LABEL))


def _each(make):
    """The same table for every observed figure, named in ``metric``."""
    tables = [make(c).withColumn("metric", F.lit(c)) for c in OBSERVED]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _each_sql(make) -> str:
    return " UNION ALL ".join(f"SELECT *, '{c}' AS metric FROM ({make(c)})" for c in OBSERVED)


@query("observed_cascades", "SELECT * FROM obs_metrics")
def q_observed_cascades(spark, d):
    return observed(spark, d)


@query("observed_compare", _compare_sql("obs_metrics"))
def q_observed_compare(spark, d):
    return C.compare_fake_real(observed(spark, d))


@query("observed_compare_norm", f"""
    SELECT label, metric, value, CASE WHEN max(value) OVER (PARTITION BY metric) > 0
           THEN value / max(value) OVER (PARTITION BY metric) ELSE 0.0 END AS normalized
    FROM ({" UNION ALL ".join(f"SELECT label, '{c}' AS metric, {c} AS value FROM ({_compare_sql('obs_metrics')})"
                              for c in C.NORM_METRICS)}) u""")
def q_observed_compare_norm(spark, d):
    return C.normalized_comparison(C.compare_fake_real(observed(spark, d)))


@query("observed_density", f"""
    SELECT label, metric, bin, bin_lo, bin_hi, count,
           count / (sum(count) OVER (PARTITION BY label, metric) * (bin_hi - bin_lo)) AS density
    FROM ({_each_sql(lambda c: hist_sql(c, 'obs_metrics', 'label', 30, KNOWN_LABEL))}) h""")
def q_observed_density(spark, d):
    m = _known(spark, d)
    return _each(lambda c: M.density(M.histogram(m, c, "label", 30), "label"))


@query("observed_box", _each_sql(lambda c: box_sql(c, "obs_metrics", "label", f"{KNOWN_LABEL} AND {c} > 0")))
def q_observed_box(spark, d):
    m = _known(spark, d)
    return _each(lambda c: M.box_stats(m, c, "label", positive_only=True))


# ------------------------------------------------------------------------ validation report

def messy_tweets(spark, d):
    n = read_table(spark, d, "documents").select(F.count(F.lit(1))).scalar()
    tw = A.tweets(spark, d).select("tweet_id", "article_id")
    shared = F.pmod(F.col("article_id").cast("bigint") + 1, n).cast("string")
    return (tw.unionAll(tw.where(F.col("tweet_id") % REPEAT_ID == 0))
            .unionAll(tw.where(F.col("tweet_id") % SHARE_ID == 0).select("tweet_id", shared)))


def messy_similarity(spark, d):
    """Nodes and edges of the dense similarity graph with self loops, missing weights and weights above 1."""
    number = lambda c: F.col(c).cast("bigint")
    nodes = A.vectors(spark, d).select(F.col("news_id").alias("node_id"))
    total = number("src") + number("dst")
    edges = S.undirected(dense_knn_df(spark, d)).select("src", "dst", F.when(total % NO_WEIGHT != 0, F.when(
        total % LARGE_WEIGHT == 0, F.col("weight") + 1.0).otherwise(F.col("weight"))).alias("weight"))
    loops = nodes.where(number("node_id") % LOOP == 0).select("node_id", "node_id", F.lit(1.0))
    return nodes, edges.unionAll(loops.toDF("src", "dst", "weight"))


sql_view("messy_lists", f"""
    SELECT tweet_id, article_id FROM (
        SELECT tweet_id, article_id FROM tweets
        UNION ALL SELECT tweet_id, article_id FROM tweets WHERE tweet_id % {REPEAT_ID} = 0
        UNION ALL SELECT tweet_id, CAST((CAST(article_id AS BIGINT) + 1) % (SELECT count(*) FROM documents) AS VARCHAR)
                  FROM tweets WHERE tweet_id % {SHARE_ID} = 0) t
    WHERE article_id IN (SELECT news_id FROM articles)""", ("tweets", "articles"))
sql_view("messy_sizes", """
    SELECT article_id, count(*) AS n, count(DISTINCT tweet_id) AS n_distinct FROM messy_lists GROUP BY article_id""",
         ("messy_lists",))
sql_view("messy_edges", f"""
    SELECT src, dst, CASE WHEN (CAST(src AS BIGINT) + CAST(dst AS BIGINT)) % {NO_WEIGHT} = 0 THEN NULL
                          WHEN (CAST(src AS BIGINT) + CAST(dst AS BIGINT)) % {LARGE_WEIGHT} = 0 THEN weight + 1.0
                          ELSE weight END AS weight
    FROM (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight FROM knn_dense GROUP BY 1, 2) k
    UNION ALL SELECT news_id, news_id, 1.0 FROM vectors WHERE CAST(news_id AS BIGINT) % {LOOP} = 0""",
         ("knn_dense", "vectors"))


@query("validation_report", f"""
    SELECT 'news_id_duplicates' AS "check", count(*) AS n FROM articles WHERE CAST(news_id AS BIGINT) % {REPEAT_NEWS} = 0
    UNION ALL SELECT 'per_article_tweet_dupes', count(*) FROM messy_sizes WHERE n <> n_distinct
    UNION ALL SELECT 'global_tweet_dupes', count(*) FROM (
        SELECT tweet_id FROM messy_lists GROUP BY tweet_id HAVING count(DISTINCT article_id) > 1)
    UNION ALL SELECT 'bipartite_articles_isolates', count(*) FROM articles
        WHERE news_id NOT IN (SELECT article_id FROM messy_lists)
    UNION ALL SELECT 'bipartite_tweets_isolates', 0
    UNION ALL SELECT 'bipartite_edges', CAST(sum(n_distinct) AS BIGINT) FROM messy_sizes
    UNION ALL SELECT 'bipartite_degree_mismatch', count(*) FROM messy_sizes WHERE n <> n_distinct
    UNION ALL SELECT 'similarity_isolates', count(*) FROM vectors
        WHERE news_id NOT IN (SELECT src FROM messy_edges UNION SELECT dst FROM messy_edges)
    UNION ALL SELECT 'similarity_edges', count(*) FROM messy_edges
    UNION ALL SELECT 'similarity_selfloops', count(*) FROM messy_edges WHERE src = dst
    UNION ALL SELECT 'similarity_bad_weights', count(*) FROM messy_edges WHERE weight < 0.0 OR weight > 1.0""")
def q_validation_report(spark, d):
    arts = A.articles(spark, d)
    news = arts.unionAll(arts.where(F.col("news_id").cast("bigint") % REPEAT_NEWS == 0))
    raw = A.raw_articles(spark, d, tweets_df=messy_tweets(spark, d), articles_df=arts)
    metrics = M.article_metrics(news, raw)
    sim_nodes, sim_edges = messy_similarity(spark, d)
    return G.validation_report(news, metrics, raw, *G.bipartite_graph(metrics, raw), sim_nodes, cut_lineage(sim_edges))


# -------------------------------------------------------------------------- retweet arrays

def stage_retweets(spark, d) -> str:
    """Retweets as JSON arrays, one a line: those of one article and original user within an hour."""
    path = staging_path(spark, "retweet_arrays")
    uid = lambda c: F.struct(F.col(c).cast("string").alias("id_str"))
    entry = F.struct(uid("src").alias("user"), F.date_format("ts", FS.TWITTER_TIME_FORMAT).alias("created_at"),
                     F.struct(F.col("tweet_id").alias("id"), uid("dst").alias("user")).alias("retweeted_status"))
    rts = A.interactions(spark, d).where(F.col("kind") == "retweet")
    lines = rts.groupBy("article_id", "dst", F.date_trunc("hour", "ts").alias("hour")).agg(F.collect_list(entry).alias("l"))
    lines.select(F.to_json("l").alias("value")).write.text(path)
    return path


@query("retweet_json_flat", """
    SELECT CAST(src AS VARCHAR) AS retweeter_id, CAST(dst AS VARCHAR) AS original_user_id,
           CAST(tweet_id AS VARCHAR) AS tweet_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at
    FROM interactions WHERE kind = 'retweet'""")
def q_retweet_json_flat(spark, d):
    rts = FS.read_retweets(spark, stage_retweets(spark, d), whole_files=False)
    return rts.select("retweeter_id", "original_user_id", "tweet_id",
                      F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("interaction_edges_json_all", """
    SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, interaction_type,
           CAST(tweet_id AS VARCHAR) AS tweet_id, n_interactions FROM (
        SELECT src, dst, kind AS interaction_type, tweet_id,
               count(*) OVER (PARTITION BY src, dst) AS n_interactions,
               row_number() OVER (PARTITION BY src, dst ORDER BY
                   CASE kind WHEN 'mention' THEN 3 WHEN 'reply' THEN 2 WHEN 'retweet' THEN 1 ELSE 0 END DESC,
                   date_trunc('second', ts) DESC, CAST(tweet_id AS VARCHAR) DESC) AS rn
        FROM (SELECT src, dst, kind, tweet_id, ts FROM interactions
              UNION ALL SELECT src, dst, kind, tweet_id, ts FROM interactions WHERE kind = 'retweet') b) x WHERE rn = 1""")
def q_interaction_edges_json_all(spark, d):
    flat = FS.read_tweets(spark, stage_tweet_json(spark, d), multi_line=False)
    rts = FS.read_retweets(spark, stage_retweets(spark, d), whole_files=False)
    return G.interaction_edges(FS.json_interactions(flat, rts)).drop("ts")


# --------------------------------------------------------------------------- small profile

@query("tweet_count_p95", "SELECT quantile_cont(tweet_count, 0.95) AS p95 FROM metrics")
def q_tweet_count_p95(spark, d):
    return M.quantile(metrics_df(spark, d), "tweet_count", 0.95).withColumnRenamed("quantile", "p95")


@query("file_labels", f"""
    SELECT source, {LABEL_NAME_SQL} AS label_name, count(*) AS n,
           100.0 * count(*) / sum(count(*)) OVER (PARTITION BY source) AS pct
    FROM articles GROUP BY 1, 2""")
def q_file_labels(spark, d):
    news = FS.load_news(spark, stage_articles(spark, d)).withColumn("label_name", label_name(F.col("label")))
    return M.share_within(news, "source", "label_name")


@query("article_snippets", f"""
    SELECT news_id, {LABEL_NAME_SQL} AS label_name, source,
           CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet
    FROM articles""")
def q_article_snippets(spark, d):
    return A.articles(spark, d).select("news_id", label_name(F.col("label")).alias("label_name"), "source",
                                       snippet(F.col("text")).alias("snippet"))
