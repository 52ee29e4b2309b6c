"""Graph-building and validation queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import label_name
from ..operators import cascades as C
from ..operators import graph as G
from ..sources import adapters as A
from .q_profile import metrics_df
from .registry import query, sql_view

LABEL_NAME_SQL = "CASE label WHEN 0 THEN 'fake' WHEN 1 THEN 'real' ELSE 'unknown' END"


def bipartite(spark, d):
    return G.bipartite_graph(metrics_df(spark, d), A.raw_articles(spark, d))


def interaction_graph(spark, d):
    tw = A.tweets(spark, d)
    edges = G.interaction_edges(A.interactions(spark, d, tweets_df=tw))
    return G.interaction_nodes(tw, edges), edges


sql_view("pairs", "SELECT id AS news_id, unnest(tweet_list) AS tweet_id FROM parsed_raw", ("parsed_raw",))
sql_view("bip_edges", """
    SELECT DISTINCT 'A_' || p.news_id AS src, 'T_' || p.tweet_id AS dst
    FROM pairs p WHERE p.news_id IN (SELECT news_id FROM metrics)""", ("pairs", "metrics"))
sql_view("bip_nodes", """
    SELECT DISTINCT 'A_' || news_id AS node_id, 'article' AS bipartite FROM metrics
    UNION ALL SELECT DISTINCT dst AS node_id, 'tweet' AS bipartite FROM bip_edges""", ("metrics", "bip_edges"))
sql_view("int_edges", """
    SELECT src, dst, interaction_type, tweet_id, n_interactions FROM (
        SELECT src, dst, kind AS interaction_type, tweet_id,
               count(*) OVER (PARTITION BY src, dst) AS n_interactions,
               row_number() OVER (PARTITION BY src, dst ORDER BY
                   CASE kind WHEN 'mention' THEN 3 WHEN 'reply' THEN 2 WHEN 'retweet' THEN 1 ELSE 0 END DESC,
                   ts DESC, tweet_id DESC) AS rn
        FROM interactions) x WHERE rn = 1""", ("interactions",))
sql_view("int_nodes", """
    SELECT user_id AS node_id FROM tweets UNION SELECT src FROM int_edges UNION SELECT dst FROM int_edges""",
         ("tweets", "int_edges"))
sql_view("label_users_v", """
    SELECT DISTINCT CASE a.label WHEN 0 THEN 'fake' ELSE 'real' END AS label_name, t.user_id
    FROM tweets t JOIN articles a ON t.article_id = a.news_id WHERE a.label IN (0, 1)""", ("tweets", "articles"))


@query("bipartite_edges", "SELECT src, dst FROM bip_edges")
def q_bipartite_edges(spark, d):
    return bipartite(spark, d)[1]


@query("bipartite_nodes", """
    SELECT n.node_id, n.bipartite,
           CAST(coalesce((SELECT count(*) FROM bip_edges e WHERE e.src = n.node_id OR e.dst = n.node_id), 0) AS BIGINT)
               AS degree
    FROM bip_nodes n""")
def q_bipartite_nodes(spark, d):
    nodes, edges = bipartite(spark, d)
    return (nodes.select("node_id", "bipartite")
            .join(G.undirected_degree(nodes, edges), "node_id"))


@query("interaction_edges", "SELECT src, dst, interaction_type, tweet_id, n_interactions FROM int_edges")
def q_interaction_edges(spark, d):
    return interaction_graph(spark, d)[1].drop("ts")


@query("interaction_nodes", """
    SELECT n.node_id,
           CAST((SELECT count(*) FROM int_edges e WHERE e.dst = n.node_id) AS BIGINT) AS in_degree,
           CAST((SELECT count(*) FROM int_edges e WHERE e.src = n.node_id) AS BIGINT) AS out_degree
    FROM int_nodes n""")
def q_interaction_nodes(spark, d):
    nodes, edges = interaction_graph(spark, d)
    ind = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    outd = edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    return (nodes.select("node_id").join(ind, "node_id", "left").join(outd, "node_id", "left")
            .select("node_id", F.coalesce("in_degree", F.lit(0)).cast("bigint").alias("in_degree"),
                    F.coalesce("out_degree", F.lit(0)).cast("bigint").alias("out_degree")))


@query("graph_isolates", """
    SELECT 'bipartite' AS graph, count(*) AS n_nodes,
           CAST(sum(CASE WHEN node_id NOT IN (SELECT src FROM bip_edges UNION SELECT dst FROM bip_edges)
                    THEN 1 ELSE 0 END) AS BIGINT) AS n_isolates,
           (SELECT count(*) FROM bip_edges) AS n_edges
    FROM bip_nodes
    UNION ALL
    SELECT 'interaction', count(*),
           CAST(sum(CASE WHEN node_id NOT IN (SELECT src FROM int_edges UNION SELECT dst FROM int_edges)
                    THEN 1 ELSE 0 END) AS BIGINT),
           (SELECT count(*) FROM int_edges)
    FROM int_nodes""")
def q_graph_isolates(spark, d):
    parts = []
    for name, (nodes, edges) in (("bipartite", bipartite(spark, d)), ("interaction", interaction_graph(spark, d))):
        parts += [nodes.select(F.lit(name).alias("graph"), F.lit("n_nodes").alias("metric")),
                  G.isolates(nodes.select("node_id"), edges).select(F.lit(name).alias("graph"),
                                                                     F.lit("n_isolates").alias("metric")),
                  edges.select(F.lit(name).alias("graph"), F.lit("n_edges").alias("metric"))]
    tall = parts[0]
    for p in parts[1:]:
        tall = tall.unionAll(p)
    # one pass: count per (graph, metric), then pivot the three metrics into columns
    wide = tall.groupBy("graph").pivot("metric", ["n_nodes", "n_isolates", "n_edges"]).agg(F.count(F.lit(1)))
    return wide.select("graph", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                                  for c in ("n_nodes", "n_isolates", "n_edges")])


@query("degree_mismatch", """
    SELECT m.news_id, m.tweet_count, CAST(coalesce(d.degree, 0) AS BIGINT) AS degree
    FROM metrics m LEFT JOIN (SELECT substr(src, 3) AS news_id, count(*) AS degree FROM bip_edges GROUP BY 1) d
      ON m.news_id = d.news_id
    WHERE m.tweet_count <> coalesce(d.degree, 0)""")
def q_degree_mismatch(spark, d):
    _, edges = bipartite(spark, d)
    return G.degree_mismatch(metrics_df(spark, d), edges)


@query("tweet_dupes", """
    SELECT id, CAST(len(tweet_list) AS BIGINT) AS n_ids, CAST(len(list_distinct(tweet_list)) AS BIGINT) AS n_distinct
    FROM parsed_raw WHERE len(tweet_list) <> len(list_distinct(tweet_list))""")
def q_tweet_dupes(spark, d):
    return G.tweet_dupes(A.raw_articles(spark, d))


@query("tweet_dupes_global", """
    SELECT tweet_id, count(*) AS n_articles FROM (SELECT DISTINCT news_id, tweet_id FROM pairs) x
    GROUP BY tweet_id HAVING count(*) > 1""")
def q_tweet_dupes_global(spark, d):
    return G.tweet_dupes_global(A.raw_articles(spark, d))


@query("tweet_dupe_samples", """
    SELECT id, tweet_id, n_repeats FROM (
        SELECT r.news_id AS id, r.tweet_id, r.n AS n_repeats,
               row_number() OVER (PARTITION BY r.news_id ORDER BY r.tweet_id) AS k
        FROM (SELECT news_id, tweet_id, count(*) AS n FROM pairs GROUP BY 1, 2 HAVING count(*) > 1) r
        WHERE r.news_id IN (SELECT DISTINCT news_id FROM pairs GROUP BY news_id, tweet_id HAVING count(*) > 1
                            ORDER BY news_id LIMIT 5)) x
    WHERE k <= 10""")
def q_tweet_dupe_samples(spark, d):
    return G.tweet_dupe_samples(A.raw_articles(spark, d))


@query("label_users", "SELECT label_name, user_id FROM label_users_v")
def q_label_users(spark, d):
    return G.label_users(A.tweets(spark, d), A.articles(spark, d))


@query("label_subgraph", """
    SELECT lu.label_name, e.src, e.dst, e.interaction_type FROM int_edges e
    JOIN label_users_v lu ON e.src = lu.user_id
    WHERE EXISTS (SELECT 1 FROM label_users_v l2 WHERE l2.label_name = lu.label_name AND l2.user_id = e.dst)""")
def q_label_subgraph(spark, d):
    _, edges = interaction_graph(spark, d)
    lu = G.label_users(A.tweets(spark, d), A.articles(spark, d))
    return G.label_subgraph(edges, lu).select("label_name", "src", "dst", "interaction_type")


# ------------------------------------------------------------------ cascades (D1-D3, D9)

@query("user_tweet_map", f"""
    SELECT ta.tweet_id,
           1000000 + (CAST(('0x' || substr(md5(ta.tweet_id), 1, 8)) AS UBIGINT)::BIGINT % 999000000) AS user_id,
           ta.article_id,
           CASE coalesce(m.label, 0) WHEN 0 THEN 'fake' WHEN 1 THEN 'real' ELSE 'unknown' END AS label_name,
           coalesce(m.source, 'unknown') AS source,
           strftime(TIMESTAMP '2017-01-01 00:00:00'
                    + to_days(CAST(h % 365 AS INTEGER)) + to_hours(CAST((h // 1000) % 24 AS INTEGER))
                    + to_minutes(CAST((h // 100) % 60 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS timestamp
    FROM (SELECT tweet_id, list(news_id ORDER BY length(news_id) DESC, news_id DESC)[1] AS article_id,
                 CAST(('0x' || substr(md5(tweet_id), 1, 8)) AS UBIGINT)::BIGINT AS h
          FROM pairs GROUP BY tweet_id) ta
    LEFT JOIN (SELECT news_id, m.label AS label, m.source AS source FROM (SELECT news_id, list({{'label': label, 'source': source}} ORDER BY label, source)[1] AS m FROM metrics GROUP BY news_id)) m
      ON ta.article_id = m.news_id""")
def q_user_tweet_map(spark, d):
    m = C.user_tweet_map(A.raw_articles(spark, d), metrics_df(spark, d))
    return m.select("tweet_id", "user_id", "article_id", label_name(F.col("label")).alias("label_name"),
                    "source", "timestamp")


def cascade_edges_df(spark, d):
    tw = A.tweets(spark, d)
    return C.cascade_edges(tw, A.interactions(spark, d, tweets_df=tw))


sql_view("casc_edges", """
    SELECT article_id, 'A_' || article_id AS src, CAST(user_id AS VARCHAR) AS dst, 'posts' AS edge_type, tweet_id
    FROM (SELECT article_id, user_id, tweet_id,
                 row_number() OVER (PARTITION BY article_id, user_id ORDER BY ts DESC, tweet_id DESC) AS rn
          FROM tweets) p WHERE rn = 1
    UNION ALL
    SELECT article_id, CAST(src AS VARCHAR), CAST(dst AS VARCHAR), kind, tweet_id FROM (
        SELECT i.*, row_number() OVER (PARTITION BY article_id, src, dst
                                       ORDER BY CASE kind WHEN 'reply' THEN 2 ELSE 1 END DESC, ts DESC, tweet_id DESC) rn
        FROM interactions i
        WHERE kind IN ('retweet', 'reply')
          AND EXISTS (SELECT 1 FROM tweets t WHERE t.article_id = i.article_id AND t.tweet_id = i.tweet_id)
          AND EXISTS (SELECT 1 FROM tweets t WHERE t.article_id = i.article_id AND t.user_id = i.src)
          AND EXISTS (SELECT 1 FROM tweets t WHERE t.article_id = i.article_id AND t.user_id = i.dst)) u
    WHERE rn = 1""", ("tweets", "interactions"))


@query("cascade_edges", "SELECT article_id, src, dst, edge_type, tweet_id FROM casc_edges")
def q_cascade_edges(spark, d):
    return cascade_edges_df(spark, d).drop("ts")


@query("cascade_assoc", """
    SELECT DISTINCT news_id AS article_id, 'A_' || news_id AS src, 'T_' || tweet_id AS dst,
           'association' AS edge_type FROM pairs""")
def q_cascade_assoc(spark, d):
    return C.cascade_association_edges(A.raw_articles(spark, d))


# the user map here holds the articles that some user posted; those only answered or mentioned fall back
sql_view("posted", "SELECT DISTINCT article_id FROM tweets WHERE kind = 'post'", ("tweets",))


@query("cascade_fallback", """
    SELECT article_id, src, dst, edge_type FROM casc_edges WHERE article_id IN (SELECT article_id FROM posted)
    UNION ALL
    SELECT DISTINCT news_id, 'A_' || news_id, 'T_' || tweet_id, 'association' FROM pairs
    WHERE news_id NOT IN (SELECT article_id FROM posted)""")
def q_cascade_fallback(spark, d):
    tw = A.tweets(spark, d)
    known = tw.join(tw.where(F.col("kind") == "post").select("article_id").distinct(), "article_id", "left_semi")
    return C.cascades_or_association(A.raw_articles(spark, d), known, A.interactions(spark, d, tweets_df=tw))


@query("cascade_summary", """
    SELECT m.news_id, m.tweet_count AS cascade_size, CAST(1 AS BIGINT) AS cascade_depth,
           m.tweet_count AS cascade_width, false AS has_timestamps,
           CAST(coalesce(c.n_users, 0) AS BIGINT) AS n_users, CAST(coalesce(c.n_user_edges, 0) AS BIGINT) AS n_user_edges
    FROM metrics m LEFT JOIN (
        SELECT article_id, sum(CASE WHEN edge_type = 'posts' THEN 1 ELSE 0 END) AS n_users,
               sum(CASE WHEN edge_type <> 'posts' THEN 1 ELSE 0 END) AS n_user_edges
        FROM casc_edges GROUP BY article_id) c ON m.news_id = c.article_id""")
def q_cascade_summary(spark, d):
    return C.cascade_summary(metrics_df(spark, d), cascade_edges_df(spark, d))
