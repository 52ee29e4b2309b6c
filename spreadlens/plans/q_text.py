"""Text-feature and similarity queries (TF-IDF, kNN graphs, lookup and vote)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_text, label_name
from ..operators import graph as G
from ..operators import similarity as S
from ..session import read_table
from ..sources import adapters as A
from .q_graph import LABEL_NAME_SQL
from .q_profile import news_clean
from .registry import query, sql_view
from .sqlviews import STOP_LIST_SQL, sql_clean

MAX_FEATURES = 20000
K = 10
THRESHOLD = 0.25
TOP_TERMS = 15
LOOKUP_TOP = 5
PROBE_DOC = "0"
R = S.SIM_DECIMALS


def tfidf_df(spark, d):
    return S.tfidf(news_clean(spark, d), MAX_FEATURES)


def tfidf_knn_df(spark, d):
    vec, vocab = tfidf_df(spark, d)
    return S.knn(S.sparse_rows(vec), MAX_FEATURES, K, THRESHOLD)


def dense_knn_df(spark, d):
    v = A.vectors(spark, d)
    dim = v.select(F.max(F.size("embedding"))).collect()[0][0] or 1
    return S.knn(S.dense_rows(v), int(dim), K, THRESHOLD)


def queries_df(spark, d):
    b = read_table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), clean_text(F.col("text")).alias("clean_text"))


# ------------------------------------------------------------------------- SQL oracle

sql_view("tok", f"""
    SELECT news_id, list_filter(string_split(clean_text, ' '),
                                lambda w: length(w) >= 2 AND NOT list_contains({STOP_LIST_SQL}, w)) AS t
    FROM news_clean""", ("news_clean",))
sql_view("tf", """
    SELECT news_id, term, count(*) AS tf FROM (
        SELECT news_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])))
               AS term FROM tok) x
    GROUP BY news_id, term""", ("tok",))
sql_view("vocab", f"""
    SELECT term, cf, df, ln(CAST(1 + (SELECT count(*) FROM news_clean) AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1 AS idf
    FROM (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT {MAX_FEATURES}) v""",
         ("tf", "news_clean"))
sql_view("tfidf", """
    SELECT news_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY news_id)) AS weight
    FROM (SELECT tf.news_id, tf.term, tf.tf * v.idf AS w FROM tf JOIN vocab v ON tf.term = v.term) x""",
         ("tf", "vocab"))
sql_view("knn_sparse", f"""
    SELECT src, dst, weight FROM (
        SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM (
            SELECT a.news_id AS src, b.news_id AS dst, round(sum(a.weight * b.weight), {R}) AS weight
            FROM tfidf a JOIN tfidf b ON a.term = b.term AND a.news_id <> b.news_id
            GROUP BY a.news_id, b.news_id) p
        WHERE weight >= {THRESHOLD}) q
    WHERE r <= {K}""", ("tfidf",))
sql_view("unit_vectors", """
    SELECT news_id, list_transform(e, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0.0 END) AS v FROM (
        SELECT news_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
               sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n
        FROM vectors) x""", ("vectors",))
sql_view("knn_dense", f"""
    SELECT src, dst, weight FROM (
        SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM (
            SELECT a.news_id AS src, b.news_id AS dst, round(list_inner_product(a.v, b.v), {R}) AS weight
            FROM unit_vectors a JOIN unit_vectors b ON a.news_id <> b.news_id) p
        WHERE weight >= {THRESHOLD}) q
    WHERE r <= {K}""", ("unit_vectors",))
sql_view("sim_graph", """
    SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight FROM knn_sparse
    GROUP BY least(src, dst), greatest(src, dst)""", ("knn_sparse",))
sql_view("q_tok", f"""
    SELECT item_id AS query_id, list_filter(string_split({sql_clean('text')}, ' '),
                                lambda w: length(w) >= 2 AND NOT list_contains({STOP_LIST_SQL}, w)) AS t
    FROM benchmark""")
sql_view("q_vec", """
    SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM (
        SELECT c.query_id, c.term, c.tf * v.idf AS w FROM (
            SELECT query_id, term, count(*) AS tf FROM (
                SELECT query_id, unnest(list_concat(t, list_transform(range(1, len(t)),
                                                                      lambda i: t[i] || ' ' || t[i + 1]))) AS term
                FROM q_tok) x GROUP BY query_id, term) c
        JOIN vocab v ON c.term = v.term) y""", ("q_tok", "vocab"))
sql_view("q_top", f"""
    SELECT query_id, CAST(rank AS BIGINT) AS rank, news_id, similarity FROM (
        SELECT query_id, news_id, similarity,
               row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, news_id) AS rank FROM (
            SELECT q.query_id, t.news_id, round(sum(q.weight * t.weight), {R}) AS similarity
            FROM q_vec q JOIN tfidf t ON q.term = t.term GROUP BY q.query_id, t.news_id) s) r
    WHERE rank <= {LOOKUP_TOP}""", ("q_vec", "tfidf"))


# --------------------------------------------------------------------------- queries

@query("tfidf_vectors", "SELECT news_id, term, weight FROM tfidf")
def q_tfidf_vectors(spark, d):
    return tfidf_df(spark, d)[0].select("news_id", "term", "weight")


@query("tfidf_vocab", "SELECT count(*) AS vocab_size, (SELECT count(*) FROM news_clean) AS n_docs FROM vocab")
def q_tfidf_vocab(spark, d):
    news = news_clean(spark, d)
    _, vocab = S.tfidf(news, MAX_FEATURES)
    n_docs = news.select(F.count(F.lit(1))).collect()[0][0]
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size")).withColumn("n_docs", F.lit(n_docs).cast("bigint"))


@query("idf_extremes", """
    SELECT 'highest' AS kind, CAST(row_number() OVER (ORDER BY idf DESC, term) AS BIGINT) AS rank, term, idf
    FROM vocab QUALIFY rank <= 20
    UNION ALL
    SELECT 'lowest', CAST(row_number() OVER (ORDER BY idf ASC, term) AS BIGINT), term, idf
    FROM vocab QUALIFY row_number() OVER (ORDER BY idf ASC, term) <= 20""")
def q_idf_extremes(spark, d):
    _, vocab = tfidf_df(spark, d)
    from pyspark.sql import Window
    hi = (vocab.orderBy(F.col("idf").desc(), "term").limit(20)
          .select(F.lit("highest").alias("kind"),
                  F.row_number().over(Window.orderBy(F.col("idf").desc(), "term")).cast("bigint").alias("rank"),
                  "term", "idf"))
    lo = (vocab.orderBy(F.col("idf").asc(), "term").limit(20)
          .select(F.lit("lowest").alias("kind"),
                  F.row_number().over(Window.orderBy(F.col("idf").asc(), "term")).cast("bigint").alias("rank"),
                  "term", "idf"))
    return hi.unionByName(lo)


@query("top_terms", f"""
    SELECT news_id, CAST(rank AS BIGINT) AS rank, term, weight FROM (
        SELECT news_id, term, weight, row_number() OVER (PARTITION BY news_id ORDER BY weight DESC, term) AS rank
        FROM tfidf) x WHERE rank <= {TOP_TERMS}""")
def q_top_terms(spark, d):
    from pyspark.sql import Window
    vec, _ = tfidf_df(spark, d)
    w = Window.partitionBy("news_id").orderBy(F.col("weight").desc(), F.col("term").asc())
    return (vec.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP_TERMS)
            .select("news_id", F.col("rank").cast("bigint").alias("rank"), "term", "weight"))


@query("similar_to_doc", f"""
    SELECT CAST(row_number() OVER (ORDER BY similarity DESC, news_id) AS BIGINT) AS rank, news_id, similarity FROM (
        SELECT b.news_id, round(sum(a.weight * b.weight), {R}) AS similarity
        FROM tfidf a JOIN tfidf b ON a.term = b.term
        WHERE a.news_id = '{PROBE_DOC}' AND b.news_id <> '{PROBE_DOC}' GROUP BY b.news_id) s
    ORDER BY similarity DESC, news_id LIMIT {LOOKUP_TOP}""")
def q_similar_to_doc(spark, d):
    from pyspark.sql import Window
    vec, _ = tfidf_df(spark, d)
    top = S.similar_to(vec, PROBE_DOC, LOOKUP_TOP)
    w = Window.orderBy(F.col("similarity").desc(), F.col("news_id").asc())
    return top.select(F.row_number().over(w).cast("bigint").alias("rank"), "news_id", "similarity")


@query("tfidf_knn", "SELECT src, dst, weight FROM knn_sparse")
def q_tfidf_knn(spark, d):
    return tfidf_knn_df(spark, d)


@query("similarity_graph", "SELECT src, dst, weight FROM sim_graph")
def q_similarity_graph(spark, d):
    return S.undirected(tfidf_knn_df(spark, d))


@query("similarity_nodes", """
    SELECT a.news_id, CASE a.label WHEN 0 THEN 'fake' WHEN 1 THEN 'real' ELSE 'unknown' END AS label_name, a.source,
           CAST((SELECT count(*) FROM sim_graph g WHERE g.src = a.news_id OR g.dst = a.news_id) AS BIGINT) AS degree
    FROM articles a""")
def q_similarity_nodes(spark, d):
    arts = A.articles(spark, d)
    edges = S.undirected(tfidf_knn_df(spark, d))
    nodes = arts.select(F.col("news_id").alias("node_id"), label_name(F.col("label")).alias("label_name"), "source")
    deg = G.undirected_degree(nodes, edges)
    return nodes.join(deg, "node_id").select(F.col("node_id").alias("news_id"), "label_name", "source", "degree")


@query("dense_knn", "SELECT src, dst, weight FROM knn_dense")
def q_dense_knn(spark, d):
    return dense_knn_df(spark, d)


@query("dense_similar_to_doc", f"""
    SELECT CAST(row_number() OVER (ORDER BY similarity DESC, news_id) AS BIGINT) AS rank, news_id, similarity FROM (
        SELECT b.news_id, round(list_inner_product(a.v, b.v), {R}) AS similarity
        FROM unit_vectors a JOIN unit_vectors b ON a.news_id <> b.news_id WHERE a.news_id = '{PROBE_DOC}') s
    ORDER BY similarity DESC, news_id LIMIT {LOOKUP_TOP}""")
def q_dense_similar_to_doc(spark, d):
    from pyspark.sql import Window
    top = S.dense_similar_to(A.vectors(spark, d), PROBE_DOC, LOOKUP_TOP)
    w = Window.orderBy(F.col("similarity").desc(), F.col("news_id").asc())
    return top.select(F.row_number().over(w).cast("bigint").alias("rank"), "news_id", "similarity")


@query("dense_similarity_graph", """
    SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight FROM knn_dense
    GROUP BY least(src, dst), greatest(src, dst)""")
def q_dense_similarity_graph(spark, d):
    return S.undirected(dense_knn_df(spark, d))


@query("query_topk", "SELECT query_id, rank, news_id, similarity FROM q_top")
def q_query_topk(spark, d):
    vec, vocab = tfidf_df(spark, d)
    qv = S.transform_texts(queries_df(spark, d), vocab)
    return S.query_topk(qv, vec, LOOKUP_TOP)


@query("lookup_results", f"""
    SELECT t.query_id, t.rank, t.news_id, t.similarity, {LABEL_NAME_SQL} AS label_name, a.source,
           CASE WHEN length(a.text) > 200 THEN left(a.text, 200) || '...' ELSE a.text END AS snippet
    FROM q_top t LEFT JOIN articles a ON t.news_id = a.news_id""")
def q_lookup_results(spark, d):
    return (S.with_articles(q_query_topk(spark, d), A.articles(spark, d))
            .select("query_id", "rank", "news_id", "similarity", "label_name", "source", "snippet"))


@query("knn_vote", """
    SELECT b.item_id AS query_id,
           CASE WHEN coalesce(v.total, 0) = 0 THEN 'Unknown' WHEN v.fake_score / v.total > v.real_score / v.total
                THEN 'Fake' ELSE 'Real' END AS prediction,
           CASE WHEN coalesce(v.total, 0) = 0 THEN 0.5 WHEN v.fake_score / v.total > v.real_score / v.total
                THEN v.fake_score / v.total ELSE v.real_score / v.total END AS confidence,
           CAST(coalesce(v.n_fake, 0) AS BIGINT) AS n_fake, CAST(coalesce(v.n_real, 0) AS BIGINT) AS n_real,
           v.mean_similarity
    FROM benchmark b LEFT JOIN (
        SELECT t.query_id,
               sum(CASE WHEN a.label = 0 THEN t.similarity ELSE 0.0 END) AS fake_score,
               sum(CASE WHEN a.label = 0 THEN 0.0 ELSE t.similarity END) AS real_score,
               sum(t.similarity) AS total,
               sum(CASE WHEN a.label = 0 THEN 1 ELSE 0 END) AS n_fake,
               sum(CASE WHEN a.label = 0 THEN 0 ELSE 1 END) AS n_real,
               avg(t.similarity) AS mean_similarity
        FROM q_top t LEFT JOIN articles a ON t.news_id = a.news_id GROUP BY t.query_id) v
      ON b.item_id = v.query_id""")
def q_knn_vote(spark, d):
    vec, vocab = tfidf_df(spark, d)
    qs = queries_df(spark, d)
    top = S.query_topk(S.transform_texts(qs, vocab), vec, LOOKUP_TOP)
    votes = S.knn_vote(top, A.articles(spark, d))
    # every query gets a row; one without neighbours votes Unknown with 0.5
    return (qs.select("query_id").join(votes, "query_id", "left")
            .select("query_id", F.coalesce("prediction", F.lit("Unknown")).alias("prediction"),
                    F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
                    F.coalesce("n_fake", F.lit(0)).cast("bigint").alias("n_fake"),
                    F.coalesce("n_real", F.lit(0)).cast("bigint").alias("n_real"), "mean_similarity"))


@query("edge_checks", f"""
    SELECT CAST((SELECT count(*) FROM sim_graph WHERE src = dst) AS BIGINT) AS n_self_loops,
           CAST((SELECT count(*) FROM sim_graph WHERE weight < 0.0 OR weight > 1.0) AS BIGINT) AS n_bad_weights,
           CAST((SELECT count(*) FROM articles WHERE news_id NOT IN (SELECT src FROM sim_graph UNION SELECT dst FROM sim_graph))
                AS BIGINT) AS n_isolates,
           CAST((SELECT count(*) FROM sim_graph) AS BIGINT) AS n_edges""")
def q_edge_checks(spark, d):
    edges = S.undirected(tfidf_knn_df(spark, d))
    nodes = A.articles(spark, d).select(F.col("news_id").alias("node_id"))
    tall = (edges.select(F.when(F.col("src") == F.col("dst"), "n_self_loops").alias("metric"))
            .unionAll(edges.select(F.when((F.col("weight") < 0.0) | (F.col("weight") > 1.0), "n_bad_weights")))
            .unionAll(G.isolates(nodes, edges).select(F.lit("n_isolates")))
            .unionAll(edges.select(F.lit("n_edges"))))
    wide = tall.where(F.col("metric").isNotNull()).groupBy().pivot(
        "metric", ["n_self_loops", "n_bad_weights", "n_isolates", "n_edges"]).agg(F.count(F.lit(1)))
    return wide.select(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                         for c in ("n_self_loops", "n_bad_weights", "n_isolates", "n_edges")])


@query("pca_2d")
def q_pca_2d(spark, d):
    return S.pca_2d(A.vectors(spark, d))


@query("pca_2d_tfidf")
def q_pca_2d_tfidf(spark, d):
    news = news_clean(spark, d)
    return S.pca_sparse(news, S.tfidf(news, MAX_FEATURES)[0], MAX_FEATURES)
