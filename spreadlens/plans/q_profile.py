"""Profile / EDA queries over the adapter views (Spark callables + SQL oracles)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_text, label_name, parse_ids
from ..operators import metrics as M
from ..sources import adapters as A
from .registry import query, sql_view
from .sqlviews import STOP_LIST_SQL, sql_clean, sql_parse_ids


def news_clean(spark, d):
    return M.with_clean_text(A.articles(spark, d))


def metrics_df(spark, d):
    arts = A.articles(spark, d)
    return M.article_metrics(arts, A.raw_articles(spark, d, articles_df=arts))


sql_view("news_clean", f"SELECT news_id, text, source, label, {sql_clean('text')} AS clean_text FROM articles",
         ("articles",))
sql_view("parsed_raw", f"SELECT id, {sql_parse_ids('tweet_ids')} AS tweet_list FROM raw_articles",
         ("raw_articles",))
sql_view("metrics", """
    SELECT a.news_id, a.label, a.source, p.tweet_list,
           CAST(coalesce(len(p.tweet_list), 0) AS BIGINT) AS tweet_count,
           coalesce(len(p.tweet_list), 0) > 0 AS has_tweets
    FROM articles a LEFT JOIN parsed_raw p ON a.news_id = p.id""", ("articles", "parsed_raw"))


@query("clean_text", "SELECT news_id, clean_text FROM news_clean")
def q_clean_text(spark, d):
    return news_clean(spark, d).select("news_id", "clean_text")


@query("parse_ids", """
    SELECT id, CAST(len(tweet_list) AS BIGINT) AS n_ids, array_to_string(tweet_list, ',') AS ids_joined
    FROM parsed_raw""")
def q_parse_ids(spark, d):
    p = A.raw_articles(spark, d).select("id", parse_ids(F.col("tweet_ids")).alias("l"))
    return p.select("id", F.size("l").cast("bigint").alias("n_ids"), F.array_join("l", ",").alias("ids_joined"))


@query("article_metrics", """
    SELECT news_id, CASE label WHEN 0 THEN 'fake' WHEN 1 THEN 'real' ELSE 'unknown' END AS label_name,
           source, tweet_count, has_tweets,
           CAST(coalesce(len(list_distinct(tweet_list)), 0) AS BIGINT) AS n_distinct_tweets
    FROM metrics""")
def q_article_metrics(spark, d):
    m = metrics_df(spark, d)
    return m.select("news_id", label_name(F.col("label")).alias("label_name"), "source", "tweet_count", "has_tweets",
                    F.coalesce(F.size(F.array_distinct("tweet_list")), F.lit(0)).cast("bigint")
                    .alias("n_distinct_tweets"))


_DESC_SQL = """count(tweet_count) AS count, avg(tweet_count) AS mean, stddev_samp(tweet_count) AS std,
    CAST(min(tweet_count) AS DOUBLE) AS min, quantile_cont(tweet_count, 0.25) AS p25,
    quantile_cont(tweet_count, 0.5) AS p50, quantile_cont(tweet_count, 0.75) AS p75,
    CAST(max(tweet_count) AS DOUBLE) AS max"""


@query("tweet_count_describe", f"SELECT {_DESC_SQL} FROM metrics")
def q_tweet_count_describe(spark, d):
    return M.describe(metrics_df(spark, d), "tweet_count")


@query("tweet_count_by_label",
       f"SELECT label, {_DESC_SQL} FROM metrics WHERE label IS NOT NULL GROUP BY label")
def q_tweet_count_by_label(spark, d):
    return M.describe(metrics_df(spark, d), "tweet_count", by=["label"])


def _dist_sql(col):
    return (f"SELECT {col}, count(*) AS count, round(count(*) * CAST(100 AS DOUBLE) / "
            f"(SELECT count(*) FROM articles), 2) AS pct FROM articles WHERE {col} IS NOT NULL GROUP BY {col}")


@query("label_distribution", _dist_sql("label"))
def q_label_distribution(spark, d):
    return M.value_distribution(A.articles(spark, d), "label")


@query("source_distribution", _dist_sql("source"))
def q_source_distribution(spark, d):
    return M.value_distribution(A.articles(spark, d), "source")


@query("missing_values", """
    SELECT column_name AS "column", n_missing FROM (
        SELECT 'news_id' AS column_name, CAST(count(*) - count(news_id) AS BIGINT) AS n_missing FROM news_clean
        UNION ALL SELECT 'text', CAST(count(*) - count(text) AS BIGINT) FROM news_clean
        UNION ALL SELECT 'source', CAST(count(*) - count(source) AS BIGINT) FROM news_clean
        UNION ALL SELECT 'label', CAST(count(*) - count(label) AS BIGINT) FROM news_clean
        UNION ALL SELECT 'clean_text', CAST(count(*) - count(clean_text) AS BIGINT) FROM news_clean) x
    WHERE n_missing > 0""")
def q_missing_values(spark, d):
    return M.missing_values(news_clean(spark, d).select("news_id", "text", "source", "label", "clean_text"))


def _dup_sql(col, table):
    return (f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates FROM "
            f"(SELECT {col}, count(*) AS n FROM {table} GROUP BY {col}) x")


@query("dup_news_ids", _dup_sql("news_id", "articles"))
def q_dup_news_ids(spark, d):
    return M.duplicate_count(A.articles(spark, d), ["news_id"])


@query("dup_clean_text", _dup_sql("clean_text", "news_clean"))
def q_dup_clean_text(spark, d):
    return M.duplicate_count(news_clean(spark, d), ["clean_text"])


def hist_sql(value_sql: str, table: str, by: str, bins: int, where: str = "TRUE") -> str:
    return f"""
    SELECT {by}, bin, s + bin * w AS bin_lo, s + (bin + 1) * w AS bin_hi, count(*) AS count FROM (
        SELECT b.{by}, CAST(CASE WHEN hi = lo THEN {bins // 2}
                                 ELSE least(floor((x - lo) * {bins} / (hi - lo)), {bins - 1}) END AS INTEGER) AS bin,
               CASE WHEN hi = lo THEN lo - 0.5 ELSE lo END AS s,
               CASE WHEN hi = lo THEN 1.0 ELSE (hi - lo) / {bins} END AS w
        FROM (SELECT {by}, CAST({value_sql} AS DOUBLE) AS x FROM {table} WHERE {by} IS NOT NULL AND {where}) b
        JOIN (SELECT {by}, min(CAST({value_sql} AS DOUBLE)) AS lo, max(CAST({value_sql} AS DOUBLE)) AS hi
              FROM {table} WHERE {by} IS NOT NULL AND {where} GROUP BY {by}) r ON b.{by} = r.{by}) y
    GROUP BY {by}, bin, s, w"""


@query("tweet_hist", hist_sql("tweet_count", "metrics", "label", 50))
def q_tweet_hist(spark, d):
    return M.histogram(metrics_df(spark, d), "tweet_count", "label", 50)


@query("tweet_hist_log", hist_sql("ln(1 + tweet_count)", "metrics", "label", 50))
def q_tweet_hist_log(spark, d):
    return M.histogram(metrics_df(spark, d), F.log(1 + F.col("tweet_count").cast("double")), "label", 50)


def box_sql(value: str, table: str, by: str, where: str = "TRUE") -> str:
    return f"""
    SELECT b.{by}, q.n, q.q1, q.median, q.q3, q.q3 - q.q1 AS iqr,
           min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_lo,
           max(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
           CAST(count(*) FILTER (WHERE NOT (x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1))) AS BIGINT)
               AS n_outliers
    FROM (SELECT {by}, CAST({value} AS DOUBLE) AS x FROM {table} WHERE {by} IS NOT NULL AND {where}) b
    JOIN (SELECT {by}, count(*) AS n, quantile_cont(CAST({value} AS DOUBLE), 0.25) AS q1,
                 quantile_cont(CAST({value} AS DOUBLE), 0.5) AS median,
                 quantile_cont(CAST({value} AS DOUBLE), 0.75) AS q3
          FROM {table} WHERE {by} IS NOT NULL AND {where} GROUP BY {by}) q ON b.{by} = q.{by}
    GROUP BY b.{by}, q.n, q.q1, q.median, q.q3"""


@query("tweet_box_by_label", box_sql("tweet_count", "metrics", "label"))
def q_tweet_box_by_label(spark, d):
    return M.box_stats(metrics_df(spark, d), "tweet_count", "label")


@query("tweet_ecdf", """
    SELECT label, tweet_count, sum(n) OVER (PARTITION BY label ORDER BY tweet_count
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                               / sum(n) OVER (PARTITION BY label) AS cum_prob
    FROM (SELECT label, tweet_count, count(*) AS n FROM metrics WHERE label IS NOT NULL
          GROUP BY label, tweet_count) x""")
def q_tweet_ecdf(spark, d):
    return M.ecdf(metrics_df(spark, d), "tweet_count", "label")


def _erfc_sql(z: str) -> str:
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
         0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t = f"(1.0 / (1.0 + 0.5 * abs({z})))"
    poly = f"{c[-1]}"
    for coef in reversed(c[:-1]):
        poly = f"({coef} + {t} * {poly})"
    ans = f"({t} * exp(-({z}) * ({z}) + {poly}))"
    return f"(CASE WHEN {z} >= 0 THEN {ans} ELSE 2.0 - {ans} END)"


def mann_whitney_sql(value: str, table: str, group: str, xv, yv) -> str:
    n1, n2 = "CAST(n1 AS DOUBLE)", "CAST(n2 AS DOUBLE)"
    u1 = f"(r1 - {n1} * ({n1} + 1) / 2.0)"
    sigma = f"sqrt({n1} * {n2} / 12.0 * (({n1} + {n2} + 1) - tie_term / (({n1} + {n2}) * ({n1} + {n2} - 1))))"
    z = f"((greatest({u1}, {n1} * {n2} - {u1}) - {n1} * {n2} / 2.0 - 0.5) / {sigma})"
    return f"""
    SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, {u1} AS u_statistic, {z} AS z,
           least(1.0, {_erfc_sql(f'({z} / sqrt(2.0))')}) AS p_value
    FROM (SELECT sum(nx) AS n1, sum(ny) AS n2, sum(nx * avg_rank) AS r1,
                 CAST(sum(t * t * t - t) AS DOUBLE) AS tie_term
          FROM (SELECT nx, ny, nx + ny AS t,
                       coalesce(sum(nx + ny) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                         + (nx + ny + 1) / 2.0 AS avg_rank
                FROM (SELECT {value} AS v, sum(CASE WHEN {group} = {xv} THEN 1 ELSE 0 END) AS nx,
                             sum(CASE WHEN {group} = {yv} THEN 1 ELSE 0 END) AS ny
                      FROM {table} WHERE {group} IN ({xv}, {yv}) GROUP BY {value}) c) r) s"""


@query("mann_whitney", mann_whitney_sql("tweet_count", "metrics", "label", 0, 1))
def q_mann_whitney(spark, d):
    return M.mann_whitney(metrics_df(spark, d), "tweet_count", "label", 0, 1)


@query("text_len_stats", """
    SELECT news_id, CAST(length(coalesce(text, '')) AS BIGINT) AS text_length,
           CAST(length(clean_text) AS BIGINT) AS clean_length,
           CASE WHEN length(coalesce(text, '')) > 0
                THEN (length(coalesce(text, '')) - length(clean_text)) * CAST(100 AS DOUBLE) / length(coalesce(text, ''))
           END AS reduction_pct
    FROM news_clean""")
def q_text_len_stats(spark, d):
    return M.text_length_stats(news_clean(spark, d))


@query("regex_counts", r"""
    SELECT news_id, CAST(len(regexp_extract_all(text, 'http')) AS BIGINT) AS n_http,
           CAST(len(regexp_extract_all(text, '@\w+')) AS BIGINT) AS n_mentions,
           CAST(len(regexp_extract_all(text, '[\x{1F600}-\x{1F64F}]')) AS BIGINT) AS n_emoji
    FROM articles""")
def q_regex_counts(spark, d):
    return M.regex_counts(A.articles(spark, d))


@query("stopword_check", f"""
    SELECT count(*) AS n_checked, CAST(sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_with_stopwords,
           CAST(coalesce(sum(k), 0) AS BIGINT) AS n_stopwords
    FROM (SELECT len(list_filter(string_split(clean_text, ' '),
                 lambda w: list_contains({STOP_LIST_SQL}, w))) AS k
          FROM news_clean) x""")
def q_stopword_check(spark, d):
    return M.stopword_check(news_clean(spark, d))


@query("top_articles", """
    SELECT row_number() OVER (ORDER BY tweet_count DESC, news_id) AS rank, news_id,
           CASE label WHEN 0 THEN 'fake' WHEN 1 THEN 'real' ELSE 'unknown' END AS label_name, tweet_count
    FROM metrics ORDER BY tweet_count DESC, news_id LIMIT 20""")
def q_top_articles(spark, d):
    m = metrics_df(spark, d).withColumn("label_name", label_name(F.col("label")))
    return M.top_k(m, "tweet_count", 20, "news_id", keep=["label_name"])


@query("eda_summary", """
    SELECT n.total_articles, n.n_fake, n.pct_fake, n.n_real, n.pct_real, n.n_sources,
           m.mean_tweets, m.median_tweets, m.min_tweets, m.max_tweets, m.std_tweets,
           m.fake_mean_tweets, m.real_mean_tweets, abs(m.fake_mean_tweets - m.real_mean_tweets) AS fake_real_gap,
           n.mean_text_length, n.median_text_length, n.mean_reduction_pct
    FROM (SELECT count(*) AS total_articles,
                 CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_fake,
                 avg(CASE WHEN label = 0 THEN 100.0 ELSE 0.0 END)::DOUBLE AS pct_fake,
                 CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_real,
                 avg(CASE WHEN label = 1 THEN 100.0 ELSE 0.0 END)::DOUBLE AS pct_real,
                 count(DISTINCT source) AS n_sources,
                 avg(length(coalesce(text, ''))) AS mean_text_length,
                 quantile_cont(length(coalesce(text, '')), 0.5) AS median_text_length,
                 avg(CASE WHEN length(coalesce(text, '')) > 0 THEN
                     (length(coalesce(text, '')) - length(clean_text)) * CAST(100 AS DOUBLE) / length(coalesce(text, ''))
                     END) AS mean_reduction_pct
          FROM news_clean) n,
         (SELECT avg(tweet_count) AS mean_tweets, quantile_cont(tweet_count, 0.5) AS median_tweets,
                 min(tweet_count) AS min_tweets, max(tweet_count) AS max_tweets, stddev_samp(tweet_count) AS std_tweets,
                 avg(tweet_count) FILTER (WHERE label = 0) AS fake_mean_tweets,
                 avg(tweet_count) FILTER (WHERE label = 1) AS real_mean_tweets
          FROM metrics) m""")
def q_eda_summary(spark, d):
    news = news_clean(spark, d)
    m = M.article_metrics(news, A.raw_articles(spark, d))
    tl = F.length(F.coalesce(F.col("text"), F.lit("")))
    tc = F.col("tweet_count")
    # one pass over the article table (one row per article here: raw ids are unique)
    return m.agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.sum((F.col("label") == 0).cast("bigint")).alias("n_fake"),
        F.avg(F.when(F.col("label") == 0, 100.0).otherwise(0.0)).alias("pct_fake"),
        F.sum((F.col("label") == 1).cast("bigint")).alias("n_real"),
        F.avg(F.when(F.col("label") == 1, 100.0).otherwise(0.0)).alias("pct_real"),
        F.countDistinct("source").alias("n_sources"),
        F.avg(tc).alias("mean_tweets"), F.percentile(tc, 0.5).alias("median_tweets"),
        F.min(tc).alias("min_tweets"), F.max(tc).alias("max_tweets"), F.stddev_samp(tc).alias("std_tweets"),
        F.avg(F.when(F.col("label") == 0, tc)).alias("fake_mean_tweets"),
        F.avg(F.when(F.col("label") == 1, tc)).alias("real_mean_tweets"),
        F.avg(tl).alias("mean_text_length"),
        F.percentile(tl, 0.5).alias("median_text_length"),
        F.avg(F.when(tl > 0, (tl - F.length("clean_text")) * 100.0 / tl)).alias("mean_reduction_pct"),
    ).select("total_articles", "n_fake", "pct_fake", "n_real", "pct_real", "n_sources",
             "mean_tweets", "median_tweets", "min_tweets", "max_tweets", "std_tweets",
             "fake_mean_tweets", "real_mean_tweets",
             F.abs(F.col("fake_mean_tweets") - F.col("real_mean_tweets")).alias("fake_real_gap"),
             "mean_text_length", "median_text_length", "mean_reduction_pct")


@query("eda_combined", """
    SELECT m.news_id, CASE m.label WHEN 0 THEN 'fake' WHEN 1 THEN 'real' ELSE 'unknown' END AS label_name,
           m.source, m.tweet_count, CAST(length(coalesce(n.text, '')) AS BIGINT) AS text_length,
           CAST(length(n.clean_text) AS BIGINT) AS clean_length
    FROM metrics m LEFT JOIN news_clean n ON m.news_id = n.news_id""")
def q_eda_combined(spark, d):
    """Article metrics joined back to the article text columns (left join on news_id)."""
    m = metrics_df(spark, d).select("news_id", "label", "source", "tweet_count")
    n = news_clean(spark, d).select("news_id", "text", "clean_text")
    j = m.join(n, "news_id", "left")
    return j.select("news_id", label_name(F.col("label")).alias("label_name"), "source", "tweet_count",
                    F.length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint").alias("text_length"),
                    F.length("clean_text").cast("bigint").alias("clean_length"))
