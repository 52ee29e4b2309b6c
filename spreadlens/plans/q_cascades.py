"""Diffusion queries (ICM / LT over all articles) and the fake-vs-real comparisons.

Oracle SQL unrolls the frontier expansion step by step (materialised CTEs);
after the last new activation each further step is empty, so the unrolled
form equals the loop that stops early.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_key, sql_md5_u32, sql_mix_unit
from ..operators import cascades as C
from ..operators import graph as G
from ..operators import metrics as M
from ..operators.reach import EDGES
from ..session import written
from ..sources import adapters as A
from .q_graph import interaction_graph
from .q_profile import box_sql, hist_sql
from .registry import query, sql_view

SEED = 42
MAX_STEPS = 50
P_DEFAULT = 0.1
P_SUBCRITICAL = 0.02
SAMPLE_SIZE = 200


# ----------------------------------------------------------------------------- Spark side

def seeds_and_graph(spark, d):
    tw = A.tweets(spark, d)
    nodes, edges = interaction_graph(spark, d)
    return C.diffusion_seeds(tw, nodes), nodes, edges


def written_graph(spark, d):
    """Seeds, nodes and edges (src, dst); the graph is read several times, but the as-of join behind it is made once."""
    tw = A.tweets(spark, d)
    edges = written(G.interaction_edges(A.interactions(spark, d, tweets_df=tw)).select("src", "dst"), "edges")
    nodes = written(G.interaction_nodes(tw, edges), "users")
    return C.diffusion_seeds(tw, nodes), nodes, edges


def icm(spark, d, p):
    seeds, _, edges = written_graph(spark, d)
    return C.icm_activation(spark, edges, seeds, p=p, max_steps=MAX_STEPS, seed=SEED, in_task=EDGES)


def lt(spark, d, distribution="uniform"):
    seeds, nodes, edges = written_graph(spark, d)
    return C.lt_activation(spark, edges, nodes, seeds, distribution=distribution, max_steps=MAX_STEPS, seed=SEED, in_task=EDGES)


def icm_metrics(spark, d, p=P_DEFAULT):
    # a row for each article, written since most comparisons read them more than once
    return written(C.cascade_metrics(icm(spark, d, p), A.articles(spark, d)), "metrics")


def lt_metrics(spark, d):
    return C.cascade_metrics(lt(spark, d), A.articles(spark, d))


# ------------------------------------------------------------------------------- SQL side

sql_view("seeds", """
    SELECT DISTINCT article_id, user_id AS node_id FROM tweets WHERE user_id IN (SELECT node_id FROM int_nodes)""",
         ("tweets", "int_nodes"))
sql_view("edge_salt", f"""
    SELECT src, dst, {sql_md5_u32(sql_key(str(SEED), 'src', 'dst'))} AS edge_salt FROM int_edges""", ("int_edges",))
sql_view("article_salt", f"""
    SELECT DISTINCT article_id, {sql_md5_u32(sql_key(str(SEED), 'article_id'))} AS article_salt FROM seeds""",
         ("seeds",))
sql_view("lt_thr", f"""
    SELECT n.node_id, 0.1 + {0.5 - 0.1!r} * ({sql_md5_u32(sql_key(str(SEED), 'n.node_id'))} / 4294967296.0) AS threshold,
           d.indeg
    FROM int_nodes n JOIN (SELECT dst AS node_id, count(*) AS indeg FROM int_edges GROUP BY dst) d
      ON n.node_id = d.node_id""", ("int_nodes", "int_edges"))


def _register_icm(prefix: str, p: float) -> str:
    sql_view(f"{prefix}_a0", "SELECT article_id, node_id, 0 AS step FROM seeds", ("seeds",))
    for t in range(1, MAX_STEPS + 1):
        prev = f"{prefix}_a{t - 1}"
        sql_view(f"{prefix}_a{t}", f"""
            SELECT * FROM {prev} UNION ALL
            SELECT DISTINCT f.article_id, e.dst AS node_id, {t} AS step
            FROM {prev} f JOIN article_salt s ON f.article_id = s.article_id JOIN edge_salt e ON f.node_id = e.src
            WHERE f.step = {t - 1} AND {sql_mix_unit('s.article_salt', 'e.edge_salt')} < {p!r}
              AND NOT EXISTS (SELECT 1 FROM {prev} x WHERE x.article_id = f.article_id AND x.node_id = e.dst)""",
                 (prev, "article_salt", "edge_salt"))
    return f"{prefix}_a{MAX_STEPS}"


def _register_lt(prefix: str) -> str:
    sql_view(f"{prefix}_a0", "SELECT article_id, node_id, 0 AS step FROM seeds", ("seeds",))
    for t in range(1, MAX_STEPS + 1):
        prev = f"{prefix}_a{t - 1}"
        sql_view(f"{prefix}_a{t}", f"""
            SELECT * FROM {prev} UNION ALL
            SELECT c.article_id, c.node_id, {t} AS step
            FROM (SELECT a.article_id, e.dst AS node_id, count(*) AS cnt
                  FROM {prev} a JOIN int_edges e ON a.node_id = e.src GROUP BY a.article_id, e.dst) c
            JOIN lt_thr th ON c.node_id = th.node_id
            WHERE c.cnt / th.indeg >= th.threshold
              AND NOT EXISTS (SELECT 1 FROM {prev} x WHERE x.article_id = c.article_id AND x.node_id = c.node_id)""",
                 (prev, "int_edges", "lt_thr"))
    return f"{prefix}_a{MAX_STEPS}"


ICM_ACT = _register_icm("icm", P_DEFAULT)
ICM02_ACT = _register_icm("icmlow", P_SUBCRITICAL)
LT_ACT = _register_lt("ltu")


def _metrics_view(name: str, act: str) -> None:
    sql_view(name, f"""
        SELECT m.article_id,
               coalesce(CASE a.label WHEN 0 THEN 'fake' WHEN 1 THEN 'real' ELSE 'unknown' END, 'unknown') AS label,
               m.cascade_size, m.cascade_depth, m.max_width,
               CASE WHEN m.cascade_depth > 0 THEN m.cascade_size / m.cascade_depth
                    ELSE CAST(m.cascade_size AS DOUBLE) END AS avg_spread_rate,
               m.time_to_max_width, m.cascade_depth AS total_time_steps
        FROM (SELECT article_id, CAST(sum(width) AS BIGINT) AS cascade_size, CAST(max(step) AS BIGINT) AS cascade_depth,
                     CAST(max(width) AS BIGINT) AS max_width,
                     CAST(arg_max(step, width * 1000 - step) AS BIGINT) AS time_to_max_width
              FROM (SELECT article_id, step, count(*) AS width FROM {act} GROUP BY article_id, step) w
              GROUP BY article_id) m
        LEFT JOIN articles a ON m.article_id = a.news_id""", (act, "articles"))


_metrics_view("icm_metrics", ICM_ACT)
_metrics_view("icmlow_metrics", ICM02_ACT)
_metrics_view("lt_metrics", LT_ACT)

METRIC_COLS = ("article_id, label, cascade_size, cascade_depth, max_width, avg_spread_rate, "
               "time_to_max_width, total_time_steps")


def _compare_sql(view: str) -> str:
    return f"""
    SELECT l.label, CAST(coalesce(s.count, 0) AS BIGINT) AS count, s.avg_cascade_size, s.std_cascade_size,
           s.avg_cascade_depth, s.std_cascade_depth, s.avg_max_width, s.std_max_width,
           s.avg_spread_rate, s.std_spread_rate, s.median_cascade_size, s.median_cascade_depth,
           s.max_cascade_size, s.max_cascade_depth
    FROM (SELECT 'fake' AS label UNION ALL SELECT 'real') l LEFT JOIN (
        SELECT label, count(*) AS count,
               avg(cascade_size) AS avg_cascade_size, stddev_samp(cascade_size) AS std_cascade_size,
               avg(cascade_depth) AS avg_cascade_depth, stddev_samp(cascade_depth) AS std_cascade_depth,
               avg(max_width) AS avg_max_width, stddev_samp(max_width) AS std_max_width,
               avg(avg_spread_rate) AS avg_spread_rate, stddev_samp(avg_spread_rate) AS std_spread_rate,
               quantile_cont(cascade_size, 0.5) AS median_cascade_size,
               quantile_cont(cascade_depth, 0.5) AS median_cascade_depth,
               max(cascade_size) AS max_cascade_size, max(cascade_depth) AS max_cascade_depth
        FROM {view} WHERE label IN ('fake', 'real') GROUP BY label) s ON l.label = s.label"""


sql_view("model_cmp", """
    SELECT model, label, count(*) AS count, avg(cascade_size) AS avg_cascade_size,
           avg(cascade_depth) AS avg_cascade_depth, avg(max_width) AS avg_max_width,
           avg(avg_spread_rate) AS avg_spread_rate, quantile_cont(cascade_size, 0.5) AS median_cascade_size
    FROM (SELECT 'ICM' AS model, * FROM icm_metrics UNION ALL SELECT 'LT' AS model, * FROM lt_metrics) x
    WHERE label IN ('fake', 'real') GROUP BY model, label""", ("icm_metrics", "lt_metrics"))
sql_view("icm_cmp", _compare_sql("icm_metrics"), ("icm_metrics",))


# --------------------------------------------------------------------------------- queries

@query("diffusion_seeds", "SELECT article_id, node_id FROM seeds")
def q_diffusion_seeds(spark, d):
    return seeds_and_graph(spark, d)[0]


@query("icm_activation", f"SELECT article_id, node_id, CAST(step AS INTEGER) AS step FROM {ICM_ACT}")
def q_icm_activation(spark, d):
    return icm(spark, d, P_DEFAULT)


@query("icm_activation_p02", f"SELECT article_id, node_id, CAST(step AS INTEGER) AS step FROM {ICM02_ACT}")
def q_icm_activation_p02(spark, d):
    return icm(spark, d, P_SUBCRITICAL)


@query("lt_activation", f"SELECT article_id, node_id, CAST(step AS INTEGER) AS step FROM {LT_ACT}")
def q_lt_activation(spark, d):
    return lt(spark, d)


@query("cascade_metrics", f"SELECT {METRIC_COLS} FROM icm_metrics")
def q_cascade_metrics(spark, d):
    return icm_metrics(spark, d)


@query("cascade_metrics_p02", f"SELECT {METRIC_COLS} FROM icmlow_metrics")
def q_cascade_metrics_p02(spark, d):
    return icm_metrics(spark, d, P_SUBCRITICAL)


@query("cascade_metrics_lt", f"SELECT {METRIC_COLS} FROM lt_metrics")
def q_cascade_metrics_lt(spark, d):
    return lt_metrics(spark, d)


@query("cascade_compare", "SELECT * FROM icm_cmp")
def q_cascade_compare(spark, d):
    return C.compare_fake_real(icm_metrics(spark, d))


@query("cascade_compare_p02", _compare_sql("icmlow_metrics"))
def q_cascade_compare_p02(spark, d):
    return C.compare_fake_real(icm_metrics(spark, d, P_SUBCRITICAL))


def _model_cmp(spark, d):
    return C.compare_models({"ICM": icm_metrics(spark, d), "LT": lt_metrics(spark, d)})


@query("model_compare", "SELECT * FROM model_cmp")
def q_model_compare(spark, d):
    return _model_cmp(spark, d)


@query("model_compare_pivot", """
    SELECT label, first(avg_cascade_size) FILTER (WHERE model = 'ICM') AS "ICM",
           first(avg_cascade_size) FILTER (WHERE model = 'LT') AS "LT"
    FROM model_cmp GROUP BY label""")
def q_model_compare_pivot(spark, d):
    return C.pivot_models(_model_cmp(spark, d))


@query("cascade_compare_norm", """
    SELECT label, metric, value,
           CASE WHEN max(value) OVER (PARTITION BY metric) > 0 THEN value / max(value) OVER (PARTITION BY metric)
                ELSE 0.0 END AS normalized
    FROM (UNPIVOT (SELECT label, avg_cascade_size, avg_cascade_depth, avg_max_width, avg_spread_rate FROM icm_cmp)
          ON avg_cascade_size, avg_cascade_depth, avg_max_width, avg_spread_rate
          INTO NAME metric VALUE value) u""")
def q_cascade_compare_norm(spark, d):
    return C.normalized_comparison(C.compare_fake_real(icm_metrics(spark, d)))


@query("cascade_size_hist", hist_sql("cascade_size", "icm_metrics", "label", 30, "label IN ('fake', 'real')"))
def q_cascade_size_hist(spark, d):
    m = icm_metrics(spark, d).where(F.col("label").isin("fake", "real"))
    return M.histogram(m, "cascade_size", "label", 30)


@query("cascade_box_by_label", box_sql("cascade_size", "icm_metrics", "label",
                                       "label IN ('fake', 'real') AND cascade_size > 0"))
def q_cascade_box_by_label(spark, d):
    m = icm_metrics(spark, d).where(F.col("label").isin("fake", "real"))
    return M.box_stats(m, "cascade_size", "label", positive_only=True)


@query("sample_articles", f"""
    SELECT news_id, CASE label WHEN 0 THEN 'fake' WHEN 1 THEN 'real' ELSE 'unknown' END AS label_name
    FROM articles ORDER BY md5(concat_ws('|', '{SEED}', news_id)), news_id LIMIT {SAMPLE_SIZE}""")
def q_sample_articles(spark, d):
    from ..functions.text import label_name
    s = C.sample_articles(A.articles(spark, d).select("news_id", "label"), SAMPLE_SIZE, SEED)
    return s.select("news_id", label_name(F.col("label")).alias("label_name"))


@query("cascade_metrics_sample", f"""
    SELECT {METRIC_COLS} FROM icm_metrics WHERE article_id IN (
        SELECT news_id FROM articles ORDER BY md5(concat_ws('|', '{SEED}', news_id)), news_id LIMIT {SAMPLE_SIZE})""")
def q_cascade_metrics_sample(spark, d):
    """The reference's sampled run: ICM over a seeded sample of articles."""
    arts = A.articles(spark, d)
    sample = C.sample_articles(arts.select("news_id"), SAMPLE_SIZE, SEED)
    seeds, _, edges = written_graph(spark, d)
    seeds = seeds.join(sample.withColumnRenamed("news_id", "article_id"), "article_id", "left_semi")
    act = C.icm_activation(spark, edges, seeds, p=P_DEFAULT, max_steps=MAX_STEPS, seed=SEED, in_task=EDGES)
    return C.cascade_metrics(act, arts)
