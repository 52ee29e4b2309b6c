"""Link-analysis queries: PageRank / HITS on the interaction graph and on the
fake / real induced subgraphs (one iteration for all graphs)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import links as L
from ..operators import metrics as M
from ..session import written
from ..sources import adapters as A
from .q_graph import interaction_graph
from .registry import query, sql_view

DAMPING = 0.85
PR_MAX_ITER = 100
PR_TOL = 1e-6
HITS_MAX_ITER = 100
HITS_TOL = 1e-8
TOP_K = 50


def _graphs(spark, d, with_labels: bool):
    nodes, edges = interaction_graph(spark, d)
    gn = nodes.select(F.lit("all").alias("graph"), "node_id")
    ge = edges.select(F.lit("all").alias("graph"), "src", "dst")
    if with_labels:
        lu = G.label_users(A.tweets(spark, d), A.articles(spark, d))
        sub = G.label_subgraph(edges, lu)
        gn = gn.unionByName(lu.select(F.col("label_name").alias("graph"), F.col("user_id").alias("node_id")))
        ge = ge.unionByName(sub.select(F.col("label_name").alias("graph"), "src", "dst"))
    return gn, ge


def scores(spark, d, with_labels=False):
    gn, ge = (written(df, "graphs") for df in _graphs(spark, d, with_labels))  # both rankings read them
    pr = L.pagerank(spark, gn, ge, DAMPING, PR_MAX_ITER, PR_TOL)
    hi = L.hits(spark, gn, ge, HITS_MAX_ITER, HITS_TOL)
    return pr.join(hi, ["graph", "node_id"], "left").select(
        "graph", "node_id", "pagerank",
        F.coalesce("authority", F.lit(0.0)).alias("authority"), F.coalesce("hub", F.lit(0.0)).alias("hub"))


# ------------------------------------------------------------------------- SQL oracle

sql_view("g_nodes", """
    SELECT 'all' AS graph, node_id FROM int_nodes
    UNION ALL SELECT label_name, user_id FROM label_users_v""", ("int_nodes", "label_users_v"))
sql_view("g_edges", """
    SELECT 'all' AS graph, src, dst FROM int_edges
    UNION ALL
    SELECT lu.label_name, e.src, e.dst FROM int_edges e JOIN label_users_v lu ON e.src = lu.user_id
    WHERE EXISTS (SELECT 1 FROM label_users_v l2 WHERE l2.label_name = lu.label_name AND l2.user_id = e.dst)""",
         ("int_edges", "label_users_v"))
sql_view("pr_nodes", """
    SELECT n.graph, n.node_id, CAST(coalesce(o.outdeg, 0) AS BIGINT) AS outdeg, c.n_nodes
    FROM g_nodes n
    LEFT JOIN (SELECT graph, src AS node_id, count(*) AS outdeg FROM g_edges GROUP BY graph, src) o
      ON n.graph = o.graph AND n.node_id = o.node_id
    JOIN (SELECT graph, count(*) AS n_nodes FROM g_nodes GROUP BY graph) c ON n.graph = c.graph""",
         ("g_nodes", "g_edges"))


def _dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _register_pagerank() -> None:
    sql_view("pr_r0", "SELECT graph, node_id, 1.0 / n_nodes AS x FROM pr_nodes", ("pr_nodes",))
    for k in range(1, PR_MAX_ITER + 1):
        prev = f"pr_r{k - 1}"
        sql_view(f"pr_r{k}", f"""
            SELECT n.graph, n.node_id,
                   {_dbl(DAMPING)} * (coalesce(c.s, 0.0) + dm.dm / n.n_nodes) + {_dbl(1.0 - DAMPING)} / n.n_nodes AS x
            FROM pr_nodes n
            LEFT JOIN (SELECT e.graph, e.dst AS node_id, sum(r.x / pn.outdeg) AS s
                       FROM {prev} r JOIN pr_nodes pn ON r.graph = pn.graph AND r.node_id = pn.node_id
                       JOIN g_edges e ON e.graph = r.graph AND e.src = r.node_id
                       GROUP BY e.graph, e.dst) c ON n.graph = c.graph AND n.node_id = c.node_id
            JOIN (SELECT r.graph, sum(CASE WHEN pn.outdeg = 0 THEN r.x ELSE 0.0 END) AS dm
                  FROM {prev} r JOIN pr_nodes pn ON r.graph = pn.graph AND r.node_id = pn.node_id
                  GROUP BY r.graph) dm ON n.graph = dm.graph""", (prev, "pr_nodes", "g_edges"))
    errs = " UNION ALL ".join(
        f"SELECT a.graph, {k} AS k, sum(abs(a.x - b.x)) AS err FROM pr_r{k} a JOIN pr_r{k - 1} b "
        f"ON a.graph = b.graph AND a.node_id = b.node_id GROUP BY a.graph"
        for k in range(1, PR_MAX_ITER + 1))
    sql_view("pr_err", errs, tuple(f"pr_r{k}" for k in range(PR_MAX_ITER + 1)))
    sql_view("pr_stop", f"""
        SELECT e.graph, coalesce(min(e.k) FILTER (WHERE e.err < c.n_nodes * {_dbl(PR_TOL)}), {PR_MAX_ITER}) AS k_stop
        FROM pr_err e JOIN (SELECT DISTINCT graph, n_nodes FROM pr_nodes) c ON e.graph = c.graph
        GROUP BY e.graph""", ("pr_err", "pr_nodes"))
    alls = " UNION ALL ".join(f"SELECT graph, node_id, x, {k} AS k FROM pr_r{k}" for k in range(1, PR_MAX_ITER + 1))
    sql_view("pr_final", f"""
        SELECT a.graph, a.node_id, a.x AS pagerank FROM ({alls}) a
        JOIN pr_stop s ON a.graph = s.graph AND a.k = s.k_stop""",
             tuple(f"pr_r{k}" for k in range(1, PR_MAX_ITER + 1)) + ("pr_stop",))


def _register_hits() -> None:
    sql_view("hi_a0", """
        SELECT n.graph, n.node_id, 1.0 / c.n_nodes AS x FROM g_nodes n
        JOIN (SELECT graph, count(*) AS n_nodes FROM g_nodes GROUP BY graph) c ON n.graph = c.graph""",
             ("g_nodes",))
    for k in range(1, HITS_MAX_ITER + 1):
        prev = f"hi_a{k - 1}"
        sql_view(f"hi_a{k}", f"""
            SELECT n.graph, n.node_id,
                   CASE WHEN m.m > 0 THEN coalesce(y.y, 0.0) / m.m ELSE 0.0 END AS x
            FROM g_nodes n
            LEFT JOIN (SELECT e2.graph, e2.dst AS node_id, sum(h.h) AS y
                       FROM (SELECT e.graph, e.src AS node_id, sum(a.x) AS h FROM {prev} a
                             JOIN g_edges e ON a.graph = e.graph AND a.node_id = e.dst GROUP BY e.graph, e.src) h
                       JOIN g_edges e2 ON h.graph = e2.graph AND h.node_id = e2.src
                       GROUP BY e2.graph, e2.dst) y ON n.graph = y.graph AND n.node_id = y.node_id
            LEFT JOIN (SELECT graph, max(y) AS m FROM (
                           SELECT e2.graph, e2.dst, sum(h.h) AS y
                           FROM (SELECT e.graph, e.src AS node_id, sum(a.x) AS h FROM {prev} a
                                 JOIN g_edges e ON a.graph = e.graph AND a.node_id = e.dst GROUP BY e.graph, e.src) h
                           JOIN g_edges e2 ON h.graph = e2.graph AND h.node_id = e2.src
                           GROUP BY e2.graph, e2.dst) z GROUP BY graph) m ON n.graph = m.graph""",
                 (prev, "g_nodes", "g_edges"))
    errs = " UNION ALL ".join(
        f"SELECT a.graph, {k} AS k, sum(abs(a.x - b.x)) AS err FROM hi_a{k} a JOIN hi_a{k - 1} b "
        f"ON a.graph = b.graph AND a.node_id = b.node_id GROUP BY a.graph"
        for k in range(1, HITS_MAX_ITER + 1))
    sql_view("hi_err", errs, tuple(f"hi_a{k}" for k in range(HITS_MAX_ITER + 1)))
    sql_view("hi_stop", f"""
        SELECT graph, coalesce(min(k) FILTER (WHERE err < {_dbl(HITS_TOL)}), {HITS_MAX_ITER}) AS k_stop
        FROM hi_err GROUP BY graph""", ("hi_err",))
    alls = " UNION ALL ".join(f"SELECT graph, node_id, x, {k} AS k FROM hi_a{k}" for k in range(1, HITS_MAX_ITER + 1))
    sql_view("hi_auth", f"""
        SELECT a.graph, a.node_id, a.x AS a FROM ({alls}) a JOIN hi_stop s ON a.graph = s.graph AND a.k = s.k_stop""",
             tuple(f"hi_a{k}" for k in range(1, HITS_MAX_ITER + 1)) + ("hi_stop",))
    sql_view("hi_final", """
        SELECT b.graph, b.node_id,
               CASE WHEN t.sa > 0 THEN b.a / t.sa ELSE 0.0 END AS authority,
               CASE WHEN t.sh > 0 THEN b.h / t.sh ELSE 0.0 END AS hub
        FROM (SELECT au.graph, au.node_id, au.a, coalesce(h.h, 0.0) AS h FROM hi_auth au
              LEFT JOIN (SELECT e.graph, e.src AS node_id, sum(a.a) AS h FROM hi_auth a
                         JOIN g_edges e ON a.graph = e.graph AND a.node_id = e.dst GROUP BY e.graph, e.src) h
              ON au.graph = h.graph AND au.node_id = h.node_id) b
        JOIN (SELECT au.graph, sum(au.a) AS sa, sum(coalesce(h.h, 0.0)) AS sh FROM hi_auth au
              LEFT JOIN (SELECT e.graph, e.src AS node_id, sum(a.a) AS h FROM hi_auth a
                         JOIN g_edges e ON a.graph = e.graph AND a.node_id = e.dst GROUP BY e.graph, e.src) h
              ON au.graph = h.graph AND au.node_id = h.node_id GROUP BY au.graph) t ON b.graph = t.graph""",
             ("hi_auth", "g_edges"))


_register_pagerank()
_register_hits()
sql_view("link_scores", """
    SELECT p.graph, p.node_id, p.pagerank, coalesce(h.authority, 0.0) AS authority, coalesce(h.hub, 0.0) AS hub
    FROM pr_final p LEFT JOIN hi_final h ON p.graph = h.graph AND p.node_id = h.node_id""", ("pr_final", "hi_final"))


def _top_sql(col: str) -> str:
    return f"""
    SELECT row_number() OVER (ORDER BY {col} DESC, node_id) AS rank, node_id, {col}
    FROM link_scores WHERE graph = 'all' ORDER BY {col} DESC, node_id LIMIT {TOP_K}"""


@query("pagerank", "SELECT node_id, pagerank FROM pr_final WHERE graph = 'all'")
def q_pagerank(spark, d):
    gn, ge = _graphs(spark, d, False)
    return L.pagerank(spark, gn, ge, DAMPING, PR_MAX_ITER, PR_TOL).select("node_id", "pagerank")


@query("hits", "SELECT node_id, authority, hub FROM hi_final WHERE graph = 'all'")
def q_hits(spark, d):
    gn, ge = _graphs(spark, d, False)
    return L.hits(spark, gn, ge, HITS_MAX_ITER, HITS_TOL).select("node_id", "authority", "hub")


@query("link_all_scores", "SELECT node_id, pagerank, authority, hub FROM link_scores WHERE graph = 'all'")
def q_link_all_scores(spark, d):
    return scores(spark, d).drop("graph")


@query("link_by_label", """
    SELECT graph AS label_name, node_id, pagerank, authority, hub FROM link_scores WHERE graph <> 'all'""")
def q_link_by_label(spark, d):
    s = scores(spark, d, with_labels=True)
    return s.where(F.col("graph") != "all").withColumnRenamed("graph", "label_name")


@query("top_pagerank", _top_sql("pagerank"))
def q_top_pagerank(spark, d):
    return M.top_k(scores(spark, d), "pagerank", TOP_K, "node_id")


@query("top_authorities", _top_sql("authority"))
def q_top_authorities(spark, d):
    return M.top_k(scores(spark, d), "authority", TOP_K, "node_id")


@query("top_hubs", _top_sql("hub"))
def q_top_hubs(spark, d):
    return M.top_k(scores(spark, d), "hub", TOP_K, "node_id")
