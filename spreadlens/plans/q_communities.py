"""Community queries: components, largest-component sample, modularity,
community statistics, Louvain communities globally and per label."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import communities as CM
from ..session import cut_lineage, written
from .q_links import _graphs
from .registry import query, sql_view

SEED = 42
RESOLUTION = 1.0
LCC_SAMPLE = 100


def und_graph(spark, d, with_labels=False):
    gn, ge = _graphs(spark, d, with_labels)
    return gn, CM.undirected(ge)


def components(spark, d):
    gn, und = und_graph(spark, d)
    return gn, und, CM.connected_components(spark, gn, und)


def louvain(spark, d, with_labels=False):
    gn, und = (written(df, "graphs") for df in und_graph(spark, d, with_labels))  # read by the communities and by what is told of them
    return gn, und, CM.louvain(spark, gn, und, RESOLUTION)


sql_view("und", "SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM int_edges", ("int_edges",))
sql_view("cc", """
    SELECT a AS node_id, min(b) AS component FROM (
        WITH RECURSIVE reach(a, b) AS (
            SELECT node_id, node_id FROM int_nodes
            UNION
            SELECT r.a, e.b FROM reach r
            JOIN (SELECT u AS a, v AS b FROM und UNION SELECT v, u FROM und) e ON r.b = e.a)
        SELECT a, b FROM reach) x
    GROUP BY a""", ("int_nodes", "und"))
sql_view("cc_part", "SELECT node_id, component AS community_id FROM cc", ("cc",))
sql_view("deg", """
    SELECT n.node_id, CAST(coalesce(d.deg, 0) AS BIGINT) AS deg FROM int_nodes n LEFT JOIN (
        SELECT node_id, count(*) AS deg FROM (SELECT u AS node_id FROM und UNION ALL SELECT v FROM und) x
        GROUP BY node_id) d ON n.node_id = d.node_id""", ("int_nodes", "und"))
sql_view("cc_internal", """
    SELECT pu.community_id, count(*) AS l_c FROM und e
    JOIN cc_part pu ON e.u = pu.node_id JOIN cc_part pv ON e.v = pv.node_id
    WHERE pu.community_id = pv.community_id GROUP BY pu.community_id""", ("und", "cc_part"))


@query("connected_components", "SELECT node_id, component FROM cc")
def q_connected_components(spark, d):
    return components(spark, d)[2].select("node_id", "component")


@query("lcc_sample", f"""
    SELECT e.u, e.v FROM und e
    WHERE e.u IN (SELECT node_id FROM s) AND e.v IN (SELECT node_id FROM s)""".replace(
    "FROM s", f"""FROM (SELECT node_id FROM cc WHERE component = (
            SELECT component FROM cc GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)
        ORDER BY md5(concat_ws('|', '{SEED}', CAST(node_id AS VARCHAR))), node_id LIMIT {LCC_SAMPLE}) s"""))
def q_lcc_sample(spark, d):
    gn, und, comps = components(spark, d)
    _, e = CM.largest_component_sample(gn, und, comps, LCC_SAMPLE, SEED)
    return e.select("u", "v")


@query("modularity", """
    SELECT sum(coalesce(i.l_c, 0) / m.m - power(d.d_c / (2.0 * m.m), 2)) AS modularity
    FROM (SELECT p.community_id, sum(g.deg) AS d_c FROM cc_part p JOIN deg g ON p.node_id = g.node_id
          GROUP BY p.community_id) d
    LEFT JOIN cc_internal i ON d.community_id = i.community_id
    CROSS JOIN (SELECT count(*) AS m FROM und) m""")
def q_modularity(spark, d):
    gn, und, comps = components(spark, d)
    part = comps.withColumnRenamed("component", "community_id")
    return CM.modularity(gn, und, part, RESOLUTION).select("modularity")


@query("community_stats", """
    SELECT s.community_id, s.size, CAST(coalesce(i.l_c, 0) AS BIGINT) AS num_edges,
           CASE WHEN s.size > 1 THEN 2.0 * coalesce(i.l_c, 0) / (s.size * (s.size - 1)) ELSE 0.0 END AS density,
           2.0 * coalesce(i.l_c, 0) / s.size AS avg_degree
    FROM (SELECT community_id, count(*) AS size FROM cc_part GROUP BY community_id) s
    LEFT JOIN cc_internal i ON s.community_id = i.community_id""")
def q_community_stats(spark, d):
    gn, und, comps = components(spark, d)
    part = comps.withColumnRenamed("component", "community_id")
    return CM.community_stats(gn, und, part).drop("graph")


@query("communities")
def q_communities(spark, d):
    return louvain(spark, d)[2].select("node_id", "community_id")


def _summary(spark, d, with_labels):
    gn, und, part = louvain(spark, d, with_labels)
    part = cut_lineage(part)
    q = CM.modularity(gn, und, part, RESOLUTION)
    sizes = part.groupBy("graph", "community_id").agg(F.count(F.lit(1)).alias("size"))
    s = sizes.groupBy("graph").agg(F.count(F.lit(1)).alias("n_communities"), F.max("size").alias("largest_size"))
    return s.join(q, "graph")


@query("community_summary")
def q_community_summary(spark, d):
    return _summary(spark, d, False).drop("graph")


@query("communities_by_label")
def q_communities_by_label(spark, d):
    return _summary(spark, d, True).where(F.col("graph") != "all").withColumnRenamed("graph", "label_name")


@query("top_communities")
def q_top_communities(spark, d):
    gn, und, part = louvain(spark, d)
    st = CM.community_stats(gn, und, part)
    return (st.orderBy(F.col("size").desc(), F.col("community_id").asc()).limit(20)
            .select("community_id", "size", "num_edges", "density", "avg_degree"))


LABEL_ROUNDS = 3

sql_view("und_adj", "SELECT u AS a, v AS b FROM und WHERE u <> v UNION ALL SELECT v, u FROM und WHERE u <> v", ("und",))
sql_view("labels0", "SELECT node_id, node_id AS c FROM int_nodes", ("int_nodes",))
for _k in range(LABEL_ROUNDS):
    sql_view(f"labels{_k + 1}", f"""
        SELECT node_id, c FROM (
            SELECT node_id, c, row_number() OVER (PARTITION BY node_id ORDER BY count(*) DESC, c) AS r FROM (
                SELECT e.a AS node_id, l.c FROM und_adj e JOIN labels{_k} l ON l.node_id = e.b
                UNION ALL SELECT node_id, c FROM labels{_k}) x
            GROUP BY node_id, c) y
        WHERE r = 1""", ("und_adj", f"labels{_k}"))


@query("label_communities", f"SELECT node_id, c AS community_id FROM labels{LABEL_ROUNDS}")
def q_label_communities(spark, d):
    """Label propagation on the interaction graph, three rounds (fewer if labels stand still or swap, which the rounds after would repeat)."""
    gn, und = und_graph(spark, d)
    return CM.label_propagation(gn, und, LABEL_ROUNDS).select("node_id", "community_id")


def louvain_faults(adj, part, nodes):
    """Counts that are zero for a right partition: nodes without a community, communities not named by their smallest
    member, parts of communities beyond the first, vertices that would gain by moving alone."""
    comm = (part.select("graph", F.col("node_id").alias("a"), F.col("community_id").alias("c"))
            .join(adj.groupBy("graph", "a").agg(F.sum("w").alias("k")), ["graph", "a"])
            .join(adj.groupBy("graph").agg(F.sum("w").alias("two_m")), "graph"))
    comm = written(comm, "communities")
    counts = [
        nodes.select("graph", "node_id").distinct().join(part, ["graph", "node_id"], "left_anti").agg(F.count(F.lit(1)).alias("uncovered")),
        part.groupBy("graph", "community_id").agg(F.min("node_id").alias("least")).agg(F.count_if(F.col("least") != F.col("community_id")).alias("misnamed")),
        CM.connected_parts(adj, comm).select("graph", "c").distinct().agg(F.count(F.lit(1)).alias("parts")),
        comm.select("graph", "c").distinct().agg(F.count(F.lit(1)).alias("whole")),
        CM.best_moves(adj, comm, RESOLUTION).agg(F.count(F.lit(1)).alias("gaining")),
    ]
    out = nodes.select("graph", "node_id").distinct().agg(F.count(F.lit(1)).alias("n_nodes"))
    for one in counts:
        out = out.crossJoin(one)  # one row each
    return out.select("n_nodes", "uncovered", "misnamed", (F.col("parts") - F.col("whole")).alias("split"), "gaining")


@query("community_faults", """
    SELECT count(*) AS n_nodes, CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS misnamed, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS gaining
    FROM int_nodes""")
def q_community_faults(spark, d):
    """What must hold of ``communities`` whatever partition is found (see ``louvain_faults``)."""
    gn, und, part = louvain(spark, d)
    part = written(part, "communities")
    return louvain_faults(cut_lineage(CM.adjacency(und)), part, gn)
