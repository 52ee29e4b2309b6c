"""Modularity communities and label propagation."""
import itertools
import random

from pyspark.sql import functions as F

from spreadlens.operators import communities as CM


def frames(spark, edges, n, graph="all"):
    und = spark.createDataFrame([(graph, min(e), max(e)) for e in edges], "graph string, u long, v long").distinct()
    return spark.createDataFrame([(graph, i) for i in range(n)], "graph string, node_id long"), und


def plain_modularity(edges, of):
    m = len(edges)
    deg = {}
    for u, v in edges:
        deg[u] = deg.get(u, 0) + 1
        deg[v] = deg.get(v, 0) + 1
    total = {}
    for v, d in deg.items():
        total[of[v]] = total.get(of[v], 0) + d
    return sum(of[u] == of[v] for u, v in edges) / m - sum((d / (2 * m)) ** 2 for d in total.values())


def test_two_triangles_and_a_lone_node(spark):
    edges = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    nodes, und = frames(spark, edges, 7)
    part = CM.louvain(spark, nodes, und)
    assert {r.node_id: r.community_id for r in part.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}
    assert abs(CM.modularity(nodes, und, part).first().modularity - 5 / 14) < 1e-12


def test_planted_partition(spark):
    """Modularity rises in every round, the planted groups come back, no single move gains, communities are connected."""
    rng = random.Random(6)
    n, groups = 60, 4
    edges = [(i, j) for i, j in itertools.combinations(range(n), 2) if rng.random() < (0.6 if i % groups == j % groups else 0.02)]
    nodes, und = frames(spark, edges, n)
    quality = []
    part = CM.louvain(spark, nodes, und, seen=lambda q: quality.append(q["all"]))
    of = {r.node_id: r.community_id for r in part.collect()}
    assert all(of[i] == i % groups for i in range(n))
    two_m = 2 * len(edges)
    start = two_m ** 2 * plain_modularity(edges, {i: i for i in range(n)})
    assert all(b > a + 1e-6 for a, b in zip([start, *quality], quality[:1] + quality[1:]) if b != a) and sorted(quality) == quality
    assert abs(quality[-1] - two_m ** 2 * plain_modularity(edges, of)) < 1e-6
    adj = CM.adjacency(und)
    k = adj.groupBy("graph", "a").agg(F.sum("w").alias("k"))
    comm = part.select("graph", F.col("node_id").alias("a"), F.col("community_id").alias("c")).join(k, ["graph", "a"]).withColumn("two_m", F.lit(float(two_m)))
    assert CM.best_moves(adj, comm).count() == 0


def test_connected_parts(spark):
    nodes, und = frames(spark, [(0, 1), (2, 3)], 4)
    adj = CM.adjacency(und)
    comm = nodes.select("graph", F.col("node_id").alias("a"), F.lit(0).cast("long").alias("c"), F.lit(1.0).alias("k"), F.lit(4.0).alias("two_m"))
    assert {r.a: r.c for r in CM.connected_parts(adj, comm).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def plain_labels(edges, n):
    near = {i: [] for i in range(n)}
    for u, v in edges:
        near[u].append(v)
        near[v].append(u)
    seen, now = [], {i: i for i in range(n)}
    while True:
        new = {}
        for i in range(n):
            votes = {now[i]: 1}
            for j in near[i]:
                votes[now[j]] = votes.get(now[j], 0) + 1
            new[i] = min(votes, key=lambda c: (-votes[c], c))
        if new == now or (seen and new == seen[-1]):
            return new
        seen.append(now)
        now = new


def test_label_propagation(spark):
    rng = random.Random(8)
    star = [(0, i) for i in range(1, 6)]
    for edges, n in ((star, 7), ([(i, i + 1) for i in range(9)], 10), (list({tuple(sorted(rng.sample(range(30), 2))) for _ in range(60)}), 30)):
        nodes, und = frames(spark, edges, n)
        got = {r.node_id: r.community_id for r in CM.label_propagation(nodes, und).collect()}
        assert got == plain_labels(edges, n)
