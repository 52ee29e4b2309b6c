"""Connected components, modularity, community statistics, modularity
communities and label propagation, all keyed by ``graph`` so several graphs
(global, fake, real) run in the same rounds.

Graphs are treated as undirected (u <= v, one row per pair).  The modularity
communities are level-synchronous: rounds of moves that cannot spoil one
another run until no vertex gains by moving, communities are split into
connected parts and contracted into vertices (internal weight becomes a
self-loop), and the next level starts.  Every round is a few joins and
group-bys over the edge list; the driver sees one number per graph and round.
Graphs whose pairs one task can hold take the same rounds there (see ``settled``).
"""
from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, written
from . import settled
from .buckets import BucketedTable
from .components import contract
from .intask import fits


def undirected(edges: DataFrame) -> DataFrame:
    """(graph, u, v) with u <= v, one row per unordered pair."""
    return (edges.select("graph", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
            .distinct())


def _both_ways(und: DataFrame) -> DataFrame:
    return (und.select("graph", F.col("u").alias("a"), F.col("v").alias("b"))
            .unionAll(und.where(F.col("u") != F.col("v")).select("graph", F.col("v").alias("a"), F.col("u").alias("b"))))


def connected_components(spark: SparkSession, nodes: DataFrame, und: DataFrame) -> DataFrame:
    """(graph, node_id, component): component = smallest node id reachable.

    Contraction with pointer jumping: rounds grow with the logarithm of the
    number of nodes and end when no edge is left."""
    at = lambda c: F.struct(F.col("graph").alias("graph"), F.col(c).alias("node_id"))
    comp = contract(und.select(at("u").alias("src"), at("v").alias("dst")))
    comp = comp.select(F.col("node.graph").alias("graph"), F.col("node.node_id").alias("node_id"),
                       F.col("component.node_id").alias("component"))
    return (nodes.select("graph", "node_id").join(comp, ["graph", "node_id"], "left")
            .select("graph", "node_id", F.coalesce("component", "node_id").alias("component")))



def largest_component_sample(nodes: DataFrame, und: DataFrame, comps: DataFrame, n: int,
                             seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Nodes of the largest component (ties: smallest id), a seeded sample of ``n``
    of them, and the subgraph they induce: (sample_nodes, sample_edges)."""
    sizes = comps.groupBy("graph", "component").agg(F.count(F.lit(1)).alias("size"))
    big = sizes.groupBy("graph").agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("component"))
    members = comps.join(big, ["graph", "component"], "left_semi")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("node_id").cast("string")))
    sample = members.select("graph", "node_id").limit(0)
    for g in sorted(r["graph"] for r in big.select("graph").collect()):  # one row for each graph
        # a limit keeps n rows in each task before they meet
        sample = sample.unionByName(members.where(F.col("graph") == g).orderBy(key, "node_id").limit(n).select("graph", "node_id"))
    e = (und.join(sample.withColumnRenamed("node_id", "u"), ["graph", "u"], "left_semi")
         .join(sample.withColumnRenamed("node_id", "v"), ["graph", "v"], "left_semi"))
    return sample, e.select("graph", "u", "v")


def _degrees(nodes: DataFrame, und: DataFrame) -> DataFrame:
    ends = (und.select("graph", F.col("u").alias("node_id"))
            .unionAll(und.select("graph", F.col("v").alias("node_id"))))
    deg = ends.groupBy("graph", "node_id").agg(F.count(F.lit(1)).alias("deg"))
    return (nodes.select("graph", "node_id").join(deg, ["graph", "node_id"], "left")
            .select("graph", "node_id", F.coalesce("deg", F.lit(0)).cast("bigint").alias("deg")))


def modularity(nodes: DataFrame, und: DataFrame, partition: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(graph, modularity) = sum_c [L_c / m - gamma (d_c / 2m)^2], unweighted."""
    part = partition.select("graph", "node_id", "community_id")
    m = und.groupBy("graph").agg(F.count(F.lit(1)).alias("m"))
    internal = (und.join(part.withColumnRenamed("node_id", "u").withColumnRenamed("community_id", "cu"), ["graph", "u"])
                .join(part.withColumnRenamed("node_id", "v").withColumnRenamed("community_id", "cv"), ["graph", "v"])
                .where(F.col("cu") == F.col("cv"))
                .groupBy("graph", F.col("cu").alias("community_id")).agg(F.count(F.lit(1)).alias("l_c")))
    dsum = (_degrees(nodes, und).join(part, ["graph", "node_id"])
            .groupBy("graph", "community_id").agg(F.sum("deg").alias("d_c")))
    per = (dsum.join(internal, ["graph", "community_id"], "left").join(m, "graph")
           .select("graph", (F.coalesce("l_c", F.lit(0)) / F.col("m")
                             - F.lit(gamma) * F.pow(F.col("d_c") / (2.0 * F.col("m")), 2)).alias("q")))
    return per.groupBy("graph").agg(F.sum("q").alias("modularity"))


def community_stats(nodes: DataFrame, und: DataFrame, partition: DataFrame) -> DataFrame:
    """(graph, community_id, size, num_edges, density, avg_degree) of each community's induced subgraph."""
    part = partition.select("graph", "node_id", "community_id")
    size = part.groupBy("graph", "community_id").agg(F.count(F.lit(1)).alias("size"))
    internal = (und.join(part.withColumnRenamed("node_id", "u").withColumnRenamed("community_id", "cu"), ["graph", "u"])
                .join(part.withColumnRenamed("node_id", "v").withColumnRenamed("community_id", "cv"), ["graph", "v"])
                .where(F.col("cu") == F.col("cv"))
                .groupBy("graph", F.col("cu").alias("community_id")).agg(F.count(F.lit(1)).alias("num_edges")))
    s = size.join(internal, ["graph", "community_id"], "left").withColumn(
        "num_edges", F.coalesce("num_edges", F.lit(0)).cast("bigint"))
    n = F.col("size")
    return s.select("graph", "community_id", F.col("size").cast("bigint").alias("size"), "num_edges",
                    F.when(n > 1, 2.0 * F.col("num_edges") / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density"),
                    (2.0 * F.col("num_edges") / n).alias("avg_degree"))


def adjacency(und: DataFrame) -> DataFrame:
    """Symmetric entries (graph, a, b, w) of (graph, u, v[, w]); a self-loop is one entry that counts twice,
    so strengths and twice the total weight are plain sums."""
    w = F.col("w").cast("double") if "w" in und.columns else F.lit(1.0)
    rows = und.select("graph", "u", "v", w.alias("w"))
    loop = F.col("u") == F.col("v")
    return (rows.select("graph", F.col("u").alias("a"), F.col("v").alias("b"), F.when(loop, 2.0 * F.col("w")).otherwise(F.col("w")).alias("w"))
            .unionAll(rows.where(~loop).select("graph", F.col("v").alias("a"), F.col("u").alias("b"), "w")))


def _gains():
    return (F.col("to") != F.col("c")) & (F.col("delta") > 0)


def _state(adj: DataFrame, comm: DataFrame, gamma: float) -> DataFrame:
    """(graph, a, c, k, two_m, big, w_cur, to, dw, delta): every vertex with its community's strength, its weight to it and its best move.

    The strengths come with the communities, so the entries are read once, and are
    not moved where they lie by ``a`` and the vertices can be broadcast.
    """
    total = comm.groupBy("graph", "c").agg(F.sum("k").alias("big"))
    at = written(comm.join(total, ["graph", "c"]).select("graph", "a", "c", "k", "two_m", "big"), "communities")
    to = at.select("graph", F.col("a").alias("b"), F.col("c").alias("to"), F.col("big").alias("big_to"))
    w = (adj.where(F.col("a") != F.col("b")).join(to, ["graph", "b"]).groupBy("graph", "a", "to")
         .agg(F.sum("w").alias("w"), F.max("big_to").alias("big_to")))
    stays = F.col("to") == F.col("c")
    near = at.join(w, ["graph", "a"], "left").groupBy("graph", "a", "c", "k", "two_m", "big").agg(
        F.coalesce(F.max(F.when(stays, F.col("w"))), F.lit(0.0)).alias("w_cur"),
        F.max_by(F.struct("to", "w", "big_to"), F.struct(
            F.when(stays, F.lit(float("-inf"))).otherwise(F.col("two_m") * F.col("w") - gamma * F.col("k") * F.col("big_to")), -F.col("to"))).alias("m"))
    dw = F.col("m.w") - F.col("w_cur")
    return near.select("graph", "a", "c", "k", "two_m", "big", "w_cur", F.col("m.to").alias("to"), dw.alias("dw"),
                       (F.col("two_m") * dw - gamma * F.col("k") * (F.col("m.big_to") - F.col("big") + F.col("k"))).alias("delta"))


def best_moves(adj: DataFrame, comm: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(graph, a, cur, to, k, dw, delta) for every vertex that gains by moving alone to a neighbour's community.

    ``comm`` is (graph, a, c, k, two_m).  delta is two_m^2 / 2 times the gain in
    modularity: whole numbers for whole weights and gamma = 1, so a gain is told
    from none exactly below 2^53.  The largest gain counts, ties to the smallest
    community.
    """
    return _moves(_state(adj, comm, gamma))


def _moves(state: DataFrame) -> DataFrame:
    return state.where(_gains()).select("graph", "a", F.col("c").alias("cur"), "to", "k", "dw", "delta")


def _apart(adj: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves of which no two are neighbours: those that gain more than every moving neighbour (ties: the smaller vertex)."""
    here = moves.select("graph", "a", F.struct("delta", -F.col("a")).alias("mine"))
    there = moves.select("graph", F.col("a").alias("b"), F.struct("delta", -F.col("a")).alias("theirs"))
    beaten = (adj.where(F.col("a") != F.col("b")).join(here, ["graph", "a"]).join(there, ["graph", "b"])
              .where(F.col("theirs") > F.col("mine")).select("graph", "a").distinct())
    return moves.join(beaten, ["graph", "a"], "left_anti")


def _moved(comm: DataFrame, moves: DataFrame) -> DataFrame:
    return comm.select("graph", "a", "c", "k", "two_m").join(moves.select("graph", "a", "to"), ["graph", "a"], "left").select("graph", "a", F.coalesce("to", "c").alias("c"), "k", "two_m")


def _told(state: DataFrame, loops: dict[str, float], gamma: float) -> tuple[dict[str, float], set[str]]:
    """two_m^2 times the modularity of each graph (exact for whole weights and gamma = 1 below 2^53), and the graphs
    in which a vertex gains by moving; ``loops`` has the weight of each graph's self-loops."""
    got = state.groupBy("graph").agg(F.max("two_m").alias("two_m"), F.sum("w_cur").alias("inside"), F.sum(F.col("k") * F.col("big")).alias("square"),
                                     F.count_if(_gains()).alias("n")).collect()  # a row for each graph
    return ({r["graph"]: r["two_m"] * (r["inside"] + loops.get(r["graph"], 0.0)) - gamma * r["square"] for r in got},
            {r["graph"] for r in got if r["n"]})


def _one_each(moves: DataFrame) -> DataFrame:
    """Moves that gain the most (ties: the smallest vertex) in both communities they touch, so no community is touched
    twice and their gains add up; the best move of all is among them."""
    order = F.struct("delta", -F.col("a"))
    ends = moves.select("graph", "a", F.explode(F.array("cur", "to")).alias("c"), order.alias("order"))
    top = ends.groupBy("graph", "c").agg(F.max_by("a", "order").alias("top"))
    both = top.select("graph", F.col("c"), F.col("top"))
    return (moves.join(both.withColumnRenamed("c", "cur").withColumnRenamed("top", "top_cur"), ["graph", "cur"])
            .join(both.withColumnRenamed("c", "to").withColumnRenamed("top", "top_to"), ["graph", "to"])
            .where((F.col("top_cur") == F.col("a")) & (F.col("top_to") == F.col("a"))).select(*moves.columns))


def settle(adj: DataFrame, comm: DataFrame, gamma: float = 1.0, seen=None) -> tuple[DataFrame, bool]:
    """Moves vertices until none gains by moving; returns comm and whether any moved.

    A round first tries half of the moves, drawn by a hash of vertex and round, all
    at once.  A graph whose modularity would not rise by that tries the moves that are no
    neighbours of one another, then one move per community, whose gains add up.
    So modularity rises in every round, no partition comes twice and the rounds end
    by themselves.  ``seen`` is called with each round's quality per graph.
    """
    loops = {r["graph"]: r["w"] for r in adj.where(F.col("a") == F.col("b")).groupBy("graph").agg(F.sum("w").alias("w")).collect()}
    state = written(_state(adj, comm, gamma), "moves")
    (quality, open_graphs), rounds = _told(state, loops, gamma), 0
    while True:
        draw = F.pmod(F.xxhash64("a", F.lit(rounds)), F.lit(2)) == 0
        rounds += 1
        chosen, done, gaining = [], set(), set()
        for pick in (lambda s: s.withColumn("c", F.when(_gains() & draw, F.col("to")).otherwise(F.col("c"))),
                     lambda s: _moved(s, _apart(adj, _moves(s))), lambda s: _moved(s, _one_each(_moves(s)))):
            if not open_graphs:
                break
            here = state.where(F.col("graph").isin(sorted(open_graphs)))
            after = written(_state(adj, pick(here).select("graph", "a", "c", "k", "two_m"), gamma), "moves")
            told, more = _told(after, loops, gamma)
            better = {g: q for g, q in told.items() if q > quality[g]}
            if better:
                quality = quality | better
                chosen.append(after.where(F.col("graph").isin(sorted(better))) if len(better) < len(told) else after)
                done, gaining, open_graphs = done | set(better), gaining | (more & set(better)), open_graphs - set(better)
        if not chosen:
            return state.select("graph", "a", "c", "k", "two_m"), rounds > 1
        if len(chosen) == 1 and len(done) == len(quality):
            state = chosen[0]
        else:
            parts = state.where(~F.col("graph").isin(sorted(done)))
            for part in chosen:
                parts = parts.unionByName(part)
            state = written(parts, "moves")
        open_graphs |= gaining
        if seen:
            seen(quality)


def connected_parts(adj: DataFrame, comm: DataFrame) -> DataFrame:
    """comm with every community split into its connected parts, named by their smallest vertex.

    Parts without an edge between them add nothing to what is inside a community but
    to its square, so a split never lowers the modularity.
    """
    side = lambda v, c: comm.select("graph", F.col("a").alias(v), F.col("c").alias(c))
    inside = (adj.where(F.col("a") < F.col("b")).join(side("a", "ca"), ["graph", "a"]).join(side("b", "cb"), ["graph", "b"]).where("ca = cb"))
    parts = connected_components(adj.sparkSession, comm.select("graph", F.col("a").alias("node_id")),
                                 inside.select("graph", F.col("a").alias("u"), F.col("b").alias("v")))
    return comm.drop("c").join(parts.select("graph", F.col("node_id").alias("a"), F.col("component").alias("c")), ["graph", "a"])


def _with_strength(adj: DataFrame, part: DataFrame | None) -> DataFrame:
    """(graph, a, c, k, two_m): each vertex its own community, or that of ``part`` (graph, a, c)."""
    k = adj.groupBy("graph", "a").agg(F.sum("w").alias("k"))
    k = k.withColumn("c", F.col("a")) if part is None else k.join(part, ["graph", "a"])
    two_m = adj.groupBy("graph").agg(F.sum("w").alias("two_m"))
    return written(k.join(two_m, "graph").select("graph", "a", "c", "k", "two_m"), "communities")


def _contracted(adj: DataFrame, part: DataFrame) -> DataFrame:
    """Adjacency of the communities (graph, a, c); what lies inside one becomes its self-loop."""
    side = lambda v, c: part.select("graph", F.col("a").alias(v), F.col("c").alias(c))
    return written(adj.join(side("a", "ca"), ["graph", "a"]).join(side("b", "cb"), ["graph", "b"])
                   .groupBy("graph", F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "communities")


def louvain(spark: SparkSession, nodes: DataFrame, und: DataFrame, gamma: float = 1.0, seen=None,
            in_task: int = settled.PAIRS) -> DataFrame:
    """(graph, node_id, community_id); community ids are the smallest member id.

    The nodes settle, communities are split into connected parts and become the
    vertices of a level that settles in turn, until a level moves nothing; then the
    nodes settle anew from there, and all ends when none of them moves.  So no node
    and no community gains by moving, and every community is connected.  There is no
    limit of rounds or levels.  A node without an edge is a community of its own.
    Graphs of at most ``in_task`` pairs are done in a task each, unless ``seen`` is
    given (see ``settle``).
    """
    part = _parts_in_tasks(und, gamma, in_task) if seen is None else None
    if part is None:
        part = _parts_in_rounds(und, gamma, seen)
    member = (nodes.select("graph", "node_id").distinct().join(part.withColumnRenamed("a", "node_id"), ["graph", "node_id"], "left")
              .select("graph", "node_id", F.coalesce("c", "node_id").alias("vertex")))
    label = member.groupBy("graph", "vertex").agg(F.min("node_id").alias("community_id"))
    return member.join(label, ["graph", "vertex"]).select("graph", "node_id", "community_id")


def _parts_in_tasks(und: DataFrame, gamma: float, most: int) -> DataFrame | None:
    """(graph, a, c) of the vertices of pairs that are long ids, none null; None if a graph is too large."""
    if {und.schema[c].dataType.simpleString() for c in "uv"} != {"bigint"}:
        return None
    pairs = written(und.select("graph", "u", "v", *(F.col("w").cast("double") for _ in range("w" in und.columns))), "pairs")
    unset = [pairs[c].isNull() for c in pairs.columns]
    if not fits(pairs, most) or not pairs.where(functools.reduce(operator.or_, unset)).isEmpty():
        return None
    return written(pairs.groupBy("graph").applyInArrow(settled.in_task(gamma), "graph string, a long, c long"), "communities")


def _parts_in_rounds(und: DataFrame, gamma: float, seen) -> DataFrame:
    entries = BucketedTable(adjacency(und), "entries", ["graph", "a"])
    base = entries.read()
    part, first = None, True
    while True:
        comm, moved = settle(base, _with_strength(base, part), gamma, seen)
        if not moved and not first:
            break
        first = False
        part = written(connected_parts(base, comm).select("graph", "a", "c"), "communities")
        adj = _contracted(base, part)
        while True:
            comm, moved = settle(adj, _with_strength(adj, None), gamma, seen)
            if not moved:
                break
            up = written(connected_parts(adj, comm).select("graph", "a", "c"), "communities")
            part = written(part.withColumnRenamed("c", "v").join(up.withColumnRenamed("a", "v"), ["graph", "v"]).select("graph", "a", "c"), "communities")
            adj = _contracted(adj, up)
    entries.drop()  # the parts are written
    return part


def label_propagation(nodes: DataFrame, und: DataFrame, rounds: int | None = None) -> DataFrame:
    """(graph, node_id, community_id) by weighted synchronous label propagation.

    Every node starts with its own id and in each round takes the label of the
    largest weight among its neighbours and itself (a weight of 1 for its own
    label, which keeps pairs from swapping labels for ever); ties go to the
    smallest label.  It ends when no label changes, when the labels of two rounds
    before come back (the labels of the round that repeats are returned), or after
    ``rounds`` rounds if given.  Longer cycles cannot occur: with symmetric weights
    synchronous majority rounds end in a cycle of one or two, ties being settled
    by a fixed order.
    """
    adj = cut_lineage(adjacency(und).where(F.col("a") != F.col("b")))
    now = written(nodes.select("graph", F.col("node_id").alias("a")).distinct().withColumn("c", F.col("a")), "labels")
    before = None
    done = 0
    while rounds is None or done < rounds:
        near = adj.join(now.select("graph", F.col("a").alias("b"), "c"), ["graph", "b"]).select("graph", "a", "c", "w")
        votes = near.unionByName(now.select("graph", "a", "c", F.lit(1.0).alias("w"))).groupBy("graph", "a", "c").agg(F.sum("w").alias("w"))
        after = written(votes.groupBy("graph", "a").agg(F.max_by("c", F.struct("w", -F.col("c"))).alias("c")), "labels")
        done += 1

        def same(x):
            return x is not None and after.join(x, ["graph", "a", "c"], "left_anti").isEmpty()
        if same(now) or same(before):
            now = after
            break
        before, now = now, after
    return now.select("graph", F.col("a").alias("node_id"), F.col("c").alias("community_id"))
