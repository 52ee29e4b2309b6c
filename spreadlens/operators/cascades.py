"""Per-article cascades and diffusion, all articles in one distributed job.

Diffusion is a deterministic frontier expansion keyed by (article_id, node_id):
every article advances one step per round, so the number of rounds is the
deepest cascade (<= max_steps), not articles x depth.

* Independent cascade: an edge (u, v) is *live* for an article when a hash coin
  keyed by (seed, article, u, v) falls below p; each newly active node tries
  each out-neighbour once, so the activation step of a node is its BFS level
  over the live edges from the article's seed users.
* Linear threshold: node v activates once (active in-neighbours / in-degree)
  reaches its threshold, drawn from a hash keyed by (seed, v) -- the same
  threshold for every article, as when a simulator is reseeded per article.

State: one table per round (the round's new activations), written once.  The
independent cascade keeps them packed, a row for each node and chunk of articles,
so a coin costs no row of its own.  The linear threshold keeps counts of active
in-neighbours in lists by chunk of articles and part of the nodes, and drops those
of articles that stand still; its loop's only driver value is whether anything is sent.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import md5_u32, md5_unit, mix_unit_array
from ..functions.text import label_name, parse_ids
from ..session import cut_lineage, written
from . import reach as in_tasks
from .prefix import numbered

KEY = ["article_id", "node_id"]

# --- fixed values -----------------------------------------------------------
SURROGATE_USER_BASE = 1000000
SURROGATE_USER_RANGE = 999000000
SURROGATE_BASE_DATE = "2017-01-01 00:00:00"
LT_UNIFORM_RANGE = (0.1, 0.5)
LT_NORMAL_MEAN_SD = (0.3, 0.1)
LT_NORMAL_CLIP = (0.1, 0.9)
CHUNK = 1024            # articles of one chunk
LIST = 64               # edges of one list
COINS = 2_000_000       # coins thrown at a time
PAIRS = 1_000_000       # pairs of article and node of one part of a chunk
# ---------------------------------------------------------------------------


# ----------------------------------------------------------------- user map (D9)

def user_tweet_map(raw: DataFrame, metrics: DataFrame) -> DataFrame:
    """tweet -> (surrogate user, article, label, source, timestamp).

    A tweet listed by several articles maps to the last one (highest article id, as
    a number for ids without leading zeros); article metadata is the smallest
    (label, source) of a news_id; missing -> (0, 'unknown').
    The surrogate user and time are md5-derived, hence reproducible.
    """
    pairs = raw.select(F.col("id").alias("article_id"), F.explode(parse_ids(F.col("tweet_ids"))).alias("tweet_id"))
    tweet_article = pairs.groupBy("tweet_id").agg(F.max_by("article_id", F.struct(F.length("article_id"), "article_id")).alias("article_id"))
    meta = (metrics.groupBy("news_id").agg(F.min(F.struct("label", "source")).alias("m"))
            .select(F.col("news_id").alias("article_id"), F.col("m.label").alias("label"),
                    F.col("m.source").alias("source")))
    h = md5_u32(F.col("tweet_id"))
    user = (F.lit(SURROGATE_USER_BASE) + F.pmod(h, F.lit(SURROGATE_USER_RANGE))).cast("bigint")
    days = F.pmod(h, F.lit(365)).cast("int")
    hours = F.pmod(F.floor(h / 1000), F.lit(24)).cast("int")
    minutes = F.pmod(F.floor(h / 100), F.lit(60)).cast("int")
    ts = F.expr(f"timestamp_ntz'{SURROGATE_BASE_DATE}'") + F.make_dt_interval(days, hours, minutes, F.lit(0))
    joined = tweet_article.join(meta, "article_id", "left")
    return joined.select("tweet_id", user.alias("user_id"), "article_id",
                         F.coalesce("label", F.lit(0)).alias("label"),
                         F.coalesce("source", F.lit("unknown")).alias("source"),
                         F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


# ------------------------------------------------------------- cascade graphs (D1-D3)

def cascade_edges(user_map: DataFrame, interactions: DataFrame) -> DataFrame:
    """Edges of every article's cascade: article -> user ``posts`` and user -> user
    ``retweet`` / ``reply`` whose tweet belongs to the article and whose two users
    are in the article's cascade.  One edge per (article, src, dst)."""
    posts = (user_map.groupBy("article_id", "user_id")
             .agg(F.max_by(F.struct("tweet_id", "ts"), F.struct("ts", "tweet_id")).alias("w"))
             .select("article_id", F.concat(F.lit("A_"), "article_id").alias("src"),
                     F.col("user_id").cast("string").alias("dst"), F.lit("posts").alias("edge_type"),
                     F.col("w.tweet_id").alias("tweet_id"), F.col("w.ts").alias("ts")))
    members = user_map.select("article_id", "user_id").distinct()
    ui = interactions.where(F.col("kind").isin("retweet", "reply"))
    ui = ui.join(user_map.select("article_id", "tweet_id"), ["article_id", "tweet_id"], "left_semi")
    ui = ui.join(members.withColumnRenamed("user_id", "src"), ["article_id", "src"], "left_semi")
    ui = ui.join(members.withColumnRenamed("user_id", "dst"), ["article_id", "dst"], "left_semi")
    prio = F.when(F.col("kind") == "reply", 2).otherwise(1)
    uu = (ui.groupBy("article_id", "src", "dst")
          .agg(F.max_by(F.struct(F.col("kind").alias("edge_type"), "tweet_id", "ts"),
                        F.struct(prio, "ts", "tweet_id")).alias("w"))
          .select("article_id", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"),
                  F.col("w.edge_type").alias("edge_type"), F.col("w.tweet_id").alias("tweet_id"),
                  F.col("w.ts").alias("ts")))
    return posts.unionByName(uu)


def cascade_association_edges(raw: DataFrame) -> DataFrame:
    """Fallback cascade without user data: article -> tweet ``association`` edges."""
    pairs = raw.select(F.col("id").alias("article_id"),
                       F.explode(parse_ids(F.col("tweet_ids"))).alias("tweet_id")).distinct()
    return pairs.select("article_id", F.concat(F.lit("A_"), "article_id").alias("src"),
                        F.concat(F.lit("T_"), "tweet_id").alias("dst"), F.lit("association").alias("edge_type"))


def cascades_or_association(raw: DataFrame, user_map: DataFrame, interactions: DataFrame) -> DataFrame:
    """(article_id, src, dst, edge_type): the cascade edges of the articles that ``user_map`` knows,
    ``association`` edges to the listed tweets for all others."""
    known = user_map.select("article_id").distinct()
    other = raw.join(known, raw["id"] == known["article_id"], "left_anti")
    return (cascade_edges(user_map, interactions).select("article_id", "src", "dst", "edge_type")
            .unionByName(cascade_association_edges(other)))


def cascade_summary(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """Per article: the simple summary (size = listed tweets, depth 1, width = size,
    no timestamps) plus the user counts of its cascade graph."""
    per = (edges.groupBy("article_id")
           .agg(F.sum((F.col("edge_type") == "posts").cast("bigint")).alias("n_users"),
                F.sum((F.col("edge_type") != "posts").cast("bigint")).alias("n_user_edges")))
    return (metrics.select("news_id", "tweet_count")
            .join(per.withColumnRenamed("article_id", "news_id"), "news_id", "left")
            .select("news_id", F.col("tweet_count").alias("cascade_size"),
                    F.lit(1).cast("bigint").alias("cascade_depth"),
                    F.col("tweet_count").alias("cascade_width"), F.lit(False).alias("has_timestamps"),
                    F.coalesce("n_users", F.lit(0)).cast("bigint").alias("n_users"),
                    F.coalesce("n_user_edges", F.lit(0)).cast("bigint").alias("n_user_edges")))


# ------------------------------------------------------------------ diffusion (D4-D7)

def diffusion_seeds(user_map: DataFrame, nodes: DataFrame) -> DataFrame:
    """(article_id, node_id): users of each article that are vertices of the graph."""
    seeds = user_map.select("article_id", F.col("user_id").alias("node_id")).distinct()
    return seeds.join(nodes.select("node_id"), "node_id", "left_semi").select(*KEY)


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    if direction == "out":
        return edges.select("src", "dst")
    if direction == "in":
        return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    raise ValueError("direction must be 'out' or 'in'")


def numbered_articles(spark: SparkSession, seeds: DataFrame, seed: int) -> DataFrame:
    """(article_id, chunk, pos, salt): every article's place in a chunk of at most ``CHUNK`` articles, and its salt.

    A null article, which equals no other, is alone in chunk -1.
    """
    ids = cut_lineage(seeds.select("article_id").where(F.col("article_id").isNotNull()).distinct())
    parts = max(1, math.ceil(ids.count() / CHUNK))
    # the number within the partition is in the lower 33 bits
    n = ids.repartition(parts).select("article_id", F.monotonically_increasing_id().alias("n"))
    n = n.withColumn("i", F.col("n").bitwiseAND(F.lit((1 << 33) - 1)))
    known = n.select("article_id", (F.col("n") - F.col("i") + F.floor(F.col("i") / CHUNK)).alias("chunk"),
                     F.pmod("i", F.lit(CHUNK)).cast("smallint").alias("pos"))
    none = seeds.where(F.col("article_id").isNull()).select(
        "article_id", F.lit(-1).cast("bigint").alias("chunk"), F.lit(0).cast("smallint").alias("pos")).limit(1)
    return written(known.unionByName(none).withColumn("salt", md5_u32(F.lit(seed), F.col("article_id"))), "articles")


def _tries(p: float):
    """Arrow function of a frontier joined with out-edges: for every edge that is live for some articles, their places."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        flat = lambda col: col.flatten().to_numpy(zero_copy_only=False)
        starts = lambda sizes: np.cumsum(sizes) - sizes
        for whole in batches:
            sizes = lambda name: whole.column(name).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            tries = np.cumsum(sizes("pos") * sizes("dst"))
            first = 0
            while first < whole.num_rows:  # some millions of coins at a time
                last = max(first + 1, int(np.searchsorted(tries, (tries[first - 1] if first else 0) + COINS, "right")))
                batch = whole.slice(first, last - first)
                first = last
                col = lambda name: batch.column(name)
                n_pos = col("pos").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                n_dst = col("dst").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(n_dst)), n_dst)  # of each edge
                each = n_pos[row]
                edge = np.repeat(np.arange(len(row)), each)  # of each coin
                at = np.arange(len(edge)) - starts(each)[edge] + starts(n_pos)[row][edge]
                live = np.flatnonzero(mix_unit_array(flat(col("salt"))[at], flat(col("edge_salt"))[edge]) < p)
                hits = np.bincount(edge[live], minlength=len(row))
                kept = np.flatnonzero(hits)
                places = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(hits[kept])), pa.int32()),
                                                  pa.array(flat(col("pos"))[at[live]], pa.int16()))
                yield pa.RecordBatch.from_arrays([col("dst").flatten().take(pa.array(kept)), pa.array(flat(col("part"))[kept], pa.int32()),
                                                  col("chunk").take(pa.array(row[kept])), places], ["node_id", "part", "chunk", "pos"])
    return run


def _out_edges(edges: DataFrame, seed: int) -> DataFrame:
    """(src, dst, edge_salt, part) with lists of at most about ``LIST`` out-edges a row; ``part`` deals the in-edges of a
    node with more than ``LIST`` of them to groups of about that size."""
    n_in = edges.groupBy("dst").agg(F.ceil(F.count(F.lit(1)) / LIST).alias("in_parts"))
    n_out = edges.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / LIST).alias("out_parts"))
    e = edges.join(n_in, "dst").join(n_out, "src")
    one = F.struct("dst", md5_u32(F.lit(seed), F.col("src"), F.col("dst")).alias("edge_salt"),
                   F.pmod(F.xxhash64("src"), F.col("in_parts")).cast("int").alias("part"))
    lists = e.groupBy("src", F.pmod(F.xxhash64("dst"), F.col("out_parts")).alias("p")).agg(F.collect_list(one).alias("l"))
    return written(lists.select("src", "l.dst", "l.edge_salt", "l.part"), "out_edges")


def icm_activation(spark: SparkSession, edges: DataFrame, seeds: DataFrame, p: float = 0.1,
                   max_steps: int = 50, seed: int = 42, direction: str = "out", in_task: int = 0) -> DataFrame:
    """Independent-cascade reach for every article: (article_id, node_id, step).

    A graph of at most ``in_task`` edges goes to every task, which takes the steps of its own articles
    (see ``reach``); what it finds is not written, so it is found again wherever it is read.  Else a step is a round of jobs.

    A row of a round is a node and the places of the articles of one chunk that
    reached it, two bytes each; it meets lists of out-edges, whose coins are thrown
    for all these articles together.  What a node has of a chunk already is kept in
    one row as well.  Lists and chunks are bounded, and nodes of very many in-edges
    are gathered in parts first.
    """
    if in_task:
        whole, seeds = written(_oriented(edges, direction), "edges"), written(seeds.select(*KEY).distinct(), "seeds")
        if whole.count() <= in_task:
            salted = whole.select("src", "dst", md5_u32(F.lit(seed), F.col("src"), F.col("dst")).alias("edge_salt"))
            found = in_tasks.independent(salted, seeds, p, max_steps, md5_u32(F.lit(seed), F.col("article_id")))
            return seeds.withColumn("step", F.lit(0)).union(found)
    arts = numbered_articles(spark, seeds, seed)
    salts = arts.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "salt"))).alias("l")).select("chunk", F.col("l.salt").alias("salts"))
    salts = written(salts, "salts")
    e = _out_edges(_oriented(edges, direction).where(F.col("src").isNotNull()), seed)
    found = seeds.select(*KEY).distinct().join(arts, seeds["article_id"].eqNullSafe(arts["article_id"]))
    frontier = written(found.groupBy("node_id", "chunk").agg(F.collect_list("pos").alias("pos")), "frontier")
    rounds, seen = [], None
    kind = frontier.schema["node_id"].dataType.simpleString()
    while len(rounds) <= max_steps and not frontier.isEmpty():
        rounds.append(frontier)
        if len(rounds) > max_steps:
            break
        # a null node or article equals no other, so it is never known to be reached
        news = frontier.where((F.col("chunk") >= 0) & F.col("node_id").isNotNull()).withColumnRenamed("pos", "had")
        if seen is None:
            seen = news
        else:
            seen = written(seen.unionByName(news).groupBy("node_id", "chunk").agg(F.flatten(F.collect_list("had")).alias("had")), "reached")
        sent = (frontier.join(e, frontier["node_id"] == e["src"]).join(salts, "chunk")
                .select("chunk", "pos", F.transform("pos", lambda x: F.get("salts", x.cast("int"))).alias("salt"), "dst", "edge_salt", "part"))
        hits = sent.mapInArrow(_tries(p), f"node_id {kind}, part int, chunk bigint, pos array<smallint>")
        gathered = lambda df, *by: df.groupBy(*by).agg(F.array_distinct(F.flatten(F.collect_list("pos"))).alias("pos"))
        cand = gathered(gathered(hits, "node_id", "chunk", "part"), "node_id", "chunk")
        left = F.array_except("pos", F.coalesce("had", F.array().cast("array<smallint>")))
        frontier = written(cand.join(seen, ["node_id", "chunk"], "left").select("node_id", "chunk", left.alias("pos")).where(F.size("pos") > 0), "frontier")
    out = frontier.select("node_id", "chunk", "pos", F.lit(0).alias("step")).limit(0)
    for step, part in enumerate(rounds):
        out = out.unionByName(part.select("node_id", "chunk", "pos", F.lit(step).alias("step")))
    return (out.select("node_id", "chunk", F.explode("pos").alias("pos"), "step").join(arts, ["chunk", "pos"])
            .select("article_id", "node_id", "step"))


def lt_thresholds(nodes: DataFrame, distribution: str = "uniform", seed: int = 42) -> DataFrame:
    u1 = md5_unit(F.lit(seed), F.col("node_id"))
    if distribution == "uniform":
        lo, hi = LT_UNIFORM_RANGE
        thr = F.lit(lo) + F.lit(hi - lo) * u1
    elif distribution == "normal":
        mean, sd = LT_NORMAL_MEAN_SD
        lo, hi = LT_NORMAL_CLIP
        a = (md5_u32(F.lit(seed), F.col("node_id")) + F.lit(0.5)) / F.lit(4294967296.0)
        b = md5_unit(F.lit(seed), F.col("node_id"), offset=8)
        z = F.sqrt(F.lit(-2.0) * F.log(a)) * F.cos(F.lit(2 * math.pi) * b)
        thr = F.least(F.lit(hi), F.greatest(F.lit(lo), F.lit(mean) + F.lit(sd) * z))
    else:
        raise ValueError("distribution must be 'uniform' or 'normal'")
    return nodes.select("node_id", thr.alias("threshold"))


def _need(threshold, indeg):
    """The smallest number of active in-neighbours whose share of ``indeg`` reaches ``threshold``, one at least."""
    about = F.ceil(threshold * indeg)
    return F.greatest(F.lit(1), F.when((about - 1) / indeg >= threshold, about - 1).when(about / indeg >= threshold, about).otherwise(about + 1)).cast("int")


_PLACES = "pos array<smallint>, node array<int>, cnt array<int>, need array<int>"


def _lists(sizes, *values):
    import pyarrow as pa
    ends = pa.array([0, *sizes], pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(v, kind)) for v, kind in zip(values, (pa.int16(), pa.int32(), pa.int32(), pa.int32()))]


def _deal(batches):
    """Deals lists of (article's place, node, count, need) to the parts of their chunk, one row for each part met in a batch.

    A single place or count stands for all nodes of its row; where ``live`` is given, places that are not in it go.
    """
    import numpy as np
    import pyarrow as pa
    for batch in batches:
        size = lambda name: batch.column(name).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731,B023
        flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)  # noqa: E731,B023
        n = size("node")
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - (np.cumsum(n) - n)[row]

        def each(name):
            own = size(name)
            return flat(name)[(np.cumsum(own) - own)[row] + np.where(own[row] == n[row], place, 0)]
        pos, node, cnt, need = each("pos"), flat("node"), each("cnt"), flat("need")
        chunk, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "parts"))
        n_live = size("live")
        if n_live.any():
            of = lambda r, p: r.astype(np.int64) << 16 | p
            kept = (n_live[row] == 0) | np.isin(of(row, pos), of(np.repeat(np.arange(len(n)), n_live), flat("live")))
            row, pos, node, cnt, need = (x[kept] for x in (row, pos, node, cnt, need))
        to, part = chunk[row], node % parts[row]
        order = np.lexsort((part, to))
        to, part = to[order], part[order]
        first = np.flatnonzero(np.append(True, (to[1:] != to[:-1]) | (part[1:] != part[:-1]))[:len(to)])
        yield pa.RecordBatch.from_arrays([pa.array(to[first], pa.int64()), pa.array(part[first], pa.int64()),
                                          *_lists(np.append(first, len(to))[1:], *(x[order] for x in (pos, node, cnt, need)))],
                                         ["chunk", "part", "pos", "node", "cnt", "need"])


def _tally(key, table):
    """Counts of one part of a chunk added up: the pairs that reach their need (new_pos, new_node), and all pairs; an active one needs 0."""
    import numpy as np
    import pyarrow as pa
    flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    pair, at = np.unique(flat("pos").astype(np.int64) << 32 | flat("node"), return_inverse=True)
    total = np.bincount(at, flat("cnt"), len(pair)).astype(np.int64)
    least = np.full(len(pair), np.iinfo(np.int32).max, np.int32)
    np.minimum.at(least, at, flat("need"))
    new = (least > 0) & (total >= least)
    pos, node = pair >> 32, pair & 0xFFFFFFFF
    gone = new | (least == 0)
    cols = [*_lists([int(new.sum())], pos[new], node[new]), *_lists([len(pair)], pos, node, np.where(gone, 0, total), np.where(gone, 0, least))]
    return pa.table([pa.array([key[0].as_py()], pa.int64()), *cols], ["chunk", "new_pos", "new_node", "pos", "node", "cnt", "need"])


def lt_activation(spark: SparkSession, edges: DataFrame, nodes: DataFrame, seeds: DataFrame,
                  distribution: str = "uniform", max_steps: int = 50, seed: int = 42,
                  direction: str = "out", in_task: int = 0) -> DataFrame:
    """Linear-threshold reach for every article: (article_id, node_id, step).

    A graph of at most ``in_task`` edges goes to every task, as for the independent cascade.  Else a step is a round of jobs:

    Influence of each active in-neighbour is 1 / in-degree; a node activates when
    (active in-neighbours / in-degree) reaches its threshold, so it needs a whole
    number of them, which its in-edges carry.  A round sends the out-edges of newly
    active nodes to their article's chunk, as lists of (place of the article, number
    of the node) that are dealt by node to parts of about ``PAIRS`` pairs, and adds
    them to the counts kept there.  Counts are read again only for articles that
    gained a node in the round before: the others never change again.
    """
    seeds = written(seeds.select(*KEY).distinct(), "seeds")
    oriented = _oriented(edges, direction)
    indeg = oriented.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("indeg"))
    needs = lt_thresholds(nodes, distribution, seed).join(indeg, "node_id").select(F.col("node_id").alias("dst"), _need(F.col("threshold"), F.col("indeg")).alias("need"))
    if in_task:
        whole = written(oriented.join(needs, "dst").select("src", "dst", "need"), "edges")
        if whole.count() <= in_task:
            known = seeds.where(F.col("article_id").isNotNull() & F.col("node_id").isNotNull())
            return seeds.withColumn("step", F.lit(0)).union(in_tasks.threshold(whole, known, max_steps))
    ends = oriented.select(F.col("src").alias("node_id")).union(oriented.select("dst")).where("node_id is not null").distinct()
    codes = written(numbered(ends, [F.col("node_id")], "code").select("node_id", F.col("code").cast("int").alias("code")), "nodes")
    code = lambda c: codes.select(F.col("node_id").alias(c), F.col("code").alias(f"{c}_code"))
    e = oriented.join(needs.join(code("dst"), "dst"), "dst").join(code("src"), "src").select(F.col("src_code").alias("src"), F.col("dst_code").alias("dst"), "need")
    n_out = e.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / LIST).alias("parts"))
    lists = e.join(n_out, "src").groupBy("src", F.pmod(F.xxhash64("dst"), F.col("parts")).alias("p")).agg(F.collect_list(F.struct("dst", "need")).alias("l"))
    out = written(lists.select("src", F.size("l").alias("n"), "l.dst", "l.need"), "out_edges")
    arts = numbered_articles(spark, seeds, seed)
    frontier = written(seeds.join(arts.where("chunk >= 0"), "article_id").join(codes, "node_id").select("chunk", "pos", F.col("code").alias("node")), "frontier")
    zero = F.array(F.lit(0))
    state = frontier.select("chunk", F.array("pos").alias("pos"), F.array("node").alias("node"), zero.alias("cnt"), zero.alias("need"))
    rounds, everyone = [], F.lit(None).cast("array<smallint>")
    for _t in range(max_steps):
        # how many pairs a chunk will hold, in how many parts, and its articles that go on
        sent = frontier.join(out.select("src", "n"), F.col("node") == F.col("src")).groupBy("chunk").agg(F.sum("n").alias("n"), F.collect_set("pos").alias("live"))
        held = state.groupBy("chunk").agg(F.sum(F.size("pos")).alias("held"))
        plan = written(sent.join(held, "chunk", "left").select("chunk", "live", F.ceil((F.col("n") + F.coalesce("held", F.lit(0))) / PAIRS).alias("parts")), "plan")
        if plan.isEmpty():
            break
        going = (frontier.join(plan.select("chunk", "parts"), "chunk").join(out, F.col("node") == F.col("src"))
                 .select("chunk", "parts", everyone.alias("live"), F.array("pos").alias("pos"), F.col("dst").alias("node"),
                         F.array(F.lit(1)).alias("cnt"), "need"))
        # the seeds are a row each, so no list of places goes with them
        kept = state.join(plan, "chunk").select("chunk", "parts", ("live" if rounds else everyone.alias("live")), "pos", "node", "cnt", "need")
        dealt = going.union(kept).mapInArrow(_deal, f"chunk bigint, part bigint, {_PLACES}")
        state = written(dealt.groupBy("chunk", "part").applyInArrow(_tally, f"chunk bigint, new_pos array<smallint>, new_node array<int>, {_PLACES}"), "counts")
        frontier = state.select("chunk", F.explode(F.arrays_zip("new_pos", "new_node")).alias("x")).select("chunk", F.col("x.new_pos").alias("pos"), F.col("x.new_node").alias("node"))
        rounds.append(frontier)
    reach = seeds.withColumn("step", F.lit(0))
    if rounds:
        found = rounds[0].withColumn("step", F.lit(1))
        for step, part in enumerate(rounds[1:], 2):
            found = found.union(part.withColumn("step", F.lit(step)))
        reach = reach.union(found.join(arts, ["chunk", "pos"]).join(codes, F.col("node") == F.col("code")).select(*KEY, "step"))
    return reach


def cascade_metrics(activation: DataFrame, articles: DataFrame) -> DataFrame:
    """Per article: size, depth, max width, spread rate, widest step (earliest on ties)."""
    per_step = activation.groupBy("article_id", "step").agg(F.count(F.lit(1)).alias("width"))
    agg = per_step.groupBy("article_id").agg(
        F.sum("width").cast("bigint").alias("cascade_size"),
        F.max("step").cast("bigint").alias("cascade_depth"),
        F.max("width").cast("bigint").alias("max_width"),
        F.max_by("step", F.struct("width", -F.col("step"))).cast("bigint").alias("time_to_max_width"))
    labels = articles.select(F.col("news_id").alias("article_id"), label_name(F.col("label")).alias("label"))
    spread = F.when(F.col("cascade_depth") > 0, F.col("cascade_size") / F.col("cascade_depth")) \
        .otherwise(F.col("cascade_size").cast("double"))
    return (agg.join(labels, "article_id", "left")
            .select("article_id", F.coalesce("label", F.lit("unknown")).alias("label"),
                    "cascade_size", "cascade_depth", "max_width", spread.alias("avg_spread_rate"),
                    "time_to_max_width", F.col("cascade_depth").alias("total_time_steps")))


# ------------------------------------------------------- observed cascades (D3, levels)

def observed_levels(tweets: DataFrame, interactions: DataFrame) -> DataFrame:
    """(article_id, user_id, level) of every article's observed cascade.

    Level 0 are the users who posted the article; a user who retweeted or replied
    to a member within the article stands one level below the nearest member.  All
    articles expand together, one round for each level; the loop ends when a round
    reaches nobody new.  Users who only interact with non-members are not reached.
    """
    roots = tweets.where(F.col("kind") == "post").select("article_id", "user_id").distinct()
    links = cut_lineage(interactions.where(F.col("kind").isin("retweet", "reply") & (F.col("src") != F.col("dst")))
                        .select("article_id", F.col("dst").alias("user_id"), F.col("src").alias("child")).distinct())
    frontier = cut_lineage(roots.withColumn("level", F.lit(0).cast("bigint")))
    reached = frontier
    while not frontier.isEmpty():
        found = (links.join(frontier, ["article_id", "user_id"])
                 .select("article_id", F.col("child").alias("user_id"), (F.col("level") + 1).alias("level")).distinct())
        frontier = cut_lineage(found.join(reached, ["article_id", "user_id"], "left_anti"))
        reached = reached.unionByName(frontier)
    return reached


def observed_metrics(levels: DataFrame, tweets: DataFrame, articles: DataFrame) -> DataFrame:
    """Size, depth, width and spread rate of the observed cascades, with whether any tweet of the article has a time."""
    timed = tweets.groupBy("article_id").agg(F.max(F.col("ts").isNotNull()).alias("has_timestamps"))
    return (cascade_metrics(levels.withColumnRenamed("level", "step"), articles)
            .drop("total_time_steps").withColumnRenamed("time_to_max_width", "widest_level")
            .join(timed, "article_id", "left").withColumn("has_timestamps", F.coalesce("has_timestamps", F.lit(False))))


def sample_articles(articles: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Deterministic sample of ``n`` articles: order by md5(seed|news_id)."""
    return (articles.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("news_id"))))
            .orderBy("_h", "news_id").limit(n).drop("_h"))


# ---------------------------------------------------------------- comparisons (A12-A15)

def compare_fake_real(metrics: DataFrame) -> DataFrame:
    """13 aggregates per label; both labels present even when one has no cascade."""
    spark = metrics.sparkSession
    both = spark.createDataFrame([("fake",), ("real",)], "label string")
    m = metrics.where(F.col("label").isin("fake", "real"))
    agg = m.groupBy("label").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("cascade_size").alias("avg_cascade_size"), F.stddev_samp("cascade_size").alias("std_cascade_size"),
        F.avg("cascade_depth").alias("avg_cascade_depth"), F.stddev_samp("cascade_depth").alias("std_cascade_depth"),
        F.avg("max_width").alias("avg_max_width"), F.stddev_samp("max_width").alias("std_max_width"),
        F.avg("avg_spread_rate").alias("avg_spread_rate"), F.stddev_samp("avg_spread_rate").alias("std_spread_rate"),
        F.percentile("cascade_size", 0.5).alias("median_cascade_size"),
        F.percentile("cascade_depth", 0.5).alias("median_cascade_depth"),
        F.max("cascade_size").alias("max_cascade_size"), F.max("cascade_depth").alias("max_cascade_depth"))
    return (both.join(F.broadcast(agg), "label", "left")
            .withColumn("count", F.coalesce("count", F.lit(0)).cast("bigint")))


def compare_models(by_model: dict[str, DataFrame]) -> DataFrame:
    """Stack per-model metrics with a ``model`` tag, aggregate per (model, label)."""
    stacked = None
    for name, df in by_model.items():
        tagged = df.withColumn("model", F.lit(name))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    return (stacked.where(F.col("label").isin("fake", "real")).groupBy("model", "label").agg(
        F.count(F.lit(1)).alias("count"), F.avg("cascade_size").alias("avg_cascade_size"),
        F.avg("cascade_depth").alias("avg_cascade_depth"), F.avg("max_width").alias("avg_max_width"),
        F.avg("avg_spread_rate").alias("avg_spread_rate"),
        F.percentile("cascade_size", 0.5).alias("median_cascade_size")))


def pivot_models(model_cmp: DataFrame, metric: str = "avg_cascade_size",
                 models: tuple[str, ...] = ("ICM", "LT")) -> DataFrame:
    return model_cmp.groupBy("label").pivot("model", list(models)).agg(F.first(metric))


NORM_METRICS = ("avg_cascade_size", "avg_cascade_depth", "avg_max_width", "avg_spread_rate")


def normalized_comparison(cmp: DataFrame) -> DataFrame:
    """Unpivot label x metric and divide each metric by its maximum over labels."""
    from pyspark.sql import Window
    long = cmp.select("label", *NORM_METRICS).unpivot(["label"], list(NORM_METRICS), "metric", "value")
    mx = F.max("value").over(Window.partitionBy("metric"))
    return long.select("label", "metric", "value",
                       F.when(mx > 0, F.col("value") / mx).otherwise(F.lit(0.0)).alias("normalized"))
