"""Jobs that the rounds of HITS and of the communities take; their results do not hang on it."""
import itertools
import random

from spreadlens.operators import communities as CM
from spreadlens.operators import links as L


def test_hits_rounds_share_jobs(spark, monkeypatch):
    """Rounds done ahead give the scores, the round to stop at and, for several graphs, the same as one by one."""
    rng = random.Random(3)
    pairs = [("dense", *rng.sample(range(12), 2)) for _ in range(60)] + [("star", i, 0) for i in range(1, 5)]
    edges = spark.createDataFrame(pairs, "graph string, src long, dst long").distinct().cache()
    nodes = spark.createDataFrame([("dense", i) for i in range(13)] + [("star", i) for i in range(5)], "graph string, node_id long")
    made = []
    plain = L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: made.append(1) or plain(df))

    def scores(**how):
        made.clear()
        out = {(r["graph"], r["node_id"]): (r["authority"], r["hub"]) for r in L.hits(spark, nodes, edges, **how).collect()}
        return out, len(made)
    one, many = scores(ahead=1), scores(ahead=3)
    assert many[1] < one[1] and one[0].keys() == many[0].keys()
    assert all(abs(x - y) < 1e-12 for k in one[0] for x, y in zip(one[0][k], many[0][k]))
    (heavy, _), (fixed, n) = scores(ahead=3, most=2), scores(max_iter=8, tol=None, ahead=4)
    assert all(abs(x - y) < 1e-12 for k in one[0] for x, y in zip(one[0][k], heavy[k]))
    assert n < 8 + 6 and len(fixed) == 18


class Counted:
    """A frame that counts how often a plan is built on it."""

    def __init__(self, df):
        self.df, self.n = df, 0

    def where(self, *a):
        self.n += 1
        return self.df.where(*a)

    def join(self, *a):
        self.n += 1
        return self.df.join(*a)


def test_a_round_of_communities_reads_the_entries_once(spark):
    """A round that succeeds at once gives quality and next moves in one pass over the entries; two equal graphs go the same way."""
    rng = random.Random(6)
    edges = [(i, j) for i, j in itertools.combinations(range(40), 2) if rng.random() < (0.6 if i % 4 == j % 4 else 0.02)]
    und = spark.createDataFrame([(g, i, j) for g in ("a", "b") for i, j in edges], "graph string, u long, v long")
    adj = CM.adjacency(und).cache()
    counted, passes = Counted(adj), []
    comm, moved = CM.settle(counted, CM._with_strength(adj, None), seen=lambda q: passes.append((counted.n, q)))
    assert moved and min(b[0] - a[0] for a, b in zip(passes, passes[1:])) == 1
    assert all(q["a"] == q["b"] for _, q in passes)
    assert CM.best_moves(adj, comm).isEmpty()
