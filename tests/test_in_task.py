"""Graphs done in one task give what the rounds of jobs give."""
import random

import numpy as np
import pytest

from spreadlens.functions.hashing import MIX_MODULUS, coins_below, mix_unit_array
from spreadlens.operators import cascades as C
from spreadlens.operators import links as L
from spreadlens.operators import reach


def graphs(spark):
    """A dense graph with repeated and null ends and an edge from a node that is not listed, a star, nodes without edges."""
    rng = random.Random(3)
    pairs = [("dense", *rng.sample(range(12), 2)) for _ in range(60)] + [("star", i, 0) for i in range(1, 5)]
    pairs += [pairs[0], ("dense", 1, None), ("dense", None, 2), ("dense", 40, 4)]
    edges = spark.createDataFrame([(*p, 1.0 + i % 3) for i, p in enumerate(pairs)], "graph string, src long, dst long, w double")
    nodes = spark.createDataFrame([("dense", i) for i in (*range(13), None)] + [("star", i) for i in range(5)] + [("bare", 1)], "graph string, node_id long")
    return nodes, edges


def same(a, b):
    a, b = ({(r[0], r[1]): r[2:] for r in map(tuple, x.collect())} for x in (a, b))
    assert a.keys() == b.keys() and len(a) == 20
    assert all(abs(x - y) < 1e-12 for k in a for x, y in zip(a[k], b[k]))


@pytest.fixture
def few_writes(monkeypatch):
    made = []
    plain = L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: made.append(1) or plain(df))
    return made


@pytest.mark.parametrize("how", [{"tol": 0.01}, {"normalized": False, "tol": None, "max_iter": 3}])
def test_hits(spark, few_writes, how):
    nodes, edges = graphs(spark)
    got = L.hits(spark, nodes, edges, **how)
    assert len(few_writes) == 2  # the edges and the scores, whatever the rounds
    same(got, L.hits(spark, nodes, edges, **how, in_task=3))


@pytest.mark.parametrize("how", [{"weight_col": "w", "tol": 1e-3}, {"tol": None, "max_iter": 2}])
def test_pagerank(spark, few_writes, how):
    nodes, edges = graphs(spark)
    got = L.pagerank(spark, nodes, edges, **how)
    assert len(few_writes) == 2
    same(got, L.pagerank(spark, nodes, edges, **how, in_task=3))


def test_no_end_is_an_error(spark):
    nodes, edges = graphs(spark)
    for f in (L.hits, L.pagerank):
        with pytest.raises(RuntimeError, match="dense.*did not converge in 2 rounds"):
            f(spark, nodes, edges, max_iter=2)


def test_coins():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2 ** 32, (2, 100_000))
    edge = np.concatenate([np.arange(50), MIX_MODULUS + np.arange(-50, 50), 2 ** 32 - 1 - np.arange(50)])
    b[:len(edge)] = a[:len(edge)] ^ edge
    for p in (0.0, 0.02, 0.1, 0.5, mix_unit_array(a[7:8], b[7:8])[0], 1.0, 1.5):
        assert (coins_below(a.astype(np.uint32), b.astype(np.uint32), p) == (mix_unit_array(a, b) < p)).all()


@pytest.mark.parametrize("which", ["icm", "lt"])
def test_diffusion(spark, monkeypatch, which):
    """Few articles and edges at a time, repeated and null edges and seeds, nodes that are not in the graph; fewer tables than steps."""
    monkeypatch.setattr(reach, "PLACES", 100)
    monkeypatch.setattr(reach, "TRIES", 5)
    names = []
    plain = C.written
    monkeypatch.setattr(C, "written", lambda df, name: names.append(name) or plain(df, name))
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40, 49)] + [tuple(rng.sample(range(40), 2)) for _ in range(60)]
    edges = spark.createDataFrame([*pairs, pairs[0], (None, 1), (1, None)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(45)] + [(None,)], "node_id long")
    first = [(f"a{i}", n) for i in range(30) for n in {i % 40, i * 3 % 40}] + [("chain", 40), ("outside", 99)]
    seeds = spark.createDataFrame([*first, first[0], (None, 3), ("a1", None)], "article_id string, node_id long")
    if which == "lt":
        run = lambda **how: C.lt_activation(spark, edges, nodes, seeds, **how)
    else:
        run = lambda **how: C.icm_activation(spark, edges, seeds, p=0.6, max_steps=6, **how)
    got = sorted(map(str, run(in_task=len(pairs) + 9).collect()))
    assert len(names) < 4
    want = sorted(map(str, run(in_task=3).collect()))
    assert got == want and len(got) > len(first) + 30 and len(names) > 9


def test_draws(spark):
    from pyspark.sql import functions as F

    from spreadlens.operators import settled
    ids = [0, 1, 7, -5, 2 ** 40 + 3, *range(100, 160)]
    for number in (0, 3, 70_000):
        rows = spark.createDataFrame([(i,) for i in ids], "a long").select("a", (F.pmod(F.xxhash64("a", F.lit(number)), F.lit(2)) == 0).alias("draw")).collect()
        assert {r["a"]: r["draw"] for r in rows} == dict(zip(ids, settled.drawn(np.array(ids), number).tolist()))


@pytest.mark.parametrize("weighted", [False, True])
def test_communities(spark, monkeypatch, weighted):
    """The rounds of jobs end in the same communities, loops, weights and lone nodes included; one task takes no rounds of jobs."""
    from spreadlens.operators import communities as CM
    rng = random.Random(6)
    rows = [("a", i, j) for i in range(15) for j in range(i + (not weighted), 15) if rng.random() < (0.7 if i % 3 == j % 3 else 0.08)]
    rows += [("b", i, i + 1) for i in range(4)] + [("c", 4, 4)] * weighted
    und = spark.createDataFrame([(*r, 1.0 + i % 3) for i, r in enumerate(rows)], "graph string, u long, v long, w double")
    und = und if weighted else und.drop("w")
    nodes = spark.createDataFrame([(g, i) for g in "abc" for i in range(16)], "graph string, node_id long")
    names = []
    plain = CM.written
    monkeypatch.setattr(CM, "written", lambda df, name: names.append(name) or plain(df, name))
    got = sorted(map(tuple, CM.louvain(spark, nodes, und).collect()))
    assert len(names) == 2
    assert got == sorted(map(tuple, CM.louvain(spark, nodes, und, in_task=5).collect())) and len(names) > 9
    assert len({c for g, _, c in got if g == "a"}) < 15
