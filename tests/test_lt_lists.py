"""Linear threshold in lists by chunk: the same reach as a plain search, in fewer rows than pairs."""
from pyspark.sql import functions as F

from spreadlens.operators import cascades as C


def plain(seeds, pairs, need):
    want = {(a, n): 0 for a, n in seeds}
    now, step, count = set(want), 0, {}
    while now:
        step += 1
        met = set()
        for a, n in now:
            for s, d in pairs:
                if s == n:
                    count[a, d] = count.get((a, d), 0) + 1
                    met.add((a, d))
        now = {(a, d) for a, d in met if (a, d) not in want and need(count[a, d], d)}
        want |= {k: step for k in now}
    return want


def test_lt_counts_in_lists(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 7)
    monkeypatch.setattr(C, "LIST", 3)
    monkeypatch.setattr(C, "PAIRS", 100)
    stored = {}
    real = C.written

    def written(df, name):
        out = real(df, name)
        stored.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(C, "written", written)
    pairs = sorted({(i, (i * 7 + j * j) % 40) for i in range(40) for j in range(5)} | {(i, 0) for i in range(1, 40)} | {(0, i) for i in range(1, 40)} | {(40, 41), (41, 42)})
    edges = spark.createDataFrame([*pairs, (None, 1), (1, None)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(43)] + [(None,)], "node_id long")
    first = [(f"a{i}", n) for i in range(30) for n in {i % 40, i * 3 % 40}] + [("chain", 40), ("outside", 99)]
    seeds = spark.createDataFrame([*first, first[0], (None, 3), ("a1", None)], "article_id string, node_id long")
    for distribution in ("normal", "uniform"):
        thr = {r["node_id"]: r["threshold"] for r in C.lt_thresholds(nodes, distribution).where(F.col("node_id").isNotNull()).collect()}
        indeg = {n: sum(d == n for _, d in pairs) + (n == 1) for n in range(43)}
        want = plain(set(first), pairs, lambda c, d: c / indeg[d] >= thr[d])  # noqa: B023
        rows = [tuple(r) for r in C.lt_activation(spark, edges, nodes, seeds, distribution).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == {(*k, s) for k, s in want.items()} | {(None, 3, 0), ("a1", None, 0)}
        assert max(want.values()) > 2 and want[("chain", 42)] == 2
    # a row for each part of a chunk, not for each article and node
    assert max(stored["counts"]) < len(want) / 3
    assert C.lt_activation(spark, edges, nodes, seeds, max_steps=0).count() == len(set(first)) + 2
