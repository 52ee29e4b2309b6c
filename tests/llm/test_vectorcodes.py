"""Dual-tree Lloyd against a plain one and the SQL."""
import duckdb
import numpy as np
import pytest

from spreadlens.llm import vectorcodes
from spreadlens.llm.vectorcodes import LEAF, Entries, Tree, codes, nearest_entries, whole_numbers

SF = "/root/testdata/sf0.01"
KIND = "vec_id long, embedding array<float>, label int, code string, error string"


def plain(x, entries, parts=4, rounds=4):
    """Codes and codebooks by all distances."""
    own = np.split(x.astype(object), parts, 1)
    books = [p[:entries].copy() for p in own]

    def near(p, b):
        return [min((sum((u - v) ** 2 for u, v in zip(row, e)), i) for i, e in enumerate(b))[1] for row in p]
    for _ in range(rounds):
        for p, b in zip(own, books):
            to = near(p, b)
            for e in set(to):
                mine = [row for row, t in zip(p, to) if t == e]
                b[e] = [sum(c) // len(mine) for c in zip(*mine)]
    return np.array([near(p, b) for p, b in zip(own, books)]).T, np.array(books, dtype=object)


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties", "large", "one"])
def test_dual_tree_equals_plain(kind):
    rng = np.random.default_rng(4)
    n, entries = 700, 20
    x = {"spread": rng.normal(size=(n, 8)), "clusters": rng.normal(size=(10, 8))[np.arange(n) % 10] * 3 + rng.normal(size=(n, 8)) * .001,
         "ties": rng.integers(-2, 3, (n, 8)) / 1024, "large": rng.normal(size=(n, 8)) * 20_000, "one": np.ones((n, 8))}[kind]
    x = whole_numbers(x, 4)
    want, want_books = plain(x, entries)
    own = np.split(x, 4, 1)
    books = np.stack([p[:entries] for p in own])
    trees = [Tree.load(*Tree(p, LEAF).store(), p.shape[1]) for p in own]
    for k in range(5):
        out = [nearest_entries(t, p, Entries(b)) for t, p, b in zip(trees, own, books)]
        if k < 4:
            books = np.stack([np.where(o[1][:, None] > 0, o[2] // np.maximum(o[1], 1)[:, None], b) for o, b in zip(out, books)])
    assert (np.stack([o[0] for o in out], 1) == want).all() and (books == want_books).all()
    for o, p in zip(out, own):
        assert (o[1] == np.bincount(o[0], minlength=entries)).all() and (o[2].sum(0) == p.sum(0)).all()
    if kind == "clusters":  # whole nodes are assigned, most combinations pruned
        assert sum(o[3]["whole"] for o in out) > 0 and sum(o[3]["distances"] for o in out) < 4 * n * entries / 3


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(vectorcodes.OP12_SQL).df()
    got = vectorcodes.op12_vector_codes(spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_odd_rows(spark, tmp_path):
    nan = float("nan")
    rows = [(5, [1.0, 2.0, 3.0, 4.0, 5.0], 1, "a", "b"), (1, None, 1, None, None), (2, [1.0, None, 3.0, 4.0, 5.0], 1, None, None), (3, [1.0, nan, 3.0, 4.0, 5.0], 2, None, None),
            (4, [float("inf")] * 5, 2, None, None), (6, [0.0] * 5, None, None, None), (6, [0.0] * 5, None, None, None), (7, [], 1, None, None), (8, [1.0, 2.0], 1, None, None),
            (None, [9.0, 9.0, 9.0, 9.0, 9.0], None, None, None), (9, [-0.0001] * 5, 3, None, None)]
    vectors = spark.createDataFrame(rows, KIND)
    each, books = codes(vectors, entries=2)
    got = sorted((r.vec_id is None, r.vec_id or 0, r.label, r.code) for r in each.collect())
    assert [g[1] for g in got] == [5, 6, 6, 9, 0] and books.shape == (4, 2, 2)
    x = whole_numbers(np.array([rows[0][1], [0] * 5, [0] * 5, rows[10][1], rows[9][1]], np.float32), 4)
    want, want_books = plain(x, 2)
    assert [g[3] for g in got] == ["".join(f"{c:02x}" for c in row) for row in want] and (books == want_books).all()
    none, books = codes(vectors.filter("false"))
    assert none.count() == 0 and books.size == 0
    with pytest.raises(ValueError):
        whole_numbers(np.array([[1e12] * 4]), 4)
    vectors.drop("code", "error").write.parquet(f"{tmp_path}/embeddings.parquet")
    sums = {r.vec_id: r.label_error for r in vectorcodes.op12_vector_codes(spark, str(tmp_path)).collect()}
    assert sums[6] == sums[None]


def test_blocks_do_not_matter(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    a, x = codes(vectors, entries=16, rounds=2)
    b, y = codes(vectors.repartition(3), entries=16, rounds=2, block=37)
    assert (x == y).all() and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
