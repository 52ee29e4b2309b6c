"""Collocations against the SQL and a plain count."""
import random
import re
from collections import Counter

import duckdb
import numpy as np

from spreadlens.llm import collocations
from test_operators import DOCS, ROWS

SF = "/root/testdata/sf0.01"


def plain(docs, least, top=2000, longest=5):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    f, n = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        own = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            own.update(tuple(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        often = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in often.items():
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(collocations.OP11_SQL).df()
    got = collocations.op11_collocations(spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_plain_count(spark):
    """Small chunks, tiles and thresholds; texts that cross slices, ties, every kind of end and blank."""
    rng = random.Random(2)
    words = ["a", "b", "C", "é", "ab", " x", "\x1c", "word"]
    docs = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "\x0b", "  ", "? "]) for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "fr", None, "und"])) for _ in range(120)]
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    for side, dense, top, more in ((2, 4, 2000, {}), (4, 1 << 30, 7, {"sent": 3, "merged": 50}), (256, 1, 2000, {"sent": 0})):
        got = collocations.collocations(df, top=top, least=6, chunk=300, side=side, dense=dense, **more)
        assert sorted(map(tuple, got.collect())) == plain(docs, 6, top)


def test_tiles_equal_unique():
    rng = np.random.default_rng(1)
    a, b = (rng.zipf(1.3, 20_000).clip(0, 5000) for _ in range(2))
    keys, counts, number = collocations.tiled_pairs(a, b, 16, 40)
    want, n = np.unique(a.astype(np.int64) << 32 | b, return_counts=True)
    assert (np.sort(keys) == want).all() and (counts[np.argsort(keys)] == n).all() and (keys[number] == (a.astype(np.int64) << 32 | b)).all()


def test_slices(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 7)
    text = "one two, threefourfivesix seven\teight.NINE " + "x" * 40 + " end"
    got = [w for part in collocations._slices(text) for w in part]
    assert got == b"one two \xff threefourfivesix seven eight \xff nine ".split() + [b"x" * 40, b"end"]


def test_scores_beyond_64_bits(spark):
    a, n = 3 * 10 ** 15, 8 * 10 ** 17
    rows = spark.createDataFrame([("en", ["x", "y", "z"], a, [a + 5, a + 1, a], [a + 7, a + 2, a], None), ("en", ["x", "y"], a, [a, a], [a, a], a)],
                                 "lang string, words array<string>, a long, heads array<long>, tails array<long>, longer long")
    got = collocations.scored(rows, spark.createDataFrame([("en", n)], "lang string, n long")).collect()
    cuts = [(1000 * a * n // (l * r), k, l, r) for k, (l, r) in enumerate(((a + 5, a + 2), (a + 1, a + 7)))]
    assert [(r.score, r.l, r.r) for r in got] == [min(cuts)[0:1] + min(cuts)[2:]]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    got = sorted(map(tuple, collocations.collocations(docs, least=2).collect()))
    assert got == plain([(r[1], r[2]) for r in ROWS], 2) and got
    assert collocations.collocations(docs.filter("false")).count() == 0
    assert collocations.collocations(docs.filter("text is null")).count() == 0
