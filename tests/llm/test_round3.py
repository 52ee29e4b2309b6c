"""Learning from positives alone, the risk's gradient, and edits applied to edited trees."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlens.llm import tokencounts, toxicity
from spreadlens.llm.common import held_out

BIG = "/root/testdata/sf0.1"


@pytest.mark.parametrize("shift", [0.0, -3.0])
def test_nnpu_risk_and_gradient(shift):
    """Against plain sums and differences; a shift makes the unlabelled part negative."""
    rng = np.random.default_rng(4)
    g_p, g_u, prior = rng.normal(1, 1, 7), rng.normal(shift, 1, 11), 0.4
    soft = lambda z: np.log1p(np.exp(z))
    part = lambda p, u: sum(map(soft, u)) / len(u) - prior * sum(map(soft, p)) / len(p)
    positive = lambda p: prior * sum(soft(-z) for z in p) / len(p)
    assert (part(g_p, g_u) < 0) == (shift < 0)
    risk, d_p, d_u = toxicity.nnpu_risk(g_p, g_u, prior)
    assert risk == pytest.approx(positive(g_p) + max(0.0, part(g_p, g_u)))
    goal = (lambda p, u: positive(p) + part(p, u)) if shift == 0 else (lambda p, u: -part(p, u))
    for i in range(len(g_p)):
        step = 1e-6 * (np.arange(len(g_p)) == i)
        assert d_p[i] == pytest.approx((goal(g_p + step, g_u) - goal(g_p - step, g_u)) / 2e-6, abs=1e-7)
    for i in range(len(g_u)):
        step = 1e-6 * (np.arange(len(g_u)) == i)
        assert d_u[i] == pytest.approx((goal(g_p, g_u + step) - goal(g_p, g_u - step)) / 2e-6, abs=1e-7)


def test_prior_of_made_rows():
    rng = np.random.default_rng(1)
    def rows(n, own):
        return [np.unique(np.concatenate([rng.integers(0, 500, 20), own[rng.random(len(own)) < 0.5]])) for _ in range(n)]
    mark = np.arange(1000, 1006)
    for prior in (0.05, 0.2, 0.5):
        pos, clean = rows(800, mark), rows(round(4000 * (1 - prior)), mark[:0])
        got = toxicity.estimate_prior(pos, clean + rows(round(4000 * prior), mark))
        assert prior * 0.8 <= got <= prior * 1.3
    assert toxicity.estimate_prior([], [mark]) == 1.0 and toxicity.estimate_prior([mark] * 3, [mark]) == 1.0


def test_toxicity_from_positive_labels_only(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "toxic")
    got = {}
    for name, known in (("all", labels), ("positive", labels.where(F.col("toxic").cast("int") == 1))):
        scores = toxicity.score(docs.where(held_out(3, 1)), toxicity.fit(docs, known), "doc_id")
        right = (F.col("score") >= 0.7).cast("int") == F.col("toxic").cast("int")
        got[name] = scores.join(labels, "doc_id").agg(F.avg(right.cast("double")), F.avg(F.when(F.col("toxic").cast("int") == 1, right.cast("double")))).first()
    print(got)
    assert got["positive"][0] >= got["all"][0] - 0.05 and got["positive"][1] >= got["all"][1] - 0.05


def test_two_batches_of_edits(spark):
    """Each batch's counts, lengths and text are those of the text counted anew."""
    rng = random.Random(8)
    words = ["alpha", "beta", "x" * 300, "1234567", "\n\n", "  ", "don't", "é", "%%%", "𝔘"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 40, 900]))) for i in range(30)}
    texts[30], texts[31] = "", None
    count = tokencounts.Counter(tokencounts.ranks_file())
    kind = "doc_id long, text string, lengths array<int>, counts array<int>, edits array<struct<start:int,end:int,replacement:string>>"
    trees = [tuple(r) for r in tokencounts.build(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()]
    for _ in range(3):
        rows, want = [], {}
        for i, text, lengths, counts in trees:
            t, cuts = text or "", sorted(rng.randrange(len(text or "") + 1) for _ in range(rng.choice([0, 2, 8])))
            edits = [(a, b, rng.choice(["", " ", "new words", "y", "\n"])) for a, b in zip(cuts[::2], cuts[1::2])]
            if not t and i % 2 == 0:
                edits = [(0, 0, "grown from nothing")]
            at, out = 0, []
            for a, b, rep in edits:
                out += [t[at:a], rep]
                at = b
            want[i] = "".join([*out, t[at:]])
            rows.append((i, text, lengths, counts, edits))
        got = tokencounts.apply_edits(spark.createDataFrame(rows, kind)).collect()
        for r in got:
            assert r["text"] == want[r["doc_id"]] and r["n_tokens_edited"] == count(r["text"]) == sum(r["counts"])
            assert sum(r["lengths"]) == len(r["text"]) and r["n_tokens"] == count(next(t for i, t, *_ in trees if i == r["doc_id"]) or "")
        trees = [(r["doc_id"], r["text"], r["lengths"], r["counts"]) for r in got]
