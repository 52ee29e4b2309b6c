"""Toxicity by non-negative positive-unlabelled learning (nnPU)."""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlens.llm.common import WordHash, columns_of, documents, held_out, labelled, sigmoid, thin
from spreadlens.session import read_table

WORD = re.compile(r"[^\W_]+")
SIZE = 1 << 20

#: Fold that lends no labels, and the threshold of a positive prediction.
FOLD, REST, THRESHOLD = 3, 1, 0.7


def _features(df: DataFrame) -> DataFrame:
    """kind, distinct hashed words of each whole text, in id order."""
    def run(batches):
        import pyarrow as pa
        ids = WordHash(SIZE)
        for kinds, texts in columns_of(batches, "kind", "text"):
            words = [sorted({ids[w] for w in WORD.findall((t or "").lower())}) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(words, pa.list_(pa.int32()))],
                                             ["kind", "words"])
    return df.select("kind", "text").mapInArrow(run, "kind int, words array<int>")


def _distinct_rows(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Rows without near copies of earlier ones: equal pairs of minimum hashes, three bands."""
    mult = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393, 3432918353], dtype=np.uint64)
    seen, out = set(), []
    for r in rows:
        if len(r):
            low = ((r.astype(np.uint64)[:, None] * mult) & np.uint64(0xFFFFFFFF)).min(0)
            bands = [(i, int(low[i]), int(low[i + 1])) for i in (0, 2, 4)]
            if any(b in seen for b in bands):
                continue
            seen.update(bands)
        out.append(r)
    return out


def estimate_prior(pos: list[np.ndarray], unl: list[np.ndarray], z: float = 2.0, least: float = 0.02) -> float:
    """Share of positives among unlabelled rows, from positive and unlabelled rows alone.

    A word's share among the unlabelled is at least the prior times its share among
    the positives, so every word bounds the prior from above, and a word that clean
    text hardly uses bounds it closely.  The least bound, each widened by ``z``
    standard errors, over words that ``least`` of the positives (ten at least) hold;
    1 if there is none.
    """
    n_p, n_u = len(pos), len(unl)
    if not n_p or not n_u:
        return 1.0
    count = lambda rows: np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), minlength=SIZE)
    c_p, c_u = count(pos), count(unl)
    held = np.flatnonzero(c_p >= max(10, least * n_p))
    if not len(held):
        return 1.0
    p, u = c_p[held] / n_p, np.maximum(c_u[held], 1) / n_u
    bound = u / p * (1 + z * np.sqrt((1 - p) / c_p[held] + (1 - u) / np.maximum(c_u[held], 1)))
    return float(min(1.0, bound.min()))


def nnpu_risk(g_p: np.ndarray, g_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk and the direction to descend, for the margins of positive and unlabelled rows.

    The direction is the risk's gradient while its unlabelled part is not negative;
    below that it is the gradient of minus that part, which raises it again.
    """
    n_p, n_u = len(g_p), len(g_u)
    neg = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
    d_u, d_pn, d_pp = sigmoid(g_u) / n_u, -prior * sigmoid(g_p) / n_p, -prior * sigmoid(-g_p) / n_p
    d_p, d_u = (d_pp + d_pn, d_u) if neg >= 0 else (-d_pn, -d_u)
    return float(prior * np.logaddexp(0, -g_p).mean() + max(0.0, neg)), d_p, d_u


def train_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float | None, epochs: int = 400, rate: float = 0.1,
               l2: float = 2e-5, least_z: float = 5.0, least_precision: float = 0.4) -> dict:
    """Linear scorer over present words that minimises the non-negative PU risk

        prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),   l(z) = log(1 + exp(-z)).

    Words enter if their share among the positives stands ``least_z`` standard
    errors above that among the unlabelled and the estimated share of positives
    among the texts that hold them, prior * P(word | positive) / P(word), reaches
    ``least_precision``; where the unlabelled part of the risk
    turns negative the step ascends it (the published correction).  Without a
    ``prior`` it is estimated from the rows themselves.
    """
    prior = estimate_prior(pos, unl) if prior is None else prior  # a share of rows, so copies count
    pos, unl = _distinct_rows(pos), _distinct_rows(unl)
    if not pos or not unl or not 0 < prior < 1:
        return {"ids": np.zeros(0, np.int64), "w": np.zeros(0), "b": -4.0}
    n_p, n_u = len(pos), len(unl)
    count = lambda rows: np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), minlength=SIZE)
    c_p, c_u = count(pos), count(unl)
    share = (c_p + c_u) / (n_p + n_u)
    z = (c_p / n_p - c_u / n_u) / np.sqrt(np.maximum(share * (1 - share) * (1 / n_p + 1 / n_u), 1e-12))
    precise = prior * c_p / n_p >= least_precision * c_u / n_u
    ids = np.flatnonzero((z >= least_z) & precise & (c_p >= max(3, 0.01 * n_p)))
    place = np.full(SIZE, -1, np.int64)
    place[ids] = np.arange(len(ids))

    def matrix(rows):
        at = [place[r] for r in rows]
        at = [a[a >= 0] for a in at]
        return np.concatenate([*at, np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), [len(a) for a in at])

    (p_col, p_row), (u_col, u_row) = matrix(pos), matrix(unl)
    w, b = np.zeros(len(ids)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for t in range(1, epochs + 1):
        g_p = b + np.bincount(p_row, w[p_col], n_p)
        g_u = b + np.bincount(u_row, w[u_col], n_u)
        _, d_p, d_u = nnpu_risk(g_p, g_u, prior)
        grad = np.append(np.bincount(p_col, d_p[p_row], len(ids)) + np.bincount(u_col, d_u[u_row], len(ids)) + l2 * w,
                         d_p.sum() + d_u.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return {"ids": ids, "w": w, "b": b}


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 12000,
        prior: float | None = None) -> dict:
    """Fit on rows of the training fold only: confirmed positives and unlabelled text.

    Both samples are bounded (``max_positive``, ``max_unlabelled`` rows, chosen by a
    hash of the id); only hashed words reach the driver.  Unless given, the class
    prior is the share of positives among the labelled rows of the training fold;
    where every label is positive that says nothing, and it is estimated from the
    positive and the unlabelled text.
    """
    docs = docs.select("doc_id", "text").filter(~held_out(FOLD, REST) & F.col("doc_id").isNotNull())
    known = labels.filter(~held_out(FOLD, REST))
    n = known.select(F.col("toxic").cast("int").alias("t")).filter("t in (0, 1)").agg(F.sum("t"), F.count("t")).first()
    n_pos, n_known = int(n[0] or 0), int(n[1])
    if not n_pos:
        return train_nnpu([], [], 0.0)
    hits = thin(known.filter(F.col("toxic").cast("int") == 1), n_pos, max_positive, F.col("doc_id"))
    pos = labelled(docs, hits, "toxic").filter("label = 1").select(F.lit(1).alias("kind"), "text")
    unl = thin(docs, docs.count(), max_unlabelled, F.col("doc_id")).select(F.lit(0).alias("kind"), "text")
    rows = [(r["kind"], np.array(r["words"], dtype=np.int64)) for r in _features(pos.union(unl)).toLocalIterator()]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return train_nnpu([r for k, r in rows if k == 1], [r for k, r in rows if k == 0],
                      prior if prior is not None else n_pos / n_known if n_pos < n_known else None)


def score(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """``keep`` columns and score (0 to 1) of every row, from its whole text only; null text counts as empty."""
    weight = dict(zip(model["ids"].tolist(), model["w"].tolist()))
    bias = float(model["b"])
    schema = docs.select(*keep).schema

    def run(batches):
        import pyarrow as pa
        ids = WordHash(SIZE)
        get = weight.get
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            g = [bias + sum(get(i, 0.0) for i in {ids[w] for w in set(WORD.findall((t or "").lower()))}) for t in texts]
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sigmoid(np.array(g)), pa.float64())], [*keep, "score"])
    return docs.select(*{*keep, "text"}).mapInArrow(run, schema.add("score", "double"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``.

    Null and empty texts score like a text without words; repeated rows score
    alike; an empty table gives no rows; without a positive label all scores are low;
    with positive labels only the share of positives is estimated from the texts.  A
    very long text is scored whole, in the memory of its distinct words.  Further
    columns of the tables are not read.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return (score(docs, model, "doc_id")
            .select("doc_id", held_out(FOLD, REST).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
