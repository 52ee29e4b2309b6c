"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlens.llm.common import WordHash, columns_of, documents, held_out, labelled, sigmoid, thin
from spreadlens.session import read_table

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
WORDS, BINS = 1 << 13, 12
FOLD, REST, THRESHOLD = 4, 2, 0.7

#: Structure statistics and metadata, each cut into BINS one-hot bins.
STATS = ("length", "upper", "digit", "common_punct", "symbol", "space", "word_length", "distinct", "same_lines",
         "line_length", "glued_symbols", "declared_length", "declared_differs")
SIZE = WORDS + len(STATS) * BINS


def _classes() -> np.ndarray:
    """Character class of every code point: 0 other letter, 1 upper, 2 digit, 3 common punctuation, 4 space, 5 symbol."""
    out = np.full(0x110000, 5, np.uint8)
    for c in range(0x30000):
        s = chr(c)
        out[c] = 4 if s.isspace() else 1 if s.isupper() else 2 if s.isdigit() else 0 if s.isalpha() else 3 if s in ".,;:'\"?-()" else 5
    return out


class Extractor:
    """Sparse features of a text; the same for training and scoring."""

    def __init__(self):
        self.classes, self.ids = _classes(), WordHash(WORDS)

    def __call__(self, text: str | None, declared: int | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        n = max(len(text), 1)
        kinds = np.bincount(self.classes[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=6)
        tokens = TOKEN.findall(text.lower())
        lines = text.split("\n")
        words = set(tokens)
        glued = sum(1 for w in tokens if not w[0].isalnum() and len(w) > 1)
        share = lambda x, scale=1.0: int(min(BINS - 1, np.floor(np.sqrt(max(0.0, x) * scale) * BINS)))
        log = lambda x: int(min(BINS - 1, np.log2(1 + max(0, x)) * 0.65))
        letters = max(1, int(kinds[0] + kinds[1]))
        bins = (log(len(text)), share(kinds[1] / letters), share(kinds[2] / n), share(kinds[3] / n, 4), share(kinds[5] / n, 2),
                share(kinds[4] / n), int(min(BINS - 1, (n - kinds[4]) / max(1, len(text.split())))),
                share(len(words) / max(1, len(tokens))), share(1 - len(set(lines)) / len(lines)),
                log(len(text) / len(lines)), share(glued / max(1, len(tokens))),
                0 if declared is None else 1 + min(BINS - 2, log(declared)),
                0 if declared is None else 1 if declared == len(text) else 2)
        stat = WORDS + np.arange(len(STATS)) * BINS + np.array(bins)
        hashed = np.fromiter({self.ids[w] for w in words}, np.int64)
        hashed.sort()
        # words together weigh as much as one statistic or two, whatever the length
        return np.concatenate([hashed, stat]), np.concatenate([np.full(len(hashed), 1.0 / np.sqrt(max(1, len(hashed)))), np.ones(len(stat))])


class FactorisationMachine:
    """w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, the pairs in linear time:

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2].
    """

    def __init__(self, size: int, rank: int = 6, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank))

    def margin(self, ids: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[ids] * x[:, None]
        total = vx.sum(0)
        return float(self.w0 + self.w[ids] @ x + 0.5 * (total @ total - (vx * vx).sum()))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 64,
            rate: float = 0.02, l2: float = 1e-4, seed: int = 7) -> "FactorisationMachine":
        """Logistic loss, AdaGrad on the parameters that a batch touches."""
        rng = np.random.default_rng(seed)
        rank = self.v.shape[1]
        share = min(max(y.mean(), 0.01), 0.99)
        self.w0 = float(np.log(share / (1 - share)))
        a0, a_w, a_v = 1e-6, np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6)
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                sizes = [len(rows[i][0]) for i in at]
                ids, x = np.concatenate([rows[i][0] for i in at]), np.concatenate([rows[i][1] for i in at])
                row = np.repeat(np.arange(len(at)), sizes)
                start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                vx = self.v[ids] * x[:, None]
                total = np.add.reduceat(vx, start)
                g = self.w0 + np.add.reduceat(self.w[ids] * x, start) + 0.5 * ((total ** 2).sum(1) - np.add.reduceat((vx * vx).sum(1), start))
                d = (sigmoid(g) - y[at]) / len(at)
                used, back = np.unique(ids, return_inverse=True)
                dx = d[row] * x
                g_w = np.bincount(back, dx, len(used)) + l2 * self.w[used]
                g_v = np.stack([np.bincount(back, dx * (total[row, f] - vx[:, f]), len(used)) for f in range(rank)], 1) + l2 * self.v[used]
                a0 += d.sum() ** 2
                a_w[used] += g_w ** 2
                a_v[used] += g_v ** 2
                self.w0 -= rate * 5 * d.sum() / np.sqrt(a0)
                self.w[used] -= rate * 5 * g_w / np.sqrt(a_w[used])
                self.v[used] -= rate * g_v / np.sqrt(a_v[used])
        return self


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> FactorisationMachine | None:
    """Fit on at most about ``max_rows`` labelled rows of the training fold, chosen by a hash of the id.

    None if no row of the fold has a label.  Only sparse features reach the driver.
    """
    docs = docs.select("doc_id", "text", "n_chars").filter(~held_out(FOLD, REST))
    known = labels.filter(~held_out(FOLD, REST)).filter("doc_id is not null and cast(quality as int) in (0, 1)")
    rows = labelled(docs, thin(known, known.count(), max_rows, F.col("doc_id")), "quality")

    def run(batches):
        import pyarrow as pa
        take = Extractor()
        for y, texts, declared in columns_of(batches, "label", "text", "n_chars"):
            got = [take(t, n) for t, n in zip(texts, declared)]
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array([a.tolist() for a, _ in got], pa.list_(pa.int32())),
                                              pa.array([b.tolist() for _, b in got], pa.list_(pa.float32()))], ["label", "ids", "x"])

    got = [(r["label"], np.array(r["ids"]), np.array(r["x"], np.float64))
           for r in rows.select("label", "text", F.col("n_chars").cast("long").alias("n_chars"))
           .mapInArrow(run, "label int, ids array<int>, x array<float>").toLocalIterator()]
    if not got:
        return None
    got.sort(key=lambda r: (len(r[1]), r[1].tobytes(), r[0]))
    return FactorisationMachine(SIZE).fit([(a, b) for _, a, b in got], np.array([y for y, _, _ in got], float))


def score(docs: DataFrame, model: FactorisationMachine | None, *keep: str) -> DataFrame:
    """``keep`` columns and the score of each row's whole text; null text counts as empty, no model gives 0.5."""
    schema = docs.select(*keep).schema

    def run(batches):
        import pyarrow as pa
        take = Extractor()
        for batch in batches:
            texts, declared = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "__declared"))
            g = [0.0 if model is None else model.margin(*take(t, n)) for t, n in zip(texts, declared)]
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sigmoid(np.array(g)), pa.float64())], [*keep, "score"])
    return (docs.select(*{*keep, "text"}, F.col("n_chars").cast("long").alias("__declared"))
            .mapInArrow(run, schema.add("score", "double")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``.

    Null and empty texts get the score of their statistics; repeated rows score
    alike; an empty table gives no rows; without labels every score is 0.5.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    model = fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return (score(docs, model, "doc_id")
            .select("doc_id", held_out(FOLD, REST).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
