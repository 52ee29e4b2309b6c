"""Benchmark decontamination: size-partitioned MinHash containment search."""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlens.llm.common import WordHash64, documents
from spreadlens.session import read_table

WORD = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * BASE + ids[j:j + n]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Items:
    """A block of test items: distinct shingles, and the minima of their hashes under each permutation, by size class.

    The class of an item with q distinct shingles is the power of two u >= q.
    Documents are looked at in windows of 3 blocks of u/2 shingles, one block
    apart, so a passage of u shingles lies in a window at most half as large
    again: the Jaccard similarity of window and item stays high however long the
    document is.
    """

    def __init__(self, rows: list[tuple], k: int, threshold: float, permutations: int = 48, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.k, self.threshold = k, threshold
        self.mult = rng.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
        self.ids, self.shingles, self.length = [], [], []
        hashes, classes = WordHash64(), {}
        for item_id, text in rows:
            words = _words(text)
            if not words:
                continue
            size = min(k, len(words))
            ids = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
            grams = np.unique(_grams(ids, size))
            classes.setdefault((size, 1 << int(len(grams) - 1).bit_length()), []).append(len(self.ids))
            self.ids.append(item_id)
            self.length.append(size)
            self.shingles.append({tuple(words[i:i + size]) for i in range(len(words) - size + 1)})
            self.__dict__.setdefault("grams", []).append(grams)
        self.classes = {}
        for at, items in classes.items():
            keys, owner = [], []
            for i in items:
                low = (self.mult[:, None] * self.grams[i] + self.add[:, None]).min(1)
                keys.append(low)
                owner.append(np.full(len(low), i))
            keys, owner = np.concatenate(keys), np.concatenate(owner)
            order = np.argsort(keys, kind="stable")
            self.classes[at] = (keys[order], owner[order])
        self.__dict__.pop("grams", None)

    def candidates(self, ids: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs of which a window and the item share a minimum; ids: the words of all documents in a row."""
        out, starts = set(), np.concatenate([[0], ends[:-1]])
        for size in sorted({s for s, _ in self.classes}):
            grams = _grams(ids, size)
            if not len(grams):
                continue
            owner = np.repeat(np.arange(len(ends)), ends - starts)[:len(grams)]
            whole = np.arange(len(grams)) + size <= ends[owner]  # not across two documents
            grams, owner = grams[whole], owner[whole]
            if not len(grams):
                continue
            for (_, u), (keys, items) in ((c, v) for c, v in self.classes.items() if c[0] == size):
                block = max(1, u // 2)
                at = np.arange(0, len(grams), block)
                for a, b in zip(self.mult, self.add):
                    low = np.minimum.reduceat(grams * a + b, at)
                    win = low.copy()
                    for step in (1, 2):
                        win[:-step] = np.minimum(win[:-step], low[step:]) if len(low) > step else win[:-step]
                    place = np.searchsorted(keys, win)
                    place[place == len(keys)] = 0
                    for w in np.flatnonzero(keys[place] == win).tolist():
                        docs = np.unique(owner[w * block:(w + 3) * block])
                        p = int(place[w])
                        while p < len(keys) and keys[p] == win[w]:
                            out.update((int(d), int(items[p])) for d in docs)
                            p += 1
        return out

    def shared(self, item: int, words: list[str]) -> int:
        """How many of the item's distinct shingles the document holds, word for word."""
        size = self.length[item]
        return len(self.shingles[item] & {tuple(words[i:i + size]) for i in range(len(words) - size + 1)})


def _search(docs: DataFrame, items: Items, schema, keep: tuple) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        hashes = WordHash64()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            i = 0
            while i < len(texts):
                words, ids, first, total = [], [], i, 0
                while i < len(texts) and total < 300_000:  # documents in a row, whole
                    words.append(_words(texts[i]))
                    ids.append(np.fromiter(map(hashes.__getitem__, words[-1]), np.uint64, len(words[-1])))
                    total += len(words[-1])
                    i += 1
                ends = np.cumsum([len(w) for w in words])
                found = []
                for d, item in sorted(items.candidates(np.concatenate(ids), ends)):
                    n, both = len(items.shingles[item]), items.shared(item, words[d])
                    if both >= items.threshold * n:
                        found.append((first + d, item, n, both))
                if found:
                    rows = pa.array([f[0] for f in found])
                    kept = [batch.column(batch.schema.get_field_index(k)).take(rows) for k in keep]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array([items.ids[f[1]] for f in found], pa.int64() if schema["item_id"].dataType.typeName() == "long" else None),
                         pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32())],
                        [*keep, "item_id", "n_shingles", "n_shared"])
    return docs.mapInArrow(run, schema)


def contained_items(docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.8,
                    block_chars: int = 20_000_000, keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns, item_id, n_shingles, n_shared, containment: items of which a document holds ``threshold`` of the shingles.

    Shingles are ``words`` lower-case words (runs of letters and digits), each
    counted once; an item with fewer words is one shingle.  Items without a word
    are contained nowhere; null texts count as empty; repeated rows come out
    again; empty tables give no rows.  The items are a stated query set: they go
    over the documents in blocks of about ``block_chars`` characters, so what is
    sent to the tasks stays bounded however many there are.
    """
    docs = docs.select(*keep, "text")
    items = benchmark.select("item_id", "text").filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    schema = (docs.select(*keep).schema.add("item_id", items.schema["item_id"].dataType).add("n_shingles", "integer").add("n_shared", "integer"))
    out = None
    for b in range(blocks):
        rows = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
        part = _search(docs, Items(rows, words, threshold), schema, keep)
        out = part if out is None else out.union(part)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with at least 0.8 of the item's five-word shingles in the whole text."""
    return contained_items(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


#: Distinct five-word shingles of items and documents, compared as text.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w, row_number() OVER () AS rid FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w, row_number() OVER () AS iid FROM benchmark),
bs AS (SELECT DISTINCT iid, item_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ds AS (SELECT DISTINCT rid, doc_id, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM d, (SELECT DISTINCT least(5, len(w)) AS n FROM b WHERE len(w) > 0) WHERE len(w) >= n)),
q AS (SELECT iid, count(*) AS n FROM bs GROUP BY iid)
SELECT doc_id, item_id, CAST(any_value(n) AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_shared, count(*) / any_value(n) AS containment
FROM ds JOIN bs USING (s) JOIN q USING (iid) GROUP BY rid, doc_id, iid, item_id HAVING count(*) >= 0.8 * any_value(n)
"""
