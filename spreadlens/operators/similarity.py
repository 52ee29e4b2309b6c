"""TF-IDF features and exact cosine k-nearest-neighbour graphs.

TF-IDF (long format ``(news_id, term, weight)``): tokens of two or more
characters from the cleaned text, stop words removed, unigrams and bigrams;
vocabulary = the ``max_features`` terms with the highest corpus frequency (ties
by term); idf = ln((1 + n_docs) / (1 + df)) + 1; raw counts times idf, L2
normalised per document.

kNN: exact all-pairs cosine, top ``k`` per document among neighbours with
similarity >= ``threshold`` (self excluded by id), then undirected with the
larger weight kept.  Documents are hashed into blocks bounded by their entries;
every block pair (i <= j) is one group, worked through in tiles: terms that many
of its documents hold by a dense matrix product, the others entry by entry.  Only
what beats a row's ``k`` best so far is looked at, and only each row's top ``k``
leaves the task.  No pair list is ever materialised, no group exceeds two blocks,
and a row's final top ``k`` is chosen among at most (n_blocks * k) candidates.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import label_name, snippet, unigrams_and_bigrams, vector_tokens
from ..session import cut_lineage, spread, written


def doc_tokens(news_clean: DataFrame) -> DataFrame:
    """(news_id, toks): the tokens of every cleaned text."""
    return spread(news_clean.select("news_id", "clean_text")).select("news_id", vector_tokens(F.col("clean_text")).alias("toks"))


def doc_terms(tokens: DataFrame) -> DataFrame:
    """(news_id, term): a row for every occurrence of a term in tokens (news_id, toks)."""
    # tokens are a column of their own: the bigram lambda reads them many times
    return tokens.select("news_id", F.explode(unigrams_and_bigrams(F.col("toks"))).alias("term"))


def top_terms(terms: DataFrame, max_features: int = 20000) -> DataFrame:
    """(term, term_idx, cf) of the ``max_features`` terms with the most occurrences, counted without regard to documents."""
    counted = terms.groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    top = counted.orderBy(F.col("cf").desc(), F.col("term").asc()).limit(max_features)
    w = Window.orderBy(F.col("cf").desc(), F.col("term").asc())  # over <= max_features rows
    return top.select("term", (F.row_number().over(w) - 1).cast("int").alias("term_idx"), "cf")


def tfidf(news_clean: DataFrame, max_features: int = 20000) -> tuple[DataFrame, DataFrame]:
    """Returns (vectors(news_id, term, term_idx, weight), vocabulary(term, term_idx, cf, df, idf)).

    Texts are cleaned and split once, into a table of tokens.  The vocabulary is
    chosen first, by a count that combines on the map side; only
    its terms are counted by document, and that table is written once (a
    checkpoint) for the document frequencies, the weights and the norms.
    """
    tokens = written(doc_tokens(news_clean), "tokens")
    n_docs = tokens.count()
    terms = doc_terms(tokens)
    top = cut_lineage(top_terms(terms, max_features))
    # the vocabulary is bounded by max_features rows: a safe broadcast
    tf = cut_lineage(terms.join(F.broadcast(top.select("term", "term_idx")), "term")
                     .groupBy("news_id", "term_idx").agg(F.count(F.lit(1)).alias("tf")))
    df = tf.groupBy("term_idx").agg(F.count(F.lit(1)).alias("df"))
    vocab = top.join(F.broadcast(df), "term_idx").select(
        "term", "term_idx", "cf", "df", (F.log((1.0 + F.lit(n_docs)) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    w = tf.join(F.broadcast(vocab.select("term", "term_idx", "idf")), "term_idx").select(
        "news_id", "term", "term_idx", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy(F.col("news_id").alias("id")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vec = w.join(norm, F.col("news_id").eqNullSafe(F.col("id"))).select(
        "news_id", "term", "term_idx", (F.col("w") / F.col("norm")).alias("weight"))
    return vec, vocab


def transform_texts(clean_texts: DataFrame, vocab: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Vectorise new cleaned texts with a fitted vocabulary: (id, term, term_idx, weight)."""
    toks = clean_texts.select(id_col, vector_tokens(F.col("clean_text")).alias("toks"))
    terms = toks.select(id_col, F.explode(unigrams_and_bigrams(F.col("toks"))).alias("term"))
    tf = terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    w = tf.join(F.broadcast(vocab.select("term", "term_idx", "idf")), "term").select(
        id_col, "term", "term_idx", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, id_col).select(id_col, "term", "term_idx", (F.col("w") / F.col("norm")).alias("weight"))


def sparse_rows(vec: DataFrame) -> DataFrame:
    """(news_id, idx array<int>, val array<double>) -- one row per document; a
    document's list is bounded by the vocabulary size."""
    return (vec.groupBy("news_id")
            .agg(F.array_sort(F.collect_list(F.struct("term_idx", "weight"))).alias("p"))
            .select("news_id", F.col("p.term_idx").alias("idx"), F.col("p.weight").alias("val")))


def dense_rows(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    """Unit-normalised dense vectors as (news_id, idx, val) rows."""
    v = vectors.select("news_id", F.transform(F.col(col), lambda x: x.cast("double")).alias("v"))
    v = v.select("news_id", "v", F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0),
                                                   lambda a, x: a + x)).alias("norm"))
    return v.select("news_id", F.sequence(F.lit(0), F.size("v") - 1).alias("idx"),
                    F.transform("v", lambda x: F.when(F.col("norm") > 0, x / F.col("norm"))
                                .otherwise(F.lit(0.0))).alias("val"))


_OUT = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()),
                     T.StructField("sim", T.DoubleType())])


# Similarities are rounded to this many decimals before thresholding and
# ranking, so mathematically equal scores (duplicate documents) tie exactly
# whatever the summation order, and ties break by neighbour id.
SIM_DECIMALS = 12

# A term is multiplied densely where the share of a tile's pairs that hold it is at least this.
DENSE_SHARE = 0.01
TILE_ROWS, TILE_COLUMNS, TILE_BYTES, PRODUCTS = 1024, 2048, 64 * 1024 * 1024, 4_000_000


class _Side:
    """The rows of one block in id order: entries in row order, and the rows' ids."""

    def __init__(self, table):
        ids = np.array(table.column("news_id").to_pylist(), dtype=object).astype(str)
        order = np.argsort(ids, kind="stable")
        at = np.empty(len(ids), dtype=np.int64)
        at[order] = np.arange(len(ids))
        parts = [_entries(batch) for batch in table.to_batches()]
        before = np.cumsum([0] + [batch.num_rows for batch in table.to_batches()])
        cat = lambda j, kind: np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, kind)
        row = at[np.concatenate([p[0] + b for p, b in zip(parts, before)])] if parts else np.zeros(0, np.int64)
        by_row = np.argsort(row, kind="stable")
        self.ids, self.n = ids[order], len(ids)
        self.code = np.cumsum(np.concatenate([[0], self.ids[1:] != self.ids[:-1]])[:self.n])  # equal where the ids are
        self.row, self.col, self.val = row[by_row], cat(1, np.int64)[by_row], cat(2, np.float64)[by_row]
        self.start = np.searchsorted(self.row, np.arange(self.n + 1))

    def strip(self, lo: int, hi: int, place: np.ndarray, width: int):
        """Rows lo to hi: the dense columns as a matrix, the other entries by column."""
        s = slice(self.start[lo], self.start[hi])
        row, col, val = self.row[s] - lo, self.col[s], self.val[s]
        head = place[col] >= 0
        dense = np.zeros((hi - lo, width))
        dense[row[head], place[col[head]]] = val[head]
        row, col, val = row[~head], col[~head], val[~head]
        by_col = np.argsort(col, kind="stable")
        return dense, row[by_col], col[by_col], val[by_col]


def _similarities(left, right) -> np.ndarray:
    """Dot products of two strips: frequent columns by a matrix product, the others entry by entry."""
    dense_l, row_l, col_l, val_l = left
    dense_r, row_r, col_r, val_r = right
    s = dense_l @ dense_r.T
    first = np.searchsorted(col_r, col_l, "left")
    met = np.searchsorted(col_r, col_l, "right") - first
    ends = np.cumsum(met)
    lo = 0
    while lo < len(met):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + PRODUCTS, "right")))
        n = met[lo:hi]
        own = np.repeat(np.arange(lo, hi), n)
        other = np.arange(len(own)) - np.repeat(ends[lo:hi] - n - done, n) + np.repeat(first[lo:hi], n)
        if len(own):
            s += np.bincount(row_l[own] * s.shape[1] + row_r[other], val_l[own] * val_r[other], s.size).reshape(s.shape)
        lo = hi
    return s


class _Best:
    """The ``k`` most similar others of each row of a strip, ties to the smaller place; others are met in rising order of place."""

    def __init__(self, n: int, k: int, thr: float):
        self.k, self.thr = k, thr
        self.floor = np.full(n, thr - 1e-11)  # what a similarity must pass before it is rounded
        self.row, self.other, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, s: np.ndarray, axis: int, first: int, skip=None) -> None:
        """Similarities to the others from place ``first`` on; the strip's rows lie along ``axis``."""
        high = s > (self.floor[:, None] if axis == 0 else self.floor[None, :])
        if skip is not None:
            high &= ~skip
        flat = np.flatnonzero(high)
        if not len(flat):
            return
        at = np.divmod(flat, s.shape[1])
        row, other = at[axis], at[1 - axis]
        sim = np.round(s.ravel()[flat], SIM_DECIMALS)
        good = sim >= self.thr
        row, other, sim = row[good], other[good], sim[good]
        if axis == 1:
            by_row = np.argsort(row, kind="stable")
            row, other, sim = row[by_row], other[by_row], sim[by_row]
        if len(row) > 64 * self.k * len(self.floor) and s.shape[1 - axis] > self.k:
            # very many, copies perhaps: only what reaches the k-th here, and the first k of those equal to it
            kth = np.round(np.partition(np.where(high, s, -np.inf), -self.k, axis=1 - axis).take(-self.k, axis=1 - axis), SIM_DECIMALS)
            equal = sim == kth[row]
            count = np.cumsum(equal)
            start = np.searchsorted(row, np.arange(len(self.floor)))
            before = np.concatenate([[0], count])[start]
            keep = (sim > kth[row]) | (equal & (count - before[row] <= self.k))
            row, other, sim = row[keep], other[keep], sim[keep]
        row, other, sim = (np.concatenate(x) for x in ((self.row, row), (self.other, other + first), (self.sim, sim)))
        order = np.lexsort((other, -sim, row))
        row, other, sim = row[order], other[order], sim[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.row, self.other, self.sim = row[keep], other[keep], sim[keep]
        full = place == self.k - 1
        # others to come have larger ids: they must be more similar than the k-th
        self.floor[row[full]] = sim[full] + 2e-13


def _block_fn(dim: int, k: int, thr: float):
    def fn(key, table):
        import pyarrow as pa
        import pyarrow.compute as pc
        own = key[0].as_py() == key[1].as_py()
        left = _Side(table.filter(pc.equal(table.column("side"), 0)))
        right = left if own else _Side(table.filter(pc.equal(table.column("side"), 1)))
        share = np.bincount(left.col, minlength=dim) / max(left.n, 1) * (np.bincount(right.col, minlength=dim) / max(right.n, 1))
        head = np.flatnonzero(share >= DENSE_SHARE)
        place = np.full(len(share), -1)
        place[head] = np.arange(len(head))
        rows_l, rows_r = (max(1, min(most, TILE_BYTES // (8 * max(1, len(head))))) for most in (TILE_ROWS, TILE_COLUMNS))
        best_l = [_Best(min(rows_l, left.n - lo), k, thr) for lo in range(0, left.n, rows_l)]
        found = []

        def take(mine, others, best, lo):
            found.append((mine.ids[best.row + lo], others.ids[best.other], best.sim))

        for lo_r in range(0, right.n, rows_r):
            hi_r = min(lo_r + rows_r, right.n)
            strip_r = right.strip(lo_r, hi_r, place, len(head))
            best_r = _Best(hi_r - lo_r, k, thr)
            for best, lo in zip(best_l, range(0, left.n, rows_l)):
                hi = min(lo + rows_l, left.n)
                s = _similarities(left.strip(lo, hi, place, len(head)), strip_r)
                if own:
                    best.meet(s, 0, lo_r, left.code[lo:hi, None] == right.code[None, lo_r:hi_r])
                else:
                    best.meet(s, 0, lo_r)
                    best_r.meet(s, 1, lo)
            if not own:
                take(right, left, best_r, lo_r)
        for best, lo in zip(best_l, range(0, left.n, rows_l)):
            take(left, right, best, lo)
        a, b, sim = (np.concatenate([f[j] for f in found]) if found else [] for j in range(3))
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "sim": pa.array(sim, pa.float64())})
    return fn


def knn_blocks(n: int, entries: int, cores: int, block_bytes: int) -> int:
    """Blocks for ``n`` rows, and how often each row is copied: a block's entries stay within the budget, and there are
    no more blocks than that needs but to keep the cores busy."""
    block_rows = max(16, min(32768, block_bytes // (64 + 12 * max(1, entries // max(1, n)))))
    return max(1, math.ceil(n / block_rows), min(math.ceil(math.sqrt(6 * cores)), n // 256))


def knn(rows: DataFrame, dim: int, k: int = 10, threshold: float = 0.25,
        block_bytes: int = 48 * 1024 * 1024) -> DataFrame:
    """Directed kNN lists (a, b, sim): each document's top ``k`` neighbours with
    sim >= threshold, ties by neighbour id."""
    base = cut_lineage(rows.select("news_id", "idx", "val"))
    n, entries = base.agg(F.count(F.lit(1)), F.sum(F.greatest(F.size("idx"), F.lit(0)))).first()
    nb = knn_blocks(n, entries or 0, rows.sparkSession.sparkContext.defaultParallelism, block_bytes)
    base = base.withColumn("blk", F.pmod(F.xxhash64("news_id"), F.lit(nb)).cast("int"))
    # each row goes once to each block pair it belongs to: as left of (blk, j >= blk), as right of (j < blk, blk)
    pairs = base.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).select(
        F.least("blk", "j").alias("bi"), F.greatest("blk", "j").alias("bj"), (F.col("blk") > F.col("j")).cast("int").alias("side"),
        "news_id", "idx", "val")
    cand = pairs.groupBy("bi", "bj").applyInArrow(_block_fn(dim, k, threshold), schema=_OUT)
    w = Window.partitionBy("a").orderBy(F.col("sim").desc(), F.col("b").asc())
    return (cand.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
            .select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("sim").alias("weight")))


def undirected(knn_edges: DataFrame) -> DataFrame:
    """One edge per unordered pair (src < dst), keeping the larger weight."""
    return (knn_edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
            .agg(F.max("weight").alias("weight")))


def similar_to(vec: DataFrame, news_id: str, top: int = 5, id_col: str = "news_id") -> DataFrame:
    """Top documents by cosine with one document (its vector is one row per term,
    bounded by the vocabulary: broadcast)."""
    q = vec.where(F.col(id_col) == news_id).select("term_idx", F.col("weight").alias("qw"))
    s = (vec.where(F.col(id_col) != news_id).join(F.broadcast(q), "term_idx")
         .groupBy(id_col).agg(F.round(F.sum(F.col("weight") * F.col("qw")), SIM_DECIMALS).alias("similarity")))
    return s.orderBy(F.col("similarity").desc(), F.col(id_col).asc()).limit(top)


def dense_similar_to(vectors: DataFrame, news_id: str, top: int = 5, col: str = "embedding") -> DataFrame:
    """Top documents by cosine with one document's dense vector (news_id, similarity).

    That one vector is a literal; a zero vector is similar to nothing (0)."""
    own = vectors.where(F.col("news_id") == news_id).select(F.col(col).cast("array<double>").alias("v")).first()
    if own is None or own["v"] is None:
        return vectors.select("news_id", F.lit(0.0).alias("similarity")).where(F.lit(False))
    q = F.lit(list(own["v"]))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = vectors.where(F.col("news_id") != news_id).select("news_id", F.col(col).cast("array<double>").alias("v"))
    norm = F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(q, q))
    s = v.select("news_id", F.round(F.when(norm > 0, dot(F.col("v"), q) / norm).otherwise(0.0), SIM_DECIMALS).alias("similarity"))
    return s.orderBy(F.col("similarity").desc(), F.col("news_id").asc()).limit(top)


def with_articles(found: DataFrame, articles: DataFrame) -> DataFrame:
    """``found`` (with news_id) and each article's label name, source and first 200 characters."""
    shown = articles.select("news_id", label_name(F.col("label")).alias("label_name"), "source", snippet(F.col("text")).alias("snippet"))
    return found.join(shown, "news_id", "left")


def query_topk(qvec: DataFrame, vec: DataFrame, top: int = 5) -> DataFrame:
    """Top ``top`` documents for each query vector: (query_id, rank, news_id, similarity).

    Computed as a term join between query postings and document postings,
    aggregated per (query, document).  Queries are a batch much smaller than
    the corpus."""
    s = (qvec.select("query_id", "term_idx", F.col("weight").alias("qw"))
         .join(vec.select("news_id", "term_idx", "weight"), "term_idx")
         .groupBy("query_id", "news_id")
         .agg(F.round(F.sum(F.col("qw") * F.col("weight")), SIM_DECIMALS).alias("similarity")))
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("news_id").asc())
    return (s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select("query_id", F.col("rank").cast("bigint").alias("rank"), "news_id", "similarity"))


def knn_vote(neigh: DataFrame, labels: DataFrame) -> DataFrame:
    """Similarity-weighted vote per query: Fake if the fake share is larger,
    otherwise Real; no neighbours or zero total weight -> Unknown, 0.5."""
    j = neigh.join(labels.select("news_id", "label"), "news_id", "left")
    fake = F.col("label") == 0
    agg = j.groupBy("query_id").agg(
        F.sum(F.when(fake, F.col("similarity")).otherwise(0.0)).alias("fake_score"),
        F.sum(F.when(fake, F.lit(0.0)).otherwise(F.col("similarity"))).alias("real_score"),
        F.sum("similarity").alias("total"),
        F.sum(fake.cast("bigint")).alias("n_fake"),
        F.sum((~fake | F.col("label").isNull()).cast("bigint")).alias("n_real"),
        F.avg("similarity").alias("mean_similarity"))
    fp = F.col("fake_score") / F.col("total")
    rp = F.col("real_score") / F.col("total")
    return agg.select(
        "query_id",
        F.when(F.col("total") == 0, F.lit("Unknown")).when(fp > rp, F.lit("Fake")).otherwise(F.lit("Real"))
        .alias("prediction"),
        F.when(F.col("total") == 0, F.lit(0.5)).when(fp > rp, fp).otherwise(rp).alias("confidence"),
        F.col("n_fake").cast("bigint").alias("n_fake"), F.col("n_real").cast("bigint").alias("n_real"),
        "mean_similarity")


def pca_2d(vectors: DataFrame, col: str = "embedding", k: int = 2) -> DataFrame:
    """Project dense vectors on their first ``k`` principal components.

    Vectors are centred first (MLlib's PCA projection does not centre); the
    covariance is aggregated by Spark (a dim x dim matrix, bounded by the vector
    dimension).  Signs are fixed so each component's largest-magnitude loading is
    positive.  Output: (news_id, pc1, ..., pck)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select("news_id", array_to_vector(F.transform(col, lambda x: x.cast("double"))).alias("features"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(v).transform(v)
    model = PCA(k=k, inputCol="centred", outputCol="pc").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[int(np.argmax(np.abs(loadings[:, j]))), j] >= 0 else -1.0 for j in range(k)]
    proj = model.transform(centred).select("news_id", vector_to_array("pc").alias("p"))
    return proj.select("news_id", *[(F.col("p")[j] * F.lit(signs[j])).alias(f"pc{j + 1}") for j in range(k)])


def _entries(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, column and value of every entry of a batch of (idx, val) rows."""
    idx, val = batch.column(batch.schema.get_field_index("idx")), batch.column(batch.schema.get_field_index("val"))
    sizes = idx.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lambda a, kind: a.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return np.repeat(np.arange(len(sizes)), sizes), flat(idx, np.int64), flat(val, np.float64)


def _gram_product(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """X'X times ``block`` for the sparse rows X: each task adds up its rows, terms are summed in a shuffle."""
    dim, m = block.shape
    names = [f"s{j}" for j in range(m)]

    def run(batches):
        import pyarrow as pa
        out = np.zeros((dim, m))
        for batch in batches:
            row, col, val = _entries(batch)
            for j in range(m):
                x = np.bincount(row, val * block[col, j], batch.num_rows)
                out[:, j] += np.bincount(col, val * x[row], dim)
        held = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *(pa.array(out[held, j]) for j in range(m))], ["idx", *names])

    parts = rows.select("idx", "val").mapInArrow(run, ", ".join(["idx int", *(f"{c} double" for c in names)]))
    total = parts.groupBy("idx").agg(*(F.sum(c).alias(c) for c in names)).toPandas()  # dim rows at most
    got = np.zeros((dim, m))
    got[total["idx"].to_numpy(dtype=np.int64)] = total[names].to_numpy(dtype=np.float64)
    return got


def sparse_components(rows: DataFrame, dim: int, k: int = 2, more: int = 8, tol: float = 1e-9,
                      max_rounds: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loadings dim x k, variances, mean) of the first ``k`` principal components of sparse rows (news_id, idx, val).

    A random block of ``k + more`` directions is improved by locally optimal block
    steps: the block, its residuals and its last step are multiplied by the
    covariance in one pass over the rows, and the best directions in their span
    go on, until the residual of the first ``k`` is under ``tol`` times the largest
    variance.  Rows are centred implicitly, so they stay sparse, and the driver holds
    some dim x 3 (k + more) matrices.  No convergence in ``max_rounds`` is an error.
    Each loading vector's entry of largest magnitude is positive.
    """
    n = rows.count()
    mean = np.zeros(dim)
    sums = (rows.select(F.explode(F.arrays_zip("idx", "val")).alias("e")).groupBy(F.col("e.idx").alias("idx"))
            .agg(F.sum("e.val").alias("s")).toPandas())  # dim rows at most
    if n:
        mean[sums["idx"].to_numpy(dtype=np.int64)] = sums["s"].to_numpy(dtype=np.float64) / n
    cov = lambda q: (_gram_product(rows, q) - n * np.outer(mean, mean @ q)) / max(n - 1, 1)

    def best(q, aq, width):
        lam, y = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        y = y[:, ::-1][:, :width]
        return lam[::-1][:width], q @ y, aq @ y

    width = min(k + more, dim)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((dim, width)))[0]
    lam, v, av = best(q, cov(q), width)
    step = np.zeros((dim, 0))
    for _ in range(max_rounds):
        left = av - v * lam
        size = np.linalg.norm(left, axis=0)
        if (size[:k] <= tol * max(lam[0], 0.0)).all():
            break
        span = np.hstack([v, left / np.maximum(size, 1e-300), step])
        q = np.linalg.qr(np.linalg.qr(span)[0])[0]
        lam, new, av = best(q, cov(q), width)
        step = new - v @ (v.T @ new)
        step /= np.maximum(np.linalg.norm(step, axis=0), 1e-300)
        v = new
    else:
        raise RuntimeError(f"no convergence of the principal components in {max_rounds} rounds")
    load = v[:, :k]
    sign = np.where(load[np.argmax(np.abs(load), axis=0), np.arange(load.shape[1])] < 0, -1.0, 1.0)
    return load * sign, lam[:k], mean


def pca_sparse(ids: DataFrame, vec: DataFrame, dim: int, k: int = 2) -> DataFrame:
    """(news_id, pc1, ..., pck): sparse vectors (news_id, term_idx, weight) on their first ``k`` principal components.

    Every row of ``ids`` comes out; one without a term is the zero vector.  The rows
    are written once (a checkpoint) and read in every round.
    """
    rows = cut_lineage(ids.select("news_id").join(sparse_rows(vec), "news_id", "left").select(
        "news_id", F.coalesce("idx", F.array().cast("array<int>")).alias("idx"),
        F.coalesce("val", F.array().cast("array<double>")).alias("val")))
    load, _, mean = sparse_components(rows, dim, k)
    at = mean @ load
    names = [f"pc{j + 1}" for j in range(load.shape[1])]

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            row, col, val = _entries(batch)
            xs = [np.bincount(row, val * load[col, j], batch.num_rows) - at[j] for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in xs)], ["news_id", *names])
    kind = rows.schema["news_id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"news_id {kind}", *(f"{c} double" for c in names)]))
