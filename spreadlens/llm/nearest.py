"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spreadlens.llm.common import thin
from spreadlens.session import cut_lineage, read_table

#: The 256 values of a substring, those with fewer bits first: the probes around a value by their distance.
_BY_WEIGHT = np.array(sorted(range(256), key=lambda x: (bin(x).count("1"), x)), np.uint8)


class Codes:
    """Iterative quantisation: principal axes, then rotations learned so that signs lose as little as possible.

    Each of ``rotations`` rotations gives as many bits as the vectors have components.
    """

    def __init__(self, sample: np.ndarray, rotations: int = 2, rounds: int = 30, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(0)
        z = sample - self.mean
        dim = z.shape[1]
        _, axes = np.linalg.eigh(z.T @ z + 1e-12 * np.eye(dim))
        self.turn = []
        for _ in range(rotations):
            turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(np.where(z @ axes @ turn > 0, 1.0, -1.0).T @ (z @ axes))
                turn = (u @ vt).T
            self.turn.append(axes @ turn)
        self.turn = np.concatenate(self.turn, 1)
        self.turn = self.turn[:, :self.turn.shape[1] // 8 * 8] if self.turn.shape[1] >= 8 else self.turn

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """One row of 8-bit substrings for each vector."""
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1)


class SubstringIndex:
    """Rows of a block by the value of each 8-bit substring of their codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.start = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row within ``radius`` bits: by the pigeonhole principle, of m substrings one of the first
        radius mod m + 1 differs in at most radius div m bits, or one of the others in one less."""
        m = len(code)
        each, more = divmod(radius, m)
        hit = np.zeros(len(self.codes), bool)
        for j in range(m):
            budget = min(8, each if j <= more else each - 1)
            if budget < 0:
                continue
            for v in (_BY_WEIGHT[:_WITHIN_SUM[budget]] ^ code[j]).tolist():
                s, e = self.start[j][v], self.start[j][v + 1]
                if s < e:
                    hit[self.order[j][s:e]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]


_WITHIN_SUM = [1, 9, 37, 93, 163, 219, 247, 255, 256]  # values of 8 bits within 0 to 8 flips


def _valid(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` finite components, not all zero, and an id."""
    x = F.col("embedding").cast("array<double>")
    good = (F.size("embedding") == dim) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.select("vec_id", x.alias("embedding")).filter("vec_id is not null").filter(F.coalesce(good, F.lit(False)))


def _radius(sample: np.ndarray, codes: Codes, k: int, recall: float, queries: int = 400) -> int:
    """Bits within which a share ``recall`` of the sample's own nearest neighbours lie; neighbours in the whole table are nearer."""
    q = sample[:queries]
    d = (q * q).sum(1)[:, None] + (sample * sample).sum(1)[None] - 2 * q @ sample.T
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    near = np.argsort(d, 1)[:, :min(k, len(sample) - 1)]
    c = codes(sample)
    bits = np.bitwise_count(c[:len(q), None] ^ c[near]).sum(2)
    return int(np.quantile(bits, recall)) + 1 if bits.size else c.shape[1] * 8


def nearest(vectors: DataFrame, is_query, k: int = 10, recall: float = 0.97, max_sample: int = 4000, query_block: int = 4096,
            block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for every row with ``is_query`` its ``k`` nearest other rows found.

    The codes and the search radius are fitted on at most about ``max_sample``
    vectors; every row is indexed.  A block of ``block`` rows holds its own
    substring tables and is probed by every query, in blocks of ``query_block``
    queries, so what is sent to the tasks is bounded; each block returns at most k
    rows a query, which a ranked window merges.  All rows within the radius are
    reranked by the Euclidean distance of the original vectors; if a block has
    fewer than k of them, the radius grows until it has, so the result is never
    short.  Rows without an id, and vectors that are null, zero, of another length
    than the most common, or hold null or non-finite components take no part; of
    rows that share an id, one counts per vector; ties go to the smaller id.
    """
    sized = vectors.filter("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).count()
    dim = sized.orderBy(F.desc("count"), "dim").first()
    if dim is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = _valid(vectors.select("vec_id", "embedding", is_query.alias("is_query")), dim["dim"])
    good = good.dropDuplicates(["vec_id", "embedding"])
    n = good.count()
    got = thin(good, n, max_sample, F.col("vec_id")).select("vec_id", "embedding").collect()
    got.sort()
    if not got:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r["embedding"] for r in got], float)
    sample = sample[np.random.default_rng(3).permutation(len(sample))]
    codes = Codes(sample)
    radius = _radius(sample, codes, k, recall)
    most_bits = codes.turn.shape[1]

    def encode(batches):
        import pyarrow as pa
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes(x)], pa.binary())], ["vec_id", "embedding", "code"])

    indexed = cut_lineage(good.select("vec_id", "embedding").mapInArrow(encode, "vec_id long, embedding array<double>, code binary"))
    queries = indexed.filter(is_query)
    n_q = queries.count()
    blocks = max(1, -(-n_q // query_block))
    out = None
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        rows.sort(key=lambda r: (r["vec_id"], r["embedding"]))
        q_id = np.array([r["vec_id"] for r in rows], np.int64)
        q_x = np.array([r["embedding"] for r in rows], float)
        q_c = np.array([np.frombuffer(r["code"], np.uint8) for r in rows])

        def probe(batches, q_id=q_id, q_x=q_x, q_c=q_c):
            import pyarrow as pa
            for batch in batches:
                for s in range(0, batch.num_rows, block):
                    part = batch.slice(s, block)
                    ids = part.column(0).to_numpy()
                    x = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                    index = SubstringIndex(np.array([np.frombuffer(c, np.uint8) for c in part.column(2).to_pylist()]))
                    found = []
                    for i in range(len(q_id)):
                        r = radius
                        while True:
                            rows = index.within(q_c[i], r)
                            rows = rows[ids[rows] != q_id[i]]
                            if len(rows) >= k or r >= most_bits:
                                break
                            r += max(1, most_bits // 32)
                        d = np.sqrt(((x[rows] - q_x[i]) ** 2).sum(1))
                        if len(rows) > k:
                            cut = np.partition(d, k - 1)[k - 1]
                            rows, d = rows[d <= cut], d[d <= cut]
                        best = np.lexsort((ids[rows], d))[:k]
                        found.append((np.full(len(best), q_id[i]), np.full(len(best), i), ids[rows[best]], d[best]))
                    if found:
                        cols = [np.concatenate(c) for c in zip(*found)]
                        yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2]), pa.array(cols[3])],
                                                         ["query_id", "q", "vec_id", "score"])
        part = indexed.mapInArrow(probe, "query_id long, q int, vec_id long, score double").withColumn("b", F.lit(b))
        out = part if out is None else out.union(part)
    place = Window.partitionBy("b", "q", "query_id").orderBy("score", "vec_id")
    return (out.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other vectors of every vector of ``embeddings`` whose vec_id is divisible by 100."""
    return nearest(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, 10)
