"""Vector codes by dual-tree Lloyd: trees over the parts of the vectors and over the codebook's entries."""
from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlens.llm.common import counted_join
from spreadlens.session import cut_lineage, read_table

#: Components become floor(SCALE * x).
SCALE = 1024
#: Vectors of a block, points of a leaf of its trees, and entries of a leaf of the codebook's tree.
BLOCK, LEAF, ENTRY_LEAF = 4096, 64, 8


def whole_numbers(x: np.ndarray, parts: int) -> np.ndarray:
    """floor(SCALE * x) as 64-bit integers, filled up with zeros to a multiple of ``parts`` columns.

    Products with a power of two are exact in double precision.  Components so
    large that a squared distance may leave 62 bits are an error: no long could
    hold the result.
    """
    x = np.floor(x.astype(np.float64) * SCALE)
    width = -(-x.shape[1] // parts)
    if x.size and 4 * width * parts * float(np.abs(x).max()) ** 2 >= 2.0 ** 62:
        raise ValueError("components are too large for exact distances in 64 bits")
    return np.pad(x.astype(np.int64), ((0, 0), (0, width * parts - x.shape[1])))


class Tree:
    """Balanced tree over integer points: boxes and sums of its nodes, kept once for all rounds.

    Node 1 is the root and node i has children 2i and 2i + 1; level l cuts the
    order of the points at n * k // 2^l.  Each node is split at the median of the
    widest side of its box.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        n = len(points)
        self.depth = max(0, int(-(-n // leaf) - 1).bit_length()) if n > leaf else 0
        self.n, order = n, np.arange(n)
        for level in range(self.depth):
            for k in range(1 << level):
                s, e, mid = n * k >> level, n * (k + 1) >> level, n * (2 * k + 1) >> level + 1
                own = points[order[s:e]]
                side = own[:, int(np.argmax(own.max(0) - own.min(0)))]
                order[s:e] = order[s:e][np.argpartition(side, mid - s)]
        self.order = order
        width, first = points.shape[1], 1 << self.depth
        self.low, self.high, self.sum = (np.zeros((2 * first, width), np.int64) for _ in range(3))
        starts = np.arange(first) * n >> self.depth
        own = points[order]
        for table, merge in ((self.low, np.minimum), (self.high, np.maximum), (self.sum, np.add)):
            table[first:] = merge.reduceat(own, starts)
            for p in range(first - 1, 0, -1):
                table[p] = merge(table[2 * p], table[2 * p + 1])

    def span(self, node: int) -> tuple[int, int]:
        level = node.bit_length() - 1
        k = node - (1 << level)
        return self.n * k >> level, self.n * (k + 1) >> level

    def store(self) -> tuple[bytes, bytes]:
        return self.order.astype(np.int32).tobytes(), np.stack([self.low, self.high, self.sum]).tobytes()

    @classmethod
    def load(cls, order: bytes, nodes: bytes, width: int) -> "Tree":
        self = cls.__new__(cls)
        self.order = np.frombuffer(order, np.int32)
        self.low, self.high, self.sum = np.frombuffer(nodes, np.int64).reshape(3, -1, width)
        self.n, self.depth = len(self.order), (len(self.low) // 2).bit_length() - 1
        return self


class Entries:
    """A part's codebook with its tree; below its leaves the entries themselves are nodes."""

    def __init__(self, book: np.ndarray):
        self.book, self.tree = book, Tree(book, ENTRY_LEAF)
        first = 1 << self.tree.depth
        self.first, self.single = first, 2 * first
        #: boxes of the tree's nodes, then each entry as a box of its own
        self.low = np.concatenate([self.tree.low, book])
        self.high = np.concatenate([self.tree.high, book])
        below = {}
        for leaf in range(first, 2 * first):
            s, e = self.tree.span(leaf)
            below[leaf] = self.tree.order[s:e] + self.single
        self.below = below
        self.floats = book.astype(np.float64)
        self.exact = 4 * book.shape[1]

    def open(self, nodes: np.ndarray) -> np.ndarray:
        """The children of inner nodes, the entries of leaves, entries as they are."""
        inner = nodes[nodes < self.first]
        leaves = nodes[(nodes >= self.first) & (nodes < self.single)]
        return np.concatenate([nodes[nodes >= self.single], 2 * inner, 2 * inner + 1, *(self.below[i] for i in leaves.tolist())])


def _survivors(low, high, entries: Entries, nodes: np.ndarray) -> np.ndarray:
    """Entry nodes that may hold the nearest entry of a point of the box.

    A node goes if all of it is farther from all of the box than some other node's
    farthest place.  Once only entries are left, one goes if the box lies wholly on
    the other side of the bisector between it and the entry nearest to the box's
    middle.  Equal distances stay, so ties are settled exactly.
    """
    a, b = entries.low[nodes], entries.high[nodes]
    gap = np.maximum(np.maximum(a - high, low - b), 0)
    far = np.maximum(b - low, high - a)
    nodes = nodes[np.einsum("ij,ij->i", gap, gap) <= np.einsum("ij,ij->i", far, far).min()]
    if len(nodes) == 1 or nodes.min() < entries.single:
        return nodes
    own = entries.book[nodes - entries.single]
    twice = 2 * own - (low + high)
    one = own[int(np.einsum("ij,ij->i", twice, twice).argmin())]
    toward = own - one
    # the most that the distance to ``one`` exceeds the distance to the other entry anywhere in the box
    most = 2 * np.maximum(toward * low, toward * high).sum(1) + (one * one).sum() - np.einsum("ij,ij->i", own, own)
    return nodes[most >= 0]


def nearest_entries(tree: Tree, points: np.ndarray, entries: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Entry of each point, and the count and sum of the points of each entry.

    Pairs of a point node and entry nodes go down both trees together.  Where one
    entry is left, the whole point node is assigned and its kept sum added; in a
    leaf that stays uncertain the distances to the entries left are computed in
    integers, ties to the lower index.
    """
    k = len(entries.book)
    assigned = np.empty(len(points), np.int64)
    count, total = np.zeros(k, np.int64), np.zeros((k, points.shape[1]), np.int64)
    told = {"pairs": 0, "whole": 0, "distances": 0}
    unsure = []
    first_leaf = 1 << tree.depth
    stack = [(1, np.array([1]))] if len(points) else []
    while stack:
        node, nodes = stack.pop()
        told["pairs"] += len(nodes)
        nodes = _survivors(tree.low[node], tree.high[node], entries, nodes)
        if len(nodes) == 1 and nodes[0] >= entries.single:
            s, e = tree.span(node)
            entry = int(nodes[0]) - entries.single
            assigned[tree.order[s:e]] = entry
            count[entry] += e - s
            total[entry] += tree.sum[node]
            told["whole"] += e - s
            continue
        if node < first_leaf:
            nodes = entries.open(nodes)
            stack += [(2 * node, nodes), (2 * node + 1, nodes)]
            continue
        while nodes.min() < entries.single:
            nodes = _survivors(tree.low[node], tree.high[node], entries, entries.open(nodes))
        left = np.sort(nodes - entries.single)
        s, e = tree.span(node)
        rows = tree.order[s:e]
        told["distances"] += len(rows) * len(left)
        assigned[rows] = left[_distances(points[rows], entries, left).argmin(1)]
        unsure.append(rows)
    if unsure:
        rows = np.concatenate(unsure)
        to = assigned[rows]
        count += np.bincount(to, minlength=k)
        np.add.at(total, to, points[rows])
    return assigned, count, total, told


def _distances(points: np.ndarray, entries: Entries, left: np.ndarray) -> np.ndarray:
    """Squared distances of whole numbers; by a product of doubles while every term is a whole number below 2^53, else of 64-bit integers."""
    most = max(int(np.abs(points).max()), int(np.abs(entries.book).max()))
    x, y = (points.astype(np.float64), entries.floats[left]) if entries.exact * most * most < 1 << 53 else (points, entries.book[left])
    return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None]


def _kept(vectors: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """Rows whose vector has no null or non-finite component, of the most common length (ties: the shorter)."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), x.alias("embedding"), F.col(label).alias("label")).filter(
        F.coalesce(F.size(x) > 0, F.lit(False)) & ~F.coalesce(bad, F.lit(True)))
    dim = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.filter(F.size("embedding") == (dim["dim"] if dim else 0))


def _blocks(rows: DataFrame, parts: int, block: int) -> DataFrame:
    """One row for each block of a partition's vectors: ids, labels, vectors, and each part's tree."""
    kind = rows.schema
    id_type, value, label_type = kind["vec_id"].dataType.simpleString(), kind["embedding"].dataType.elementType.simpleString(), kind["label"].dataType.simpleString()
    dtype = np.float32 if value == "float" else np.float64

    def run(batches):
        import pyarrow as pa

        def emit(got):
            t = pa.Table.from_batches(got).combine_chunks()
            n = t.num_rows
            flat = t.column(1).chunk(0).flatten().to_numpy(zero_copy_only=False).astype(dtype)
            x = whole_numbers(flat.reshape(n, -1), parts)
            orders, nodes = zip(*(Tree(p, LEAF).store() for p in np.split(x, parts, axis=1)))
            one = pa.array([0, n], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(one, t.column(0).chunk(0)), pa.ListArray.from_arrays(one, t.column(2).chunk(0)), pa.array([flat.tobytes()], pa.binary()),
                 pa.array([list(orders)], pa.list_(pa.binary())), pa.array([list(nodes)], pa.list_(pa.binary()))], ["ids", "labels", "vectors", "orders", "nodes"])
        held, rows_held = [], 0
        for batch in batches:
            for s in range(0, batch.num_rows, block):
                some = batch.slice(s, block)
                if rows_held + some.num_rows > block:
                    yield emit(held)
                    held, rows_held = [], 0
                held.append(some)
                rows_held += some.num_rows
        if rows_held:
            yield emit(held)
    return rows.mapInArrow(run, f"ids array<{id_type}>, labels array<{label_type}>, vectors binary, orders array<binary>, nodes array<binary>")


def _read(batch, dtype, parts: int):
    """Of each block its row number, vectors as whole numbers by part, and trees."""
    for i in range(batch.num_rows):
        orders, nodes = batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
        n = len(orders[0]) // 4
        x = whole_numbers(np.frombuffer(batch.column(2)[i].as_py(), dtype).reshape(n, -1), parts)
        own = np.split(x, parts, axis=1)
        yield i, own, [Tree.load(o, t, p.shape[1]) for o, t, p in zip(orders, nodes, own)]


def _sums(blocks: DataFrame, books: np.ndarray, dtype) -> DataFrame:
    """part, entry, position, n, total: what a partition's points add to each entry in use."""
    def run(batches):
        import pyarrow as pa
        parts, k, width = books.shape
        entries = [Entries(b) for b in books]
        count, total = np.zeros((parts, k), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for _, own, trees in _read(batch, dtype, parts):
                for p in range(parts):
                    _, n, s, _ = nearest_entries(trees[p], own[p], entries[p])
                    count[p] += n
                    total[p] += s
        part, entry = np.nonzero(count)
        cells = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), np.repeat(count[part, entry], width), total[part, entry].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if i < 3 else np.int64)) for i, c in enumerate(cells)], ["part", "entry", "position", "n", "total"])
    return blocks.select("ids", "labels", "vectors", "orders", "nodes").mapInArrow(run, "part int, entry int, position int, n long, total long")


def fit(blocks: DataFrame, books: np.ndarray, rounds: int, dtype) -> np.ndarray:
    """Codebooks after ``rounds`` rounds; at most parts x entries x width sums come to the driver in each."""
    for _ in range(rounds):
        exact = "decimal(38,0)"
        got = (_sums(blocks, books, dtype).groupBy("part", "entry", "position")
               .agg(F.sum(F.col("n").cast(exact)).alias("n"), F.sum(F.col("total").cast(exact)).alias("total")).collect())
        books = books.copy()
        for r in got:
            books[r.part, r.entry, r.position] = int(r.total) // int(r.n)
    return books


def assign(blocks: DataFrame, books: np.ndarray, dtype) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    kinds = [blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")]

    def run(batches):
        import pyarrow as pa
        parts = len(books)
        entries = [Entries(b) for b in books if len(b)]
        for batch in batches:
            for i, own, trees in _read(batch, dtype, parts):
                codes = np.stack([nearest_entries(t, p, e)[0] for t, p, e in zip(trees, own, entries)], 1)
                error = sum(((p - e.book[codes[:, j]]) ** 2).sum(1) for j, (p, e) in enumerate(zip(own, entries)))
                hexed, w = codes.astype(np.uint8).tobytes().hex(), 2 * parts
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, batch.column(1)[i].values, pa.array([hexed[s:s + w] for s in range(0, len(hexed), w)], pa.string()), pa.array(error)],
                    ["vec_id", "label", "code", "error"])
    return blocks.mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long")


def codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector: str = "embedding",
          label: str = "label", block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept vector, and the codebooks (parts x entries x width).

    Each part position's codebook starts as that part of the first ``entries`` kept
    rows by id (null ids last; rows that share an id by their vectors, each counting;
    fewer rows, fewer entries).  Rounds are exact in integers, so partitions and
    blocks do not change the result.  A null vector, or one with a null or
    non-finite component, takes no part, nor does one of another length than the
    most common or an empty one; a length that is no multiple of ``parts`` is filled
    up with zeros.  Repeated rows come out as often as they occur; null ids and
    labels and further columns do no harm; an empty table gives no rows and empty
    codebooks.  Components beyond some 2^17 are an error (see ``whole_numbers``).
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    rows = _kept(vectors, id_col, vector, label)
    value = rows.schema["embedding"].dataType.elementType.simpleString()
    if value not in ("float", "double"):
        rows, value = rows.withColumn("embedding", F.col("embedding").cast("array<double>")), "double"
    dtype = np.float32 if value == "float" else np.float64
    start = rows.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    first = whole_numbers(np.array([r.embedding for r in start], np.float64).reshape(len(start), len(start[0].embedding) if start else 0), parts)
    books = np.stack(np.split(first, parts, axis=1))
    blocks = cut_lineage(_blocks(rows, parts, block))
    if len(start):
        books = fit(blocks, books, rounds, dtype)
    return assign(blocks, books, dtype), books


def books_hash(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of all kept ``embeddings`` (see ``codes``)."""
    each, books = codes(read_table(spark, sf_dir, "embeddings"))
    each = cut_lineage(each)
    by_label = each.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return (counted_join(each, by_label, F.col("label").eqNullSafe(F.col("__label")))
            .select("vec_id", "code", "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256")))


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same by joining every part with every entry in each round."""
    def assigned(name, book):
        return f"""{name} AS (SELECT r, part, min(struct_pack(d := d, entry := entry)) AS m
            FROM (SELECT r, x.part, entry, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS d FROM x JOIN {book} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL)
            GROUP BY ALL)"""
    steps = [f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label,
            [floor(1024 * c::DOUBLE)::BIGINT FOR c IN embedding] AS e, len(embedding) // {parts} AS w
          FROM embeddings WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0)""",
             "x AS (SELECT r, (i - 1) // w AS part, (i - 1) % w AS pos, e[i] AS v FROM (SELECT r, w, e, unnest(range(1, len(e) + 1)) AS i FROM kept))",
             f"b0 AS (SELECT part, r AS entry, pos, v FROM x WHERE r < {entries})"]
    for k in range(rounds):
        steps += [assigned(f"a{k}", f"b{k}"),
                  f"""b{k + 1} AS (SELECT b.part, b.entry, b.pos, coalesce((s - ((s % n) + n) % n) // n, b.v)::BIGINT AS v FROM b{k} b LEFT JOIN
                (SELECT x.part, m.entry AS entry, pos, sum(v)::BIGINT AS s, count(*) AS n FROM a{k} JOIN x ON a{k}.r = x.r AND a{k}.part = x.part GROUP BY ALL) t
                ON b.part = t.part AND b.entry = t.entry AND b.pos = t.pos)"""]
    steps += [assigned("a", f"b{rounds}"),
              "done AS (SELECT r, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a GROUP BY r)",
              f"book AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS h FROM b{rounds})"]
    steps = [s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps]
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM done JOIN kept USING (r), book"""


OP12_SQL = _sql()
