"""Small helpers that the operators of this subpackage share."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlens.session import read_table


#: Rows and bytes of an Arrow batch while whole texts go to Python: the defaults, 10,000 and 64 MB, hold hundreds of MB in a worker.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def whole_texts(spark: SparkSession) -> None:
    """Hands texts to Python in batches of at most BATCH_ROWS rows and, but for one longer row, about BATCH_BYTES from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole_texts(spark)
    return read_table(spark, sf_dir, "documents")


def remainder(mod: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod ``mod``; null for a null id."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod))


def held_out(mod: int, rest: int, col: str = "doc_id") -> Column:
    """Whether a row belongs to the held-out fold; a row without an id does not."""
    return F.coalesce(remainder(mod, col) == rest, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Texts with a 0/1 label: one label per doc_id (the largest, if rows disagree).

    ``labels`` is a sample of bounded size (see ``thin``), so it is broadcast and no text is shuffled.
    """
    one = (labels.select("doc_id", F.col(label).cast("int").alias("label"))
           .filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")))
    return docs.join(F.broadcast(one), "doc_id")


def thin(df: DataFrame, rows: int, most: int, key: Column) -> DataFrame:
    """About ``most`` of ``rows`` rows, chosen by a hash of ``key``; all of them if there are no more."""
    if rows <= most:
        return df
    cut = int(most / rows * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < cut)


#: Up to so many rows of a few numbers (some 30 MB) may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def counted_join(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a table that is counted first: broadcast if it is small, by a shuffle beyond."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def same_row(id_col: str, doc_col: str, text: str = "text") -> Column:
    """Whether a row of documents is the one named by an id, which may be null, and its text's hash."""
    return F.col("doc_id").eqNullSafe(F.col(id_col)) & F.xxhash64(text).eqNullSafe(F.col(doc_col))


class WordHash(dict):
    """word -> stable hash below ``size``; forgets its words when it holds too many."""

    def __init__(self, size: int, most: int = 100_000):
        super().__init__()
        self.size, self.most = size, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = zlib.crc32(word.encode("utf-8", "replace")) % self.size
        return value


class WordHash64(dict):
    """word -> XXH64; forgets its words when it holds too many."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word) -> int:
        import xxhash
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def columns_of(batches: Iterator, *names: str) -> Iterator[tuple]:
    """Arrow record batches as tuples of Python lists, in the order of ``names``."""
    for batch in batches:
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)
