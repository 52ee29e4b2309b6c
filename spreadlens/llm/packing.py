"""Best-fit packing of token sequences by hierarchical residual packing."""
from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlens.llm.common import documents
from spreadlens.session import cut_lineage

CAPACITY, SEPARATOR, SPECIAL = 2048, 0, "<|endoftext|>"

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, bin long, place long"


def tokenizer_files() -> tuple[str, str]:
    """The vocabulary as a tokenizers file and the same vocabulary as ranks."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """ids as the tokenizers file gives them, without special tokens added.

    The ranks file holds the same vocabulary, and its library gives the same ids
    several times faster; texts that name a special token, or that its pattern
    engine gives up on, go through the tokenizers file itself.
    """

    def __init__(self, files: tuple[str, str]):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        with open(files[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(files[0])

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if SPECIAL not in text:
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # the engine's own panic is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return self.whole.encode(text, add_special_tokens=False).ids


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit, largest items first: bin and offset of each item; bins are numbered from 0.

    Bins are kept by the room that is left, so each step is one search among at
    most ``capacity`` rooms.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    used = 0
    for i in order.tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
        else:
            b, room, used = used, capacity, used + 1
        bins[i], place[i] = b, capacity - room
        if left := room - size:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins, place


def pieces(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str] | None = None) -> DataFrame:
    """Every piece of every document, packed best-fit among the pieces of its own partition.

    A piece is a run of the document's ids and the separator; longer documents are
    cut into pieces of ``capacity``, the first of which may be shorter.  ``bin``
    names a bin of the partition, ``place`` the offset in it.
    """
    files = files or tokenizer_files()
    docs = docs.select("doc_id", "text")

    def run(batches):
        import pyarrow as pa
        encode = Encoder(files)
        ids_of, rows = [], []
        for batch in batches:
            owner = batch.column(batch.schema.get_field_index("doc_id"))
            at = []
            for k, text in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                ids = np.array(encode(text) + [SEPARATOR], "<u4")
                first = len(ids) % capacity or capacity
                for p, e in enumerate(range(first, len(ids) + 1, capacity)):
                    s = max(0, e - capacity) if p else 0
                    at.append(k)
                    rows.append((p, s, e - s, zlib.crc32(ids[s:e].tobytes())))
            ids_of.append(owner.take(pa.array(at, pa.int64())))
        if not rows:
            return
        table = np.array(rows, np.int64)
        bins, place = best_fit(table[:, 2], capacity)
        bins += TaskContext.get().partitionId() << 40
        owner = pa.chunked_array(ids_of).combine_chunks()
        owner = owner.combine_chunks() if isinstance(owner, pa.ChunkedArray) else owner
        for s in range(0, len(table), 20_000):
            part = slice(s, s + 20_000)
            yield pa.RecordBatch.from_arrays(
                [owner[part], pa.array(table[part, 0].astype(np.int32)), *(pa.array(table[part, c].copy()) for c in (1, 2, 3)),
                 pa.array(bins[part].copy()), pa.array(place[part].copy())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place"])
    return docs.mapInArrow(run, PIECES.format(id=docs.schema["doc_id"].dataType.simpleString()))


def _merge(underfull: DataFrame, groups: int, capacity: int, salt: int) -> DataFrame:
    """bin, size, grp of underfull bins -> bin, root, shift, fill: each group's bins packed best-fit as items."""
    def run(batches):
        import pyarrow as pa
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        bins, sizes = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(bins)
        bins, sizes = bins[order], sizes[order]
        to, place = best_fit(sizes, capacity)
        root, fill = np.zeros(to.max() + 1, np.int64), np.zeros(to.max() + 1, np.int64)
        root[to[place == 0]] = bins[place == 0]
        np.add.at(fill, to, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(root[to]), pa.array(place), pa.array(fill[to])], ["bin", "root", "shift", "fill"])
    grp = F.pmod(F.xxhash64("bin", F.lit(salt)), F.lit(groups)).cast("int")
    # one partition for each group: the group's number is its partition
    return (underfull.select("bin", "size").repartitionByRange(groups, grp) if groups > 1 else underfull.select("bin", "size").coalesce(1)
            ).mapInArrow(run, "bin long, root long, shift long, fill long")


def pack(docs: DataFrame, capacity: int = CAPACITY, nearly: int = 4, fan_in: int = 8, most: int = 400_000,
         files: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Partitions pack best-fit locally and emit their bins with at most ``nearly``
    free places.  The others are items of the next round: ``fan_in`` partitions'
    worth of them meet in one task and are packed best-fit again, until one task
    is left.  A bin that could take not even the smallest underfull bin is final
    too, so bins that fit with nothing don't pile up.  A task gets about ``most``
    bins; while there are more, rounds deal them anew as long as they save a
    twentieth of a percent of the bins.
    """
    each = cut_lineage(pieces(docs, capacity, files))
    groups = max(1, each.select(F.shiftright("bin", 40).alias("p")).distinct().count())
    size = each.groupBy("bin").agg(F.sum("length").alias("size"))
    under = cut_lineage(size.filter(F.col("size") < capacity - nearly))
    moved, salt = None, 0
    while True:
        low, n = under.agg(F.min("size"), F.count("size")).first()
        under = under.filter(F.col("size") + F.lit(low) <= capacity) if n else under
        if n < 2:
            break
        last, groups = groups, max(-(-groups // fan_in), -(-n // most))
        step = cut_lineage(_merge(under, groups, capacity, salt := salt + 1))
        went = step.filter("bin <> root").select("bin", "root", "shift")
        if moved is None:
            moved = went
        else:
            up = went.select(F.col("bin").alias("root"), F.col("root").alias("top"), F.col("shift").alias("more"))
            moved = (moved.join(up, "root", "left")
                     .select("bin", F.coalesce("top", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
                     .union(went))
        moved = cut_lineage(moved)
        if groups == 1 or (last <= groups and went.count() < n // 2000):
            break
        under = cut_lineage(step.filter("bin = root").filter(F.col("fill") < capacity - nearly).select("bin", F.col("fill").alias("size")))
    if moved is None:
        return each.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    return (each.join(moved, "bin", "left")
            .select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("root", "bin").alias("sequence_id"),
                    (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed into sequences of at most 2048 tokens.

    A null or empty text is one separator; repeated rows are packed as often as
    they occur; an empty table gives no rows.
    """
    return pack(documents(spark, sf_dir))
