"""Phrase collocations, pairs of frequency-ranked ids counted in direct-address tiles, recursively."""
from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spreadlens.llm.common import counted_join, documents
from spreadlens.operators.prefix import numbered
from spreadlens.session import cut_lineage

#: Words of a chunk, bytes of text that are split at a time, ids along a side of a tile, and pairs from which a tile is counted densely.
CHUNK, SLICE, SIDE, DENSE = 1 << 20, 1 << 20, 256, 4096
#: Up to so many frequent pairs (16 bytes each), and an eighth as many frequent words, are sent to the tasks; more are
#: joined by a shuffle.  Pairs that a task merges before it hands them on.
SENT, MERGED = 1 << 21, 1 << 22

#: Ends of pieces become the byte 0xFF, which no UTF-8 text holds, tabs blanks, and A-Z small letters.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(0xFF if b in _ENDS else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_END = b"\xff"

WORDS = "chunk long, lang string, n long, size int, at binary, keys array<string>, counts array<long>"
#: Pairs of a chunk in order of their keys; keys as differences, both compressed.
PAIRS = "chunk long, lang string, size int, at binary, n_keys int, keys binary, counts binary"


class _Local(dict):
    """word -> its number in a chunk, in order of first occurrence; the end of a piece is -1."""

    def __init__(self):
        super().__init__()
        self[_END] = -1

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


def _slices(text: str) -> Iterator[list[bytes]]:
    """Words and ends of pieces of a text, some SLICE bytes at a time, cut between words."""
    raw, at = text.encode().translate(_TABLE), 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            end = max(raw.rfind(b" ", at, end), raw.rfind(_END, at, end)) + 1
            if end <= at:  # a longer word: up to its end
                found = re.compile(b"[ \xff]").search(raw, at + SLICE)
                end = found.end() if found else len(raw)
        yield raw[at:end].replace(_END, b" \xff ").split()
        at = end


def _pack(codes: np.ndarray, kind=np.int32) -> bytes:
    import pyarrow as pa
    return pa.compress(np.ascontiguousarray(codes, kind).tobytes(), codec="zstd", asbytes=True)


def _unpack(at: bytes, size: int, kind=np.int32) -> np.ndarray:
    import pyarrow as pa
    return np.frombuffer(pa.decompress(at, np.dtype(kind).itemsize * size, codec="zstd"), kind) if size else np.zeros(0, kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=0), np.int64)


def _unpack_keys(keys: bytes, size: int) -> np.ndarray:
    return np.cumsum(_unpack(keys, size, np.int64))


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their counts."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(np.concatenate(counts)[order], first) if len(first) else first


def word_chunks(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Texts as word numbers: of each chunk its language, words, their counts, and the number of the word at every place.

    A task holds about ``chunk`` words of all languages at a time; a text longer than
    that goes on in the next chunk from an end of a piece.
    """
    def run(batches):
        import pyarrow as pa
        base, made, held = TaskContext.get().partitionId() << 32, 0, 0
        open_chunks: dict[str, tuple[_Local, list[np.ndarray]]] = {}

        def flush(langs):
            nonlocal made, held
            for lang in langs:
                local, codes = open_chunks.pop(lang)
                at = np.concatenate(codes)
                held -= len(at)
                words = list(local)[1:]
                made += 1
                counts = np.bincount(at[at >= 0], minlength=len(words))
                row = base | made, lang, int(counts.sum()), len(at), _pack(at), [w.decode() for w in words], counts
                kinds = pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["chunk", "lang", "n", "size", "at", "keys", "counts"])
        for batch in batches:
            for text, lang in zip(*(batch.column(i).to_pylist() for i in range(2))):
                lang = "und" if lang is None else lang
                for words in _slices(text or ""):
                    if not words:
                        continue
                    local, codes = open_chunks.setdefault(lang, (_Local(), []))
                    codes.append(np.fromiter(map(local.__getitem__, words), np.int32, len(words)))
                    held += len(words)
                    if held > chunk and words[-1] == _END:
                        yield from flush(list(open_chunks))
                if lang in open_chunks:
                    open_chunks[lang][1].append(np.full(1, -1, np.int32))
                    held += 1
                if held > chunk:
                    yield from flush(list(open_chunks))
        yield from flush(list(open_chunks))
    return docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, WORDS)


def tiled_pairs(a: np.ndarray, b: np.ndarray, side: int = SIDE, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of ids (``a << 32 | b``), their counts, and the number of the pair at each place.

    Ids are ranks by frequency, so the pairs crowd in the tiles of low ids.  A tile
    of side x side pairs that holds at least ``dense`` of them is counted by one
    bincount over all its cells, the cell being the address; the pairs of all other
    tiles are sorted as coordinates.
    """
    a, b = a.astype(np.int64), b.astype(np.int64)
    if not len(a):
        return a, a, a
    tile = a // side * (int(b.max()) // side + 1) + b // side
    order = np.argsort(tile, kind="stable")
    starts = np.flatnonzero(np.diff(tile[order], prepend=-1))
    ends = np.append(starts[1:], len(order))
    full = ends - starts >= dense
    number, keys, counts, used = np.empty(len(a), np.int64), [], [], 0
    for s, e in zip(starts[full].tolist(), ends[full].tolist()):
        rows = order[s:e]
        cell = a[rows] % side * side + b[rows] % side
        cells = np.bincount(cell, minlength=side * side)
        met = np.flatnonzero(cells)
        address = np.empty(side * side, np.int64)
        address[met] = np.arange(used, used + len(met))
        number[rows] = address[cell]
        keys.append((int(a[rows[0]]) // side * side + met // side) << 32 | (int(b[rows[0]]) // side * side + met % side))
        counts.append(cells[met])
        used += len(met)
    rows = order[np.repeat(~full, ends - starts)]
    if len(rows):
        key, place, count = np.unique(a[rows] << 32 | b[rows], return_inverse=True, return_counts=True)
        number[rows] = place + used
        keys.append(key)
        counts.append(count)
    key = np.concatenate(keys)
    order = np.argsort(key)
    place = np.empty(len(key), np.int64)
    place[order] = np.arange(len(key))
    return key[order], np.concatenate(counts)[order], place[number]


def pair_chunks(chunks: DataFrame, side: int = SIDE, dense: int = DENSE) -> DataFrame:
    """Chunks of the pairs of neighbouring ids, from chunks with the ids of their frequent keys (``ids``: place << 32 | id)."""
    def run(batches):
        import pyarrow as pa
        kinds = pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary()
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, lang, size, at, n_keys = (batch.column(c)[i].as_py() for c in range(5))
                ids = batch.column(5)[i].values.to_numpy(zero_copy_only=False)
                rank = np.full(n_keys + 1, -1, np.int32)  # the last is that of -1
                rank[ids >> 32] = ids & 0xFFFFFFFF
                here = rank[_unpack(at, size)]
                valid = (here[:-1] >= 0) & (here[1:] >= 0)
                keys, counts, number = tiled_pairs(here[:-1][valid], here[1:][valid], side, dense)
                if not len(keys):
                    continue
                pairs = np.full(len(valid), -1, np.int32)
                pairs[valid] = number
                row = chunk, lang, len(pairs), _pack(pairs), len(keys), _pack_keys(keys), _pack(counts)
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["chunk", "lang", "size", "at", "n_keys", "keys", "counts"])
    return chunks.select("chunk", "lang", "size", "at", "n_keys", "ids").mapInArrow(run, PAIRS)


def _numbered(often: DataFrame, by: list[str]) -> DataFrame:
    return cut_lineage(numbered(often, [F.desc("a"), *map(F.col, by)], "id"))


def _frequent_words(chunks: DataFrame, least: int) -> DataFrame:
    """lang, key, a, id of the words with a count of at least ``least``, numbered from the most frequent on."""
    each = chunks.select("lang", F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("lang", F.col("x.keys").alias("key"), F.col("x.counts").alias("count"))
    return _numbered(each.groupBy("lang", "key").agg(F.sum("count").alias("a")).filter(F.col("a") >= least), ["lang", "key"])


def _frequent_pairs(chunks: DataFrame, least: int, side: int, merged: int = MERGED) -> DataFrame:
    """key, a, id of the pairs with a count of at least ``least``, numbered from the most frequent on.

    A task adds up its chunks' pairs and hands them on in packed runs, by buckets of
    tiles; the task of a bucket adds up its runs.
    """
    buckets = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def runs(batches):
        import pyarrow as pa

        def out(keys, counts):
            key, count = _added(keys, counts)
            tile = (key >> 32) // side * 1_000_003 + (key & 0xFFFFFFFF) // side
            bucket = (tile * 2_654_435_761 >> 16) % buckets
            order = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            rows = [(int(bucket[own[0]]), len(own), _pack_keys(key[own]), _pack(count[own], np.int64)) for own in np.split(order, starts[1:])]
            kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "size", "keys", "counts"])
        keys, counts, held = [], [], 0
        for batch in batches:
            for size, key, count in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys.append(_unpack_keys(key, size))
                counts.append(_unpack(count, size))
                held += size
                if held >= merged:
                    yield out(keys, counts)
                    keys, counts, held = [], [], 0
        if held:
            yield out(keys, counts)

    def sums(batches):
        import pyarrow as pa
        keys, counts, held, last = [], [], 0, 0
        for batch in batches:
            for _, size, key, count in zip(*(batch.column(i).to_pylist() for i in range(4))):
                keys.append(_unpack_keys(key, size))
                counts.append(_unpack(count, size, np.int64))
                held += size
                if held >= 2 * last + merged:  # what is kept grows only with the different keys
                    key, count = _added(keys, counts)
                    keys, counts, held, last = [key], [count], len(key), len(key)
        if keys:
            key, count = _added(keys, counts)
            often = count >= least
            yield pa.RecordBatch.from_arrays([pa.array(key[often]), pa.array(count[often])], ["key", "a"])
    packed = chunks.select("n_keys", "keys", "counts").mapInArrow(runs, "bucket int, size int, keys binary, counts binary")
    return _numbered(packed.repartition(buckets, "bucket").mapInArrow(sums, "key long, a long"), ["key"])


#: Chunks with the ids of their frequent keys.
WITH_IDS = "chunk long, lang string, size int, at binary, n_keys int, ids array<long>"


def _id_row(batch, i: int, n_keys: int, place: np.ndarray, number: np.ndarray):
    import pyarrow as pa
    ids = pa.ListArray.from_arrays(pa.array([0, len(place)], pa.int32()), pa.array(place.astype(np.int64) << 32 | number))
    return pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(4)), pa.array([n_keys], pa.int32()), ids], ["chunk", "lang", "size", "at", "n_keys", "ids"])


def _with_word_ids(chunks: DataFrame, found: DataFrame, sent: int = SENT) -> DataFrame:
    """Chunks with ``ids``: the place and id of each of their words that is in ``found``.

    Up to an eighth of ``sent`` frequent words go to the tasks.  Beyond, each chunk asks
    for its different words in a join, where a word comes up once a chunk however
    frequent it is.
    """
    if found.count() > sent // 8:
        asked = chunks.select("chunk", "lang", F.posexplode("keys").alias("place", "key"))
        return _joined(chunks.withColumn("n_keys", F.size("keys")), asked.join(found.select("lang", "key", "id"), ["lang", "key"]))
    table: dict[str, dict[str, int]] = {}
    for lang, key, number in zip(*(c.to_pylist() for c in found.select("lang", "key", "id").toArrow().columns)):
        table.setdefault(lang, {})[key] = number
    table = chunks.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column(4)[i].values.to_pylist()
                number = np.fromiter(map(table.value.get(batch.column(1)[i].as_py(), {}).get, words, repeat(-1)), np.int64, len(words))
                place = np.flatnonzero(number >= 0)
                yield _id_row(batch, i, len(words), place, number[place])
    return chunks.select("chunk", "lang", "size", "at", "keys").mapInArrow(run, WITH_IDS)


def _joined(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    ids = hits.groupBy("chunk").agg(F.collect_list(F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("id").cast("long"))).alias("ids"))
    return chunks.select("chunk", "lang", "size", "at", "n_keys").join(ids, "chunk")


def _with_pair_ids(chunks: DataFrame, found: DataFrame, sent: int = SENT) -> DataFrame:
    """The same for pairs.  Up to ``sent`` frequent pairs go to the tasks as sorted arrays; more meet the chunks' pairs in a shuffle."""
    if found.count() > sent:
        def asked(batches):
            import pyarrow as pa
            for batch in batches:
                for chunk, size, key in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    key = _unpack_keys(key, size)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, chunk)), pa.array(np.arange(size, dtype=np.int32)), pa.array(key)], ["chunk", "place", "key"])
        each = chunks.select("chunk", "n_keys", "keys").mapInArrow(asked, "chunk long, place int, key long")
        return _joined(chunks, each.join(found.select("key", "id"), "key"))
    table = found.select("key", "id").toArrow()
    key, number = (table.column(c).to_numpy() for c in ("key", "id"))
    order = np.argsort(key)
    table = chunks.sparkSession.sparkContext.broadcast((key[order], number[order].astype(np.int64)))

    def run(batches):
        key, number = table.value
        for batch in batches:
            for i in range(batch.num_rows if len(key) else 0):
                own = _unpack_keys(batch.column(5)[i].as_py(), batch.column(4)[i].as_py())
                place = np.minimum(np.searchsorted(key, own), len(key) - 1)
                hit = np.flatnonzero(key[place] == own)
                yield _id_row(batch, i, len(own), hit, number[place[hit]])
    return chunks.select("chunk", "lang", "size", "at", "n_keys", "keys").mapInArrow(run, WITH_IDS)


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, chunk: int = CHUNK, side: int = SIDE, dense: int = DENSE,
            sent: int = SENT, merged: int = MERGED) -> tuple[DataFrame, DataFrame]:
    """(lang, words, a, heads, tails, longer) of every phrase of 2 to ``longest`` words that occurs ``least`` times, and (lang, n).

    Texts are split into words once and kept as numbers.  Frequent words get ids by
    frequency; pairs of neighbouring ids are counted in tiles; the frequent pairs
    are ranked anew, and a pair of neighbouring frequent phrases of k words is a
    phrase of k + 1.  A phrase can only be frequent if both its parts are, so
    nothing is lost.  heads and tails are the counts of the phrase's first and last 1, 2, ...
    words, longer the largest count of a frequent phrase of one word more that holds it.

    Null texts are empty, null languages ``und``; rows, also repeated ones and those
    without an id, count as often as they occur; further columns are not read; an
    empty table gives no rows.
    """
    chunks = cut_lineage(word_chunks(docs, chunk))
    words = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    found = _frequent_words(chunks, least)
    rows = found.select("id", "lang", F.array("key").alias("words"), "a", F.array("a").alias("heads"), F.array("a").alias("tails"))
    levels = []
    for k in range(2, longest + 1):
        chunks = cut_lineage(pair_chunks(_with_word_ids(chunks, found, sent) if k == 2 else _with_pair_ids(chunks, found, sent), side, dense))
        found = _frequent_pairs(chunks, least, side, merged)
        first = rows.select(F.col("id").alias("left"), "lang", F.col("words").alias("begin"), "heads")
        last = rows.select(F.col("id").alias("right"), F.element_at("words", -1).alias("end"), "tails")
        pairs = found.select("id", "a", F.shiftrightunsigned("key", 32).alias("left"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("right"))
        held = pairs.select(F.explode(F.array("left", "right")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("longer"))
        levels.append(rows.join(held, "id", "left"))
        rows = cut_lineage(counted_join(counted_join(pairs, first, "left"), last, "right").select(
            "id", "lang", F.concat("begin", F.array("end")).alias("words"), "a", F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails")))
        if rows.isEmpty():
            break
    levels.append(rows.withColumn("longer", F.lit(None).cast("long")))
    out = levels[1]
    for level in levels[2:]:
        out = out.unionByName(level)
    return out.drop("id"), words


def scored(candidates: DataFrame, words: DataFrame, share: int = 100) -> DataFrame:
    """Candidates with n and their lowest-scoring cut: l, r and floor(1000 * a * n / (l * r)); ties go to the shortest first part.

    Candidates whose words lie inside a longer candidate with ``share`` percent of
    their count are left out: if any longer one has it, so has one of a word more.
    Products are exact decimals of 38 digits, which counts to 9 * 10^15 cannot leave.
    """
    kept = candidates.filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    cut = """array_min(transform(sequence(1, size(words) - 1), k -> named_struct(
        'score', (cast(1000 * a as decimal(19,0)) * cast(n as decimal(18,0)))
                 div (cast(heads[k - 1] as decimal(18,0)) * cast(tails[size(words) - k - 1] as decimal(18,0))),
        'k', k, 'l', heads[k - 1], 'r', tails[size(words) - k - 1])))"""
    return (counted_join(kept, words, "lang").withColumn("cut", F.expr(cut))
            .select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score"))


def collocations(docs: DataFrame, top: int = 2000, least: int = 100, longest: int = 5, share: int = 100, **tiles) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language by score, count and phrase (see ``phrases``, ``scored``)."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored(*phrases(docs, least, longest, **tiles), share).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language over the whole texts of ``documents`` (see ``phrases`` and ``scored``)."""
    return collocations(documents(spark, sf_dir).select("text", "lang"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, [w FOR w IN string_split_regex(piece, '[ \t]') IF w <> ''] AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
          unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM places GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, x.a AS l, y.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:c.k], ' ')
  JOIN n ON n.lang = c.lang),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT DISTINCT s.lang, s.phrase, s.a
  FROM (SELECT lang, a, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
        FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))) s),
gone AS (SELECT DISTINCT lang, phrase, a FROM inside),
kept AS (SELECT * FROM least WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.lang = least.lang AND g.phrase = least.phrase AND 100 * g.a >= 100 * least.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept)
WHERE rank <= 2000
"""
