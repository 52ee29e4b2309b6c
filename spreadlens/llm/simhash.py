"""SimHash near-duplicates found by pigeonring filtering."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlens.llm.common import documents
from spreadlens.operators.components import contract
from spreadlens.session import cut_lineage

BITS, SEED = 64, 42


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of a whole text as an unsigned 64-bit number.

    A-Z in lower case, words are runs without ASCII white space, shingles keep
    repeats; a text with fewer words is one shingle, one without words gives 0.
    A bit is set if it is set in over half of the shingles' XXH64 values.
    """
    import xxhash
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined, ends = b" ".join(parts), np.cumsum(np.fromiter(map(len, parts), np.int64) + 1) - 1
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1:].tolist())], np.uint64)
    on = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 8192):
        on += np.unpackbits(h[i:i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * on > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, *keep: str) -> DataFrame:
    """``keep`` columns and fp (the fingerprint's bits as a signed long), one row for each row of ``docs``."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            fp = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fp)], [*keep, "fp"])
    return docs.select(*keep, "text").mapInArrow(run, docs.select(*keep).schema.add("fp", "long"))


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of distance + 1 segments of the 64 bits, laid in a ring."""
    m = distance + 1
    return [(BITS * i // m, BITS * (i + 1) // m - BITS * i // m) for i in range(m)]


def _chain(x: np.ndarray, first: int, distance: int) -> np.ndarray:
    """Which differences ``x`` (XOR of two fingerprints) pass the chain that starts at segment ``first``:

    for every l the first l segments of the ring from there differ in at most
    floor(l * distance / m) bits; and, as the last step, in ``distance`` bits in all.
    """
    ring, at, spent = segments(distance), np.arange(len(x)), np.zeros(len(x), np.int64)
    for step in range(1, len(ring) + 1):
        shift, bits = ring[(first + step - 1) % len(ring)]
        spent = spent[at] if len(spent) != len(at) else spent
        spent = spent + np.bitwise_count((x[at] >> np.uint64(shift)) & np.uint64((1 << bits) - 1))
        ok = spent <= step * distance // len(ring)
        at, spent = at[ok], spent[ok]
    return at


def _group_links(fp: np.ndarray, probe: np.ndarray, first: int, distance: int, strip: int = 1 << 18):
    """Links of one bucket as star edges (fp, smallest linked fp): a component of the bucket's links each."""
    own, root = np.flatnonzero(~probe), np.arange(len(fp))
    found_a, found_b = [], []
    rows = max(1, strip // max(1, len(fp)))
    for i in range(0, len(own), rows):
        a = own[i:i + rows]
        x = (fp[a][:, None] ^ fp[None, :]).ravel()
        keep = np.flatnonzero(x)  # equal fingerprints are one already
        keep = keep[_chain(x[keep], first, distance)]
        a, b = a[keep // len(fp)], keep % len(fp)
        found_a.append(a)
        found_b.append(b)
        if sum(map(len, found_a)) > strip:  # fold what is known, so that a dense bucket stays small
            root = _fold(root, np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b = [], []
    if found_a:
        root = _fold(root, np.concatenate(found_a), np.concatenate(found_b))
    out = np.flatnonzero(root != np.arange(len(fp)))
    return fp[out], fp[root[out]]


def _fold(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each component after the links a-b join the ones in ``root``."""
    if not len(a):
        return root
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[root])
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def links(distinct: DataFrame, distance: int = 4, bucket: int = 256, cell: int = 4096) -> DataFrame:
    """Edges (src, dst) with the connected components of all pairs of ``distinct`` (fp) within ``distance`` bits.

    Pigeonring: with m = distance + 1 segments in a ring, a pair within the
    distance has a segment from which every chain of l segments differs in at most
    l * distance / m bits: in none of the first segment, in one of the first two,
    and so on.  So the first segment is part of the key of a bucket; so are some
    bits of the second, of which the probing side tries every value one bit away,
    as many as keep the mean bucket near ``bucket``.  Pairs of a bucket pass the
    chain step by step before the full distance.  A bucket over ``cell`` rows is
    dealt to the pairs of its cells, so no task holds more than two cells of it.
    """
    n = distinct.count()
    ring = segments(distance)
    extra = max(0, min(ring[1 % len(ring)][1] if distance else 0, math.ceil(math.log2(max(1, n) / (bucket << ring[0][1]))) if n else 0))
    keys = []
    for i, (shift, bits) in enumerate(ring):
        s2, _ = ring[(i + 1) % len(ring)]
        own = F.shiftrightunsigned("fp", shift).bitwiseAND((1 << bits) - 1 if bits < 64 else -1)
        more = F.shiftrightunsigned("fp", s2).bitwiseAND((1 << extra) - 1)
        for flip in [None, *range(extra)]:
            ext = more if flip is None else more.bitwiseXOR(1 << flip)
            keys.append(F.struct(F.lit(i).alias("ring"), (F.shiftleft(own, extra).bitwiseOR(ext) if extra else own).alias("key"),
                                 F.lit(flip is not None).alias("probe")))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")
    big = cut_lineage(rows.groupBy("ring", "key").count().filter(F.col("count") > cell)
                      .select("ring", "key", F.ceil(F.col("count") / cell).cast("int").alias("cells")))
    if big.isEmpty():
        rows = rows.withColumn("a", F.lit(0)).withColumn("b", F.lit(0))
    else:
        rows = rows.join(big, ["ring", "key"], "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
        rows = (rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
                .select("fp", "ring", "key", "probe", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b")))

    def run(batches):
        import pyarrow as pa
        held, held_key = [], None

        def flush():
            fp = np.concatenate([h[0] for h in held])
            probe = np.concatenate([h[1] for h in held])
            return _group_links(fp, probe, int(held_key[0]), distance)

        names = ["ring", "key", "a", "b"]
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            key = np.stack([col(c).astype(np.int64) for c in names], 1)
            fp, probe = col("fp").view(np.uint64), col("probe").astype(bool)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            src, dst = [], []
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)]):
                if held and not (key[s] == held_key).all():
                    if sum(len(h[0]) for h in held) > 1:
                        a, b = flush()
                        src.append(a)
                        dst.append(b)
                    held = []
                held_key = key[s]
                held.append((fp[s:e], probe[s:e]))
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src).view(np.int64)), pa.array(np.concatenate(dst).view(np.int64))], ["src", "dst"])
        if held:
            a, b = flush()
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"])

    return (rows.repartition(F.col("ring"), F.col("key"), F.col("a"), F.col("b")).sortWithinPartitions("ring", "key", "a", "b")
            .select("fp", "ring", "key", "probe", "a", "b").mapInArrow(run, "src long, dst long").distinct())


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, *keep: str) -> DataFrame:
    """doc_id, ``keep``, fp, component, component_id of every row of ``docs``.

    component is the smallest fingerprint and component_id the smallest doc_id that
    is reachable over links.

    Rows with equal fingerprints are one node, so copies are never paired.  Null
    and empty texts have fingerprint 0 and link like any other; a null doc_id is
    kept, and a component of null ids only has a null component_id; repeated rows
    come out as often as they go in; an empty table gives no rows.
    """
    each = cut_lineage(fingerprints(docs, words, "doc_id", *keep))
    distinct = cut_lineage(each.groupBy("fp").agg(F.min("doc_id").alias("low")))
    comp = contract(links(distinct.select("fp"), distance))
    # the component's smallest doc_id: only nodes with a link change theirs
    linked = distinct.join(comp.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("component").agg(F.min("low").alias("least"))
    name = linked.join(least, "component").select("fp", "component", "least")
    named = distinct.join(name, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"),
                                                     F.when(F.col("component").isNotNull(), F.col("least")).otherwise(F.col("low")).alias("component_id"))
    return each.join(named, "fp").select("doc_id", *keep, "fp", "component", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all of ``documents``: 4-word shingles, 4 bits (see ``near_duplicates`` for odd rows)."""
    out = near_duplicates(documents(spark, sf_dir), 4, 4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
