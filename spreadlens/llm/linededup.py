"""Line deduplication by a deletion-neighbourhood join; DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spreadlens.llm.common import counted_join, documents, same_row
from spreadlens.session import cut_lineage

#: Lines with fewer words are not matched but for edits, nor by default if they are equal.
MIN_WORDS = 5

def _words(line) -> Column:
    """Words of a line in lower case; blanks are spaces, tabs and carriage returns."""
    plain = F.replace(F.replace(F.lower(line), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def _hashes(words: str = "words") -> list[Column]:
    """128 bits that stand for the words of a line."""
    joined = F.array_join(words, " ")
    return [F.xxhash64(joined).alias("h1"), F.xxhash64(F.lit(1), joined).alias("h2")]


def _order() -> Column:
    """Place of a line in the corpus: by doc_id, null last, then by line number."""
    first = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(2 ** 63)).cast("decimal(20,0)"))
    return (first * F.lit(2 ** 31).cast("decimal(10,0)") + F.col("line_no").cast("decimal(10,0)")).cast("decimal(38,0)")


def _shared_run(a: Column, b: Column) -> Column:
    """How many words two arrays share from their start."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs == 0, F.greatest(F.size(a), F.size(b))).otherwise(differs - 1)


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether one inserted, deleted or replaced word at most makes ``a`` into ``b``."""
    longer = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (_shared_run(a, b) + _shared_run(F.reverse(a), F.reverse(b)) >= longer - 1)


def _active(occurrences: DataFrame) -> DataFrame:
    """ord, h1, h2 of the distinct lines that share a half with another: no others can be within one edit.

    Two lines within one edit share their first or their last floor(min(n, m) / 2)
    words, so each line gives its halves of floor(n / 2) and of floor((n - 1) / 2) words.
    """
    halves = occurrences.select("h1", "h2", "ord", F.explode(F.array("p0", "s0", "p1", "s1")).alias("half")).filter("half is not null")
    common = cut_lineage(halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("half"))
    return counted_join(halves, common, ["half"], "left_semi").groupBy("h1", "h2").agg(F.min("ord").alias("ord"))


def _variants(text: DataFrame) -> DataFrame:
    """id, pos, key: the hash of a line without its word at pos, for every word of every line.

    A line's hash is the xor of its words' hashes by position, so the hash without
    word i is the xor of what comes before it and of what comes after it, moved one
    place to the left: two running xors.
    """
    word = (text.select("id", "moved", F.posexplode("words").alias("pos", "word"))
            .select("id", "pos", F.xxhash64("pos", "word").alias("here"),
                    F.xxhash64(F.col("pos") - 1, "word").bitwiseXOR(F.when(F.col("pos") == 0, F.col("moved")).otherwise(F.lit(0).cast("long"))).alias("left")))
    at = Window.partitionBy("id").orderBy("pos")
    before = F.coalesce(F.bit_xor("here").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    until = F.bit_xor("left").over(at.rowsBetween(Window.unboundedPreceding, 0))
    return word.select("id", "pos", before.bitwiseXOR(until).alias("key"))


def _near_earlier(docs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """h1, h2 of the distinct lines that have an earlier distinct line within one edited word."""
    active = cut_lineage(_active(occurrences))
    # their words, from the occurrence that comes first
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select(_order().alias("ord"), "line")
    found = (counted_join(each, active, ["ord"]).withColumn("words", _words(F.col("line")))
             .select("ord", "words", "h1", "h2", *(h.alias(n) for h, n in zip(_hashes(), ("g1", "g2"))))
             .dropDuplicates(["h1", "h2", "g1", "g2"]))
    xor = lambda shift: F.aggregate(F.transform("words", lambda w, i: F.xxhash64(i - shift, w)), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    # the hashes are compared after the table is written: before, they would become join keys and be taken of every line
    text = cut_lineage(found.select(F.monotonically_increasing_id().alias("id"), "ord", "h1", "h2", "g1", "g2", "words",
                                    xor(0).alias("whole"), xor(1).alias("moved"))).filter("h1 = g1 and h2 = g2").drop("g1", "g2")
    variants = _variants(text)
    place = text.select("id", "ord")
    # equal variants: the same word replaced (at the same place), or a line against the same line less a word;
    # only the earliest line of a bucket matters, so buckets are aggregates and no pairs are made within them
    same = cut_lineage(variants.groupBy("key", "pos").agg(F.count("*").alias("c")).filter("c > 1").select("key", "pos"))
    members = counted_join(variants, same, ["key", "pos"]).join(place, "id")
    earliest = members.groupBy("key", "pos").agg(F.min("ord").alias("found"))
    replaced = members.join(earliest, ["key", "pos"]).filter("found < ord").select("id", "found")
    wholes = text.select(F.col("whole").alias("key"), F.col("id").alias("short"), F.col("ord").alias("short_ord"))
    pair = counted_join(variants, wholes, ["key"]).select("id", "short", "short_ord").join(place, "id")
    deleted = pair.filter("short_ord < ord").select("id", F.col("short_ord").alias("found"))
    inserted = pair.filter("ord < short_ord").select(F.col("short").alias("id"), F.col("ord").alias("found"))
    best = replaced.union(deleted).union(inserted).groupBy("id").agg(F.min("found").alias("found"))
    mine = text.select("id", "h1", "h2", F.col("words").alias("a"))
    theirs = text.select(F.col("ord").alias("found"), F.col("words").alias("b"))
    return best.join(mine, "id").join(theirs, "found").filter(within_one_edit(F.col("a"), F.col("b"))).select("h1", "h2").distinct()


def _as_chars(codes: Column) -> Column:
    """A text with one character for each number under 2^20."""
    return F.decode(F.unhex(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c + F.lit(0x10000)), 8, "0")), "")), "UTF-32")


def _code(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(1 << 20))


#: Longs of a line's bitmap of words.
BITMAP = 4


def _bitmap(hashes: str) -> list[Column]:
    """For each of 64 * BITMAP places by hash, whether an odd number of words falls on it: an edit changes two at most."""
    of = F.col(hashes)
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 8).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return [F.aggregate(F.filter(of, lambda h: F.pmod(h, F.lit(BITMAP)) == i), F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(bit(h))).alias(f"b{i}")  # noqa: B023
            for i in range(BITMAP)]


def _class_variants(long: DataFrame, words_per_edit: int) -> DataFrame:
    """h1, key: the hashes of each line's variants that have the words of one class left, all others deleted.

    For a bound of k edits the words are dealt into 2k + 1 classes by their hash.  An
    inserted or deleted word touches one class and a replaced one two, so two lines
    within k edits have a class that no edit touches: their variants with the words of
    that class are equal.  The bound is the longer line's, so a line of n words gives
    the variants of every k from n / words_per_edit to n / (words_per_edit - 1).  A
    variant's hash is the xor of its words' hashes, 0 if no word is left.
    """
    each = (long.select(F.monotonically_increasing_id().alias("id"), "h1", "n", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
            .select("id", "h1", "hashes", F.explode(F.sequence(F.greatest(F.lit(2), F.floor(F.col("n") / words_per_edit).cast("int")),
                                                               F.floor(F.col("n") / (words_per_edit - 1)).cast("int"))).alias("k")))
    at = lambda c, h: F.struct(c.cast("int").alias("c"), h.alias("h"))
    word = each.select("id", "h1", "k", F.explode(F.concat(
        F.transform("hashes", lambda h: at(F.pmod(h, 2 * F.col("k") + 1), h)),
        F.transform(F.sequence(F.lit(0), 2 * F.col("k")), lambda c: at(c, F.lit(0).cast("long"))))).alias("w"))
    return (word.groupBy("id", "h1", "k", F.col("w.c").alias("c")).agg(F.bit_xor("w.h").alias("left"))
            .select("h1", F.xxhash64("k", "c", "left").alias("key")))


def _near_earlier_long(docs: DataFrame, near: DataFrame, min_words: int, words_per_edit: int) -> DataFrame:
    """h1, h2 of the distinct lines that have an earlier one within an edit for each ``words_per_edit`` words of the longer, two at least.

    Equal variants (see ``_class_variants``) are joined.  A line is held first against the
    earliest line of each of its variants, then against the earliest that its bitmap of
    words lets pass, and only what is still left against all of those; lines that are
    ``near`` already are only compared with.
    """
    bound = lambda a, b: F.greatest(F.lit(1), F.floor(F.greatest(a, b) / words_per_edit)).cast("int")
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select(_order().alias("ord"), _words(F.col("line")).alias("words"))
    long = each.withColumn("n", F.size("words")).filter(F.col("n") >= max(min_words, 2 * words_per_edit - 2)).select("ord", "n", "words", *_hashes())
    flat = cut_lineage(_class_variants(long, words_per_edit))
    shared = cut_lineage(flat.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key"))
    hits = cut_lineage(counted_join(flat, shared, ["key"]).distinct())
    lines = cut_lineage(counted_join(long.select("h1", "h2", "n", "ord"), cut_lineage(hits.select("h1").distinct()), ["h1"], "left_semi")
                        .groupBy("h1", "h2", "n").agg(F.min("ord").alias("ord")))
    text = cut_lineage(counted_join(long.withColumnsRenamed({"h1": "g1", "h2": "g2"}), lines.select("h1", "h2", "ord"), ["ord"])
                       .filter("h1 = g1 and h2 = g2").dropDuplicates(["h1", "h2"])
                       .select("h1", "h2", "n", "ord", "words", _as_chars(F.transform("words", _code)).alias("chars"),
                               F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
                       .select("h1", "h2", "n", "ord", "words", "chars", *_bitmap("hashes")))
    bits = [f"b{i}" for i in range(BITMAP)]
    members = cut_lineage(hits.join(text.select("h1", "h2", "n", "ord", *bits), "h1"))

    def alike(n, m, mine, theirs):
        """Whether lengths and bitmaps let two lines be within the bound."""
        apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(mine, theirs)), F.lit(0))
        return (F.abs(F.col(n) - F.col(m)) <= bound(F.col(n), F.col(m))) & (apart <= 2 * bound(F.col(n), F.col(m)))

    def close(pairs):
        """h1, h2 of the lines of pairs (h1, h2 and the earlier line's e1, e2) that are within the bound."""
        of = pairs.select("h1", "h2", "e1", "e2").distinct()
        both = of.join(text.select("h1", "h2", "words", "chars"), ["h1", "h2"]).join(text.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("words").alias("others"),
                                                            F.col("chars").alias("other_chars")), ["e1", "e2"])
        most = bound(F.size("words"), F.size("others"))
        within = lambda x, y: F.call_function("levenshtein", x, y, most) >= 0
        # words with one code make the distance smaller: then it is taken again, with each word's place among all as its code
        known = F.array_distinct(F.concat("words", "others"))
        exact = F.size(known) == F.size(F.array_distinct(F.transform(known, _code)))
        near_by_code = cut_lineage(both.filter(within(F.col("chars"), F.col("other_chars"))).select("h1", "h2", "words", "others", exact.alias("exact")))
        again = (near_by_code.filter(~F.col("exact")).withColumn("known", known)
                 .select("h1", "h2", most.alias("most"), *(_as_chars(F.transform(c, lambda w: F.array_position("known", w))).alias(f"{c}_at") for c in ("words", "others")))
                 .filter("levenshtein(words_at, others_at, most) >= 0"))
        return near_by_code.filter("exact").select("h1", "h2").union(again.select("h1", "h2")).distinct()

    theirs = [f"e_{b}" for b in bits]
    others = members.select("key", F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("n").alias("m"), F.col("ord").alias("before"),
                            *(F.col(b).alias(e) for b, e in zip(bits, theirs)))
    first = others.groupBy("key").agg(F.min_by(F.struct("before", "e1", "e2", "m", *theirs), F.struct("before", "e1", "e2")).alias("e")).select("key", "e.*")
    earlier = (F.col("before") < F.col("ord")) & alike("n", "m", bits, theirs)
    todo = cut_lineage(members.join(near, ["h1", "h2"], "left_anti"))
    # most of a group of copies is settled by its earliest line, without pairs
    settled = cut_lineage(close(todo.join(first, "key").filter(earlier)))
    todo = cut_lineage(todo.join(settled, ["h1", "h2"], "left_anti"))
    # then by the earliest of all that pass: pairs are made and aggregated one by one, not written
    best = (todo.join(others, "key").filter(earlier).groupBy("h1", "h2")
            .agg(F.min_by(F.struct("e1", "e2"), F.struct("before", "e1", "e2")).alias("e")).select("h1", "h2", "e.e1", "e.e2"))
    tried = cut_lineage(best)
    more = cut_lineage(close(tried))
    # a line that nothing passed for has no partner; those whose partner is further off than the bitmaps show are held against all
    left = cut_lineage(todo.join(tried.join(more, ["h1", "h2"], "left_anti").select("h1", "h2"), ["h1", "h2"], "left_semi"))
    rest = close(left.join(others, "key").filter(earlier).select("h1", "h2", "e1", "e2"))
    return settled.union(more).union(rest)


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, words_per_edit: int | None = None, equal_words: int | None = None) -> DataFrame:
    """doc_id, doc (xxhash64 of the text), dropped: the numbers of the lines that repeat an earlier one.

    A line repeats an earlier one if it equals it, or if one inserted, deleted or
    replaced word makes them equal; words are in lower case, between spaces, tabs
    and carriage returns.  With ``words_per_edit`` (4 at least) the bound grows: one
    edit for every so many words of the longer line, and never less than one.
    Earlier means a smaller doc_id (null is last), or a smaller line number in the
    document; lines in one place (repeated rows) are not earlier than each other.
    Lines with fewer than ``min_words`` words are left alone, but equal lines repeat
    from ``equal_words`` words on, if that is given (1 at least).  Null and empty
    texts drop nothing; documents that drop nothing have no row.
    """
    docs = docs.select("doc_id", "text")
    lines = (docs.select("doc_id", F.xxhash64("text").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
             .select("doc_id", "doc", "line_no", _words(F.col("line")).alias("words")).withColumn("n", F.size("words"))
             .filter(F.col("n") >= (min_words if equal_words is None else max(1, min(equal_words, min_words)))))
    half = lambda t, tag, start: F.when((t > 0) & (F.col("n") >= min_words), F.xxhash64(F.lit(tag), F.slice("words", start, t)))
    t0, t1 = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")
    other = F.col("n") % 2 == 0
    thin = cut_lineage(lines.select(
        "doc_id", "doc", "line_no", *_hashes(), half(t0, 0, F.lit(1)).alias("p0"), half(t0, 1, F.col("n") - t0 + 1).alias("s0"),
        F.when(other, half(t1, 0, F.lit(1))).alias("p1"), F.when(other, half(t1, 1, F.col("n") - t1 + 1)).alias("s1")))
    occurrences = thin.withColumn("ord", _order())
    near = _near_earlier(docs, occurrences)
    if words_per_edit:
        near = cut_lineage(near)
        near = near.union(_near_earlier_long(docs, near, min_words, words_per_edit)).distinct()
    near = near.withColumn("near", F.lit(True))
    copied = occurrences.groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).filter("first < last").drop("last")
    known = cut_lineage(copied.join(near, ["h1", "h2"], "full"))
    return (counted_join(occurrences.select("doc_id", "doc", "line_no", "h1", "h2", "ord"), known, ["h1", "h2"])
            .filter("near or first < ord")
            .groupBy("doc_id", "doc").agg(F.sort_array(F.collect_set("line_no")).alias("dropped")))


def without_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without their ``dropped`` lines; documents that lost lines and have no word left go.

    The others keep every column; n_chars, if there is one, follows a changed text.
    """
    drop = dropped.select(F.col("doc_id").alias("__id"), F.col("doc").alias("__doc"), F.col("dropped").alias("__dropped"))
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("__dropped", i))
    both = counted_join(docs, drop, same_row("__id", "__doc"), "left")
    new = {"text": F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__dropped").isNull(), F.col("n_chars")).otherwise(F.length(F.array_join(kept, "\n")))
    return (both.filter(F.col("__dropped").isNull() | F.exists(kept, lambda x: F.size(_words(x)) > 0))
            .withColumns(new).select(*docs.columns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its number of lines and the numbers of those that repeat an earlier line.

    Repeated rows come out again; null texts have no line; an empty table gives no rows.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    drop = repeated_lines(docs).select(F.col("doc_id").alias("id"), F.col("doc").alias("hash"), "dropped")
    each = docs.select("doc_id", F.xxhash64("text").alias("doc"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    both = each.join(drop, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("doc") == F.col("hash")), "left")
    return both.select("doc_id", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).cast("int").alias("n_lines"),
                       F.coalesce(F.size("dropped"), F.lit(0)).cast("int").alias("n_dropped"),
                       F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped"))


#: The same with whole lines and variants as text.
OP2_SQL = r"""
WITH l AS (SELECT rid, doc_id, no - 1 AS line_no, list_filter(regexp_split_to_array(lower(ls[no]), '[ \t\r]+'), lambda x: x <> '') AS w
           FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS no
                 FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(text, chr(10)) AS ls FROM documents))),
o AS (SELECT *, CAST(doc_id AS HUGEINT) * 2147483648 + line_no AS ord, array_to_string(w, ' ') AS s FROM l WHERE len(w) >= 5),
d AS (SELECT s, min(ord) AS ord, any_value(w) AS w FROM o GROUP BY s),
v AS (SELECT s, ord, i, len(w) AS n, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v
      FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
near AS (SELECT s FROM (SELECT s, ord, min(ord) OVER (PARTITION BY v, i, n) AS low FROM v) WHERE low < ord
         UNION SELECT v.s FROM v JOIN d ON d.s = v.v WHERE d.ord < v.ord
         UNION SELECT d.s FROM v JOIN d ON d.s = v.v WHERE v.ord < d.ord),
r AS (SELECT o.rid, o.line_no FROM o JOIN d USING (s) WHERE d.ord < o.ord OR o.s IN (SELECT s FROM near)),
g AS (SELECT rid, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS dropped FROM r GROUP BY rid)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS INTEGER) AS n_lines, CAST(coalesce(n, 0) AS INTEGER) AS n_dropped, coalesce(dropped, '') AS dropped
FROM (SELECT *, row_number() OVER () AS rid FROM documents) LEFT JOIN g USING (rid)
"""
