"""Corpus pipeline: quality, line dedup, SimHash near-dedup, decontamination, packing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlens.llm import decontamination, linededup, packing, quality, simhash
from spreadlens.llm.common import counted_join, documents, same_row, whole_texts
from spreadlens.session import cut_lineage, read_table, staging_path

#: No SQL expresses a learned classifier or a byte-pair encoder.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, fitted on the labels of ``documents``, rejects."""
    base = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    model = quality.fit(base, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
    columns = docs.columns
    scored = quality.score(docs.withColumnsRenamed({"score": "__score"}), model, *("__score" if c == "score" else c for c in columns))
    return scored.filter(F.col("score") >= 0.5).drop("score").withColumnsRenamed({"__score": "score"}).select(*columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that equal an earlier line or, from five words on, repeat it but for a word in 25 (one at least); documents left without a word go."""
    return linededup.without_lines(docs, linededup.repeated_lines(docs, words_per_edit=25, equal_words=1))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component: the smallest doc_id (null last), of rows that share it the smallest text hash.

    Of repeated rows one stays.  Only ids and hashes are shuffled; whole rows are, if
    at all, those that repeat.
    """
    whole_texts(spark)
    each = simhash.near_duplicates(docs.select("doc_id", "text", F.xxhash64("text").alias("doc")), 4, 4, "doc")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc")
    rows = cut_lineage(each.groupBy("component", "doc_id", "doc").count())
    lead = rows.groupBy("component").agg(F.min(place).alias("lead"))
    gone = cut_lineage(rows.join(lead, "component").filter(place != F.col("lead")).select(F.col("doc_id").alias("__id"), F.col("doc").alias("__doc")))
    kept = counted_join(docs, gone, same_row("__id", "__doc"), "left_anti")
    again = cut_lineage(rows.filter("count > 1").select(F.col("doc_id").alias("__id"), F.col("doc").alias("__doc")))
    if again.isEmpty():
        return kept
    once = counted_join(kept, again, same_row("__id", "__doc"), "left_anti")
    more = counted_join(kept, again, same_row("__id", "__doc"), "left_semi")
    return once.union(more.dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    whole_texts(spark)
    found = decontamination.contained_items(docs.select("doc_id", "text", F.xxhash64("text").alias("doc")),
                                            read_table(spark, sf_dir, "benchmark"), keep=("doc_id", "doc"))
    hit = cut_lineage(found.select(F.col("doc_id").alias("__id"), F.col("doc").alias("__doc")).distinct())
    return counted_join(docs, hit, same_row("__id", "__doc"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens (the columns of op9)."""
    whole_texts(spark)
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = staging_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
