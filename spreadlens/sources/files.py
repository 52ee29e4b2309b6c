"""File sources and sinks: article CSVs, raw tweet-id CSVs, tweet JSON, catalogs.

Layouts follow the reference data: article CSVs named ``<source>_<fake|real>.csv``
(or folders named that way), raw CSVs with ``id`` / ``tweet_ids`` columns, and
tweet JSON (one object per file, or JSON lines) with Twitter's nested fields.
Reading is Spark's CSV / JSON sources with declared options; per-file choices
(which column holds the text, which the id) are made from each file's header,
which is joined to its rows: one scan reads all files.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
TEXT_CANDIDATES = ("title", "text", "content", "body", "article", "news_article", "tweet_text",
                   "description", "clean_title")
ID_CANDIDATES = ("news_id", "id", "newsid")
LABEL_BY_NAME = {"fake": 0, "real": 1}
SOURCE_LABEL_PATTERN = r"([A-Za-z0-9]+)_(fake|real|unknown)"
TWITTER_TIME_FORMAT = "EEE MMM dd HH:mm:ss Z yyyy"
# parsing skips the leading day name ("Wed "), which Spark only formats
TWITTER_TIME_PARSE = "MMM dd HH:mm:ss Z yyyy"
# ---------------------------------------------------------------------------

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


#: Columns that a CSV file may have; a file with more is an error.
MAX_COLUMNS = 128


def list_files(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """(path) of the files under ``root`` (recursive); a table, since there may be many."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(root).select("path"))


def read_csv_files(spark: SparkSession, root: str, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """Every record of the CSV files under ``root``: (path, header, cells, row_index), in one scan whatever their headers.

    ``header`` is the file's first record, up to its last name; ``row_index`` counts the
    others from 0.  A multi-line file is never split, so ids that rise along a partition
    rise along each file without a gap, and the first record is the one with the least.
    A file without a record gives nothing; one with more than ``max_columns`` is an error.
    """
    names = [f"c{i}" for i in range(max_columns + 1)]
    cells = F.array(*names)
    scan = (spark.read.options(**{**CSV_OPTIONS, "header": "false"}, recursiveFileLookup="true", pathGlobFilter="*.csv")
            .schema(", ".join(f"{n} string" for n in names)).csv(root))
    rows = scan.select(F.col("_metadata.file_path").alias("path"), cells.alias("cells"), F.monotonically_increasing_id().alias("at"))
    used = F.array_max(F.transform(F.col("head"), lambda c, i: F.when(c.isNotNull(), i + 1)))
    heads = (rows.groupBy("path").agg(F.min("at").alias("first"), F.min_by("cells", "at").alias("head"))
             .select("path", "first", F.when(F.col("head")[max_columns].isNull(), F.slice("head", F.lit(1), F.coalesce(used, F.lit(0))))
                     .otherwise(F.raise_error(F.concat(F.lit(f"more than {max_columns} columns in "), "path"))).alias("header")))
    return (rows.join(heads, "path").where(F.col("at") > F.col("first"))
            .select("path", "header", "cells", (F.col("at") - F.col("first") - 1).alias("row_index")))


def _cell(name: str | F.Column) -> F.Column:
    """A record's cell in the column called ``name``; null where the file has none."""
    return F.get("cells", (F.array_position("header", name) - 1).cast("int"))


def _first_name(candidates: tuple[str, ...]) -> F.Column:
    """The first candidate that the header has, else null."""
    return F.get(F.filter(F.array(*map(F.lit, candidates)), lambda c: F.array_contains("header", c)), F.lit(0))


def load_news(spark: SparkSession, root: str) -> DataFrame:
    """Every ``<source>_<label>`` CSV under ``root`` -> (news_id, text, label, source).

    Text is the first of TEXT_CANDIDATES that the file has, without which it is an
    error; the id the first of ID_CANDIDATES, else the row index."""
    found = lambda g: F.element_at(F.regexp_extract_all("path", F.lit(SOURCE_LABEL_PATTERN), F.lit(g)), -1)
    named = read_csv_files(spark, root).where(F.regexp_like("path", F.lit(SOURCE_LABEL_PATTERN)))
    picked = named.withColumns({"text_name": _first_name(TEXT_CANDIDATES), "id_name": _first_name(ID_CANDIDATES)})
    missing = F.raise_error(F.concat(F.lit("could not find a text column in "), "path", F.lit("; columns were "), F.array_join("header", ", ")))
    label = F.create_map(*[F.lit(x) for pair in LABEL_BY_NAME.items() for x in pair])
    return picked.select(
        F.when(F.col("id_name").isNull(), F.col("row_index").cast("string")).otherwise(_cell(F.col("id_name"))).alias("news_id"),
        F.when(F.col("text_name").isNull(), missing).otherwise(_cell(F.col("text_name"))).alias("text"),
        F.try_element_at(label, found(2)).cast("int").alias("label"), found(1).alias("source"))


def raw_stack(spark: SparkSession, root: str) -> DataFrame:
    """(id, tweet_ids) from every raw CSV; no column id -> row index, no or empty tweet_ids -> ''."""
    return read_csv_files(spark, root).select(
        F.when(F.array_contains("header", "id"), _cell("id")).otherwise(F.col("row_index").cast("string")).alias("id"),
        F.coalesce(_cell("tweet_ids"), F.lit("")).alias("tweet_ids"))


def file_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(file_name, n_rows, n_columns) per CSV file under ``root`` that has a row."""
    return (read_csv_files(spark, root).groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("header")).cast("bigint").alias("n_columns"))
            .select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "n_rows", "n_columns"))


# ------------------------------------------------------------------- tweet JSON (S7-S9)

_ID = T.StructType([T.StructField("id_str", T.StringType()), T.StructField("id", T.LongType())])
TWEET_SCHEMA = T.StructType([
    T.StructField("id_str", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("user", _ID),
    T.StructField("retweeted_status", T.StructType([
        T.StructField("id_str", T.StringType()), T.StructField("user", _ID)])),
    T.StructField("in_reply_to_user_id_str", T.StringType()),
    T.StructField("in_reply_to_user_id", T.LongType()),
    T.StructField("entities", T.StructType([
        T.StructField("user_mentions", T.ArrayType(_ID))])),
])


def _id(col: str) -> F.Column:
    return F.coalesce(F.col(f"{col}.id_str"), F.col(f"{col}.id").cast("string"))


def read_tweets(spark: SparkSession, root: str, multi_line: bool = True) -> DataFrame:
    """Tweet JSON -> (tweet_id, user_id, created_at, is_retweet, original_user_id,
    in_reply_to_user_id, mentioned_user_ids, path).  Unreadable records and
    tweets without a user are dropped."""
    raw = (spark.read.schema(TWEET_SCHEMA).option("multiLine", str(multi_line).lower())
           .option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(root))
    flat = raw.select(
        F.coalesce(F.col("id_str"), F.col("id").cast("string")).alias("tweet_id"),
        _id("user").alias("user_id"),
        F.try_to_timestamp(F.expr("substring(created_at, 5)"), F.lit(TWITTER_TIME_PARSE)).alias("created_at"),
        F.col("retweeted_status").isNotNull().alias("is_retweet"),
        F.coalesce("retweeted_status.user.id_str", F.col("retweeted_status.user.id").cast("string")).alias("original_user_id"),
        F.coalesce("in_reply_to_user_id_str", F.col("in_reply_to_user_id").cast("string")).alias("in_reply_to_user_id"),
        F.transform(F.coalesce(F.col("entities.user_mentions"), F.array().cast(T.ArrayType(_ID))),
                    lambda m: F.coalesce(m["id_str"], m["id"].cast("string"))).alias("mentioned_user_ids"),
        F.col("_metadata.file_path").alias("path"))
    return flat.where(F.col("user_id").isNotNull() & (F.col("user_id") != ""))


def tweet_interactions(flat: DataFrame) -> DataFrame:
    """Retweet, reply and mention interactions (src, dst, kind, tweet_id, ts) from flat tweets."""
    rt = flat.where(F.col("is_retweet") & F.col("original_user_id").isNotNull()).select(
        F.col("user_id").alias("src"), F.col("original_user_id").alias("dst"), F.lit("retweet").alias("kind"),
        "tweet_id", F.col("created_at").alias("ts"))
    rp = flat.where(F.col("in_reply_to_user_id").isNotNull()).select(
        F.col("user_id").alias("src"), F.col("in_reply_to_user_id").alias("dst"), F.lit("reply").alias("kind"),
        "tweet_id", F.col("created_at").alias("ts"))
    mn = flat.select(F.col("user_id").alias("src"), F.explode("mentioned_user_ids").alias("dst"),
                     F.lit("mention").alias("kind"), "tweet_id", F.col("created_at").alias("ts"))
    return rt.unionByName(rp).unionByName(mn).where(F.col("dst").isNotNull())


RETWEET_ARRAY = T.ArrayType(T.StructType([
    T.StructField("user", _ID), T.StructField("created_at", T.StringType()),
    T.StructField("retweeted_status", T.StructType([
        T.StructField("id_str", T.StringType()), T.StructField("id", T.LongType()), T.StructField("user", _ID)]))]))


def read_retweets(spark: SparkSession, root: str, whole_files: bool = True) -> DataFrame:
    """JSON arrays of retweets -> (retweeter_id, original_user_id, tweet_id, created_at, path).

    One array a file, or one a line with ``whole_files=False``.  Text that is not an
    array gives nothing, nor does an entry without both users; ``tweet_id`` is the
    retweeted tweet's, null if it has none."""
    text = spark.read.text(root, wholetext=whole_files, recursiveFileLookup=True)
    entry = (text.where(F.ltrim("value").startswith("["))
             .select(F.explode(F.from_json("value", RETWEET_ARRAY)).alias("rt"), F.col("_metadata.file_path").alias("path")))
    some = lambda c: F.when(c != "", c)
    return entry.select(
        some(_id("rt.user")).alias("retweeter_id"), some(_id("rt.retweeted_status.user")).alias("original_user_id"),
        some(_id("rt.retweeted_status")).alias("tweet_id"),
        F.try_to_timestamp(F.expr("substring(rt.created_at, 5)"), F.lit(TWITTER_TIME_PARSE)).alias("created_at"),
        "path").where("retweeter_id is not null and original_user_id is not null")


def retweet_interactions(retweets: DataFrame) -> DataFrame:
    """Retweets of the arrays in the shape of ``tweet_interactions``."""
    return retweets.select(F.col("retweeter_id").alias("src"), F.col("original_user_id").alias("dst"),
                           F.lit("retweet").alias("kind"), "tweet_id", F.col("created_at").alias("ts"))


def json_interactions(tweets: DataFrame, retweets: DataFrame) -> DataFrame:
    """All interactions that JSON files hold: those of flat tweets and those of retweet arrays.

    A retweet that both have is two interactions of the same pair of users."""
    return tweet_interactions(tweets).unionByName(retweet_interactions(retweets))


def path_fields(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds domain, label_name and article_id from ``.../domain/label/article/(tweets|retweets)/file``, null elsewhere."""
    pattern = "([^/]+)/([^/]+)/([^/]+)/(?:tweets|retweets)/[^/]+$"
    return files.withColumns({name: F.nullif(F.regexp_extract(path, pattern, i + 1), F.lit(""))
                              for i, name in enumerate(("domain", "label_name", "article_id"))})


# ----------------------------------------------------------------------------- sinks

def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(**CSV_OPTIONS).csv(path)
    else:
        w.format(fmt).save(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two parquet tables, ``nodes`` and ``edges``."""
    write_table(nodes, f"{path}/nodes")
    write_table(edges, f"{path}/edges")
