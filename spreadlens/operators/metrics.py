"""Article metrics and descriptive statistics (tables, not charts).

Distribution operators pre-aggregate to (group, value, count) before any
window, so a window never sees more rows than there are distinct values.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, is_stop_word, parse_ids
from .prefix import running_sums


def with_clean_text(news: DataFrame, src_col: str = "text", dest_col: str = "clean_text") -> DataFrame:
    if src_col not in news.columns:
        raise KeyError(f"expected column '{src_col}', got {news.columns}")
    return news.withColumn(dest_col, clean_text(F.col(src_col)))


def article_metrics(news: DataFrame, raw: DataFrame) -> DataFrame:
    """news LEFT JOIN parsed raw lists on id (no de-duplication: duplicate raw ids fan out)."""
    parsed = raw.select(F.col("id"), parse_ids(F.col("tweet_ids")).alias("tweet_list"))
    joined = news.join(parsed, news["news_id"] == parsed["id"], "left").drop("id")
    count = F.coalesce(F.size("tweet_list"), F.lit(0)).cast("bigint")
    # size(null) is -1 under legacy settings; guard explicitly.
    count = F.when(F.col("tweet_list").isNull(), F.lit(0).cast("bigint")).otherwise(count)
    return (joined.withColumn("tweet_count", count)
            .withColumn("has_tweets", F.col("tweet_count") > 0))


def quantiles(df: DataFrame, value: str, qs: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, name, ...): exact quantiles of each group with linear interpolation; a row for each group that has a value.

    ``qs`` gives the share of each name.  Values are counted first, the counts
    summed up over range partitions of (group, value), and the two rows whose
    counts hold the ranks of a quantile are picked by an aggregate: no task holds
    all distinct values of a group.  Null and NaN values take no part.
    """
    x = F.col(value).cast("double")
    counts = (df.select(*by, x.alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x")).groupBy(*by, "__x")
              .agg(F.count(F.lit(1)).alias("__n")))
    upto = running_sums(counts, [F.col("__x")], {"__upto": F.col("__n")}, by)
    sizes = counts.groupBy(*by).agg(F.sum("__n").alias("__all"))
    if by:
        on = [upto[c].eqNullSafe(sizes[c]) for c in by]
        ranked = upto.join(sizes, on).select(*(upto[c] for c in by), "__x", "__n", "__upto", "__all")
    else:
        ranked = upto.withColumn("__all", sizes.scalar())
    at = {name: F.lit(q) * (F.col("__all") - 1) for name, q in qs.items()}
    holds = lambda r: (F.col("__upto") > r) & (F.col("__upto") - F.col("__n") <= r)
    picked = ranked.groupBy(*by).agg(
        F.max("__all").alias("__all"),
        *(F.max(F.when(holds(F.floor(r)), F.col("__x"))).alias(f"__lo_{name}") for name, r in at.items()),
        *(F.max(F.when(holds(F.ceil(r)), F.col("__x"))).alias(f"__hi_{name}") for name, r in at.items()))
    part = {name: r - F.floor(r) for name, r in at.items()}
    return picked.where(F.col("__all") > 0).select(
        *by, *(F.when(part[name] == 0, F.col(f"__lo_{name}"))
               .otherwise(F.col(f"__lo_{name}") * (1 - part[name]) + F.col(f"__hi_{name}") * part[name]).alias(name) for name in qs))


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear interpolation), max."""
    x = F.col(value)
    aggs = [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max")]
    if by:
        base = df.where(F.col(by[0]).isNotNull())
        g, q = base.groupBy(*by).agg(*aggs), quantiles(base, value, QUARTILES, tuple(by))
        g = g.join(q, [g[c].eqNullSafe(q[c]) for c in by], "left").select(*(g[c] for c in by), *(c for c in g.columns if c not in by), *QUARTILES)
    else:
        g = df.agg(*aggs).join(F.broadcast(quantiles(df, value, QUARTILES)), F.lit(True), "left")  # a row at most
    return g.select(*(by or []), "count", "mean", "std", "min", *QUARTILES, "max")


def value_distribution(df: DataFrame, col: str) -> DataFrame:
    """value_counts of a column (nulls dropped) with percentage of all rows, 2 decimals."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return (counts.where(F.col(col).isNotNull())
            .select(col, F.col("n").alias("count"),
                    F.round(F.col("n") * 100.0 / total, 2).alias("pct")))


def missing_values(df: DataFrame) -> DataFrame:
    """(column, n_missing) for every column with at least one null."""
    sums = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns])
    long = sums.unpivot([], df.columns, "column", "n_missing")
    return long.where(F.col("n_missing") > 0)


def duplicate_count(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows minus distinct keys (null is one key), like duplicated().sum()."""
    per_key = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


def histogram(df: DataFrame, value: str | Column, by: str, bins: int) -> DataFrame:
    """Equal-width bins over each group's own [min, max]; right edge inclusive.

    A single-valued group falls in the middle bin (the numpy convention).
    """
    v = value if isinstance(value, Column) else F.col(value)
    base = df.where(F.col(by).isNotNull()).select(F.col(by), v.cast("double").alias("x"))
    rng = base.groupBy(by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = (F.when(F.col("hi") == F.col("lo"), F.lit(bins // 2))
         .otherwise(F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))),
                            F.lit(bins - 1))).cast("int"))
    width = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")) / bins)
    start = F.when(F.col("hi") == F.col("lo"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    return (base.join(rng, by).withColumn("bin", b)
            .groupBy(by, "bin").agg(F.count(F.lit(1)).alias("count"),
                                    F.first(start).alias("_s"), F.first(width).alias("_w"))
            .select(by, "bin", (F.col("_s") + F.col("bin") * F.col("_w")).alias("bin_lo"),
                    (F.col("_s") + (F.col("bin") + 1) * F.col("_w")).alias("bin_hi"), "count"))


def box_stats(df: DataFrame, value: str, by: str, positive_only: bool = False) -> DataFrame:
    """Quartiles, IQR, 1.5*IQR whiskers (furthest data inside the fences), outlier count."""
    base = df.where(F.col(by).isNotNull())
    if positive_only:
        base = base.where(F.col(value) > 0)
    x = F.col(value).cast("double")
    q = (base.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
         .join(quantiles(base, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, (by,)), by, "left"))
    lo_fence = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi_fence = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (x >= lo_fence) & (x <= hi_fence)
    return (base.join(q, by).groupBy(by, "n", "q1", "median", "q3")
            .agg(F.min(F.when(inside, x)).alias("whisker_lo"), F.max(F.when(inside, x)).alias("whisker_hi"),
                 F.sum((~inside).cast("bigint")).alias("n_outliers"))
            .select(by, "n", "q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
                    "whisker_lo", "whisker_hi", "n_outliers"))


def ecdf(df: DataFrame, value: str, by: str) -> DataFrame:
    """Empirical CDF step points: (group, value, cum_prob = P(X <= value))."""
    counts = (df.where(F.col(by).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n")))
    upto = running_sums(counts, [F.col(value)], {"upto": F.col("n")}, (by,))
    totals = counts.groupBy(by).agg(F.sum("n").alias("total"))
    return upto.join(totals, by).select(by, value, (F.col("upto") / F.col("total")).alias("cum_prob"))


def _erfc(z: Column) -> Column:
    """Complementary error function (Chebyshev fit, fractional error < 1.2e-7)."""
    # --- fixed values: coefficients of the published erfc approximation ---
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
         0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t = 1.0 / (1.0 + 0.5 * F.abs(z))
    poly = F.lit(c[-1])
    for coef in reversed(c[:-1]):
        poly = F.lit(coef) + t * poly
    ans = t * F.exp(-z * z + poly)
    return F.when(z >= 0, ans).otherwise(2.0 - ans)


def mann_whitney(df: DataFrame, value: str, group: str, x_value, y_value) -> DataFrame:
    """Two-sided Mann-Whitney U of x vs y: average ranks over ties, tie-corrected
    normal approximation with continuity correction.

    Ranks are computed over the distinct values (pre-aggregated), not rows.
    """
    g = F.col(group)
    counts = (df.where(g.isin(x_value, y_value)).groupBy(value)
              .agg(F.sum((g == x_value).cast("bigint")).alias("nx"), F.sum((g == y_value).cast("bigint")).alias("ny")))
    t = F.col("nx") + F.col("ny")
    many = F.col("t").cast("double")  # a bigint's cube overflows from 2,097,152 ties on
    ranked = running_sums(counts, [F.col(value)], {"upto": t}).select(
        "nx", "ny", t.alias("t"), (F.col("upto") - t + (t + 1) / 2.0).alias("avg_rank"))
    s = ranked.agg(F.sum("nx").alias("n1"), F.sum("ny").alias("n2"),
                   F.sum(F.col("nx").cast("double") * F.col("avg_rank")).alias("r1"),
                   F.sum(many * many * many - many).alias("tie_term"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2.0
    mu = n1 * n2 / 2.0
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    big_u = F.greatest(u1, n1 * n2 - u1)
    z = (big_u - mu - 0.5) / sigma
    return s.select(F.col("n1").cast("bigint").alias("n1"), F.col("n2").cast("bigint").alias("n2"),
                    u1.alias("u_statistic"), z.alias("z"),
                    F.least(F.lit(1.0), _erfc(z / F.sqrt(F.lit(2.0)))).alias("p_value"))


def regex_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    t = F.col(text_col)
    return df.select("news_id",
                     F.regexp_count(t, F.lit("http")).cast("bigint").alias("n_http"),
                     F.regexp_count(t, F.lit(r"@\w+")).cast("bigint").alias("n_mentions"),
                     F.regexp_count(t, F.lit("[\\x{1F600}-\\x{1F64F}]")).cast("bigint").alias("n_emoji"))


def stopword_check(df: DataFrame, clean_col: str = "clean_text") -> DataFrame:
    left = F.size(F.filter(F.split(F.col(clean_col), " "), lambda w: is_stop_word(w)))
    per = df.select(left.alias("k"))
    return per.agg(F.count(F.lit(1)).alias("n_checked"),
                   F.sum((F.col("k") > 0).cast("bigint")).alias("n_with_stopwords"),
                   F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("n_stopwords"))


def text_length_stats(df: DataFrame) -> DataFrame:
    """Per-article raw/clean lengths and percentage reduction (null for empty text)."""
    tl = F.length(F.coalesce(F.col("text"), F.lit("")))
    cl = F.length(F.col("clean_text"))
    return df.select("news_id", tl.cast("bigint").alias("text_length"), cl.cast("bigint").alias("clean_length"),
                     F.when(tl > 0, (tl - cl) * 100.0 / tl).alias("reduction_pct"))


def top_k(df: DataFrame, score: str, k: int, id_col: str, keep: list[str] | None = None,
          by: str | None = None) -> DataFrame:
    """Top-k rows by score (desc, id asc tie-break) with a 1-based rank, of each ``by`` if given."""
    if by:
        each = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(id_col).asc())
        return (df.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k)
                .select(F.col("rank").cast("bigint").alias("rank"), by, id_col, *(keep or []), score))
    ordered = df.orderBy(F.col(score).desc(), F.col(id_col).asc()).limit(k)
    w = Window.orderBy(F.col(score).desc(), F.col(id_col).asc())
    return ordered.select(F.row_number().over(w).cast("bigint").alias("rank"), id_col, *(keep or []), score)


def density(hist: DataFrame, by: str) -> DataFrame:
    """A histogram with ``density``: shares of the group's rows by bin width (bounded by groups x bins rows)."""
    total = F.sum("count").over(Window.partitionBy(by))
    return hist.withColumn("density", F.col("count") / (total * (F.col("bin_hi") - F.col("bin_lo"))))


def quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """One row: the exact, interpolated quantile; null without a value."""
    one = df.sparkSession.range(1).select()
    return one.join(F.broadcast(quantiles(df, value, {"quantile": q})), F.lit(True), "left")  # a row at most


def share_within(df: DataFrame, group: str, col: str) -> DataFrame:
    """(group, col, n, pct): rows of each value and their share of the group in percent."""
    n = df.groupBy(group, col).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(group)))
