"""Driver-level entry points mirroring the reference's command-line steps.

Each function computes its tables lazily from the inputs and writes them to
``out`` (parquet; one folder per table).  They are thin orchestration over the
operators: the work runs on Spark.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import cascades as C
from ..operators import communities as CM
from ..operators import graph as G
from ..operators import links as L
from ..operators import metrics as M
from ..operators import similarity as S
from ..sources.files import write_graph, write_table


def prepare(spark: SparkSession, news: DataFrame, out: str, max_features: int = 20000) -> None:
    """Clean text and build TF-IDF vectors (reference phase 2)."""
    clean = M.with_clean_text(news)
    write_table(clean, f"{out}/news_clean")
    vec, vocab = S.tfidf(clean, max_features)
    write_table(vec, f"{out}/tfidf_vectors")
    write_table(vocab, f"{out}/tfidf_vocabulary")


def graphs(spark: SparkSession, news_clean: DataFrame, raw: DataFrame, tweets: DataFrame,
           interactions: DataFrame, out: str, k: int = 10, threshold: float = 0.25,
           max_features: int = 20000) -> None:
    """Article metrics, bipartite, similarity, interaction and cascade graphs (phase 3)."""
    metrics = M.article_metrics(news_clean, raw)
    write_table(metrics.drop("tweet_list"), f"{out}/article_metrics")
    write_graph(*G.bipartite_graph(metrics, raw), f"{out}/bipartite")
    vec, _ = S.tfidf(news_clean, max_features)
    sim = S.undirected(S.knn(S.sparse_rows(vec), max_features, k, threshold))
    write_graph(news_clean.select("news_id", "label", "source"), sim, f"{out}/similarity")
    edges = G.interaction_edges(interactions)
    write_graph(G.interaction_nodes(tweets, edges), edges, f"{out}/interaction")
    write_table(C.cascade_edges(tweets, interactions), f"{out}/cascade_edges")


def profile(spark: SparkSession, news: DataFrame, raw: DataFrame, out: str, bins: int = 50, top_k: int = 20) -> None:
    """Tables that describe the articles: text cleaning, tweet counts by label, duplicates and missing values.

    The article metrics are written first, and every other table reads that one.
    """
    write_table(M.article_metrics(M.with_clean_text(news), raw), f"{out}/article_metrics")
    m = spark.read.parquet(f"{out}/article_metrics")
    counts = {"tweet_count_describe": M.describe(m, "tweet_count"), "tweet_count_by_label": M.describe(m, "tweet_count", by=["label"]),
              "tweet_histogram": M.histogram(m, "tweet_count", "label", bins), "tweet_box": M.box_stats(m, "tweet_count", "label"),
              "tweet_ecdf": M.ecdf(m, "tweet_count", "label"), "mann_whitney": M.mann_whitney(m, "tweet_count", "label", 0, 1),
              "tweet_count_p95": M.quantile(m, "tweet_count", 0.95), "top_articles": M.top_k(m, "tweet_count", top_k, "news_id", ["label", "source"])}
    texts = {"text_lengths": M.text_length_stats(m), "text_patterns": M.regex_counts(m), "stop_words": M.stopword_check(m),
             "label_distribution": M.value_distribution(m, "label"), "source_distribution": M.value_distribution(m, "source"),
             "missing_values": M.missing_values(news), "duplicate_ids": M.duplicate_count(news, ["news_id"]),
             "duplicate_texts": M.duplicate_count(m, ["clean_text"])}
    for name, table in {**counts, **texts}.items():
        write_table(table, f"{out}/{name}")


def validate(spark: SparkSession, news: DataFrame, raw: DataFrame, sim_nodes: DataFrame, sim_edges: DataFrame, out: str) -> DataFrame:
    """The validation report and samples of repeated tweets, written; returns the report as read back."""
    metrics = M.article_metrics(news, raw)
    bip_nodes, bip_edges = G.bipartite_graph(metrics, raw)
    write_table(G.validation_report(news, metrics, raw, bip_nodes, bip_edges, sim_nodes, sim_edges), f"{out}/validation_report")
    write_table(G.tweet_dupe_samples(raw), f"{out}/tweet_dupe_samples")
    return spark.read.parquet(f"{out}/validation_report")


def links(spark: SparkSession, nodes: DataFrame, edges: DataFrame, out: str, damping: float = 0.85,
          top_k: int = 50) -> None:
    """PageRank + HITS and rankings; ``nodes``/``edges`` carry a ``graph`` key."""
    pr = L.pagerank(spark, nodes, edges, damping)
    hi = L.hits(spark, nodes, edges)
    scores = pr.join(hi, ["graph", "node_id"], "left")
    write_table(scores, f"{out}/link_scores")
    for col in ("pagerank", "authority", "hub"):
        write_table(M.top_k(scores, col, top_k, "node_id", by="graph"), f"{out}/top_{col}")


def communities(spark: SparkSession, nodes: DataFrame, edges: DataFrame, out: str,
                resolution: float = 1.0, seed: int = 42) -> None:
    und = CM.undirected(edges)
    part = CM.louvain(spark, nodes, und, resolution)
    write_table(part, f"{out}/communities")
    write_table(CM.community_stats(nodes, und, part), f"{out}/community_statistics")
    write_table(CM.modularity(nodes, und, part, resolution), f"{out}/modularity")


def cascades(spark: SparkSession, articles: DataFrame, tweets: DataFrame, nodes: DataFrame,
             edges: DataFrame, out: str, p: float = 0.1, max_steps: int = 50, seed: int = 42,
             run_lt: bool = True) -> None:
    """ICM (and LT) over all articles, metrics and fake-vs-real comparisons (phase 4)."""
    seeds = C.diffusion_seeds(tweets, nodes)
    icm = C.cascade_metrics(C.icm_activation(spark, edges, seeds, p, max_steps, seed), articles)
    write_table(icm, f"{out}/cascade_metrics")
    write_table(C.compare_fake_real(icm), f"{out}/cascade_comparison_fake_vs_real")
    if run_lt:
        lt = C.cascade_metrics(C.lt_activation(spark, edges, nodes, seeds, max_steps=max_steps, seed=seed), articles)
        write_table(lt, f"{out}/cascade_metrics_lt")
        cmp = C.compare_models({"ICM": icm, "LT": lt})
        write_table(cmp, f"{out}/model_comparison")
        write_table(C.pivot_models(cmp), f"{out}/model_comparison_pivot")
