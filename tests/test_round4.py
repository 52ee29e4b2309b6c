"""Queries that have to scale with their tables: staged files, diffusion rounds, link rounds, document blocks."""
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spreadlens.plans import q_sources as QS


def put_tables(spark, root, n_docs, n_events, n_users):
    """documents, labels and events of a small data set."""
    kinds = ("signup", "click", "view", "purchase", "error")
    spark.createDataFrame([(i, f"text {i}", f"s{i % 3}") for i in range(n_docs)], "doc_id long, text string, source string") \
        .write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(0, n_docs, 2)], "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    at = datetime(2024, 1, 1)
    spark.createDataFrame([(i, at + timedelta(minutes=i), i * 7 % n_users, kinds[i % 5], f'{{"k": {i % 13 + 1}}}') for i in range(n_events)],
                          "event_id long, ts timestamp, user_id long, event_type string, props string").write.parquet(f"{root}/events.parquet")
    return str(root)


def test_tweet_json_files_do_not_grow_with_articles(spark, tmp_path):
    d = put_tables(spark, tmp_path, 400, 600, 37)
    path = QS.stage_tweet_json(spark, d)
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".json")]
    assert 0 < len(files) <= 8
    staged = spark.read.json(path)
    assert staged.count() == 600 and staged.select("article_id").distinct().count() > 100
    edges = QS.q_interaction_edges_json(spark, d)
    want = QS.G.interaction_edges(QS.A.interactions(spark, d))
    assert {(r["src"], r["dst"], r["n_interactions"]) for r in edges.collect()} == {
        (str(r["src"]), str(r["dst"]), r["n_interactions"]) for r in want.collect()}
    assert edges.agg(F.count(F.lit(1))).first()[0] > 20


def test_icm_state_is_a_row_for_each_node_and_chunk(spark, monkeypatch):
    """Places in chunks instead of a row for each article and node; same reach as a plain search, null articles and hubs too."""
    from spreadlens.functions.hashing import md5_u32, mix_unit
    from spreadlens.operators import cascades as C
    monkeypatch.setattr(C, "CHUNK", 7)
    monkeypatch.setattr(C, "LIST", 3)
    monkeypatch.setattr(C, "COINS", 50)
    stored = {}
    real = C.written

    def written(df, name):
        out = real(df, name)
        stored.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(C, "written", written)
    pairs = [(i, (i * 7 + j * j) % 40) for i in range(40) for j in range(5)] + [(i, 0) for i in range(1, 40)] + [(0, i) for i in range(1, 40)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    seeds = spark.createDataFrame([(f"a{i}", i % 40) for i in range(60)] + [("a1", 5), ("a1", 5)], "article_id string, node_id long")
    coins = (seeds.select("article_id").distinct().crossJoin(edges.distinct())
             .withColumn("coin", mix_unit(md5_u32(F.lit(42), F.col("article_id")), md5_u32(F.lit(42), F.col("src"), F.col("dst")))))
    live = {}
    for r in coins.where("coin < 0.3").collect():
        live.setdefault((r["article_id"], r["src"]), set()).add(r["dst"])
    want = {(r["article_id"], r["node_id"]): 0 for r in seeds.collect()}
    now, step = set(want), 0
    while now:
        step += 1
        now = {(a, d) for a, n in now for d in live.get((a, n), ())} - set(want)
        want |= {k: step for k in now}
    got = C.icm_activation(spark, edges, seeds, p=0.3)
    rows = got.collect()
    assert len(rows) == len(want) and {(r["article_id"], r["node_id"]): r["step"] for r in rows} == want
    assert max(stored["frontier"]) < len(want) / 3
    none = C.icm_activation(spark, spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"),
                            spark.createDataFrame([(None, 1), ("b", 1)], "article_id string, node_id long"), p=1.0)
    assert sorted(map(str, map(tuple, none.collect()))) == sorted(map(str, [(None, 1, 0), (None, 2, 1), (None, 3, 2), ("b", 1, 0), ("b", 2, 1), ("b", 3, 2)]))
    assert sorted(map(tuple, C.icm_activation(spark, edges, seeds, p=1.0, max_steps=0).collect())) == sorted((a, n, 0) for a, n in {tuple(r) for r in seeds.collect()})


def test_tfidf_cleans_each_text_once(spark):
    """The vocabulary and the counts by document read one table of tokens."""
    from spreadlens.operators import similarity as S
    cleaned = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def clean(text):
        cleaned.add(1)
        return text.lower()
    news = spark.createDataFrame([(str(i), f"Word{i % 5} shared thing") for i in range(30)], "news_id string, text string")
    vec, vocab = S.tfidf(news.select("news_id", clean("text").alias("clean_text")), 50)
    assert vec.select("news_id").distinct().count() == 30
    assert {(r["term"], r["df"]) for r in vocab.collect()} >= {("shared", 30), ("shared thing", 30), ("word1", 6), ("word1 shared", 6)}
    assert cleaned.value == 30
