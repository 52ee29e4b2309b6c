"""The corpus pipeline stage by stage."""
import corpus_pipeline as cp

from spreadlens.llm import decontamination, simhash

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == COLUMNS and out.select("doc_id").distinct().count() == out.count()
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        if name == "quality":
            lab = docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
            good = lab.filter("quality = 1").select("doc_id")
            assert good.join(out, "doc_id", "left_anti").count() <= 0.01 * good.count()
            bad = lab.filter("quality = 0").select("doc_id")
            assert bad.join(out, "doc_id", "left_semi").count() <= 0.1 * bad.count()
        if name == "near_dedup":
            comp = simhash.near_duplicates(docs).select("component").distinct().count()
            assert out.count() == comp
            again = simhash.near_duplicates(out)
            assert again.select("component").distinct().count() == comp
        if name == "decontamination":
            assert decontamination.contained_items(out, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
            gone = docs.join(out, "doc_id", "left_anti").count()
            assert 0 < gone < 0.1 * docs.count()
        docs = out
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_near_dedup_with_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(2, text, "en", "a", 1), (1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, "en", "a", 1),
            (None, "quite another text without an id", "en", "a", 1), (3, None, None, None, None), (4, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, "quite another text without an id"), (1, text), (3, "")]


def test_line_dedup_of_short_lines(spark):
    text = "Title\n\none two three four five six seven\nThe end"
    rows = [(1, text, "en", "a", 1), (2, text, "en", "b", 1), (3, "title\nquite other words stand in this line\n\nthe END now", "en", "a", 1), (4, "\n \n", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in cp.drop_lines(spark, docs, SF).collect()}
    assert got == {1: text, 3: "quite other words stand in this line\n\nthe END now", 4: "\n \n"}


def test_near_copy_without_a_common_line(spark):
    """The same words in lines of another width: line_dedup finds nothing equal or near, near_dedup keeps one."""
    words = [f"w{i * 7919 % 1009}" for i in range(400)]
    wrapped = lambda width: "\n".join(" ".join(words[i:i + width]) for i in range(0, len(words), width))
    rows = [(1, wrapped(60), "en", "a", 1), (2, wrapped(97), "en", "a", 1), (3, "some other text of five words", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines = cp.drop_lines(spark, docs, SF)
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {r[0]: r[1] for r in rows}
    assert sorted(r["doc_id"] for r in cp.drop_near_duplicates(spark, lines, SF).collect()) == [1, 3]


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if out.columns == COLUMNS else docs


def test_run(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns
