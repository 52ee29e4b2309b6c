from pyspark.sql import functions as F

from spreadlens.functions.text import clean_text, parse_ids


def test_parse_ids_samples(spark):
    rows = [("111\t222 333",), (" 444,555|666 ",), ("",), (None,), ("nan",), ("None",), ("[]",), ("x-777 y",)]
    df = spark.createDataFrame(rows, "s string")
    got = [r[0] for r in df.select(parse_ids(F.col("s"))).collect()]
    assert got == [["111", "222", "333"], ["444", "555", "666"], [], [], [], [], [], ["x-777"]]


def test_clean_text_samples(spark):
    rows = [("The <b>Quick</b> fox: https://t.co/abc!",), ("www.a.com  Price 3,000",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    got = [r[0] for r in df.select(clean_text(F.col("s"))).collect()]
    assert got == ["quick fox", "price 3 000", ""]
