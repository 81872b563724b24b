from pyspark.sql import functions as F

from evigrid.functions import numeric, text


def test_words_and_stems(spark):
    row = spark.createDataFrame([("maxRetries MAX_RETRIES organization flies cherries is",)], "t string").select(text.words(F.col("t")).alias("w"), F.transform(text.words(F.col("t")), text.stem).alias("s")).first()
    assert row["w"] == ["max", "retries", "max", "retries", "organization", "flies", "cherries", "is"]
    assert row["s"] == ["max", "retry", "max", "retry", "organ", "fli", "cherry", "is"]


def test_null_text(spark):
    assert spark.createDataFrame([(None,)], "t string").select(text.content_terms(F.col("t")).alias("c")).first()["c"] == []


def test_wilson(spark):
    low, high = numeric.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(0, 0), (5, 10)], "k int, n int").select(low.alias("l"), high.alias("h")).collect()
    assert got[0]["l"] is None and 0.23 < got[1]["l"] < 0.24 and 0.76 < got[1]["h"] < 0.77
