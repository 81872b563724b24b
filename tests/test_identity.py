import hashlib
import hmac

from pyspark.sql import functions as F

from evigrid.operators import identity


def test_signature_is_hmac(spark):
    key, texts = b"k" * 20, ["", "a", "é" * 100, '{"sub":1}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", identity.signature(F.col("t"), key).alias("s")).collect()
    assert {r["t"]: r["s"] for r in rows} == {t: hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts}


def test_verdicts(spark):
    claims = ['{"sub":1,"aud":"a","exp":9}', '{"sub":1,"aud":"b","exp":9}', '{"sub":1,"aud":"a","exp":1}']
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(claims)], "i int, c string").withColumn("token", identity.signed(F.col("c"), b"k"))
    got = rows.select("i", identity.verdict(F.col("token"), b"k", F.lit("a"), F.lit(5)).alias("own"), identity.verdict(F.col("token"), b"other", F.lit("a"), F.lit(5)).alias("other")).orderBy("i").collect()
    assert [r["own"] for r in got] == ["ok", "wrong_audience", "expired"] and {r["other"] for r in got} == {"bad_signature"}
