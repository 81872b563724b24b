"""What a scored provider is given and what its answers count for: trusted texts, bound calibrations, shadow runs, spending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators.decisions import SKIP, USE
from evigrid.plans.registry import query
from evigrid.sources.tables import table


def banded(p: Column, answered: Column) -> Column:
    """No answer: unavailable. An answer without a calibration bound to it is a shadow: the candidate is preserved. Else by bands."""
    return F.when(~answered, "unavailable").when(p.isNull(), "preserve").when(p >= USE, "use").when(p < SKIP, "skip").otherwise("preserve")


@query(f"""WITH c AS (SELECT source, lang, avg(quality) AS p FROM labels JOIN documents USING (doc_id) GROUP BY ALL HAVING count(*) >= 3), l AS (SELECT DISTINCT doc_id, true AS answered FROM labels)
SELECT d.doc_id, CASE WHEN answered IS NULL THEN 'unavailable' WHEN p IS NULL THEN 'preserve' WHEN p >= {USE} THEN 'use' WHEN p < {SKIP} THEN 'skip' ELSE 'preserve' END AS decision
FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN c ON c.source = d.source AND c.lang = d.lang""")
def provider_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that was asked, with its decision: answers are joined to what was asked, calibrations to both by the keys that bind them (source and language, with three records at least)."""
    asked, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), table(spark, sf_dir, "labels")
    bound = labels.join(asked, "doc_id").groupBy("source", "lang").agg(F.avg("quality").alias("p"), F.count("*").alias("n")).where("n >= 3").drop("n")
    answers = labels.select("doc_id").distinct().withColumn("answered", F.lit(True))
    rows = asked.join(answers, "doc_id", "left").join(bound, ["source", "lang"], "left")
    return rows.select("doc_id", banded(F.col("p"), F.coalesce("answered", F.lit(False))).alias("decision"))


@query("""WITH e AS (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT r.user_id AS request_id, r.k AS artifact_id, sha256(text) AS text FROM (SELECT DISTINCT user_id, k FROM e WHERE event_type = 'purchase') r
JOIN (SELECT DISTINCT user_id, k FROM e WHERE event_type <> 'purchase') f ON f.user_id = r.user_id AND f.k = r.k JOIN documents d ON d.doc_id = r.k WHERE lang IN ('en', 'fr')""")
def trusted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what whole_trusted_texts hands over."""
    return whole_trusted_texts(spark, sf_dir).withColumn("text", F.sha2(F.col("text").cast("binary"), 256))


@query("""WITH e AS (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT r.user_id AS request_id, r.k AS artifact_id, text FROM (SELECT DISTINCT user_id, k FROM e WHERE event_type = 'purchase') r
JOIN (SELECT DISTINCT user_id, k FROM e WHERE event_type <> 'purchase') f ON f.user_id = r.user_id AND f.k = r.k JOIN documents d ON d.doc_id = r.k WHERE lang IN ('en', 'fr')""")
def whole_trusted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that a request sends (purchases) become texts, whole, only if the request fetched them itself and its caller may read them."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), k.alias("artifact_id"), "event_type")
    sent, fetched = (e.where(c).select("request_id", "artifact_id") for c in ("event_type = 'purchase'", "event_type <> 'purchase'"))
    may = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr")).select(F.col("doc_id").alias("artifact_id"), "text")
    return sent.distinct().join(fetched, ["request_id", "artifact_id"], "left_semi").join(may, "artifact_id").select("request_id", "artifact_id", "text")


@query("SELECT source, count(*) AS records, count(*) FILTER (quality = 1) AS positives, sum(n_chars)::BIGINT AS usage, count(DISTINCT lang) = 1 AS one_model FROM labels JOIN documents USING (doc_id) GROUP BY source")
def fit_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shadow run's records for a fit: labels, usage, and whether a single model (stand-in: language) answered."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("records"), F.count_if(F.col("quality") == 1).alias("positives"), F.sum("n_chars").alias("usage"), (F.countDistinct("lang") == 1).alias("one_model"))
